"""What a source is: records as a DataFrame, read whole or page by page from a cursor."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TripletRecipe
from ..errors import ConfigurationError
from ..functions.hashing import hash52
from ..operators.splits import hash_ranked


@dataclass(frozen=True)
class Cursor:
    """Where the next page begins, and the newest change seen so far."""

    revision: int = 0
    last_seen: datetime | None = None


@dataclass(frozen=True)
class Page:
    records: DataFrame
    cursor: Cursor


class DataSource:
    """Base of all sources: ``name`` and ``records(spark)`` are needed, the rest follows."""

    name: str

    def records(self, spark: SparkSession) -> DataFrame:
        raise ConfigurationError(f"{type(self).__name__} has no records")

    def count(self, spark: SparkSession) -> int:
        return self.records(spark).count()

    def recipes(self) -> tuple[TripletRecipe, ...]:
        return ()

    def refresh(self, spark: SparkSession, cursor: Cursor | None = None, limit: int | None = None, seed: int = 42) -> Page:
        """At most ``limit`` records from the cursor on, in an order hashed from the source, its size and
        the seed; it begins again after the last, and where a cursor is beyond it."""
        df = self.records(spark)
        n = df.count()
        if not n:
            return Page(df.limit(0), Cursor(0, cursor.last_seen if cursor else None))
        if limit is None or limit >= n:
            return Page(df, Cursor(_start(cursor, n), _newest(df, cursor)))
        start = _start(cursor, n)
        placed = hash_ranked(df, (), page_key(self.name, n, seed, F.col("id")), "id")
        page = placed.filter(F.pmod(F.col("pos") - start, F.lit(n)) < limit).drop("pos")
        return Page(page, Cursor((start + limit) % n, _newest(page, cursor)))


def page_key(source: str, total: int, seed: int, id):  # noqa: ANN001, ANN201
    return hash52(seed, "page", source, total, id)


def _start(cursor: Cursor | None, n: int) -> int:
    return cursor.revision if cursor and cursor.revision < n else 0


def _newest(page: DataFrame, cursor: Cursor | None) -> datetime | None:
    seen = page.agg(F.max("updated_at")).first()[0] if "updated_at" in page.columns else None
    return max((x for x in (seen, cursor.last_seen if cursor else None) if x), default=None)


class IndexableSource:
    """A corpus addressed by index: ``rows(spark)`` are records with ``row_idx``, from 0 to ``len_hint`` - 1;
    an index without a row is a hole."""

    name: str

    def len_hint(self, spark: SparkSession) -> int | None:
        return None

    def rows(self, spark: SparkSession) -> DataFrame:
        raise ConfigurationError(f"{type(self).__name__} has no rows")


@dataclass(frozen=True)
class IndexableAdapter(DataSource):
    """An indexable corpus as a source: pages go by a permutation of all indexes, holes are skipped and
    the page filled up behind them."""

    inner: IndexableSource

    @property
    def name(self) -> str:
        return self.inner.name

    def records(self, spark: SparkSession) -> DataFrame:
        return self.inner.rows(spark)

    def count(self, spark: SparkSession) -> int:
        n = self.inner.len_hint(spark)
        if n is None:
            raise ConfigurationError(f"{self.name} doesn't know its length")
        return n

    def refresh(self, spark: SparkSession, cursor: Cursor | None = None, limit: int | None = None, seed: int = 42) -> Page:
        total, rows = self.count(spark), self.inner.rows(spark)
        if not total:
            return Page(rows.limit(0), Cursor())
        start, limit = _start(cursor, total), total if limit is None else limit
        index = spark.range(total).withColumnRenamed("id", "row_idx")
        placed = hash_ranked(index, (), page_key(self.name, total, seed, F.col("row_idx")), "row_idx")
        cyclic = rows.join(placed, "row_idx").withColumn("_after", F.pmod(F.col("pos") - start, F.lit(total)))
        page = cyclic.orderBy("_after").limit(limit).drop("pos")
        last, newest = page.agg(F.max("_after"), F.max("updated_at")).first()
        upto = total if page.count() < limit or last is None else last + 1
        return Page(page.drop("_after"), Cursor((start + upto) % total, newest))


@dataclass(frozen=True)
class TableSource(DataSource):
    """Records that are a DataFrame already."""

    name: str
    table: DataFrame

    def records(self, spark: SparkSession) -> DataFrame:
        return self.table
