"""Records handed over by the program."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators.mixing import sequential_page
from ..operators.records import RECORD
from .base import Cursor, DataSource, Page


@dataclass
class InMemorySource(DataSource):
    name: str
    rows: list[dict] = field(default_factory=list)

    def add(self, *rows: dict) -> InMemorySource:
        self.rows.extend(rows)
        return self

    def count(self, spark: SparkSession | None = None) -> int:
        return len(self.rows)

    def refresh(self, spark: SparkSession, cursor: Cursor | None = None, limit: int | None = None, seed: int = 42) -> Page:
        """Records in the order added, from the cursor on and around."""
        n = len(self.rows)
        start = cursor.revision if cursor and cursor.revision < n else 0
        take = n if limit is None else min(limit, n)
        return Page(self.page(spark, start, take), Cursor((start + take) % n if n else 0, cursor.last_seen if cursor else None))

    def records(self, spark: SparkSession) -> DataFrame:
        """Every row as a record of this source, in the order added (row_idx)."""
        full = [{**r, "source": self.name, "row_idx": i} for i, r in enumerate(self.rows)]
        return spark.createDataFrame(full, f"{RECORD}, row_idx long")

    def page(self, spark: SparkSession, start: int, limit: int) -> DataFrame:
        return sequential_page(self.records(spark), start % max(1, len(self.rows)), limit)
