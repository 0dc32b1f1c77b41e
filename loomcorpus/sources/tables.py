"""CSV files with a header: role columns (anchor, positive) or one text column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CONTEXT, TripletRecipe, row_recipes
from ..errors import ConfigurationError
from ..operators.records import record, section
from .base import DataSource


@dataclass(frozen=True)
class CsvSource(DataSource):
    """Records of a CSV file. Column names match whatever their case, cells are trimmed, rows with an
    empty required cell are skipped (their number stays unused), a row of another width is an error.
    Ids are ``{name}::row_{n}`` by the row's place in the file, so one file is read in order."""

    name: str
    path: str
    anchor: str | None = None
    positive: str | None = None
    text: str | None = None
    trust: float = 0.85

    def __post_init__(self) -> None:
        if self.text and (self.anchor or self.positive):
            raise ConfigurationError("role columns and a text column exclude each other")
        if not (self.text or self.anchor):
            raise ConfigurationError("an anchor or a text column is needed")

    def frame(self, spark: SparkSession) -> DataFrame:
        read = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST")
        return read.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(self.path)

    def records(self, spark: SparkSession) -> DataFrame:
        df = self.frame(spark)
        names = {c.strip().lower(): c for c in df.columns}
        wanted = [c for c in (self.anchor, self.positive, self.text) if c]
        missing = [c for c in wanted if c.strip().lower() not in names]
        if missing:
            raise ConfigurationError(f"no such column in {self.path}: {', '.join(missing)}")
        # a multi-line CSV file is one task, so these ids count its rows from 0; several files go by name
        numbered = df.withColumn("_n", F.monotonically_increasing_id() + 1)
        cell = lambda c: F.trim(F.coalesce(F.col(f"`{names[c.strip().lower()]}`"), F.lit("")))
        for c in wanted:
            numbered = numbered.filter(cell(c) != F.lit(""))
        if self.text:
            sections = F.array(section("context", cell(self.text)))
        else:
            parts = [section("anchor", cell(self.anchor))] + ([section("context", cell(self.positive))] if self.positive else [])
            sections = F.array(*parts)
        return record(numbered, F.concat(F.lit(f"{self.name}::row_"), F.col("_n").cast("string")), F.lit(self.name), sections, self.trust, F.array(F.lit(self.name)))

    def recipes(self) -> tuple[TripletRecipe, ...]:
        if self.text:
            return (TripletRecipe("csv_simcse", CONTEXT, CONTEXT, CONTEXT, allow_same_anchor_positive=True),)
        return row_recipes(True)
