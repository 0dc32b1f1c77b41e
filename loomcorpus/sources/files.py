"""Trees of .txt files: the name is the title, the content the body, the folders the taxonomy."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TripletRecipe, title_context_recipes
from ..functions.text import is_blank, is_text_file, slug_title
from ..operators.mixing import group_cap
from ..operators.records import record, section
from .base import DataSource


def default_sections(title: Column, body: Column) -> Column:
    return F.array(section("anchor", title), section("context", body))


def default_taxonomy(source: Column, folders: Column) -> Column:
    return F.concat(F.array(source), folders)


@dataclass(frozen=True)
class FileSource(DataSource):
    """Records of all .txt files under a root, one file a record, read by the executors. ``category_trust``
    maps folder names (any case) to trust; ``taxonomy`` and ``sections`` are Column functions."""

    name: str
    root: str
    trust: float = 0.85
    category_trust: dict[str, float] = field(default_factory=dict)
    taxonomy: Callable[[Column, Column], Column] = default_taxonomy
    sections: Callable[[Column, Column], Column] = default_sections
    date_aware: bool = False

    def files(self, spark: SparkSession) -> DataFrame:
        """relpath, folders, title, body, modified of every text file; unreadable ones are skipped."""
        read = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("ignoreCorruptFiles", True)
        df = read.text(self.root).select(F.col("value").alias("body"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"))
        root = "/" + self.root.split("://", 1)[-1].split(":", 1)[-1].strip("/") + "/"
        rel = F.element_at(F.split(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), F.concat(F.lit("\\Q"), F.lit(root), F.lit("\\E")), 2), -1)
        df = df.withColumn("relpath", rel).filter(is_text_file(F.col("relpath")))
        parts = F.split("relpath", "/", -1)
        stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
        return df.select("relpath", F.slice(parts, 1, F.size(parts) - 1).alias("folders"), slug_title(stem).alias("title"), "body", "modified")

    def records(self, spark: SparkSession) -> DataFrame:
        df = self.files(spark).filter(~is_blank(F.col("body")))
        trust: Column = F.lit(self.trust)
        for name, t in reversed(list(self.category_trust.items())):
            trust = F.when(F.array_contains(F.transform("folders", F.lower), name.lower()), F.lit(t)).otherwise(trust)
        id = F.concat(F.lit(f"{self.name}::"), F.col("relpath"))
        return record(df, id, F.lit(self.name), self.sections(F.col("title"), F.col("body")), trust, self.taxonomy(F.lit(self.name), F.col("folders")), F.col("modified"))

    def capped(self, spark: SparkSession, limit: int) -> DataFrame:
        """Files by folder, none with more than its fair share of the limit."""
        df = self.files(spark).withColumn("folder", F.array_join("folders", "/"))
        return group_cap(df, "folder", limit, ("relpath",))

    def count(self, spark: SparkSession) -> int:
        return self.files(spark).count()

    def recipes(self) -> tuple[TripletRecipe, ...]:
        return title_context_recipes(self.date_aware)
