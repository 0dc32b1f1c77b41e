"""Canonical records and their sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentences

RECORD = (
    "id string, source string, created_at timestamp, updated_at timestamp, trust double, taxonomy array<string>,"
    " sections array<struct<role: string, heading: string, text: string, sentences: array<string>>>"
)
TRUST = 0.5


def section(role: str, text: Column, heading: Column | None = None) -> Column:
    return F.struct(F.lit(role).alias("role"), (heading if heading is not None else F.lit(None)).cast("string").alias("heading"), text.alias("text"), sentences(text).alias("sentences"))


def record(df: DataFrame, id: Column, source: Column, sections: Column, trust: Column | float = TRUST, taxonomy: Column | None = None, created: Column | None = None) -> DataFrame:
    """Records in the canonical schema from any frame's columns; ids must be unique over all sources."""
    at = (created if created is not None else F.timestamp_seconds(F.lit(0))).cast("timestamp")
    tax = taxonomy if taxonomy is not None else F.array(source)
    return df.select(id.alias("id"), source.alias("source"), at.alias("created_at"), at.alias("updated_at"), (trust if isinstance(trust, Column) else F.lit(trust)).cast("double").alias("trust"), tax.alias("taxonomy"), sections.alias("sections"))


def from_text(df: DataFrame, id: Column, source: Column, text: Column, role: str = "context") -> DataFrame:
    return record(df, id, source, F.array(section(role, text)))


def from_documents(documents: DataFrame, trust: Column | float = TRUST) -> DataFrame:
    """The documents table: the first line is the anchor, the whole text the context."""
    docs = documents.filter("text is not null and doc_id is not null")
    title = F.trim(F.substring_index("text", "\n", 1))
    id = F.concat_ws("::", "source", F.col("doc_id").cast("string"))
    tax = F.array(F.col("source"), F.concat(F.lit("lang="), F.col("lang")))
    return record(docs, id, F.col("source"), F.array(section("anchor", title), section("context", F.col("text"))), trust, tax)


def sections_of(records: DataFrame) -> DataFrame:
    """One row a section: id, source, trust, section_idx, role, text."""
    return records.select("id", "source", "trust", F.posexplode("sections").alias("section_idx", "s")).select("id", "source", "trust", "section_idx", F.col("s.role").alias("role"), F.col("s.text").alias("text"))


def source_of_id(id: Column) -> Column:
    return F.when(id.contains("::"), F.substring_index(id, "::", 1)).otherwise("unknown")
