"""The corpus pipeline: stages of training-data operators applied to the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcorpus.llm import near_dedup, packing, quality, secrets, suffix_dedup
from loomcorpus.llm.common import Shared, documents

#: SQL cannot express near-dedup, token efficiency or bin packing; tests hold every stage against
#: brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that lose too much text go; the others keep their good lines.

    Null, empty and blank texts have no line to keep and go; a null doc_id, lang or source stays as it
    is. Repeated rows are judged alike, a document that loses just the allowed share stays; texts are
    read whole, however long; extra columns go; an empty table gives an empty result."""
    kept = quality.clean_lines(docs, carry=("lang", "source")).filter("keep")
    return kept.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id.

    Null, empty and blank texts and rows with a null doc_id all stay; of repeated rows of one doc_id one
    stays, with the smallest text; texts are read whole, however long; extra columns go; an empty table
    gives an empty result."""
    return near_dedup.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document or place has too are cut out; all documents stay.

    Null, empty and short texts and rows with a null doc_id stay as they are; repeated rows of one doc_id
    and text are no earlier places of each other; texts are read whole, however long; extra columns
    go; an empty table gives an empty result."""
    return suffix_dedup.drop_repeats(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; all documents stay.

    Null and empty texts and a null doc_id stay as they are; repeated rows are masked alike, every place of
    a secret is masked; texts are read whole, however long; extra columns go; an empty table gives an
    empty result."""
    return secrets.mask_secrets(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of what is left gets its place in a training sequence: bin_id, bin_offset, doc_id, piece,
    start, n_tokens.

    Null and empty texts have no token and no place; rows with a null doc_id are placed; repeated rows and
    ties of length are placed one by one; longer texts than a sequence are cut; extra columns are
    ignored; an empty table gives an empty result."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = Shared(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = shared.table(stage(spark, docs, sf_dir), f"stage{i}")
        if i:
            shared.drop(f"stage{i - 1}")
    return docs
