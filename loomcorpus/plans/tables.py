"""Skew, capacity and similarity reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import weights
from ..operators import metrics, splits
from .common import DOCS, docs, label, table
from .text import SIMILARITY


def source_skew(spark, d):
    skew = metrics.source_skew(docs(spark, d))
    return skew.select("source", "n", F.round("share", 9).alias("share"), "total", "least", "most", F.round("mean", 9).alias("mean"), F.round("ratio", 9).alias("ratio"))


def order_skew(spark, d):
    skew = metrics.source_skew(table(spark, d, "lineitem").withColumn("source", F.col("l_returnflag")))
    return skew.select("source", "n", F.round("share", 9).alias("share"))


def balance_weights(spark, d):
    b = metrics.balance(docs(spark, d))
    return b.select("source", "n", *[F.round(c, 9).alias(c) for c in ("balancing", "boost", "replay")])


def capacity_report(spark, d):
    c = metrics.capacity(splits.assign(docs(spark, d).select("id", "source")), 2, 6)
    return c.select("source", "split", "n", *[F.col(x).cast("string").alias(x) for x in ("triplets", "effective", "pairs", "texts")])


def similarity_summary(spark, d):
    title = F.trim(F.substring_index("text", "\n", 1))
    s = docs(spark, d).select("source", weights.byte_similarity(title, F.col("text")).alias("s")).select("source", "s.*")
    out = metrics.similarity_summary(s)
    return out.select("source", *[F.round(c, 9).alias(c) for c in out.columns if c != "source"])


_N = f"{DOCS}, c AS (SELECT source, count(*) AS n FROM docs GROUP BY 1)"
QUERIES = {
    "source_skew": (source_skew, f"WITH {_N} SELECT source, n, round(n / sum(n) OVER (), 9) AS share, (sum(n) OVER ())::BIGINT AS total, min(n) OVER () AS least, max(n) OVER () AS most, round(avg(n) OVER (), 9) AS mean, round((max(n) OVER ())::DOUBLE / min(n) OVER (), 9) AS ratio FROM c"),
    "order_skew": (order_skew, "WITH c AS (SELECT l_returnflag AS source, count(*) AS n FROM lineitem GROUP BY 1) SELECT source, n, round(n / sum(n) OVER (), 9) AS share FROM c"),
    "balance_weights": (balance_weights, f"WITH {_N} SELECT source, n, round(n::DOUBLE / max(n) OVER (), 9) AS balancing, round((min(n) OVER ())::DOUBLE / n, 9) AS boost, round((max(n) OVER ())::DOUBLE / n, 9) AS replay FROM c"),
    "capacity_report": (
        capacity_report,
        f"""WITH {DOCS}, c AS (SELECT source, {label('id')} AS split, count(*)::HUGEINT AS n FROM docs GROUP BY ALL)
SELECT source, split, sum(n)::BIGINT AS n, sum(n * (n - 1) * 2)::VARCHAR AS triplets, sum(n * 8)::VARCHAR AS effective, sum(n * n * 2)::VARCHAR AS pairs, sum(n * 6)::VARCHAR AS texts FROM c GROUP BY CUBE (source, split)""",
    ),
    "similarity_summary": (
        similarity_summary,
        f"""WITH {SIMILARITY} SELECT source, round(avg(jaccard), 9) AS mean_jaccard, round(median(jaccard), 9) AS median_jaccard, round(avg(cosine), 9) AS mean_cosine, round(median(cosine), 9) AS median_cosine FROM sims GROUP BY source""",
    ),
}
