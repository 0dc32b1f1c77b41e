"""What the queries share: the tables as the operators want them, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import splits

SPACE = r"[\t-\r\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
DOCS = "docs AS (SELECT source || '::' || doc_id AS id, source, lang, doc_id, text FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter("text is not null and doc_id is not null")
    return t.select(F.concat_ws("::", "source", F.col("doc_id").cast("string")).alias("id"), "source", "lang", "doc_id", "text")


def sections(spark: SparkSession, d: str) -> DataFrame:
    """Anchor: the first line; context: the whole text."""
    title = F.struct(F.lit(0).alias("section_idx"), F.lit("anchor").alias("role"), F.trim(F.substring_index("text", "\n", 1)).alias("text"))
    body = F.struct(F.lit(1).alias("section_idx"), F.lit("context").alias("role"), F.col("text"))
    return docs(spark, d).select("id", "source", F.lit(0.5).alias("trust"), F.explode(F.array(title, body)).alias("s")).select("id", "source", "trust", "s.*")


def pool(spark: SparkSession, d: str) -> DataFrame:
    """Orders as dated records of the sources that their priorities are."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("source"), F.col("o_orderdate").cast("date").alias("date"))
    return splits.assign(o)


def h(*parts: str) -> str:
    """hash52 in SQL; parts are SQL expressions of strings."""
    return "('0x' || substr(md5(" + " || '|' || ".join(parts) + "), 1, 13))::BIGINT"


def u(*parts: str) -> str:
    return f"({h(*parts)} / 4503599627370496.0::DOUBLE)"


def label(id: str) -> str:
    x = u("'42'", "'split'", id)
    return f"CASE WHEN {x} < 0.8::DOUBLE THEN 'train' WHEN {x} < 0.9::DOUBLE THEN 'validation' ELSE 'test' END"


def toks(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{SPACE}'), lambda w: w <> '')"


SECTIONS = f"""{DOCS}, sections AS (
  SELECT id, source, 0.5::DOUBLE AS trust, 0 AS section_idx, 'anchor' AS role, trim(split_part(text, chr(10), 1)) AS text FROM docs
  UNION ALL SELECT id, source, 0.5::DOUBLE, 1, 'context', text FROM docs)"""


def chunk_ctes(base: str, keep: str, window: int, overlaps: tuple[int, ...], head: int) -> str:
    """CTE ``chunks`` of the windows of ``base``."""
    cut = "".join(
        f" UNION ALL SELECT {keep}, text, w, n, 'window', i, {o}, i * {max(1, window - o)}, least({window}, n - i * {max(1, window - o)})"
        f" FROM counted, unnest(range(0, ceil((n - {window}) / {max(1, window - o)}.0)::INT + 1)) AS r(i) WHERE n > {window}"
        for o in overlaps
    )
    summary = f" UNION ALL SELECT {keep}, text, w, n, 'summary', 0, 0, 0, {min(head, window)} FROM counted WHERE n > {window}" if head else ""
    return f"""tokened AS (SELECT *, {toks('text')} AS w FROM {base}),
counted AS (SELECT *, len(w) AS n FROM tokened WHERE len(w) > 0),
spans AS (SELECT {keep}, text, w, n, 'window' AS view, 0 AS window_index, 0 AS overlap, 0 AS start, n AS len FROM counted WHERE n <= {window}{cut}{summary}),
chunks AS (SELECT {keep}, view, window_index::INT AS window_index, overlap::INT AS overlap, least(n, {window})::INT AS span, len::INT AS n_tokens,
  CASE WHEN len = n THEN text ELSE array_to_string(w[start + 1:start + len], ' ') END AS text FROM spans)"""
