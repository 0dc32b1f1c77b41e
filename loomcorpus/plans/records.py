"""Records, their sections, metadata and search texts; totals of splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import ChunkingStrategy
from ..functions import metadata
from ..functions import text as T
from ..operators import chunking, metrics, records, sampling, selection, splits
from .common import DOCS, docs, label, table, toks
from .text import _SENTENCES

PREPROCESSED = ChunkingStrategy(window=64, overlaps=(8,), fallback_tokens=0, preprocessors=(lambda c: F.regexp_replace(c, "[0-9]+", "#"), lambda c: F.when(T.token_count(c) >= 20, c)))


def _records(spark, d):
    return records.from_documents(table(spark, d, "documents"))


def record_sections(spark, d):
    s = _records(spark, d).select("id", "trust", F.posexplode("sections").alias("section_idx", "s"))
    return s.select("id", "section_idx", "trust", "s.role", F.length("s.text").alias("n_chars"), F.size("s.sentences").cast("long").alias("n_sentences"))


def record_taxonomy(spark, d):
    tax = F.col("taxonomy")
    return _records(spark, d).select("id", tax[0].alias("first"), metadata.taxonomy_value(tax, "lang").alias("lang"), metadata.taxonomy_value(tax, "date").alias("date"), records.source_of_id(F.col("id")).alias("of_id"), metadata.encode("id", F.col("id")).alias("entry"))


def record_search_text(spark, d):
    return selection.record_text(_records(spark, d), 48)


def preprocessed_chunks(spark, d):
    out = chunking.windows(docs(spark, d).select("id", "text"), PREPROCESSED)
    return out.select("id", "window_index", "n_tokens", "text")


def split_totals(spark, d):
    """How many of a source's records each split gets by the ratios alone."""
    n = docs(spark, d).groupBy("source").agg(F.count("*").alias("n"))
    train, validation, test = metrics.split_counts(F.col("n"), 0.8, 0.1)
    return n.select("source", "n", train.alias("train"), validation.alias("validation"), test.alias("test"))


def split_overrides(spark, d):
    """Labels by hash, but for documents that are labelled toxic: they are for tests."""
    some = table(spark, d, "labels").filter("toxic = 1").join(docs(spark, d), "doc_id").select("id", F.lit("test").alias("split"))
    return splits.assign(docs(spark, d).select("id"), overrides=some)


def meta_policy(spark, d):
    policy = metadata.MetaPolicy({"lang": F.array("lang"), "length": F.array(F.length("text").cast("string"))})
    return docs(spark, d).select("id", F.array_join(policy.instantiate().all_metadata(), "|").alias("entries"))


def chunk_keys(spark, d):
    out = chunking.windows(docs(spark, d).select("id", "text"), ChunkingStrategy(window=128, overlaps=(16,), fallback_tokens=96))
    return out.select(sampling.chunk_key(F.col("id"), F.lit(1), F.col("view"), F.col("window_index")).alias("key"), "n_tokens")


_TITLE = "trim(split_part(text, chr(10), 1))"
_ID = "source || '::' || doc_id"
_WORDS = toks("regexp_replace(text, '[0-9]+', '#', 'g')")

QUERIES = {
    "record_sections": (
        record_sections,
        f"""WITH {DOCS}, titles AS (SELECT doc_id, {_TITLE} AS text FROM docs), s AS ({_SENTENCES}), t AS ({_SENTENCES.replace('FROM documents WHERE', 'FROM titles WHERE')})
SELECT id, i::INT AS section_idx, 0.5::DOUBLE AS trust, CASE i WHEN 0 THEN 'anchor' ELSE 'context' END AS role, length(CASE i WHEN 0 THEN {_TITLE} ELSE text END)::INT AS n_chars,
  CASE i WHEN 0 THEN len(t.sentences) ELSE len(s.sentences) END AS n_sentences FROM docs JOIN s USING (doc_id) JOIN t USING (doc_id), range(2) r(i)""",
    ),
    "record_taxonomy": (record_taxonomy, f"WITH {DOCS} SELECT id, source AS first, lang, NULL::VARCHAR AS date, source AS of_id, 'id=' || id AS entry FROM docs"),
    "record_search_text": (
        record_search_text,
        f"""WITH {DOCS}, l AS (SELECT source, id, array_to_string(list_filter([{_TITLE}, text], lambda x: len({toks('x')}) > 0), chr(10)) AS body FROM docs), w AS (SELECT *, {toks('body')} AS w FROM l)
SELECT source, id, CASE WHEN len(w) = 0 THEN id WHEN len(w) <= 48 THEN body ELSE array_to_string(w[1:48], ' ') END AS text FROM w""",
    ),
    "preprocessed_chunks": (
        preprocessed_chunks,
        f"""WITH {DOCS}, t AS (SELECT id, regexp_replace(text, '[0-9]+', '#', 'g') AS text, {_WORDS} AS w FROM docs), c AS (SELECT *, len(w) AS n FROM t WHERE len(w) >= 20),
s AS (SELECT id, text, w, n, 0 AS i, 0 AS start, n AS len FROM c WHERE n <= 64 UNION ALL SELECT id, text, w, n, i, i * 56, least(64, n - i * 56) FROM c, unnest(range(0, ceil((n - 64) / 56.0)::INT + 1)) r(i) WHERE n > 64)
SELECT id, i::INT AS window_index, len::INT AS n_tokens, CASE WHEN len = n THEN text ELSE array_to_string(w[start + 1:start + len], ' ') END AS text FROM s""",
    ),
    "split_totals": (split_totals, f"WITH {DOCS}, c AS (SELECT source, count(*) AS n FROM docs GROUP BY 1) SELECT source, n, floor(n * 0.8::DOUBLE)::BIGINT AS train, floor(n * 0.1::DOUBLE)::BIGINT AS validation, (n - floor(n * 0.8::DOUBLE) - floor(n * 0.1::DOUBLE))::BIGINT AS test FROM c"),
    "split_overrides": (split_overrides, f"WITH {DOCS} SELECT id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'test' ELSE {label('id')} END AS split FROM docs"),
    "meta_policy": (meta_policy, f"WITH {DOCS} SELECT id, array_to_string(list_sort(['lang=' || lang, 'length=' || length(text)]), '|') AS entries FROM docs"),
    "chunk_keys": (
        chunk_keys,
        f"""WITH {DOCS}, t AS (SELECT id, len({toks('text')}) AS n FROM docs), s AS (SELECT id, 'w|0' AS v, n AS len FROM t WHERE n BETWEEN 1 AND 128
UNION ALL SELECT id, 'w|' || i, least(128, n - i * 112) FROM t, unnest(range(0, ceil((n - 128) / 112.0)::INT + 1)) r(i) WHERE n > 128 UNION ALL SELECT id, 's|head', 96 FROM t WHERE n > 128)
SELECT id || '|1|' || v AS key, len::INT AS n_tokens FROM s""",
    ),
}
