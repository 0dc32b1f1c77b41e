"""Text functions and row mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, denoise, metadata, weights
from ..functions import text as T
from ..sources.rows import RowSource, decode_lines
from .common import DOCS, SPACE, docs, h, table, toks, u


def token_counts(spark, d):
    return docs(spark, d).select("doc_id", T.token_count(F.col("text")).alias("n_tokens"))


def normalize_ws(spark, d):
    return docs(spark, d).select("doc_id", T.normalize_whitespace(F.col("text")).alias("text"))


def sentence_split(spark, d):
    return docs(spark, d).select("doc_id", T.sentences(F.col("text")).alias("sentences"))


def denoise_gates(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(denoise.gated_lines(F.col("text")), "\n").alias("text"))


def denoise_full(spark, d):
    pages = table(spark, d, "pages").select(F.concat(F.lit("page::"), F.col("page_id").cast("string")).alias("id"), F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    return docs(spark, d).select("id", "text").unionByName(pages).select("id", denoise.denoise(F.col("text")).alias("text"))


def row_map_role(spark, d):
    turns = table(spark, d, "conversations")
    q = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    rows = q.join(a, ["conv_id", "turn"], "left").withColumn("id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    found = RowSource("chat", "", anchor=("question",), positive=("answer",)).map_rows(rows)
    return found.select("id", "source", "trust", F.col("sections")[0]["text"].alias("anchor"), F.col("sections")[1]["text"].alias("context"))


def row_map_text(spark, d):
    rows = docs(spark, d).select(F.col("doc_id").alias("id"), "text", "lang")
    found = RowSource("docs", "", text=("text", "lang"), trust=0.7).map_rows(rows)
    return found.select("id", "trust", F.size("sections").alias("n_sections"), F.col("sections")[1]["text"].alias("context"))


def json_lines(spark, d):
    lines = table(spark, d, "events").select("event_id", F.col("props").alias("value"))
    entries = F.transform(F.map_entries("object"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return decode_lines(lines, strict=True).select("event_id", F.array_join(F.array_sort(entries), "|").alias("entries"))


def date_meta_values(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.array_join(dates.date_meta_values(F.col("o_orderdate").cast("date")), "|").alias("values"))


def folder_dates(spark, d):
    o = table(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    year = F.year("day").cast("string")
    names = {"us": F.concat(F.date_format("day", "MM_dd_yyyy"), F.lit("--DRAFT")), "iso": F.date_format("day", "yyyy-MM-dd"), "short": F.date_format("day", "MM-dd"), "none": F.lit("reports")}
    cols = [dates.folder_date(year, n).cast("string").alias(k) for k, n in names.items()]
    months = dates.month_range_date(year, F.concat(F.lit("Jan 2020 + "), F.date_format("day", "MMM yyyy"))).cast("string").alias("months")
    return o.select("o_orderkey", *cols, months)


def _prefix():
    return metadata.KvpPrefix([[metadata.KvpField("lang", F.array("lang")), metadata.KvpField("source", F.array("source"), 0.5)], [metadata.KvpField("source", F.array("source"))]], emit=0.7)


def kvp_prefix(spark, d):
    return docs(spark, d).select("id", _prefix().draw(F.col("id")).alias("prefix"))


def kvp_all_metadata(spark, d):
    return docs(spark, d).select("id", F.array_join(_prefix().all_metadata(), "|").alias("entries"))


def decorate_chunk(spark, d):
    t = T.tokens(F.col("text"))
    return docs(spark, d).select("id", metadata.decorate(_prefix().draw(F.col("id")), t, F.col("text"), 64).alias("text"))


def lexical_similarity(spark, d):
    title = F.trim(F.substring_index("text", "\n", 1))
    both = docs(spark, d).select("id", "source", weights.byte_similarity(title, F.col("text")).alias("s"))
    return both.select("id", "source", F.round("s.jaccard", 9).alias("jaccard"), F.round("s.cosine", 9).alias("cosine"))


_LINES = "string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))"
_TRIM = "regexp_replace(x, '^[\\t-\\r\\x{20}\\x{85}\\x{a0}]+|[\\t-\\r\\x{20}\\x{85}\\x{a0}]+$', '', 'g')"
_CELL = _TRIM.replace("(x,", "(c,")
_TABLE = f"({_TRIM} LIKE '|%' AND length({_TRIM}) - length(replace({_TRIM}, '|', '')) >= 2)"
_SHOW = lambda k, v: f"'{k}=' || {v}"
_KVP = f"""{DOCS}, drawn AS (SELECT id, text, lang, source, {u("'42'", "'emit'", 'id')} < 0.7::DOUBLE AS emit, ({h("'42'", "'variant'", 'id')} % 2)::INT AS which,
  {u("'42'", "'presence'", "'source'", 'id')} < 0.5::DOUBLE AS has_source, {h("'42'", "'order'", "'lang'", 'id')} AS ol, {h("'42'", "'order'", "'source'", 'id')} AS os FROM docs),
prefixed AS (SELECT id, text, CASE WHEN emit THEN 'meta: ' || CASE WHEN which = 1 THEN 'source=' || source WHEN NOT has_source THEN 'lang=' || lang
  WHEN ol < os THEN 'lang=' || lang || ' | source=' || source ELSE 'source=' || source || ' | lang=' || lang END END AS prefix FROM drawn)"""

#: Sentences: a full stop that is neither within an abbreviation or number nor followed by another ends one, as do ! and ?.
_INNER = "'([A-Z0-9])\\.([A-Z0-9])', '\\1' || chr(2) || '\\2', 'g'"
_SENTENCES = f"""SELECT doc_id, list_filter(list_transform(flatten(list_transform(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10) || chr(10)),
  lambda b: string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(b, '{SPACE}', ' ', 'g')), {_INNER}), {_INNER}),
    '(\\.+)', '\\1' || chr(1), 'g'), '([!?])', '\\1' || chr(1), 'g'), chr(1)))),
  lambda s: replace(trim(s), chr(2), '.')), lambda s: s <> '') AS sentences FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL"""
_DIGITS = "length(regexp_replace({0}, '[^0-9]', '', 'g'))"
_LETTERS = "length(regexp_replace({0}, '[^\\p{{L}}\\p{{Nl}}]', '', 'g'))"
_GATED = f"""list_filter(list_transform(list_filter({_LINES}, lambda x: NOT ({_TABLE} AND translate({_TRIM}, '|-: ' || chr(9), '') = '')),
  lambda x: CASE WHEN {_TABLE} THEN array_to_string(list_filter(list_transform(string_split(x, '|'), lambda c: {_CELL}), lambda c: c <> ''), ' ') ELSE x END),
  lambda x: regexp_matches(x, '[\\p{{L}}\\p{{Nl}}]'))"""
_DENOISE = f"""WITH {DOCS}, t AS (SELECT id, text FROM docs UNION ALL SELECT 'page::' || page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') FROM pages),
gated AS (SELECT id, {_GATED} AS lines FROM t),
line AS (SELECT id, i, lines[i] AS x, {_DIGITS.format('lines[i]')} AS d, {_LETTERS.format('lines[i]')} AS a FROM gated, unnest(range(1, len(lines) + 1)) r(i)),
word AS (SELECT id, i, j, w[j] AS w, {_DIGITS.format('w[j]')} AS d, {_LETTERS.format('w[j]')} AS a FROM (SELECT id, i, {toks('x')} AS w FROM line WHERE d > 0.35::DOUBLE * (d + a)), unnest(range(1, len(w) + 1)) r(j)),
near AS (SELECT *, least(coalesce(j - max(CASE WHEN a > 0 THEN j END) OVER (PARTITION BY id, i ORDER BY j), 1000000000),
  coalesce(min(CASE WHEN a > 0 THEN j END) OVER (PARTITION BY id, i ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - j, 1000000000)) AS wave FROM word),
upto AS (SELECT *, sum(d) OVER (PARTITION BY id, i ORDER BY wave) AS ud, sum(a) OVER (PARTITION BY id, i ORDER BY wave) AS ua FROM near),
kept AS (SELECT id, i, string_agg(w, ' ' ORDER BY j) AS x FROM upto WHERE wave = 0 OR ud <= 0.35::DOUBLE * (ud + ua) GROUP BY id, i)
SELECT g.id, l.text FROM gated g LEFT JOIN (SELECT id, string_agg(coalesce(kept.x, line.x), chr(10) ORDER BY i) AS text FROM line LEFT JOIN kept USING (id, i) GROUP BY id) l USING (id)"""
#: Counts of the bytes of two texts, and their similarities.
_BYTES = lambda x: f"(SELECT id, b, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(hex(encode({x})), '..')) AS b FROM pairs) GROUP BY ALL)"
SIMILARITY = f"""{DOCS}, pairs AS (SELECT id, source, trim(split_part(text, chr(10), 1)) AS title, text FROM docs),
bytes AS (SELECT id, coalesce(p.n, 0) AS p, coalesce(q.n, 0) AS q FROM {_BYTES('title')} p FULL JOIN {_BYTES('text')} q USING (id, b)),
sums AS (SELECT id, sum(p * q)::DOUBLE AS pq, sum(p * p)::DOUBLE AS pp, sum(q * q)::DOUBLE AS qq, count(*) FILTER (p > 0 AND q > 0) AS shared, count(*) AS uni FROM bytes GROUP BY id),
sims AS (SELECT id, source, CASE WHEN pp > 0 AND qq > 0 THEN shared::DOUBLE / uni ELSE 0 END AS jaccard, CASE WHEN pp > 0 AND qq > 0 THEN pq / sqrt(pp * qq) ELSE 0 END AS cosine FROM pairs LEFT JOIN sums USING (id))"""

QUERIES = {
    "token_counts": (token_counts, f"SELECT doc_id, len({toks('text')})::INT AS n_tokens FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL"),
    "normalize_ws": (normalize_ws, f"SELECT doc_id, trim(regexp_replace(text, '{SPACE}', ' ', 'g')) AS text FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL"),
    "sentence_split": (sentence_split, _SENTENCES),
    "denoise_gates": (
        denoise_gates,
        f"""SELECT doc_id, array_to_string(list_filter(list_transform(list_filter({_LINES},
  lambda x: NOT ({_TABLE} AND translate({_TRIM}, '|-: ' || chr(9), '') = '')),
  lambda x: CASE WHEN {_TABLE} THEN array_to_string(list_filter(list_transform(string_split(x, '|'), lambda c: {_CELL}), lambda c: c <> ''), ' ') ELSE x END),
  lambda x: regexp_matches(x, '[\\p{{L}}\\p{{Nl}}]')), chr(10)) AS text FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL""",
    ),
    "denoise_full": (denoise_full, _DENOISE),
    "row_map_role": (
        row_map_role,
        """SELECT 'chat::' || q.conv_id || '-' || q.turn AS id, 'chat' AS source, 0.5::DOUBLE AS trust, q.text AS anchor, a.text AS context
FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
WHERE q.role = 'user' AND a.role = 'assistant' AND trim(q.text) <> '' AND trim(a.text) <> ''""",
    ),
    "row_map_text": (row_map_text, "SELECT 'docs::' || doc_id AS id, 0.7::DOUBLE AS trust, 2 AS n_sections, CASE WHEN trim(text) <> '' THEN text ELSE lang END AS context FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL AND (trim(text) <> '' OR trim(lang) <> '')"),
    "json_lines": (json_lines, "SELECT event_id, array_to_string(list_sort(list_transform(json_keys(props), lambda k: k || '=' || json_extract_string(props, k))), '|') AS entries FROM events"),
    "date_meta_values": (
        date_meta_values,
        """SELECT o_orderkey, array_to_string(list_sort(list_distinct([strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%b. %-d, %Y'),
  strftime(o_orderdate, '%B %-d, %Y'), strftime(o_orderdate, '%d.%m.%Y'), strftime(o_orderdate, '%m/%d/%Y'), strftime(o_orderdate, '%b %-d, %Y')])), '|') AS values FROM orders""",
    ),
    "folder_dates": (folder_dates, "SELECT o_orderkey, d AS us, d AS iso, d AS short, NULL::VARCHAR AS none, d[1:8] || '01' AS months FROM (SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS d FROM orders)"),
    "kvp_prefix": (kvp_prefix, f"WITH {_KVP} SELECT id, prefix FROM prefixed"),
    "kvp_all_metadata": (kvp_all_metadata, f"WITH {DOCS} SELECT id, 'lang=' || lang || '|source=' || source AS entries FROM docs"),
    "decorate_chunk": (
        decorate_chunk,
        f"""WITH {_KVP}, t AS (SELECT *, {toks('text')} AS w, len({toks("coalesce(prefix, '')")}) AS p FROM prefixed)
SELECT id, CASE WHEN prefix IS NULL THEN text WHEN len(w) <= 64 - p THEN prefix || chr(10) || text
  ELSE prefix || chr(10) || array_to_string(w[1:64 - p], ' ') END AS text FROM t""",
    ),
    "lexical_similarity": (lexical_similarity, f"WITH {SIMILARITY} SELECT id, source, round(jaccard, 9) AS jaccard, round(cosine, 9) AS cosine FROM sims"),
}
