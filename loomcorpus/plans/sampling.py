"""Negatives, neighbours, BM25 and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import ANCHOR, CONTEXT, ChunkingStrategy, Selector, TextRecipe, TripletRecipe, long_section_recipe, row_recipes, tickets, title_context_recipes
from ..functions.hashing import hash52
from ..operators import metrics, sampling, selection, splits
from .common import DOCS, SECTIONS, chunk_ctes, docs, h, label, pool, sections, table, toks, u

STRATEGY = ChunkingStrategy(window=128, overlaps=(16,), fallback_tokens=96)
RECIPES = title_context_recipes()
TEXTS = (TextRecipe("titles", ANCHOR, 1.0), TextRecipe("bodies", CONTEXT, 2.0))
ANY = Selector("random")
#: Recipes of the further triplet queries, by selector.
BY = {
    "triplet_random": (TripletRecipe("any", ANY, ANY, ANY, instruction="compare"), TripletRecipe("any_body", ANY, CONTEXT, ANY, weight=2.0)),
    "triplet_paragraph": (TripletRecipe("first_second", Selector("paragraph", 0), Selector("paragraph", 1), Selector("paragraph", 1)),),
    "triplet_temporal": (TripletRecipe("month_later", ANCHOR, Selector("temporal_offset", 30), CONTEXT),),
    "triplet_simcse": row_recipes(False),
    "triplet_long_sections": (long_section_recipe("docs"),),
    "triplet_same_role": (TripletRecipe("bodies", CONTEXT, CONTEXT, CONTEXT),),
}


def _negatives(f):
    return lambda spark, d: f(pool(spark, d))


def temporal_neighbor(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").alias("source"), F.concat("o_orderstatus", "o_orderpriority").alias("taxon"), F.col("o_orderdate").alias("created_at"))
    return selection.temporal_neighbor(o, 30, ("source",), ("taxon",))


def bm25_topk(spark, d):
    return selection.bm25_top(docs(spark, d))


def bm25_negative(spark, d):
    return selection.bm25_negative(bm25_topk(spark, d), _doc_pool(spark, d), draw_no=1)


def _doc_pool(spark, d):
    return splits.assign(docs(spark, d).select("id", "source", F.lit(None).cast("date").alias("date"), F.timestamp_seconds(hash52("at", F.col("id")) % 31_536_000).alias("created_at"), F.col("lang").alias("taxon")))


def _rounded(t):
    return t.withColumn("weight", F.round("weight", 9))


def triplet_batch(spark, d):
    return _rounded(sampling.triplets(sections(spark, d), _doc_pool(spark, d), RECIPES, STRATEGY))


def _triplets(name):
    where = "role = 'context'" if name in ("triplet_simcse", "triplet_same_role") else "true"
    return lambda spark, d: _rounded(sampling.triplets(sections(spark, d).filter(where), _doc_pool(spark, d), BY[name], STRATEGY))


def triplet_hard(spark, d):
    """BM25 negatives in samples."""
    return _rounded(sampling.triplets(sections(spark, d), _doc_pool(spark, d), RECIPES, STRATEGY, backend=selection.Bm25Backend(docs(spark, d))))


def pair_batch(spark, d):
    return sampling.pairs(triplet_batch(spark, d))


def text_batch(spark, d):
    return sampling.texts(sections(spark, d), TEXTS, STRATEGY)


def recipe_counts(spark, d):
    return metrics.recipe_counts(triplet_batch(spark, d).withColumn("source", F.substring_index("slot_id", "::", 1)))


def fallback_rate(spark, d):
    return metrics.fallback_rate(bm25_negative(spark, d))


_POOL = f"pool AS (SELECT o_orderkey::VARCHAR AS id, o_orderpriority AS source, o_orderdate::DATE AS date, {label('o_orderkey::VARCHAR')} AS split FROM orders)"


_RANGE = f"({h(chr(39) + 'rank' + chr(39), 'id')} >> 44)"


def _draw(name: str, by: str, purpose: str, where: str = "TRUE", pool: str = "pool") -> str:
    return f"""{name}_r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {_RANGE}, id) - 1 AS rk, count(*) OVER (PARTITION BY {by}) AS n FROM {pool} WHERE {where}),
{name} AS (SELECT a.id, b.id AS neg FROM (SELECT *, {h("'42'", f"'{purpose}'", 'id')} % (n - 1) AS r FROM {name}_r WHERE n > 1) a
  JOIN {name}_r b ON {' AND '.join(f'a.{c.strip()} = b.{c.strip()}' for c in by.split(','))} AND b.rk = CASE WHEN a.r >= a.rk THEN a.r + 1 ELSE a.r END)"""


def _tiers(tables: list[tuple[str, bool]], pool: str = "pool") -> str:
    joins = " ".join(f"LEFT JOIN {t} USING (id)" for t, _ in tables)
    case = " ".join(f"WHEN {t}.neg IS NOT NULL THEN {str(f).upper()}" for t, f in tables)
    return f"SELECT id, coalesce({', '.join(t + '.neg' for t, _ in tables)}) AS negative_id, CASE {case} END AS fallback FROM {pool} {joins} WHERE coalesce({', '.join(t + '.neg' for t, _ in tables)}) IS NOT NULL"


def _wrong_date(pool: str) -> str:
    return f"""dr AS (SELECT *, coalesce(date::VARCHAR, '') AS day, row_number() OVER (PARTITION BY source, split ORDER BY coalesce(date::VARCHAR, ''), {_RANGE}, id) - 1 AS rk, count(*) OVER (PARTITION BY source, split) AS n FROM {pool}),
dl AS (SELECT *, min(rk) OVER (PARTITION BY source, split, day) AS lo, count(*) OVER (PARTITION BY source, split, day) AS size FROM dr),
dd AS (SELECT a.id, b.id AS neg FROM (SELECT *, {h("'42'", "'wrong_date'", 'id')} % (n - size) AS r FROM dl WHERE n > size) a
  JOIN dl b ON a.source = b.source AND a.split = b.split AND b.rk = CASE WHEN a.r >= a.lo THEN a.r + a.size ELSE a.r END),
{_draw('fb', 'split', 'wrong_date', pool=pool)}"""


_BM25 = f"""{DOCS}, __t__"""
_INDEX = f"""t AS (SELECT source, id, {toks('lower(text)')} AS t FROM docs), t1 AS (SELECT source, id, t, len(t) AS len FROM t WHERE len(t) > 0),
stats AS (SELECT source, count(*) AS nd, avg(len) AS mean FROM t1 GROUP BY 1 HAVING count(*) >= 2),
terms AS (SELECT source, id, len, unnest(t) AS term FROM t1), tf AS (SELECT source, term, id, count(*) AS tf, any_value(len) AS len FROM terms GROUP BY ALL),
df AS (SELECT source, term, count(*) AS df FROM tf GROUP BY ALL),
post AS (SELECT tf.source, tf.term, id, ln(1 + (nd - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))) AS w
  FROM tf JOIN df USING (source, term) JOIN stats USING (source)),
asked AS (SELECT source, id AS anchor, unnest(list_distinct(t[1:64])) AS term FROM __asked__),
scores AS (SELECT source, anchor, id, round(sum(w), 6) AS score FROM asked JOIN post USING (source, term) GROUP BY ALL),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY source, anchor ORDER BY score DESC, id))::INT AS rank FROM scores QUALIFY rank <= 32)"""
_BM25 = _BM25.replace("__t__", _INDEX.replace("__asked__", "t1"))
_AT = h("'at'", "id")
_DPOOL = f"dpool AS (SELECT id, source, lang, NULL::DATE AS date, {_AT} % 31536000 AS at, {label('id')} AS split FROM docs), mine AS (SELECT * FROM dpool WHERE split = 'train')"
_CHUNKS = f"""{chunk_ctes('sections', 'id, section_idx, role, trust', 128, (16,), 96)},
rk AS (SELECT id, section_idx, role, trust, view, overlap, window_index, text, greatest(0.1::DOUBLE, CASE WHEN view = 'summary' THEN 0.35::DOUBLE ELSE 1.0::DOUBLE / (window_index + 1) END * trust) AS cw,
  row_number() OVER (PARTITION BY id, section_idx ORDER BY view, overlap, window_index) - 1 AS nth, count(*) OVER (PARTITION BY id, section_idx) AS n FROM chunks)"""
_TEMPORAL = """SELECT a.id, b.id AS record_id FROM mine a JOIN mine b ON a.id <> b.id AND (a.source = b.source OR a.lang = b.lang)
  QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY abs(b.at - a.at - {days} * 86400), b.id) = 1"""


def _drawn(s: Selector, visit: int = 0) -> str:
    """The chunk that a selector takes of each record, in SQL."""
    if s.kind == "paragraph":
        choice = f"SELECT id, id AS record_id, section_idx FROM rk WHERE nth = 0 AND section_idx = {s.value}"
    else:
        role = Selector("role", "context") if s.kind == "temporal_offset" else s
        value, where = (role.value, f"role = '{role.value}'") if role.kind == "role" else ("", "TRUE")
        choice = f"""SELECT id, id AS record_id, section_idx FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY section_idx) - 1 AS k, count(*) OVER (PARTITION BY id) AS m FROM rk WHERE nth = 0 AND {where})
  WHERE k = ({h("'42'", f"'{role.kind}'", f"'{value}'", 'id')} + {visit}) % m"""
        if s.kind == "temporal_offset":
            choice = f"SELECT t.id, t.record_id, c.section_idx FROM ({_TEMPORAL.format(days=s.value)}) t JOIN ({choice}) c ON c.id = t.record_id"
    return f"""SELECT c.id, c.record_id, rk.* EXCLUDE (id) FROM ({choice}) c JOIN rk ON rk.id = c.record_id AND rk.section_idx = c.section_idx
  WHERE nth = ({h("'42'", "'chunk'", 'c.record_id', 'c.section_idx::VARCHAR')} + {visit}) % n"""


def _long(side: str) -> str:
    key = ("id", "section_idx::VARCHAR", "overlap::VARCHAR")
    return f"""SELECT rk.id, rk.id AS record_id, rk.* EXCLUDE (id) FROM rk JOIN (SELECT id, section_idx, overlap, a, CASE WHEN b >= a THEN b + 1 ELSE b END AS p FROM (
  SELECT id, section_idx, overlap, {h("'42'", "'anchor'", *key)} % count(*) AS a, {h("'42'", "'positive'", *key)} % (count(*) - 1) AS b FROM rk WHERE view = 'window' AND role = 'context' GROUP BY id, section_idx, overlap HAVING count(*) >= 2))
  l ON rk.id = l.id AND rk.section_idx = l.section_idx AND rk.overlap = l.overlap AND rk.window_index = l.{side} AND view = 'window'"""


def _triplet_sql(recipes: tuple, negatives: str, where: str = "TRUE") -> str:
    """CTEs up to ``triplets``, for recipes of one strategy."""
    names = [n for n, k in tickets({r.name: r.weight for r in recipes}).items() for _ in range(k)]
    each = []
    for r in recipes:
        a, p = (_long("a"), _long("p")) if r.long_section else (_drawn(r.anchor), _drawn(r.positive, int(r.anchor == r.positive)))
        near = "CASE WHEN a.record_id = p.record_id AND a.section_idx = p.section_idx AND a.view = 'window' AND p.view = 'window' THEN 1 - abs(a.window_index - p.window_index)::DOUBLE / (abs(a.window_index - p.window_index) + 1) ELSE 1.0::DOUBLE END"
        pair = f"2 * greatest(0.1::DOUBLE, ({near}) * (a.trust + p.trust) / 2)" if r.long_section else f"greatest(0.1::DOUBLE, a.cw * ({near})) + greatest(0.1::DOUBLE, p.cw * ({near}))"
        each.append(f"""SELECT s.id AS slot_id, CASE WHEN fallback THEN '{r.name}_fallback_same_split' ELSE '{r.name}' END AS recipe,
  CASE WHEN {_SWAP} < 0.5 THEN p.record_id ELSE a.record_id END AS anchor_id, CASE WHEN {_SWAP} < 0.5 THEN a.record_id ELSE p.record_id END AS positive_id, negative_id,
  CASE WHEN {_SWAP} < 0.5 THEN p.text ELSE a.text END AS anchor_text, CASE WHEN {_SWAP} < 0.5 THEN a.text ELSE p.text END AS positive_text, n.text AS negative_text,
  round({r.weight}::DOUBLE * ({pair} + greatest(0.1::DOUBLE, n.trust)) / 3, 9) AS weight, {f"'{r.instruction}'" if r.instruction else 'NULL::VARCHAR'} AS instruction, '{r.strategy}' AS reason, {r.allow_same_anchor_positive} AS same
  FROM slots s JOIN ({a}) a ON a.id = s.id JOIN ({p}) p ON p.id = s.id JOIN ({_drawn(r.negative)}) n ON n.id = s.negative_id WHERE s.r = '{r.name}'""")
    return f"""{SECTIONS.replace('sections AS', 'all_sections AS')}, {_DPOOL}, sections AS (SELECT * FROM all_sections JOIN (SELECT id FROM mine) USING (id) WHERE {where}),
{_CHUNKS},
{negatives},
slots AS (SELECT *, list_value({', '.join(f"'{n}'" for n in names)})[{h("'42'", "'slot'", 'id')} % {len(names)} + 1] AS r FROM neg),
full_ AS ({' UNION ALL '.join(each)}),
triplets AS (SELECT * EXCLUDE (same) FROM full_ WHERE (same OR anchor_text <> positive_text) AND anchor_text <> negative_text AND positive_text <> negative_text
  QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id, negative_id ORDER BY slot_id) = 1)"""


_SWAP = u("'42'", "'swap'", "s.id")
_UNIFORM = f"{_draw('s1', 'source, split', 'wrong_article', pool='mine')}, {_draw('s2', 'split', 'wrong_article', pool='mine')}, neg AS ({_tiers([('s1', False), ('s2', True)], 'mine')})"
_TRIPLETS = "WITH " + _triplet_sql(RECIPES, _UNIFORM)


def _hard(pool: str, draw_no: int) -> str:
    """Negatives by BM25 with a uniform draw where there is no hit."""
    return f"""{_draw('u1', 'source, split', 'wrong_article', pool=pool)}, {_draw('u2', 'split', 'wrong_article', pool=pool)},
uni AS (SELECT id, negative_id AS neg FROM ({_tiers([('u1', False), ('u2', True)], pool)})),
hits AS (SELECT anchor, id, row_number() OVER (PARTITION BY anchor ORDER BY rank) - 1 AS nth, count(*) OVER (PARTITION BY anchor) AS n
  FROM ranked WHERE anchor <> id AND {label('anchor')} = {label('id')} AND anchor IN (SELECT id FROM {pool})),
hit AS (SELECT anchor AS id, id AS neg FROM hits WHERE nth = {draw_no} % least(3, n)),
neg AS ({_tiers([('hit', False), ('uni', True)], pool)})"""


QUERIES = {
    "neg_wrong_article": (
        _negatives(selection.wrong_article),
        f"WITH {_POOL}, {_draw('d1', 'source, split, date', 'wrong_article', 'date IS NOT NULL')}, {_draw('d2', 'source, split', 'wrong_article')}, {_draw('d3', 'split', 'wrong_article')} {_tiers([('d1', False), ('d2', False), ('d3', True)])}",
    ),
    "neg_wrong_date": (_negatives(selection.wrong_date), f"WITH {_POOL}, {_wrong_date('pool')} {_tiers([('dd', False), ('fb', True)])}"),
    "neg_qa_mismatch": (_negatives(selection.qa_mismatch), f"WITH {_POOL}, {_draw('d2', 'source, split', 'qa')}, {_draw('d3', 'split', 'qa')} {_tiers([('d2', False), ('d3', True)])}"),
    "temporal_neighbor": (
        temporal_neighbor,
        """WITH o AS (SELECT o_orderkey::VARCHAR AS id, o_custkey AS c, o_orderstatus || o_orderpriority AS t, epoch_us(o_orderdate) AS at FROM orders)
SELECT a.id, b.id AS neighbor_id FROM o a JOIN o b ON (a.c = b.c OR a.t = b.t) AND a.id <> b.id
QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY abs(b.at - a.at - 30 * 86400000000), b.id) = 1""",
    ),
    "bm25_topk": (bm25_topk, f"WITH {_BM25} SELECT source, anchor, id, score, rank FROM ranked"),
    "bm25_negative": (bm25_negative, f"WITH {_BM25}, {_DPOOL}, {_hard('dpool', 1)} SELECT * FROM neg"),
    "triplet_batch": (triplet_batch, f"{_TRIPLETS} SELECT * FROM triplets"),
    **{name: (_triplets(name), "WITH " + _triplet_sql(r, _UNIFORM, "role = 'context'" if name in ("triplet_simcse", "triplet_same_role") else "TRUE") + " SELECT * FROM triplets") for name, r in BY.items()},
    "triplet_hard": (triplet_hard, "WITH " + _triplet_sql(RECIPES, _INDEX.replace("__asked__", f"(SELECT d.source, d.id, {toks('lower(c.text)')} AS t FROM docs d JOIN ({_drawn(ANCHOR)}) c ON c.id = d.id)") + ", " + _hard("mine", 0)) + " SELECT * FROM triplets"),
    "pair_batch": (
        pair_batch,
        f"""{_TRIPLETS} SELECT slot_id, recipe, anchor_id, anchor_text, 0 AS nth, positive_id AS other_id, positive_text AS other_text, 'positive' AS label, NULL::VARCHAR AS reason, weight, instruction FROM triplets
UNION ALL SELECT slot_id, recipe, anchor_id, anchor_text, 1, negative_id, negative_text, 'negative', reason, weight, instruction FROM triplets""",
    ),
    "text_batch": (
        text_batch,
        f"""WITH {SECTIONS}, drawn AS (SELECT id, CASE WHEN {h("'42'", "'slot'", 'id')} % 3 < 1 THEN 'titles' ELSE 'bodies' END AS recipe FROM docs), {_CHUNKS}
SELECT id, recipe, text, CASE recipe WHEN 'titles' THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END * cw AS weight, NULL::VARCHAR AS instruction FROM drawn JOIN (SELECT 'titles' AS recipe, * FROM ({_drawn(ANCHOR)}) UNION ALL SELECT 'bodies', * FROM ({_drawn(CONTEXT)})) USING (id, recipe)""",
    ),
    "recipe_counts": (recipe_counts, f"{_TRIPLETS} SELECT split_part(slot_id, '::', 1) AS source, recipe, count(*) AS n FROM triplets GROUP BY ALL"),
    "fallback_rate": (fallback_rate, f"WITH {_BM25}, {_DPOOL}, {_hard('dpool', 1)} SELECT count(*) FILTER (fallback) AS fallbacks, count(*) AS selections FROM neg"),
}
