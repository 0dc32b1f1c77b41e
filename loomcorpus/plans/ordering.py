"""Splits, epochs, orders, mixing and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import TripletRecipe
from ..functions.hashing import hash52
from ..operators import mixing, sampling, splits
from .common import DOCS, docs, h, label, table

RECIPES = tuple(TripletRecipe(n, weight=w) for n, w in (("a", 0.75), ("b", 0.25), ("c", 0.0), ("d", 10.0)))
WEIGHTS = {"src0": 3.0, "src1": 0.5, "src2": 0.0}


def split_assign(spark, d):
    return splits.assign(docs(spark, d)).select("id", "split")


def split_counts(spark, d):
    return splits.assign(docs(spark, d)).groupBy("source", "split").agg(F.count("*").alias("n"))


def source_order(spark, d):
    return splits.source_order(docs(spark, d), epoch=3).select("id", "source", "pos")


def source_cycle(spark, d):
    return splits.source_cycle(docs(spark, d), 5)


def anchor_rotation(spark, d):
    ordered = splits.source_order(docs(spark, d)).select("source", "pos", "id")
    slots = ordered.groupBy("source").agg(F.count("*").alias("n")).select("source", F.explode(F.sequence(F.lit(0).cast("long"), 2 * F.col("n") - 1)).alias("visit"))
    return splits.anchor_rotation(ordered, slots)


def epoch_interleave(spark, d):
    return splits.interleave(docs(spark, d))


def epoch_reconcile(spark, d):
    consumed = docs(spark, d).filter(hash52("used", F.col("id")) % 3 == 0).select("id")
    return splits.reconcile(splits.source_order(docs(spark, d)).select("id", "source", "pos"), consumed)


def population_checksum(spark, d):
    return splits.population_checksum(docs(spark, d))


def recipe_tickets(spark, d):
    return sampling.ticket_table(spark, RECIPES)


def recipe_cycle(spark, d):
    return sampling.recipe_order(spark, RECIPES, turn=2)


def round_robin_mix(spark, d):
    return mixing.round_robin(docs(spark, d), 500, ("id",)).select("turn", "source", "id")


def weighted_mix(spark, d):
    return mixing.weighted(docs(spark, d), WEIGHTS, 500, ("id",)).select("step", "source", "id")


def rolling_cache(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("version"))
    return mixing.rolling_cache(e, 50)


def group_cap(spark, d):
    return mixing.group_cap(docs(spark, d), "source", 200, ("id",)).select("source", "id", "nth")


def grouped_order(spark, d):
    return mixing.in_grouped_order(docs(spark, d), "source").select("position", "source", "id")


def permuted_page(spark, d):
    return mixing.permuted_page(docs(spark, d), 5, 10).select("source", "id", "pos")


def batch_assign(spark, d):
    ids = docs(spark, d).select("id")
    return sampling.batches(ids, 32, ("id",))


def batch_dedupe(spark, d):
    return sampling.dedupe(docs(spark, d), ("text",), ("id",)).select("id")


def batch_pad(spark, d):
    return sampling.pad(docs(spark, d).select("source", "id"), 64, ("id",), ("source",))


def _ord(by: str, key: str, epoch: int = 0) -> str:
    return f"row_number() OVER (PARTITION BY {by} ORDER BY {h(repr(str(42 ^ epoch)), chr(39) + 'order' + chr(39), key)}, {key})"


_Q = "'"
_TICKETS = "tickets AS (SELECT * FROM (VALUES ('a', 3), ('b', 1), ('d', 16)) v(recipe, n)), cycle AS (SELECT recipe, i::INT AS ticket FROM tickets, unnest(range(1, n + 1)) r(i))"
_ORDERED = f"{DOCS}, ordered AS (SELECT id, source, ({_ord('source', 'id')} - 1)::BIGINT AS pos FROM docs), sizes AS (SELECT source, count(*) AS size FROM docs GROUP BY 1)"

_WEIGHT = " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items())
_WEIGHTED = f"""WITH RECURSIVE {DOCS}, each AS (SELECT source, count(*)::INT AS n, (CASE source {_WEIGHT} ELSE 1.0 END)::DOUBLE AS w FROM docs GROUP BY 1),
init AS (SELECT list(source ORDER BY source) AS s, list(n ORDER BY source) AS cap, list(w ORDER BY source) AS w FROM each),
run AS (SELECT 0 AS step, 0 AS pick, 0 AS nth, list_transform(w, lambda x: 0.0::DOUBLE) AS credit, list_transform(cap, lambda x: 0) AS given FROM init
  UNION ALL SELECT step + 1, best, given[best], list_transform(grown, lambda x, i: CASE WHEN i = best THEN x - turn ELSE x END), list_transform(given, lambda x, i: CASE WHEN i = best THEN x + 1 ELSE x END)
  FROM (SELECT *, list_position(list_transform(grown, lambda x, i: CASE WHEN live[i] THEN x ELSE -1e300 END), list_max(list_transform(grown, lambda x, i: CASE WHEN live[i] THEN x ELSE -1e300 END))) AS best,
      list_sum(list_transform(w, lambda x, i: CASE WHEN live[i] THEN x ELSE 0 END)) AS turn
    FROM (SELECT run.*, w, live, list_transform(credit, lambda x, i: CASE WHEN live[i] THEN x + w[i] ELSE x END) AS grown
      FROM run, init, LATERAL (SELECT list_transform(cap, lambda x, i: w[i] > 0 AND given[i] < x) AS live) WHERE step < 500 AND list_contains(live, TRUE)))),
placed AS (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY id) - 1 AS nth FROM docs)
SELECT (step - 1)::INT AS step, source, id FROM run, init, placed WHERE step > 0 AND placed.source = s[pick] AND placed.nth = run.nth"""
_GROUPED = f"""WITH RECURSIVE {DOCS}, each AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY {h("'42'", "'group'", 'source')}, source) AS r FROM docs GROUP BY 1),
init AS (SELECT list(source ORDER BY r) AS s, list(n ORDER BY r) AS n, sum(n)::BIGINT AS total, greatest(1, sum(n)::BIGINT // 8) AS size FROM each),
run AS (SELECT 0::BIGINT AS begun, list_transform(n, lambda x: 0::BIGINT) AS given, 0::BIGINT AS was, list_transform(n, lambda x: 0::BIGINT) AS before, list_transform(n, lambda x: 0::BIGINT) AS take FROM init
  UNION ALL SELECT begun + list_sum(took)::BIGINT, list_transform(given, lambda x, i: x + took[i]), begun, given, took
  FROM (SELECT *, list_transform(want, lambda x, i: greatest(0, least(x, room - coalesce(list_sum(want[1:i - 1]), 0)))::BIGINT) AS took
    FROM (SELECT run.*, room, list_transform(n, lambda x, i: least(greatest(1, ceil(room / len(list_filter(n, lambda y, j: y > given[j]))::DOUBLE)::BIGINT), x - given[i])) AS want
      FROM run, init, LATERAL (SELECT least(size, total - begun) AS room) WHERE begun < total))),
blocks AS (SELECT s[i] AS source, before[i] AS first, take[i] AS n, was + coalesce(list_sum(take[1:i - 1]), 0)::BIGINT AS begun FROM run, init, unnest(range(1, len(s) + 1)) r(i) WHERE take[i] > 0),
placed AS (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY {h("'42'", "'item'", 'id')}, id) - 1 AS nth FROM docs)
SELECT begun + nth - first AS position, source, id FROM placed JOIN blocks USING (source) WHERE nth >= first AND nth < first + n"""

QUERIES = {
    "split_assign": (split_assign, f"WITH {DOCS} SELECT id, {label('id')} AS split FROM docs"),
    "split_counts": (split_counts, f"WITH {DOCS} SELECT source, {label('id')} AS split, count(*) AS n FROM docs GROUP BY ALL"),
    "source_order": (source_order, f"WITH {DOCS} SELECT id, source, ({_ord('source', 'id', 3)} - 1)::BIGINT AS pos FROM docs"),
    "source_cycle": (
        source_cycle,
        f"""WITH {DOCS}, c AS (SELECT source, cycle FROM (SELECT DISTINCT source FROM docs), range(5) r(cycle))
SELECT cycle, (row_number() OVER (PARTITION BY cycle ORDER BY {h("'42'", 'cycle::VARCHAR', 'source')}, source) - 1)::INT AS pos, source FROM c""",
    ),
    "anchor_rotation": (
        anchor_rotation,
        f"""WITH {_ORDERED}, slots AS (SELECT source, size, visit FROM sizes, unnest(range(0, 2 * size)) r(visit)),
placed AS (SELECT source, visit, (visit + {h("'42'", "'offset'", 'source', '(visit // size)::VARCHAR')}) % size AS pos FROM slots)
SELECT source, visit, id FROM placed JOIN ordered USING (source, pos)""",
    ),
    "epoch_interleave": (
        epoch_interleave,
        f"""WITH {_ORDERED}, placed AS (SELECT source, size, (row_number() OVER (ORDER BY {h("'42'", "'source'", 'source')}, source) - 1)::INT AS place, max(size) OVER () AS longest FROM sizes),
turns AS (SELECT source, place, size, unnest(range(0, longest)) AS turn FROM placed)
SELECT turn, place, source, id FROM turns JOIN ordered USING (source) WHERE pos = turn % size""",
    ),
    "epoch_reconcile": (
        epoch_reconcile,
        f"WITH {_ORDERED}, f AS (SELECT *, {h(_Q + 'used' + _Q, 'id')} % 3 = 0 AS consumed FROM ordered) SELECT id, source, (row_number() OVER (PARTITION BY source ORDER BY consumed, pos) - 1)::BIGINT AS pos, consumed FROM f",
    ),
    "population_checksum": (population_checksum, f"WITH {DOCS} SELECT count(*) AS n, bit_xor({h(_Q + 'population' + _Q, 'source', 'id')}) AS checksum FROM docs"),
    "recipe_tickets": (recipe_tickets, f"WITH {_TICKETS} SELECT recipe, ticket FROM cycle"),
    "recipe_cycle": (
        recipe_cycle,
        f"""WITH {_TICKETS} SELECT ((row_number() OVER (ORDER BY {h("'42'", "'recipe'", 'recipe', 'ticket::VARCHAR')}, recipe, ticket) - 1 - 2 + 20) % 20)::INT AS pos, recipe, ticket FROM cycle""",
    ),
    "round_robin_mix": (round_robin_mix, f"WITH {DOCS} SELECT (row_number() OVER (PARTITION BY source ORDER BY id) - 1)::INT AS turn, source, id FROM docs ORDER BY turn, source LIMIT 500"),
    "weighted_mix": (weighted_mix, _WEIGHTED),
    "rolling_cache": (
        rolling_cache,
        """WITH newest AS (SELECT event_type AS source, user_id::VARCHAR AS id, max(event_id) AS version FROM events GROUP BY ALL)
SELECT source, id, version FROM newest QUALIFY row_number() OVER (PARTITION BY source ORDER BY version DESC, id) <= 50""",
    ),
    "group_cap": (group_cap, f"WITH {DOCS}, n AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY id))::INT AS nth FROM docs) SELECT source, id, nth FROM n WHERE nth <= ceil(200.0 / (SELECT count(DISTINCT source) FROM docs))"),
    "grouped_order": (grouped_order, _GROUPED),
    "permuted_page": (
        permuted_page,
        f"""WITH {DOCS}, p AS (SELECT source, id, (row_number() OVER (PARTITION BY source ORDER BY {h("'42'", "'page'", 'source', 'id')}, id) - 1)::BIGINT AS pos, count(*) OVER (PARTITION BY source) AS n FROM docs)
SELECT source, id, pos FROM p WHERE pos >= CASE WHEN n <= 5 THEN 0 ELSE 5 END AND pos < CASE WHEN n <= 5 THEN 10 ELSE 15 END""",
    ),
    "batch_assign": (
        batch_assign,
        f"""WITH {DOCS}, n AS (SELECT id, row_number() OVER (ORDER BY {h("'42'", "'visit'", 'id')}, id) - 1 AS k FROM docs) SELECT id, k // 32 AS batch, (k % 32)::INT AS slot FROM n""",
    ),
    "batch_dedupe": (batch_dedupe, f"WITH {DOCS} SELECT min(id) AS id FROM docs GROUP BY text"),
    "batch_pad": (
        batch_pad,
        f"""WITH {DOCS}, n AS (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY id) - 1 AS nth, count(*) OVER (PARTITION BY source) AS n FROM docs)
SELECT source, id, nth + lap * n AS slot FROM n, unnest(range(0, greatest(1, ceil((64 - nth) / n::DOUBLE)::INT))) r(lap)""",
    ),
}
