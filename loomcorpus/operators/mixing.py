"""Draining of several sources into one stream of records, rolling caches and paging."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidWeight
from ..functions.hashing import hash52, hash52_of
from .splits import hash_ranked


def round_robin(df: DataFrame, limit: int, order: tuple[Column | str, ...]) -> DataFrame:
    """The first ``limit`` records when the sources give one each in turn (sources by name)."""
    turn = F.row_number().over(Window.partitionBy("source").orderBy(*order)) - 1
    return df.withColumn("turn", turn).filter(F.col("turn") < limit).orderBy("turn", "source").limit(limit)


def check_weights(weights: Mapping[str, float], sources: set[str]) -> None:
    for name, w in weights.items():
        if name not in sources:
            raise InvalidWeight(f"no such source: {name}")
        if w < 0:
            raise InvalidWeight(f"negative weight of {name}")


def schedule(sizes: Mapping[str, int], weights: Mapping[str, float], limit: int) -> list[tuple[int, str, int]]:
    """(step, source, nth record) by smooth weighted round robin over sources in order of name. Sources
    without a weight have 1; those with 0 give nothing, unless all have. ``limit`` steps at most."""
    names = sorted(sizes)
    weight = {s: float(weights.get(s, 1.0)) for s in names}
    if all(w <= 0 for w in weight.values()):
        weight = dict.fromkeys(names, 1.0)
    credit, given, out = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0), []
    while len(out) < limit:
        live = [s for s in names if weight[s] > 0 and given[s] < sizes[s]]
        if not live:
            break
        for s in live:
            credit[s] += weight[s]
        best = max(live, key=lambda s: credit[s])  # the first of equal ones
        credit[best] -= sum(weight[s] for s in live)
        out.append((len(out), best, given[best]))
        given[best] += 1
    return out


def weighted(df: DataFrame, weights: Mapping[str, float], limit: int, order: tuple[Column | str, ...]) -> DataFrame:
    """step and the record of each step of the schedule. The driver plans ``limit`` steps from the
    sources' sizes; records are matched by their place within the source."""
    spark = df.sparkSession
    sizes = {r.source: r["count"] for r in df.groupBy("source").count().collect()}  # one row a source
    check_weights(weights, set(sizes))
    steps = spark.createDataFrame(schedule(sizes, weights, limit), "step int, source string, nth int")
    placed = df.withColumn("nth", F.row_number().over(Window.partitionBy("source").orderBy(*order)) - 1).filter(F.col("nth") < limit)
    return steps.join(placed, ["source", "nth"]).drop("nth")


def rolling_cache(arrivals: DataFrame, keep: int, key: str = "id", version: str = "version") -> DataFrame:
    """The newest arrival of each key, and of those the ``keep`` newest per source."""
    last = F.row_number().over(Window.partitionBy("source", key).orderBy(F.desc(version)))
    newest = arrivals.withColumn("k", last).filter("k = 1").drop("k")
    recent = F.row_number().over(Window.partitionBy("source").orderBy(F.desc(version), key))
    return newest.withColumn("k", recent).filter(F.col("k") <= keep).drop("k")


def group_cap(df: DataFrame, group: str, limit: int, order: tuple[Column | str, ...]) -> DataFrame:
    """At most ceil(limit / groups) records of each group."""
    groups = df.agg(F.count_distinct(group).alias("groups"))
    nth = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("nth", nth).filter(F.col("nth") <= limit).crossJoin(F.broadcast(groups)).filter(F.col("nth") <= F.ceil(F.lit(limit) / F.col("groups"))).drop("groups")


def grouped_order(sizes: Mapping[str, int], divisor: int = 8, seed: int = 42) -> list[tuple[int, str, int, int]]:
    """(position, group, first, how many) blocks that interleave groups window by window: in each
    window of total / divisor records, each group left gives at most its fair share. Groups come in
    hashed order. Works on group sizes only; records are joined by their place in the group."""
    left = {k: v for k, v in sizes.items() if v}
    total, names = sum(left.values()), sorted(left, key=lambda k: (hash52_of(seed, "group", k), k))
    window, at, given, out = max(1, total // divisor), 0, dict.fromkeys(left, 0), []
    while at < total:
        room = min(window, total - at)
        live = [k for k in names if left[k]]
        share = max(1, -(-room // len(live)))
        for k in live:
            take = min(share, left[k], room)
            if take:
                out.append((at, k, given[k], take))
                at, room, left[k], given[k] = at + take, room - take, left[k] - take, given[k] + take
    return out


def in_grouped_order(df: DataFrame, group: str, id: str = "id", divisor: int = 8, seed: int = 42) -> DataFrame:
    """The frame with ``position`` in the interleaved order of its groups."""
    spark = df.sparkSession
    sizes = {r[group]: r["count"] for r in df.groupBy(group).count().collect()}  # one row a group
    blocks = spark.createDataFrame(grouped_order(sizes, divisor, seed), f"at long, {group} string, first long, n long")
    placed = hash_ranked(df, (group,), hash52(seed, "item", F.col(id)), id, "nth")
    inside = (F.col("nth") >= F.col("first")) & (F.col("nth") < F.col("first") + F.col("n"))
    return placed.join(F.broadcast(blocks), group).filter(inside).withColumn("position", F.col("at") + F.col("nth") - F.col("first")).drop("at", "first", "n", "nth")


def permuted_page(df: DataFrame, start: int, limit: int, seed: int = 42, id: str = "id") -> DataFrame:
    """``limit`` records per source from ``start`` on in a hashed permutation; a start past the end
    begins again."""
    sizes = df.groupBy("source").agg(F.count("*").alias("n"))
    placed = hash_ranked(df, ("source",), hash52(seed, "page", F.col("source"), F.col(id)), id).join(F.broadcast(sizes), "source")  # one row a source
    begin = F.when(F.col("n") <= start, F.lit(0)).otherwise(F.lit(start))
    return placed.filter((F.col("pos") >= begin) & (F.col("pos") < begin + limit)).drop("n")


def sequential_page(df: DataFrame, start: int, limit: int, order: str = "row_idx") -> DataFrame:
    """``limit`` records from ``start`` on, wrapping around, in the given order."""
    n = F.count("*").over(Window.partitionBy())
    at = F.row_number().over(Window.orderBy(order)) - 1  # small in-memory sources only
    return df.withColumn("at", F.pmod(at - F.lit(start), n)).filter(F.col("at") < limit).orderBy("at").drop("at")
