"""Splits, epochs and the orders in which records are visited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SplitRatios
from ..functions.hashing import hash52, uniform


def split_label(id: Column, seed: int = 42, ratios: SplitRatios = SplitRatios()) -> Column:
    u = uniform(seed, "split", id)
    return F.when(u < ratios.train, "train").when(u < ratios.train + ratios.validation, "validation").otherwise("test")


def assign(df: DataFrame, id: str = "id", seed: int = 42, ratios: SplitRatios = SplitRatios(), overrides: DataFrame | None = None) -> DataFrame:
    """The frame with ``split``; rows named in ``overrides`` (id, split) take theirs."""
    label = split_label(F.col(id), seed, ratios)
    if overrides is None:
        return df.withColumn("split", label)
    given = overrides.select(F.col("id").alias(id), F.col("split").alias("given"))
    return df.join(given, id, "left").withColumn("split", F.coalesce("given", label)).drop("given")


def ranked(df: DataFrame, by: tuple[str, ...], range_: Column, order: list, name: str = "pos") -> DataFrame:
    """The frame with ``name``: each row's place in its group, from 0, in an order that begins with
    ``range_``. Ranges are ranked each on its own and moved by the sizes of those before, so no task
    sorts a whole group."""
    ranged = df.withColumn("_range", range_)
    sizes = ranged.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    inside = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)) - 1
    met = ranged.withColumn("_in", inside).join(sizes.select(*by, "_range", before.alias("_before")), [*by, "_range"])
    return met.withColumn(name, (F.col("_before") + F.col("_in")).cast("long")).drop("_range", "_in", "_before")


def hash_ranked(df: DataFrame, by: tuple[str, ...], hashed: Column, id: str, name: str = "pos", bits: int = 8) -> DataFrame:
    """``ranked`` in the order of a hash52."""
    return ranked(df.withColumn("_hash", hashed), by, F.shiftright("_hash", 52 - bits), ["_hash", id], name).drop("_hash")


def source_order(df: DataFrame, epoch: int = 0, seed: int = 42, id: str = "id", by: tuple[str, ...] = ("source",)) -> DataFrame:
    """The frame with ``pos``: the place of each record within its source in this epoch."""
    return hash_ranked(df, by, hash52(seed ^ epoch, "order", F.col(id)), id)


def source_cycle(sources: DataFrame, cycles: int, epoch: int = 0, seed: int = 42) -> DataFrame:
    """cycle, pos, source: the sources in a fresh order each cycle. ``sources`` has one row a source."""
    each = sources.select("source").distinct().crossJoin(sources.sparkSession.range(cycles).withColumnRenamed("id", "cycle"))
    w = Window.partitionBy("cycle").orderBy(hash52(seed ^ epoch, F.col("cycle"), F.col("source")), "source")
    return each.withColumn("pos", F.row_number().over(w) - 1)


def anchor_rotation(ordered: DataFrame, slots: DataFrame, seed: int = 42, id: str = "id") -> DataFrame:
    """slots (source, visit) with the record that each visits: position (visit + offset) mod size, the
    offset hashed for each round through the source."""
    size = ordered.groupBy("source").agg(F.count("*").alias("size"))
    turn = F.floor(F.col("visit") / F.col("size")).cast("long")
    placed = slots.join(size, "source").withColumn("pos", ((F.col("visit") + hash52(seed, "offset", F.col("source"), turn)) % F.col("size")).cast("long"))
    return placed.join(ordered.select("source", "pos", id), ["source", "pos"]).select("source", "visit", id)


def interleave(df: DataFrame, epoch: int = 0, seed: int = 42, id: str = "id") -> DataFrame:
    """turn, place, source, id: sources take turns in hashed order; short sources begin again until the
    longest is through. Each source is repeated by a join on its position, so no row of the long
    sources moves more than once."""
    ordered = source_order(df.select("source", id), epoch, seed, id)
    sizes = ordered.groupBy("source").agg(F.count("*").alias("size"))
    longest = sizes.agg(F.max("size").alias("longest"))
    place = F.row_number().over(Window.orderBy(hash52(seed ^ epoch, "source", F.col("source")), "source")) - 1  # one row a source
    sizes = sizes.withColumn("place", place).crossJoin(F.broadcast(longest))
    times = F.ceil((F.col("longest") - F.col("pos")) / F.col("size")).cast("int")
    return (
        ordered.join(F.broadcast(sizes), "source")
        .withColumn("lap", F.explode(F.sequence(F.lit(0), times - 1)))
        .select((F.col("pos") + F.col("lap") * F.col("size")).alias("turn"), "place", "source", id)
    )


def reconcile(order: DataFrame, consumed: DataFrame, id: str = "id", by: tuple[str, ...] = ("source",), span: int = 1 << 16) -> DataFrame:
    """An epoch's order (pos within ``by``) after its population changed: ids that were consumed go to the
    end, both parts in their order; ``consumed`` says which."""
    seen = consumed.select(id).distinct().withColumn("seen", F.lit(True))
    flagged = order.join(seen, id, "left").withColumn("consumed", F.coalesce("seen", F.lit(False))).drop("seen")
    at = F.struct("consumed", F.floor(F.col("pos") / span).alias("at"))
    return ranked(flagged.withColumnRenamed("pos", "was").withColumn("pos", F.col("was")), by, at, ["pos"], "pos").drop("was")


def resumed(order: DataFrame, consumed: DataFrame, checksum: int | None, seed: int = 42, id: str = "id") -> DataFrame:
    """The order to go on with: as it is where the population is the one of ``checksum``, else reconciled."""
    now = population_checksum(order, id).first().checksum if checksum is not None else None
    return order if checksum is not None and now == checksum else reconcile(order, consumed, id).drop("consumed")


def population_checksum(df: DataFrame, id: str = "id") -> DataFrame:
    """One row: n and checksum, independent of order."""
    return df.agg(F.count("*").alias("n"), F.bit_xor(hash52("population", F.col("source"), F.col(id))).alias("checksum"))
