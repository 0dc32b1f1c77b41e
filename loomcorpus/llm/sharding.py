"""Sharding by sampled splitters: size-weighted key samples give quantile boundaries; records are
range-partitioned between them; ranges that come out overfull are subdivided."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import DOCUMENT_COLUMNS, Shared, documents, pick

NAME = "op9_sharding"
#: Shards that a table is cut into at least, and bytes that one should hold between these bounds.
SHARDS = 64
LEAST_BYTES, MOST_BYTES = 16 << 10, 64 << 20
#: Samples a shard, bytes a record counts beside its text, and the share of the target from which a
#: range is overfull.
SAMPLES_PER_SHARD = 64
RECORD_BYTES = 64
OVERFULL = 1.25
#: Boundaries that are sent to every executor (about 32 bytes each); of more, every so many are sent
#: and those between are joined.
LEVEL = 2_000_000
#: Rows that one task sorts about, of the sample or of overfull ranges.
SORTED_ROWS = 1_000_000


def _sized(df: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    weight = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + F.lit(RECORD_BYTES)
    some = pick(df, *dict.fromkeys(("doc_id", "text", "source", *carry)))
    return some.select(
        F.coalesce("source", F.lit("")).alias("shard_source"), "doc_id", F.coalesce("doc_id", F.lit(-1)).alias("key"), weight.alias("weight"), *[c for c in carry if c != "doc_id"]
    )


def _hits(step: int) -> Column:
    """How many of the points every ``step`` bytes, from an offset hashed from the record, fall into
    its bytes; so a record is drawn by its size."""
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("weight").cast("string")))
    offset = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % F.lit(step)
    return F.floor((F.col("weight") + offset) / F.lit(step)).cast("long")


def running(shared: Shared, df: DataFrame, value: str, order: list, name: str, rows: int) -> DataFrame:
    """The table with ``upto``: the sum of ``value`` up to each row in the order. Ranges of about so
    many rows are summed each on its own; through the driver goes one sum a range."""
    df = shared.table(df, f"{name}-rows")
    ranges = -(-df.count() // rows) or 1
    cut = shared.table(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), name)
    shared.drop(f"{name}-rows")
    sums, before, at = {r["_range"]: r.s for r in cut.groupBy("_range").agg(F.sum(value).alias("s")).collect()}, {}, 0
    for k in sorted(sums):
        before[k], at = at, at + sums[k]
    earlier = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("_range")) if before else F.lit(0)
    inside = F.sum(value).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("upto", earlier + inside).drop("_range")


def boundaries(shared: Shared, narrow: DataFrame, total: int, target: int, rows: int = SORTED_ROWS) -> tuple[list[str], np.ndarray]:
    """Sources and keys of the splitters in order: the size quantiles of the sample, found in Spark;
    the driver gets splitters only, one a shard, never the sample."""
    hits = narrow.withColumn("hits", _hits(max(1, target // SAMPLES_PER_SHARD))).filter("hits > 0")
    drawn = running(shared, hits.groupBy("shard_source", "key").agg(F.sum("hits").alias("hits")), "hits", ["shard_source", "key"], "sample", rows)
    h = drawn.agg(F.max("upto")).first()[0] or 1
    quantile = lambda c: F.floor(c.cast("decimal(38,0)") * F.lit(max(1, -(-total // target))) / F.lit(h))
    crossed = quantile(F.col("upto") - F.col("hits")) < quantile(F.col("upto"))
    cuts = drawn.filter(crossed & (F.col("upto") < h)).orderBy("shard_source", "key").select("shard_source", "key").toArrow()
    return cuts["shard_source"].to_pylist(), cuts["key"].to_numpy()


def place(df: DataFrame, sources: list[str], keys: np.ndarray) -> DataFrame:
    """The table with ``range_id``: the number of boundaries under the record's (source, key)."""
    names, first = np.unique(np.array(sources, object), return_index=True) if sources else (np.zeros(0, object), np.zeros(0, np.int64))
    sent = df.sparkSession.sparkContext.broadcast((names.tolist(), np.append(first, len(keys)), keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import bisect

        names, first, keys = sent.value
        for b in batches:
            source, key = b["shard_source"].dictionary_encode(), b["key"].to_numpy()
            code, ids = source.indices.to_numpy(), np.zeros(len(key), np.int64)
            for i, name in enumerate(source.dictionary.to_pylist()):  # a few sources a batch
                mine, at = code == i, bisect.bisect_left(names, name)
                ids[mine] = first[at] + (np.searchsorted(keys[first[at] : first[at + 1]], key[mine]) if at < len(names) and names[at] == name else 0)
            yield b.append_column("range_id", pa.array(ids))

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("range_id", T.LongType())]))


def placed(df: DataFrame, sources: list[str], keys: np.ndarray, level: int = LEVEL) -> DataFrame:
    """``place``; more boundaries than ``level`` are placed in two steps, the second by a join."""
    if len(keys) <= level:
        return place(df, sources, keys)
    step = -(-len(keys) // level)
    rows = [(i, [] if not i else [(s, int(k)) for s, k in zip(sources[(i - 1) * step : i * step], keys[(i - 1) * step : i * step], strict=True)]) for i in range(-(-len(keys) // step) + 1)]
    fine = df.sparkSession.createDataFrame(rows, "range_id bigint, cuts array<struct<s:string,k:bigint>>")
    under = F.filter("cuts", lambda c: (c["s"] < F.col("shard_source")) | ((c["s"] == F.col("shard_source")) & (c["k"] < F.col("key"))))
    base = F.greatest(F.col("range_id") - 1, F.lit(0)) * step
    return place(df, sources[::step], keys[::step]).join(fine, "range_id").select(*df.columns, (base + F.size(under)).alias("range_id"))


def shard(df: DataFrame, target: int | None = None, shards: int = SHARDS, level: int = LEVEL, rows: int = SORTED_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, range_id, part, weight (and the columns ``carry``) of every row; (range_id, part) is its
    shard. A shard holds about ``target`` bytes: if none are given, the table's share of ``shards``,
    LEAST_BYTES at least and MOST_BYTES at most.

    Rows are ordered by (source, doc_id); a null source counts as '' and a null doc_id as -1 in
    that order. A row's weight is its bytes of UTF-8 and RECORD_BYTES more, so rows with a null
    or empty text are placed too. Ranges over OVERFULL times the target are cut where their
    running weight passes multiples of the target; so ties and repeated rows can be split, and a
    row larger than the target is a part of its own with what starts before its end. An empty
    table gives an empty result; extra columns are ignored.
    """
    shared = Shared(df.sparkSession, "shards")
    sized = _sized(df, carry)
    narrow = shared.table(sized.select("shard_source", "doc_id", "key", "weight"), "sized")
    total = narrow.agg(F.sum("weight")).first()[0] or 0
    target = target or min(MOST_BYTES, max(LEAST_BYTES, total // shards))
    sources, keys = boundaries(shared, narrow, total, target, rows)
    ranged = placed(sized if carry else narrow, sources, keys, level)
    sums = (ranged if not carry else placed(narrow, sources, keys, level)).groupBy("range_id").agg(F.sum("weight").alias("w"))
    over = shared.table(sums.filter(F.col("w") > int(OVERFULL * target)), "over")
    out = ["doc_id", "range_id", "part", "weight", *[c for c in carry if c != "doc_id"]]
    if not over.head(1):
        return ranged.withColumn("part", F.lit(0).cast("long")).select(*out)
    # rows that are alike in all of the order may stand for each other, so their place in the files tells them apart
    order = ["range_id", "shard_source", "key", "weight", F.isnull("doc_id"), "_at"]
    heavy = running(shared, ranged.join(over.select("range_id"), "range_id", "left_semi").withColumn("_at", F.monotonically_increasing_id()), "weight", order, "heavy", rows)
    # what lies before a range in the order is the weight of the overfull ranges before it
    starts = running(shared, over, "w", ["range_id"], "starts", rows).select("range_id", (F.col("upto") - F.col("w")).alias("_start"))
    part = F.floor((F.col("upto") - F.col("weight") - F.col("_start")) / F.lit(target)).cast("long")
    light = ranged.join(over.select("range_id"), "range_id", "left_anti").withColumn("part", F.lit(0).cast("long"))
    return light.select(*out).unionByName(heavy.join(starts, "range_id").withColumn("part", part).select(*out))


def write_shards(df: DataFrame, path: str, **settings) -> None:  # noqa: ANN003
    """Writes the documents as Parquet, a folder a shard (range_id=.../part=...), sorted by source and doc_id in it."""
    rows = shard(df, carry=DOCUMENT_COLUMNS, **settings)
    cut = rows.drop("weight").repartition("range_id", "part").sortWithinPartitions("range_id", "part", "source", "doc_id")
    cut.write.mode("overwrite").partitionBy("range_id", "part").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))


def sql(target: int | None = None) -> str:
    size = f"{target}" if target else f"least({MOST_BYTES}, greatest({LEAST_BYTES}, w // {SHARDS}))"
    return f"""
WITH weighed AS (
  SELECT coalesce(source, '') AS source, doc_id, coalesce(doc_id, -1) AS key, coalesce(strlen(text), 0) + {RECORD_BYTES} AS weight FROM documents),
sizes AS (SELECT w, {size}::BIGINT AS target FROM (SELECT sum(weight)::BIGINT AS w FROM weighed)),
sized AS (
  SELECT weighed.*, target, greatest(1, target // {SAMPLES_PER_SHARD}) AS step,
         (weight + ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '|' || weight::VARCHAR), 1, 12))::BIGINT % step) // step AS hits
  FROM weighed, sizes),
whole AS (SELECT greatest(ceil(sum(weight)::DOUBLE / any_value(target)), 1)::BIGINT AS ranges, sum(hits)::BIGINT AS h FROM sized),
upto AS (SELECT source, key, hits, sum(hits) OVER (ORDER BY source, key ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM (SELECT source, key, sum(hits)::BIGINT AS hits FROM sized WHERE hits > 0 GROUP BY 1, 2)),
cuts AS (SELECT source AS s, key AS k FROM upto, whole
  WHERE (upto - hits) * ranges // h < upto * ranges // h AND upto < h),
placed AS (SELECT d.*, (SELECT count(*) FROM cuts WHERE s < d.source OR (s = d.source AND k < d.key)) AS range_id
  FROM sized d)
SELECT doc_id, range_id::BIGINT AS range_id, CASE WHEN sum(weight) OVER (PARTITION BY range_id) > floor({OVERFULL} * target)
  THEN coalesce(sum(weight) OVER (PARTITION BY range_id ORDER BY source, key, weight, doc_id IS NULL
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // target ELSE 0 END::BIGINT AS part, weight::BIGINT AS weight
FROM placed
"""


SQL = sql()
