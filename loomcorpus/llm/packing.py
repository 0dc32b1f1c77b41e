"""Best-fit packing by minimum bin slack. Only the histogram of piece lengths decides how bins are
filled, so the driver works on at most one count per length, however many documents there are;
the documents are then matched with the plan by their rank within their length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vocab
from .common import Shared, documents, pick, slices

NAME = "op1_bin_packing"
SQL = None
#: Tokens a training sequence holds.
CAPACITY = 2048
#: Pieces of one length are ranked in buckets of about so many.
BUCKET = 1 << 20


def fullest(lengths: list[int], counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """(length, how many) of the fullest feasible combination of the available lengths, longest
    first. A bitset holds the sums that the lengths so far reach; each length enters as often as
    it is available, in doubling steps; the search ends as soon as the bin can be filled."""
    full, sums, steps = (1 << (capacity + 1)) - 1, 1, []
    for length in lengths:
        left = min(counts[length], capacity // length)
        steps.append((length, left, sums))
        chunk = 1
        while left > 0:
            take = min(chunk, left)
            sums |= (sums << (take * length)) & full
            left -= take
            chunk *= 2
        if sums >> capacity & 1:
            break
    at, found = sums.bit_length() - 1, []
    for length, most, before in reversed(steps):
        n = 0
        while not before >> at & 1:  # the fewest of the shorter ones: the longer ones go first
            at -= length
            n += 1
            assert n <= most
        if n:
            found.append((length, n))
    return found[::-1]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bins, [(length, how many a bin)]) in packing order. A combination stays the fullest while
    the lengths it uses last, so it is taken as many times as they allow at once."""
    counts = {k: v for k, v in histogram.items() if v}
    lengths = sorted(counts, reverse=True)
    bins = []
    while lengths:
        chosen = fullest(lengths, counts, capacity)
        times = min(counts[length] // n for length, n in chosen)
        bins.append((times, chosen))
        for length, n in chosen:
            counts[length] -= times * n
        if any(not counts[length] for length, _ in chosen):
            lengths = [x for x in lengths if counts[x]]
    return bins


def intervals(bins: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, first bin, how many a bin, offset in the bin)."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for times, chosen in bins:
        offset = 0
        for length, n in chosen:
            rows.setdefault(length, []).append((used.get(length, 0), first, n, offset))
            used[length] = used.get(length, 0) + times * n
            offset += length * n
        first += times
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def token_lengths(df: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens of every row, over whole texts; null texts have 0."""
    path = vocabulary or vocab.vocabulary_path()
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocab.encoding(path)
        for batch in batches:
            for piece in slices(batch, "text"):
                n = [len(encoder.encode_to_numpy(t, disallowed_special=())) if t else 0 for t in piece["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([piece["doc_id"], pa.array(n, pa.int64())], schema=out)

    return pick(df, "doc_id", "text").mapInArrow(count, "doc_id bigint, n_tokens bigint")


def pack(df: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """bin_id, bin_offset, doc_id, piece, start, n_tokens: where each piece of each row goes.

    A text over ``capacity`` tokens is cut into pieces of that many and a rest; start is the
    piece's first token in the text. Every token of every text is in exactly one bin, and no bin
    holds more than ``capacity``. Null and empty texts have no tokens and no piece. Repeated rows
    and ties of length are placed one by one, by doc_id and piece; a null doc_id is placed too.
    Extra columns are ignored; an empty table gives an empty result.
    """
    spark = df.sparkSession
    shared = Shared(spark, "packing")
    counted = shared.table(token_lengths(df, vocabulary), "lengths")
    cap = F.lit(capacity)
    pieces = (
        counted.filter("n_tokens > 0")
        .select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), ((F.col("n_tokens") - 1) / cap).cast("int"))).alias("piece"))
        .select("doc_id", "piece", F.least(F.col("n_tokens") - F.col("piece") * cap, cap).cast("int").alias("length"))
    )
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    where = spark.sparkContext.broadcast(intervals(plan(histogram, capacity)))
    # each length has a bucket per BUCKET pieces, so no rank needs one task for a whole length
    buckets = F.create_map(*[F.lit(x) for k, v in histogram.items() if v > BUCKET for x in (k, -(-v // BUCKET))]) if any(v > BUCKET for v in histogram.values()) else None
    many = F.lit(1) if buckets is None else F.coalesce(buckets[F.col("length")], F.lit(1))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), many).cast("int"))
    sizes = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.withColumn("at", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")))
    ranked = ranked.join(starts, ["length", "bucket"]).select("doc_id", "piece", "length", (F.col("before") + F.col("at") - 1).alias("rank"))
    out = pa.schema([("bin_id", pa.int64()), ("bin_offset", pa.int32()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int32())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b["length"].to_numpy()
            rank = b["rank"].to_numpy()
            bin_id, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int32)
            for one in np.unique(length):
                here = np.flatnonzero(length == one)
                table = where.value[int(one)]
                row = table[np.searchsorted(table[:, 0], rank[here], side="right") - 1]
                k = rank[here] - row[:, 0]
                bin_id[here] = row[:, 1] + k // row[:, 2]
                offset[here] = row[:, 3] + k % row[:, 2] * int(one)
            piece = b["piece"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(bin_id), pa.array(offset), b["doc_id"], b["piece"], pa.array(piece.astype(np.int64) * capacity), b["length"]], schema=out)

    return ranked.mapInArrow(place, "bin_id bigint, bin_offset int, doc_id bigint, piece int, start bigint, n_tokens int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
