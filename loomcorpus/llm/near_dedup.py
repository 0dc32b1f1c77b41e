"""Near duplicates by BagMinHash: weighted signatures of the multiset of word shingles, banding, and
verification of the exact multiset overlap.

A shingle that a text has w times owns, on the axis of discretised weights, the levels up to w. The
axis is cut into the intervals (0,1], (1,2], (2,4], (4,8], ...; each holds a Poisson process whose
rate is its width and whose points are shared by all texts with that shingle. Points come in order
of time. Whether a point lies within w is what descending the halves of its interval would find out;
as weights are whole numbers, its place, drawn once, is compared with the text's share of the interval
instead. Those inside compete for one of the signature's components. The earliest point of a component
is the same in two texts with just the probability of their weighted Jaccard index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, Shared, documents, list_array, pick, release, slices
from .words import Words, bags, mix, split_hashes

NAME = "op7_near_dedup"
SQL = None
#: Words a shingle, bands, components a band, and the overlap from which texts are near copies.
SHINGLE = 3
BANDS = 21
ROWS = 3
OVERLAP = 0.5
#: Components of two signatures that must agree for an exact comparison. At the least overlap 31 of 63
#: do on average; fewer than 16 by chance in 1 of 20,000 pairs, where banding misses 1 of 16.
AGREE = 16
#: Ids, and edges, up to which a set is sent to the executors or handled on the driver (8 and 16 bytes
#: each); larger sets are joined.
SENT_IDS = 1_000_000
SENT_EDGES = 1_000_000
#: Documents of a bucket that are compared with each other, or with as many others, in one task; and
#: rows of small buckets that a task takes together.
BLOCK = 4096
TOGETHER = 50_000
#: A shingle and its count in one number: 40 bits and 24 bits.
COUNT_BITS = 24
U = np.uint64


def signatures(text: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int, m: int) -> np.ndarray:
    """The m components of each of n texts' signatures, from its distinct shingles and counts; a
    text without shingles has infinities."""
    out = np.full(n * m, np.inf)
    total = np.bincount(text, count, n)
    open_ = total > 0
    budget = m * (np.log(m) + 4.0)  # points until all components are likely to have one
    while open_.any():
        mine = open_[text]
        _points(text[mine], shingle[mine], count[mine], np.where(total > 0, budget / np.maximum(total, 1), 0), m, out)
        filled = np.isfinite(out.reshape(n, m)).all(axis=1)
        open_ &= ~filled
        budget *= 2
    return out.reshape(n, m)


def _points(text, shingle, count, horizon, m, out) -> None:  # noqa: ANN001
    """All points up to each text's horizon, into the minima ``out``."""
    octaves = np.where(count > 1, 1 + np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64), 1)
    row = np.repeat(np.arange(len(text)), octaves)
    octave = np.arange(len(row)) - np.repeat(np.cumsum(octaves) - octaves, octaves)
    low = np.where(octave > 0, 1 << np.maximum(octave - 1, 0), 0)
    width = np.maximum(low, 1)
    inside = np.minimum(count[row] - low, width) / width  # share of the interval that the text owns
    state = mix(shingle[row] * U(0x9E3779B97F4A7C15) + octave.astype(U) * U(0xD1B54A32D192ED03))
    doc = text[row]
    until = horizon[doc]
    time = np.zeros(len(row))
    rate = width.astype(np.float64)
    while len(doc):
        state = mix(state + U(0x9E3779B97F4A7C15))
        time = time - np.log(((state >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        live = time <= until
        if not live.all():
            state, time, rate, doc, until, inside = state[live], time[live], rate[live], doc[live], until[live], inside[live]
        draw = mix(state ^ U(0xA0761D6478BD642F))
        component = ((draw >> U(32)) * U(m) >> U(32)).astype(np.int64)
        # the low bits are the point's way down the halves of its interval
        own = ((draw & U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32) < inside
        np.minimum.at(out, (doc * m + component)[own], time[own])


_words = Words(plain=False)


_BANDED = "doc_id bigint, bag_a bigint, bag_b bigint, sig binary, bands array<bigint>"


def banded(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, bag_a, bag_b, sig, bands of every text with a word: two hashes of the whole multiset,
    16 bits of each component of the signature, and one hash per band of it."""
    out = pa.schema([("doc_id", pa.int64()), ("bag_a", pa.int64()), ("bag_b", pa.int64()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                hashes, lengths = split_hashes(_words, piece["text"].to_pylist())
                text, sh, count = bags(hashes, lengths, shingle)
                n, m = len(lengths), bands * rows
                sig = mix(signatures(text, sh, count, n, m).view(U))
                key = np.tile(np.arange(1, bands + 1, dtype=U), (n, 1))
                for j in range(rows):
                    key = mix(key * U(0x9E3779B97F4A7C15) + sig[:, j::rows])
                some = lengths > 0
                sums = [np.zeros(n, U), np.zeros(n, U)]
                for s, salt in zip(sums, (1, 2), strict=True):
                    np.add.at(s, text, mix(sh * U(2 * salt + 1) + U(salt)) * count.astype(U))
                key, short = key[some], (sig[some] >> U(48)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece["doc_id"].filter(pa.array(some)),
                        *[pa.array(s[some].view(np.int64)) for s in sums],
                        pa.array([x.tobytes() for x in short], pa.binary()),
                        list_array(key.ravel().view(np.int64), [bands] * len(key), pa.int64()),
                    ],
                    schema=out,
                )

    return docs.mapInArrow(run, _BANDED)


def by_ids(table: DataFrame, ids: DataFrame, how: str, sent: int | None = None) -> DataFrame:
    """left_semi or left_anti of the table with a set of doc_ids: sent out if it is small, else
    joined by a shuffle."""
    sent = SENT_IDS if sent is None else sent
    small = ids.limit(sent + 1).count() <= sent
    return table.join(F.broadcast(ids) if small else ids.hint("merge"), "doc_id", how)


def shingled(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, bag: the distinct shingles of each text in order, each with its count in one number."""
    out = pa.schema([("doc_id", pa.int64()), ("bag", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                hashes, lengths = split_hashes(_words, piece["text"].to_pylist())
                text, sh, count = bags(hashes, lengths, shingle)
                packed = (sh >> U(8)) << U(COUNT_BITS) | np.minimum(count, (1 << COUNT_BITS) - 1).astype(U)
                edge = np.searchsorted(text, np.arange(len(lengths) + 1))
                yield pa.RecordBatch.from_arrays([piece["doc_id"], pa.array([packed[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)], pa.binary())], schema=out)

    return docs.mapInArrow(run, "doc_id bigint, bag binary")


def agreement(pairs: DataFrame) -> DataFrame:
    """a, b, agree: how many components of sig_a and sig_b are the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b[c].to_pylist()), np.uint16).reshape(b.num_rows, -1) for c in ("sig_a", "sig_b"))
            same = (x == y).sum(axis=1) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b["a"], b["b"], pa.array(same.astype(np.int32))], names=["a", "b", "agree"])

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a bigint, b bigint, agree int")


def verified(pairs: DataFrame, bagged: DataFrame, overlap: float) -> DataFrame:
    """The pairs (a, b) whose multisets of shingles overlap by at least ``overlap``."""
    met = pairs.select("a", "b")
    for side in ("a", "b"):
        met = met.join(bagged.select(F.col("doc_id").alias(side), F.col("bag").alias(f"bag_{side}")), side)
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "bag_a", 8_000_000):
                n, keys, counts, total = piece.num_rows, [], [], np.zeros(piece.num_rows)
                for side in ("bag_a", "bag_b"):
                    raw = piece[side].to_pylist()
                    length = np.array([len(x) // 8 for x in raw], np.int64)
                    flat = np.frombuffer(b"".join(raw), U)
                    pair = np.repeat(np.arange(n), length)
                    count = (flat & U((1 << COUNT_BITS) - 1)).astype(np.int64)
                    total += np.bincount(pair, count, n)
                    keys.append(pair.astype(U) << U(64 - COUNT_BITS) | flat >> U(COUNT_BITS))
                    counts.append(count)
                key, count = np.concatenate(keys), np.concatenate(counts)
                by = np.argsort(key, kind="stable")
                key, count = key[by], count[by]
                both = np.flatnonzero(key[1:] == key[:-1])
                common = np.bincount((key[both] >> U(64 - COUNT_BITS)).astype(np.int64), np.minimum(count[both], count[both + 1]), n)
                yield pa.RecordBatch.from_arrays([piece["a"], piece["b"]], names=["a", "b"]).filter(pa.array(common >= overlap * (total - common))).cast(out)

    return met.mapInArrow(run, "a bigint, b bigint")


def _smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges, and the smallest node that each is connected with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def components(shared: Shared, edges: DataFrame, name: str, sent: int | None = None) -> DataFrame:
    """(doc_id, label): every node's smallest connected node. Few edges are connected on the driver;
    more by passing labels along edges and then to the labels' own labels until nothing changes."""
    spark, sent = edges.sparkSession, SENT_EDGES if sent is None else sent
    edges = shared.table(edges.select("a", "b").filter("a <> b").distinct(), f"{name}-pairs")
    if edges.count() <= sent:
        table = edges.toArrow()
        nodes, label = _smallest(table["a"].to_numpy(), table["b"].to_numpy())
        return shared.table(spark.createDataFrame(pa.table({"doc_id": nodes.astype(np.int64), "label": label.astype(np.int64)})), name)
    both = shared.table(edges.union(edges.select("b", "a")), f"{name}-edges")
    labels = shared.table(both.select(F.col("a").alias("doc_id")).distinct().withColumn("label", F.col("doc_id")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.withColumnRenamed("doc_id", "b"), "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "doc_id").select("doc_id", "label", F.least("label", "near").alias("next"))
        lower = shared.table(lower, f"{name}-lower{step}")
        jump = lower.select(F.col("doc_id").alias("next"), F.col("next").alias("far"))
        moved = shared.table(lower.join(jump, "next").select("doc_id", F.col("far").alias("label"), (F.col("far") != F.col("label")).alias("moved")), f"{name}-{step}")
        shared.drop(f"{name}-lower{step}")
        shared.drop(f"{name}-{step - 1}")
        if not moved.filter("moved").head(1):
            return moved.select("doc_id", "label")
        labels = moved.select("doc_id", "label")


def _pairs_of(rows: pa.Table, agree: int) -> pa.Table:
    """a, b, label_a, label_b, agree of the pairs of one task's buckets that are of different groups
    and agree enough; where the buckets' rows are of two blocks, pairs of the two only."""
    rows = rows.sort_by("key")
    key, doc, label, block = (rows[c].to_numpy() for c in ("key", "doc_id", "label", "block"))
    sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), np.uint16).reshape(rows.num_rows, -1)
    cross = len(rows) and rows["i"][0].as_py() != rows["j"][0].as_py()
    found = []
    for start, stop in zip(edges := np.flatnonzero(np.append(True, key[1:] != key[:-1])), np.append(edges[1:], len(key)), strict=True):
        here = np.arange(start, stop)
        one, two = (here[block[here] == rows["i"][0].as_py()], here[block[here] == rows["j"][0].as_py()]) if cross else (here, here)
        for some in np.array_split(one, -(-len(one) // 256) or 1):  # 256 rows against a block at once
            same = np.zeros((len(some), len(two)), np.uint8)
            for c in range(sig.shape[1]):
                same += sig[some, c][:, None] == sig[two, c][None, :]
            x, y = np.nonzero((same >= agree) & (label[some][:, None] != label[two][None, :]))
            a, b, n = some[x], two[y], same[x, y]
            keep = doc[a] != doc[b] if cross else doc[a] > doc[b]
            found.append((a[keep], b[keep], n[keep]))
    a, b, n = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    swap = doc[a] < doc[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    return pa.table({"a": doc[a], "b": doc[b], "label_a": label[a], "label_b": label[b], "agree": n.astype(np.int32)})


def mixed_pairs(members: DataFrame, groups: DataFrame, sigs: DataFrame, agree: int, block: int) -> DataFrame:
    """The pairs of all buckets that hold documents of several groups. Small buckets share tasks; of
    large ones every two blocks meet in a task of their own, so no task grows with a bucket."""
    label = members.join(groups, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    mixed = label.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).filter("low <> high")
    rest = label.join(mixed.select("key", "n"), "key").join(sigs, "doc_id").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    own = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).otherwise(0).cast("int")
    rest = rest.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = F.lit(-(-members.count() // TOGETHER) or 1)
    rest = rest.withColumn("task", F.when(F.col("blocks") > 1, F.col("key")).otherwise(F.pmod("key", tasks)))
    rest = rest.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    rest = rest.select("key", "doc_id", "label", "block", "sig", "task", (F.col("blocks") > 1).alias("large"), "i", "j")
    return rest.groupBy("task", "large", "i", "j").applyInArrow(lambda t: _pairs_of(t, agree), "a bigint, b bigint, label_a bigint, label_b bigint, agree int")


def near_groups(df: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, overlap: float = OVERLAP, agree: int = AGREE, block: int = BLOCK) -> DataFrame:
    """doc_id, group_id, keep, copies, links of every document that has near copies; group_id is the
    smallest doc_id of the group, whose document is the one to keep. copies is how many documents have
    the same multiset of shingles, links how many other texts a document's text was compared with and
    found near; texts that hang together already are not compared again.

    Two documents are near copies if their multisets of word shingles overlap (weighted Jaccard) by
    at least ``overlap``; case and punctuation at the ends of words don't count. Groups are
    connected by verified pairs; equal multisets are one text, which is compared once. In a bucket
    every text is compared with the smallest document first; then the best candidate of every
    other group; then all pairs that are still of different groups. So any two texts of different
    groups that share a bucket, and agree in ``agree`` components, have been compared. Null, empty
    and blank texts and null doc_ids have no near copies. Rows with the same doc_id are one
    document, whose text is the smallest of theirs. Texts of fewer words than a shingle count as one shingle. Extra columns are ignored;
    an empty table gives an empty result; texts are read whole, however long.
    """
    spark = df.sparkSession
    shared = Shared(spark, "near")
    docs = pick(df, "doc_id", "text").filter("doc_id is not null and text is not null")
    again = shared.table(docs.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "again")
    if again.head(1):
        whole = by_ids(docs, again, "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
        docs = by_ids(docs, again, "left_anti").unionByName(whole)
    signed = shared.table(banded(docs, shingle, bands, rows), "bands", "snappy")
    one = F.min(F.struct("doc_id", "sig", "bands")).alias("r")
    texts = shared.table(signed.groupBy("bag_a", "bag_b").agg(one).select("bag_a", "bag_b", "r.*"), "texts")
    of = signed.select("doc_id", "bag_a", "bag_b").join(texts.select("bag_a", "bag_b", F.col("doc_id").alias("first")), ["bag_a", "bag_b"])
    of = shared.table(of.select("doc_id", "first"), "of")
    shared.drop("bands")
    sizes = of.groupBy("first").agg(F.count("*").alias("copies"))
    keyed = texts.select("doc_id", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("hub")).filter("n > 1").select("key", "hub")
    members = shared.table(keyed.join(buckets, "key"), "members")
    release(spark)
    ids = shared.table(members.select("doc_id").distinct(), "ids")
    sigs = shared.table(by_ids(texts.select("doc_id", "sig"), ids, "left_semi"), "sigs")
    bagged = shared.table(shingled(by_ids(docs, ids, "left_semi"), shingle), "bags")
    release(spark)
    side = lambda c: sigs.select(F.col("doc_id").alias(c), F.col("sig").alias(f"sig_{c}"))
    star = members.filter("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct()
    star = agreement(star.join(side("a"), "a").join(side("b"), "b")).filter(F.col("agree") >= agree)
    tried = shared.table(star.groupBy("a").agg(F.max(F.struct("agree", (-F.col("b")).alias("b"))).alias("m")).select("a", (-F.col("m.b")).alias("b")), "tried0")
    members, groups = members.select("key", "doc_id"), None
    for turn in range(3):
        good = shared.table(verified(tried, bagged, overlap), f"good{turn}")
        edges = good if turn == 0 else edges.unionByName(good)  # noqa: F821
        groups = components(shared, edges, f"groups{turn}")
        if turn == 2:
            break
        every = tried if turn == 0 else every.unionByName(tried)  # noqa: F821
        pairs = mixed_pairs(members, groups, sigs, agree, block)
        if turn == 0:  # of each text, the best candidate of every other group in its buckets
            best = F.max(F.struct("agree", (-F.col("b")).alias("b"))).alias("m")
            pairs = pairs.groupBy("a", "label_b").agg(best).select("a", (-F.col("m.b")).alias("b"))
        tried = shared.table(pairs.select("a", "b").distinct().join(every, ["a", "b"], "left_anti"), f"tried{turn + 1}")
        release(spark)
    linked = edges.select("a", "b").union(edges.select("b", "a")).groupBy(F.col("a").alias("first")).agg(F.count("*").alias("links"))
    label = of.join(groups.withColumnRenamed("doc_id", "first"), "first", "left").join(sizes, "first").join(linked, "first", "left")
    group = F.coalesce("label", "first")
    found = label.filter("label is not null or copies > 1").select("doc_id", group.alias("group_id"), (F.col("doc_id") == group).alias("keep"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    result = shared.table(found, "result")
    shared.only("result")
    return result


def one_of_each(df: DataFrame, **settings) -> DataFrame:  # noqa: ANN003
    """The documents without those that near_groups doesn't keep, with the columns of documents; of rows
    with the same doc_id, one stays (with the smallest text; a null text only where there is no other).
    Rows with a null doc_id, and null, empty and blank texts, all stay. Extra columns go; an empty
    table gives an empty result; long texts, ties and repeated rows are as in near_groups."""
    docs = pick(df, *DOCUMENT_COLUMNS)
    shared = Shared(df.sparkSession, "near-kept")
    gone = near_groups(docs, **settings).filter("not keep").select("doc_id")
    kept = by_ids(docs, gone, "left_anti")
    again = shared.table(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "again")
    if not again.head(1):
        return kept
    rest = [c for c in DOCUMENT_COLUMNS if c not in ("doc_id", "text")]
    row = F.struct(F.isnull("text").alias("bare"), "text", *rest)
    single = by_ids(kept, again, "left_semi").groupBy("doc_id").agg(F.min(row).alias("row"))
    return by_ids(kept, again, "left_anti").unionByName(single.select("doc_id", *[F.col(f"row.{c}").alias(c) for c in ("text", *rest)]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))
