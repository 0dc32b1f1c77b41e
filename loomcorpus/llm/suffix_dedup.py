"""Passages of many words that repeat across documents, by merging Burrows-Wheeler transforms.

Every run of ``words`` words owns an anchor: the smallest hashed gram in it. Runs that are equal have
equal anchors, so a text is cut into pieces (all runs of one anchor) and only pieces of one anchor
need comparing. Pieces that are equal as a whole are counted, and so are the runs of anchors with so
many different pieces that no task should hold them all. Of other different pieces with a common anchor, each task that reads texts builds the transform of its own shard; the shards of a bucket of
anchors are then merged by refining their interleave one word at a time, as often as the passage has
words: two suffixes part in the round of their first different word, which is their common prefix,
and rows that never part are the repeated intervals. No suffix is sorted again in merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, Shared, documents, pick, release, slices
from .near_dedup import by_ids
from .words import Words, mix, split_hashes

NAME = "op4_suffix_dedup"
#: Words from which a passage counts, and words of the gram that anchors it.
WORDS = 50
GRAM = 8
#: Words that one bucket of merging holds about, and pieces of one anchor beyond which its runs are
#: counted one by one, so that a bucket's largest anchor has about as many words.
BUCKET_WORDS = 1_000_000
HOT_PIECES = 10_000
U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_BACK = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_plain = Words(plain=True)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    if n:
        out[0] = U(1)
    return np.multiply.accumulate(out)


class Runs:
    """Hashes of all words of a slice of texts, and of any run of them."""

    def __init__(self, texts: list[str | None]):
        self.hash, self.length = split_hashes(_plain, texts)
        n = len(self.hash)
        self.first = np.cumsum(self.length) - self.length
        terms = self.hash * _powers(_BASE, n)
        self.sums = np.concatenate([np.zeros(1, U), np.add.accumulate(terms)])
        self.back = _powers(_BACK, n + 1)

    def run(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.back[start] + (stop - start).astype(U) * U(0xD1B54A32D192ED03))


def cut(runs: Runs, words: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor, start, stop) of the pieces of all texts; starts count in the whole slice."""
    n = len(runs.hash)
    begin = np.arange(max(0, n - words + 1))
    text = np.repeat(np.arange(len(runs.length)), runs.length)
    inside = text[begin] == text[begin + words - 1] if len(begin) else np.zeros(0, bool)
    if not inside.any():
        none = np.zeros(0, np.int64)
        return none, none.astype(U), none, none
    at = np.arange(n - gram + 1)
    grams = runs.run(at, at + gram)
    # the smallest of a run's grams, the first of equal ones
    low = (grams >> U(31) << U(31)) | at.astype(U)
    wide, span = words - gram + 1, 1
    while span * 2 <= wide:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < wide:
        low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
    own = (low & U((1 << 31) - 1)).astype(np.int64)
    begin, own = begin[inside], own[inside]
    new = np.append(True, (own[1:] != own[:-1]) | (text[begin[1:]] != text[begin[:-1]]))
    start = begin[new]
    stop = np.append(begin[np.flatnonzero(new)[1:] - 1], begin[-1]) + words
    return text[start], grams[own[new]], start, stop


def identified(df: DataFrame) -> DataFrame:
    return pick(df, "doc_id", "text").filter("doc_id is not null and text is not null").withColumn("tx", F.xxhash64("text"))


def cut_pieces(docs: DataFrame, words: int, gram: int) -> DataFrame:
    """anchor, piece, doc_id, tx, start, stop of every piece; start and stop count a text's words."""
    out = pa.schema([("anchor", pa.int64()), ("piece", pa.int64()), ("doc_id", pa.int64()), ("tx", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                runs = Runs(part["text"].to_pylist())
                text, anchor, start, stop = cut(runs, words, gram)
                take = pa.array(text)
                first = runs.first[text]
                arrays = [anchor.view(np.int64), runs.run(start, stop).view(np.int64), part["doc_id"].take(take), part["tx"].take(take), (start - first).astype(np.int32), (stop - first).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(a) if isinstance(a, np.ndarray) else a for a in arrays], schema=out)

    return docs.mapInArrow(run, "anchor bigint, piece bigint, doc_id bigint, tx bigint, start int, stop int")


_SHARD = ["bucket", "anchor", "piece", "doc_id", "tx", "start", "length", "bwt"]
SHARD = "bucket bigint, " + ", ".join(f"{c} binary" for c in _SHARD[1:])


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each of several runs, one after the other."""
    return np.repeat(start - np.cumsum(length) + length, length) + np.arange(int(length.sum()))


def transform(symbols: np.ndarray, item: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes, Burrows-Wheeler transform) of items that each end with a 0, bucket by
    bucket; equal suffixes stay in the order of their items."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    ends = np.flatnonzero(np.append(item[1:] != item[:-1], True))
    room = ends[item] - np.arange(n)  # symbols after this one in its item
    step, longest = 1, int(room.max()) + 1
    while step < longest:
        after = np.zeros(n, np.int64)
        ok = np.flatnonzero(room >= step)
        after[ok] = rank[ok + step]
        rank = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)[1].astype(np.int64)
        step *= 2
    order = np.lexsort((rank, bucket[item]))
    before = np.roll(symbols, 1)
    before[np.append(0, ends[:-1] + 1)] = 0
    return order, before[order]


def shard_transforms(docs: DataFrame, words: int, buckets: int) -> DataFrame:
    """Per slice of texts and bucket, the transform of the wanted pieces; docs has ``want``, an array
    of (anchor, piece, start, stop, hot). Hot pieces have no transform: their runs go to bucket -1, the
    runs' hashes in place of the anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                runs = Runs(part["text"].to_pylist())
                parent = pc.list_parent_indices(part["want"]).to_numpy(zero_copy_only=False)
                flat = pc.list_flatten(part["want"])
                anchor, piece, start, stop, hot = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("anchor", "piece", "start", "stop", "hot"))
                doc_ids, txs, start, stop = part["doc_id"].to_numpy(), part["tx"].to_numpy(), start.astype(np.int64), stop.astype(np.int64)
                if hot.any():
                    many = (stop - start - words + 1)[hot]
                    row, at = np.repeat(parent[hot], many), _spread(start[hot], many)
                    begin = runs.first[row] + at
                    cols = {"anchor": runs.run(begin, begin + words).view(np.int64), "doc_id": doc_ids[row], "tx": txs[row], "start": at}
                    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), *[pa.array([cols[n].tobytes() if n in cols else b""], pa.binary()) for n in _SHARD[1:]]], names=_SHARD)
                    if hot.all():
                        continue
                anchor, piece, start, stop, row = (x[~hot] for x in (anchor, piece, start, stop, parent))
                length = stop - start
                begin = runs.first[row] + start
                bucket = (mix(anchor.view(U)) % U(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                row, start, length, begin, anchor, piece, bucket = (x[by] for x in (row, start, length, begin, anchor, piece, bucket))
                doc_id = doc_ids[row]
                tx = txs[row]
                symbols = np.zeros(int(length.sum() + len(length)), U)
                item = np.repeat(np.arange(len(length)), length + 1)
                symbols[_spread(np.cumsum(length + 1) - length - 1, length)] = np.maximum(runs.hash[_spread(begin, length)], U(1))
                order, bwt = transform(symbols, item, bucket)
                at = bucket[item[order]]
                for b in np.unique(bucket):
                    lo, hi = np.searchsorted(bucket, (b, b + 1))
                    x, y = np.searchsorted(at, (b, b + 1))
                    cols = [c[lo:hi].astype(np.int64) for c in (anchor, piece, doc_id, tx, start, length)]
                    yield pa.RecordBatch.from_arrays([pa.array([int(b)], pa.int64()), *[pa.array([c.tobytes()], pa.binary()) for c in (*cols, bwt[x:y])]], names=_SHARD)

    return docs.mapInArrow(run, SHARD)


def hot_runs(shards: DataFrame) -> DataFrame:
    """run, doc_id, tx, start of every run in bucket -1."""
    names = ["run", "doc_id", "tx", "start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*[batch[c].to_pylist() for c in ("anchor", "doc_id", "tx", "start")], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in row], names=names)

    return shards.filter("bucket = -1").select("anchor", "doc_id", "tx", "start").mapInArrow(run, "run bigint, doc_id bigint, tx bigint, start bigint")


def _stable(codes: np.ndarray) -> np.ndarray:
    """Stable order of small integers, by radix."""
    low = np.argsort((codes & 0xFFFF).astype(np.uint16), kind="stable")
    high = codes >> 16
    return low if not high.any() else low[np.argsort(high[low].astype(np.uint16), kind="stable")]


def interleave(bwts: list[np.ndarray], items: list[int], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows in merged order, common prefix of each with the row before it, row that precedes each
    row's suffix) of several shards, refined ``depth`` times. Rows count through all shards; a common
    prefix of ``depth`` stands for that or more. Two ends of items are never equal."""
    code = np.unique(np.concatenate([np.zeros(1, U), *bwts]), return_inverse=True)[1][1:].astype(np.int32)
    n = len(code)
    back = np.empty(n, np.int32)
    dollars, at = [], 0
    for bwt, k in zip(bwts, items, strict=True):
        back[at + _stable(code[at : at + len(bwt)])] = np.arange(at, at + len(bwt), dtype=np.int32)
        dollars.append(np.arange(at, at + k, dtype=np.int32))
        at += len(bwt)
    dollars = np.concatenate(dollars)
    rows = np.arange(n, dtype=np.int32)
    first = np.zeros(n, bool)
    first[0] = True
    common = np.full(n, depth, np.int16)
    common[0] = 0
    for h in range(depth):
        here = code[rows]
        block = np.cumsum(first, dtype=np.int32)
        s = _stable(here)
        here, block = here[s], block[s]
        rows = back[rows[s]]
        rows[: len(dollars)] = dollars
        parts = np.append(True, (here[1:] != here[:-1]) | (block[1:] != block[:-1]))
        parts[: len(dollars)] = True
        common[parts & ~first] = h
        first = parts
        if first.all():
            break
    return rows, common, back


def merged(shards: pd.DataFrame, words: int) -> tuple[np.ndarray, ...]:
    """(doc_id, tx, start, stop, later) of the repeated runs of one bucket's shards, joined where
    they touch within a piece; later: only what an earlier text or place has too."""
    shards = shards.sort_values(["anchor", "piece", "doc_id", "start"]).reset_index(drop=True)
    cols = {k: [np.frombuffer(x, np.int64) for x in shards[k]] for k in ("doc_id", "tx", "start", "length")}
    bwts = [np.frombuffer(x, U) for x in shards["bwt"]]
    items = [len(x) for x in cols["start"]]
    doc, tx, start, length = (np.concatenate(cols[k]) for k in ("doc_id", "tx", "start", "length"))
    rows, common, back = interleave(bwts, items, words)
    # every item's words, from its end to its start, by the rows that precede each other
    shard_at = np.cumsum([0, *[len(b) for b in bwts]])[:-1]
    row = np.concatenate([at + np.arange(k) for at, k in zip(shard_at, items, strict=True)])
    of, off = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
    alive = np.arange(len(row))
    for k in range(1, int(length.max()) + 1):
        alive = alive[length[alive] >= k]
        row[alive] = back[row[alive]]
        of[row[alive]], off[row[alive]] = alive, length[alive] - k
    equal = common >= words  # with the row before
    equal[0] = False
    hit = equal | np.append(equal[1:], False)
    block = np.cumsum(~equal)[hit]
    of, off = of[rows[hit]], off[rows[hit]]
    if not len(of):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(bool)
    rank = np.empty(len(doc), np.int64)
    rank[np.lexsort((start, tx, doc))] = np.arange(len(doc))
    place = rank[of] * (int(length.max()) + 1) + off
    heads = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    least = np.minimum.reduceat(place, heads)
    later = place != np.repeat(least, np.diff(np.append(heads, len(place))))
    found = []
    for some, flag in ((np.ones(len(of), bool), False), (later, True)):
        o, f = of[some], off[some]
        by = np.lexsort((f, o))
        o, f = o[by], f[by]
        if not len(o):
            continue
        new = np.append(True, (o[1:] != o[:-1]) | (f[1:] > f[:-1] + words))
        head = np.flatnonzero(new)
        tail = np.append(head[1:] - 1, len(o) - 1)
        found.append((doc[o[head]], tx[o[head]], start[o[head]] + f[head], start[o[head]] + f[tail] + words, np.full(len(head), flag)))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _islands(spans: DataFrame) -> DataFrame:
    """Spans of the same text and kind, joined where they overlap or touch."""
    of = Window.partitionBy("doc_id", "tx", "later").orderBy("start", "stop")
    upto = F.max("stop").over(of.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.coalesce((F.col("start") > upto).cast("int"), F.lit(1)))
    marked = marked.withColumn("island", F.sum("new").over(of.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("doc_id", "tx", "later", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def repeated_spans(df: DataFrame, words: int = WORDS, gram: int = GRAM, bucket_words: int = BUCKET_WORDS, hot_pieces: int = HOT_PIECES) -> DataFrame:
    """doc_id, tx, later, start, stop of every maximal span of a text that is covered by runs of
    ``words`` words which occur more than once in the table (another text or place); start and stop
    count words between white space. later: the same for runs that also occur in an earlier place,
    by doc_id, then start; tx is the hash of the text.

    Words are compared as they are. Null and empty texts, texts of fewer words and rows with a null
    doc_id have no spans. Repeated rows repeat each other, but as one doc_id and text they are no
    later copies of each other. Extra columns are ignored; an empty table gives an empty result;
    texts are read whole, however long.
    """
    spark = df.sparkSession
    shared = Shared(spark, "suffix")
    docs = identified(df)
    pieces = shared.table(cut_pieces(docs, words, min(gram, words)), "pieces")
    place = F.struct("doc_id", "tx", "start", "stop")
    kinds = shared.table(pieces.groupBy("anchor", "piece").agg(F.count("*").alias("n"), F.min(place).alias("rep")), "kinds")
    mixed = kinds.groupBy("anchor").agg(F.count("*").alias("variants")).filter("variants > 1")
    reps = kinds.join(mixed, "anchor").select("anchor", "piece", "rep.*", (F.col("variants") > hot_pieces).alias("hot"))
    reps = shared.table(reps, "reps")
    size = reps.filter("not hot").agg(F.sum(F.col("stop") - F.col("start"))).first()[0]
    want = reps.groupBy("doc_id", "tx").agg(F.collect_list(F.struct("anchor", "piece", "start", "stop", "hot")).alias("want"))
    again = shared.table(pick(df, "doc_id").filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "again")
    one = docs  # a text that many rows hold under one doc_id is merged once
    if again.head(1):
        one = by_ids(docs, again, "left_anti").unionByName(by_ids(docs, again, "left_semi").dropDuplicates(["doc_id", "tx"]))
    release(spark)
    shards = shared.table(shard_transforms(one.join(want, ["doc_id", "tx"]), words, max(1, -(-(size or 0) // bucket_words))), "shards", "snappy")
    shared.drop("reps")
    release(spark)

    def merge(bucket: pd.DataFrame) -> pd.DataFrame:
        found = merged(bucket, words)
        return pd.DataFrame(dict(zip(("doc_id", "tx", "start", "stop", "later"), found, strict=True)))

    ranges = shared.table(shards.filter("bucket >= 0").groupBy("bucket").applyInPandas(merge, "doc_id bigint, tx bigint, start bigint, stop bigint, later boolean"), "ranges")
    release(spark)
    if shards.filter("bucket = -1").head(1):
        hot = hot_runs(shards)
        first = hot.groupBy("run").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "tx", "start")).alias("first")).filter("n > 1")
        again = hot.join(first, "run").withColumn("isfirst", F.struct("doc_id", "tx", "start") == F.col("first"))
        both = F.when(F.col("isfirst"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
        spans = again.select("doc_id", "tx", "start", (F.col("start") + words).alias("stop"), F.explode(both).alias("later"))
        ranges = ranges.unionByName(spans)
    copies = pieces.join(kinds.filter("n > 1").select("anchor", "piece", "rep"), ["anchor", "piece"])
    is_rep = (F.col("doc_id") == F.col("rep.doc_id")) & (F.col("tx") == F.col("rep.tx")) & (F.col("start") == F.col("rep.start"))
    kinds_of = F.when(is_rep, F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    copies = copies.select("doc_id", "tx", F.col("start").cast("long"), F.col("stop").cast("long"), F.explode(kinds_of).alias("later"))
    spans = shared.table(_islands(copies.unionByName(ranges)), "spans")
    shared.only("spans")
    return spans


def drop_repeats(df: DataFrame, **settings) -> DataFrame:  # noqa: ANN003
    """The documents, with the columns of documents, without the spans that repeat an earlier place; all
    rows stay, and those without such a span stay as they are (null, empty and short texts and null
    doc_ids too). Of repeated rows with one doc_id and text each stays whole, as none is earlier;
    equal texts of different doc_ids lose what the smallest has. Extra columns go; an empty table
    gives an empty result; texts are cut whole, however long."""
    docs = pick(df, *DOCUMENT_COLUMNS)
    shared = Shared(df.sparkSession, "suffix-cuts")
    later = repeated_spans(docs, **settings).filter("later")
    cuts = shared.table(later.groupBy("doc_id", "tx").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("cuts")), "cuts")

    @F.pandas_udf("string")
    def without(texts, cuts):  # noqa: ANN001, ANN202
        import re

        word = re.compile(r"\S+")
        out = []
        for text, spans in zip(texts, cuts, strict=True):
            if text is None:
                out.append(None)
                continue
            ends = np.array([m.span() for m in word.finditer(text)], np.int64)
            parts, at = [], 0
            for span in spans:
                parts.append(text[at : ends[span["start"], 0]])
                at = int(ends[span["stop"] - 1, 1])
            out.append("".join([*parts, text[at:]]))
        return pd.Series(out)

    # only texts with a cut cross to Python
    cut = docs.withColumn("tx", F.xxhash64("text")).join(cuts, ["doc_id", "tx"], "left").withColumn("new", without(F.when(F.col("cuts").isNotNull(), F.col("text")), "cuts"))
    chars = F.when(F.col("new").isNotNull(), F.length("new").cast("long")).otherwise(F.col("n_chars"))
    return cut.select("doc_id", F.coalesce("new", "text").alias("text"), "lang", "source", chars.alias("n_chars"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, later, start, stop of the spans of all documents."""
    return repeated_spans(documents(spark, sf_dir)).select("doc_id", "later", "start", "stop").distinct()


_SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
SQL = f"""
WITH texts AS (
  SELECT doc_id, list_filter(string_split_regex(text, '{_SPACE}'), lambda w: w <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
runs AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + {WORDS - 1}], ' ')) AS run
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WORDS} + 2)) AS i FROM texts)),
copied AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY run) AS n, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS nth FROM runs),
kinds AS (
  SELECT doc_id, i, FALSE AS later FROM copied WHERE n > 1 UNION ALL SELECT doc_id, i, TRUE FROM copied WHERE nth > 1),
marked AS (
  SELECT *, CASE WHEN i <= lag(i) OVER w + {WORDS} THEN 0 ELSE 1 END AS new FROM kinds WINDOW w AS (PARTITION BY doc_id, later ORDER BY i)),
islands AS (
  SELECT *, sum(new) OVER (PARTITION BY doc_id, later ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM marked)
SELECT doc_id, later, (min(i) - 1)::BIGINT AS start, (max(i) - 1 + {WORDS})::BIGINT AS stop FROM islands GROUP BY doc_id, later, island
"""
