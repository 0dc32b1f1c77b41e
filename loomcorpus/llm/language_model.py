"""Language-model scores by deleted interpolation of token n-grams.

Weights are learned on held-out counts: for each bucket of contexts that are about equally frequent,
expectation-maximisation finds how much to trust the bigram, the unigram and the uniform distribution
of the other documents. Then the held-out counts join the rest, and every document is scored over its
whole text by the counts of all documents but itself (its own are deleted), so that what only it holds
is new to the model. Bigram counts grow with the corpus and stay distributed; a model of a checked
size is sent to the executors, a larger one is joined with the documents' bigrams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vocab
from .common import Shared, documents, pick, slices

NAME = "op6_lm_scores"
SQL = None
#: One in so many documents is held out.
HELD_OUT = 10
#: Rounds of expectation-maximisation at most, and the change of a weight below which they end.
ROUNDS = 30
SETTLED = 1e-3
#: Bigrams up to which the model is sent to every executor, at 12 bytes each; more are joined.
SENT_BIGRAMS = 6_000_000
#: Least weight of a distribution.
LEAST = 1e-6
#: Keys that a counting task holds before it sends them on.
HELD_KEYS = 3_000_000
BUCKETS = 50


def bucket_of(count: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else 1 + floor(log2(count))."""
    return np.where(count > 0, np.frexp(count.astype(np.float64))[1], 0)


def width_of(size: int) -> tuple[int, type]:
    """Bits of a token id and the type it is kept in; ``size`` itself stands for the begin of a text."""
    return (16, np.uint16) if size < 1 << 16 else (size.bit_length(), np.uint32)


def tokenised(df: DataFrame, path: str, held_out: int, size: int) -> DataFrame:
    """row, doc_id, held, n_tokens, tokens (ids of 2 or 4 bytes) of every row."""
    out = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held", pa.bool_()), ("n_tokens", pa.int32()), ("tokens", pa.binary())])
    kind = width_of(size)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocab.encoding(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [encoder.encode_to_numpy(t, disallowed_special=()).astype(kind) if t else np.zeros(0, kind) for t in part["text"].to_pylist()]
                cols = [part["row"], part["doc_id"], part["held"], pa.array([len(x) for x in ids], pa.int32()), pa.array([x.tobytes() for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, schema=out)

    held = F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(held_out)) == 0)
    rows = pick(df, "doc_id", "text").select("doc_id", "text", held.alias("held"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(run, "row bigint, doc_id bigint, held boolean, n_tokens int, tokens binary")


def keys_of(tokens: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(context and token in one number, text) of every token; a text begins after the id ``size``."""
    bits, kind = width_of(size)
    length = np.array([len(t) // kind().itemsize for t in tokens], np.int64)
    flat = np.frombuffer(b"".join(tokens), kind).astype(np.int64)
    text = np.repeat(np.arange(len(tokens)), length)
    before = np.roll(flat, 1)
    before[(np.cumsum(length) - length)[length > 0]] = size
    return before << bits | flat, text


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted numbers: each once, how often, and where each row's is."""
    new = np.append(True, x[1:] != x[:-1]) if len(x) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return x[first], np.diff(np.append(first, len(x))), np.cumsum(new) - 1


def own_counts(tokens: list[bytes], size: int) -> tuple[np.ndarray, ...]:
    """(text, key, times, context's times, token's times) of the distinct bigrams of each text."""
    bits = width_of(size)[0]
    key, text = keys_of(tokens, size)
    packed, times, _ = _counted(np.sort(text << 2 * bits | key))
    text, key = packed >> 2 * bits, packed & ((1 << 2 * bits) - 1)
    _, _, at = _counted(packed >> bits)
    context = np.bincount(at, times).astype(np.int64)[at] if len(at) else times
    by = text << bits | key & ((1 << bits) - 1)
    order = np.argsort(by, kind="stable")
    _, _, at = _counted(by[order])
    token = np.empty(len(by), np.int64)
    token[order] = np.bincount(at, times[order]).astype(np.int64)[at] if len(at) else 0
    return text, key, times.astype(np.int64), context, token


def bigram_counts(tokens: DataFrame, size: int) -> DataFrame:
    """key, n of all bigrams; each task sends what it has counted, added up."""
    out = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def add(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        return key[first], np.add.reduceat(n, first) if len(key) else n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for part in slices(batch, "tokens", 2_000_000):
                key, n = np.unique(keys_of(part["tokens"].to_pylist(), size)[0], return_counts=True)
                parts.append((key, n.astype(np.int64)))
                held += len(key)
                if held > HELD_KEYS:
                    parts = [add(parts)]
                    held = len(parts[0][0])
                    if held > HELD_KEYS // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts[0]], schema=out)
                        parts, held = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in add(parts)], schema=out)

    return tokens.select("tokens").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


class Interpolation:
    """What is bounded by the vocabulary: unigrams, context counts and the weights of each bucket."""

    def __init__(self, size: int, unigram: np.ndarray, context: np.ndarray, weights: np.ndarray):
        self.size, self.bits = size, width_of(size)[0]
        self.unigram, self.context, self.total = unigram, context, float(unigram.sum())
        self.weights = weights

    def probability(self, key: np.ndarray, count: np.ndarray, own: tuple | None = None) -> np.ndarray:
        """Of tokens after their contexts; ``own`` are the counts (of the bigram, its context, its token,
        all tokens) of the text that is scored, which are taken off."""
        bigram, context, token, total = own or (0, 0, 0, 0)
        count = count - bigram
        context = self.context[key >> self.bits] - context
        token = self.unigram[key & ((1 << self.bits) - 1)] - token
        total = self.total - total
        w = self.weights[bucket_of(context)]
        # a context never seen has no bigram to trust, a corpus of nothing else no unigram; their weight goes to the others
        w2 = np.where(context > 0, w[:, 0], 0)
        w1 = np.where(total > 0, w[:, 1], 0)
        return (w2 * count / np.maximum(context, 1) + w1 * token / np.maximum(total, 1) + w[:, 2] / self.size) / (w2 + w1 + w[:, 2])


def margins(bigrams: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all tokens, and of all contexts, by id."""
    bits = width_of(size)[0]
    out = []
    for side in (F.col("key").bitwiseAND((1 << bits) - 1), F.shiftright("key", bits)):
        into = np.zeros(1 << bits)
        table = bigrams.groupBy(side.cast("int").alias("t")).agg(F.sum("n").alias("n")).toArrow()  # at most the vocabulary
        into[table["t"].to_numpy()] = table["n"].to_numpy()
        out.append(into)
    return out[0], out[1]


def fit(shared: Shared, tokens: DataFrame, size: int, rounds: int = ROUNDS) -> tuple[Interpolation, DataFrame]:
    """The model and its table of bigrams (key, n) of all documents; weights by the held-out ones."""
    bits = width_of(size)[0]
    bigrams = shared.table(bigram_counts(tokens.filter("not held"), size), "trained")
    held = shared.table(bigram_counts(tokens.filter("held"), size), "held")
    unigram, context = margins(bigrams, size)
    total = max(float(unigram.sum()), 1.0)
    met = held.withColumnRenamed("n", "held").join(bigrams, "key", "left")
    out = pa.schema([("bucket", pa.int32()), ("p2", pa.float64()), ("p1", pa.float64()), ("held", pa.int64())])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b["key"].to_numpy()
            n = b["n"].fill_null(0).to_numpy()
            c = context[key >> bits]
            p1 = unigram[key & ((1 << bits) - 1)] / total
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(c).astype(np.int32)), pa.array(np.where(c > 0, n / np.maximum(c, 1), 0.0)), pa.array(p1), b["held"]], schema=out)

    seen = met.select("key", "n", "held").mapInArrow(parts, "bucket int, p2 double, p1 double, held bigint")
    # equal shares count together, which keeps what every round reads small
    seen = shared.table(seen.groupBy("bucket", "p2", "p1").agg(F.sum("held").alias("held")), "seen")
    weights = np.full((BUCKETS, 3), 1 / 3)
    for _ in range(rounds):
        w = [F.element_at(F.array(*[F.lit(float(x)) for x in weights[:, i]]), F.col("bucket") + 1) for i in range(3)]
        shares = [w[0] * F.col("p2"), w[1] * F.col("p1"), w[2] / F.lit(float(size))]
        whole = shares[0] + shares[1] + shares[2]
        sums = seen.groupBy("bucket").agg(*[F.sum(F.col("held") * s / whole).alias(f"s{i}") for i, s in enumerate(shares)]).collect()
        change = 0.0
        for r in sums:
            new = np.array([r.s0, r.s1, r.s2])
            new = np.maximum(new / new.sum(), LEAST) if new.sum() > 0 else weights[r.bucket]
            new = new / new.sum()
            change = max(change, float(np.abs(new - weights[r.bucket]).max()))
            weights[r.bucket] = new
        if change < SETTLED:
            break
    every = shared.table(bigrams.unionByName(held).groupBy("key").agg(F.sum("n").alias("n")), "bigrams")
    return Interpolation(size, *margins(every, size), weights), every


def score(df: DataFrame, vocabulary: str | None = None, held_out: int = HELD_OUT, rounds: int = ROUNDS, sent_bigrams: int = SENT_BIGRAMS) -> DataFrame:
    """doc_id, n_tokens, log_prob (natural), perplexity of every row, over its whole text, by the counts
    of all other rows.

    Null and empty texts have 0 tokens, log_prob 0 and a null perplexity. Repeated rows are rows like
    others: they count each, know each other and score alike; a null doc_id stays null and counts, but
    is never held out. Where nothing is held out (small tables) the three weights are equal, as they
    are in buckets that no held-out context falls into. The only row of a table scores by the uniform
    distribution. Extra columns are ignored; an empty table gives an empty result.
    """
    path = vocabulary or vocab.vocabulary_path()
    spark = df.sparkSession
    shared = Shared(spark, "lm")
    size = vocab.encoding(path).max_token_value + 1
    tokens = shared.table(tokenised(df, path, held_out, size), "tokens")
    model, bigrams = fit(shared, tokens, size, rounds)
    sent = bigrams.count() <= sent_bigrams
    scored = _sent(tokens, model, bigrams) if sent else _joined(tokens, model, bigrams)
    shared.only("tokens", *([] if sent else ["bigrams"]))
    return scored.select("doc_id", "n_tokens", "log_prob", F.when(F.col("n_tokens") > 0, F.exp(-F.col("log_prob") / F.col("n_tokens"))).alias("perplexity"))


def _sent(tokens: DataFrame, model: Interpolation, bigrams: DataFrame) -> DataFrame:
    table = bigrams.toArrow()
    keys, counts = table["key"].to_numpy(), table["n"].to_numpy()
    del table
    order = np.argsort(keys)
    kind = np.uint32 if model.bits == 16 else np.int64
    sent = tokens.sparkSession.sparkContext.broadcast((keys[order].astype(kind), counts[order].astype(np.float64), model))
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int32()), ("log_prob", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, model = sent.value
        for batch in batches:
            for part in slices(batch, "tokens", 2_000_000):
                text, key, times, context, token = own_counts(part["tokens"].to_pylist(), model.size)
                n = count[np.searchsorted(known, key.astype(known.dtype))] if len(key) else np.zeros(0)
                p = model.probability(key, n, (times, context, token, part["n_tokens"].to_numpy()[text]))
                total = np.bincount(text, times * np.log(p), part.num_rows) if len(key) else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["n_tokens"], pa.array(total)], schema=out)

    return tokens.select("doc_id", "n_tokens", "tokens").mapInArrow(run, "doc_id bigint, n_tokens int, log_prob double")


def _joined(tokens: DataFrame, model: Interpolation, bigrams: DataFrame) -> DataFrame:
    """The same where the model is too large to send: each row's distinct bigrams meet their counts."""
    names = ("row", "key", "times", "context", "token", "total")
    asked = pa.schema([(n, pa.int64()) for n in names])
    size = model.size

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "tokens", 2_000_000):
                text, *counts = own_counts(part["tokens"].to_pylist(), size)
                row, total = part["row"].to_numpy()[text], part["n_tokens"].to_numpy().astype(np.int64)[text]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (row, *counts, total)], schema=asked)

    logged = pa.schema([("row", pa.int64()), ("log_prob", pa.float64())])

    def logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = tuple(b[x].to_numpy() for x in names[2:])
            p = model.probability(b["key"].to_numpy(), b["n"].to_numpy().astype(np.float64), own)
            yield pa.RecordBatch.from_arrays([b["row"], pa.array(own[0] * np.log(p))], schema=logged)

    met = tokens.select("row", "n_tokens", "tokens").mapInArrow(ask, ", ".join(f"{n} bigint" for n in names)).join(bigrams, "key")
    sums = met.select(*names, "n").mapInArrow(logs, "row bigint, log_prob double").groupBy("row").agg(F.sum("log_prob").alias("log_prob"))
    return tokens.select("row", "doc_id", "n_tokens").join(sums, "row", "left").select("doc_id", "n_tokens", F.coalesce("log_prob", F.lit(0.0)).alias("log_prob"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
