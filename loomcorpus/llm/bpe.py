"""BPE encoding by speculation: greedy longest matches propose tokens, one vectorised check tests
every adjacent pair, and only words with a failing pair are merged exactly."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import vocab
from .common import documents, list_array, pick, slices

NAME = "op8_bpe_codec"
SQL = None
#: Words that a Python worker remembers; forgetting them costs time, never results.
REMEMBERED = 250_000
ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int32()), ("tokens", pa.list_(pa.int32())), ("same", pa.bool_())])


def encode_words(v: vocab.Vocab, words: list[str]) -> tuple[list[bytes], int]:
    """The tokens of each word as ids of the vocabulary's width, and how many words had to be merged exactly."""
    raw = [w.encode() for w in words]
    joined = vocab.BREAK.join([w.decode("latin-1") for w in raw])
    matches = v.greedy(joined)
    end, token = matches[0::2], matches[1::2]
    ends = np.cumsum(np.array([len(w) + 1 for w in raw], np.int64))
    word = np.searchsorted(ends, end, side="right")
    inner = np.flatnonzero(word[1:] == word[:-1])
    keys, back = np.unique(token[inner] << vocab.SHIFT | token[inner + 1], return_inverse=True)
    ok = v.compatible(keys >> vocab.SHIFT, keys & ((1 << vocab.SHIFT) - 1))[back] if len(keys) else np.zeros(0, bool)
    failing = np.unique(word[inner[~ok]])
    flat = token.astype(v.kind).tobytes()
    stops = (v.kind().itemsize * np.searchsorted(word, np.arange(len(words)), side="right")).tolist()
    parts, at = [], 0
    for stop in stops:
        parts.append(flat[at:stop])
        at = stop
    for i in failing.tolist():
        parts[i] = array(v.code, v.exact(words[i], raw[i])).tobytes()
    return parts, len(failing)


class Encoder:
    """Encodes texts word by word, remembering words."""

    def __init__(self, path: str):
        self.vocab = vocab.load(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.known) > REMEMBERED:  # words that are met again come back from the older half
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        known.update((w, older[w]) for w in words if w in older)
        new = [w for w in words if w not in known]
        if new:
            parts, _ = encode_words(self.vocab, new)
            self.known.update(zip(new, parts, strict=True))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [self.vocab.splitter.findall(t) if t else [] for t in texts]
        unique: set[str] = set()
        for words in split:
            unique.update(words)
        self.learn(unique)
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), self.vocab.kind) for words in split]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(df: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, tokens, same of every row; same says that decoding gave the text back.

    A null text has null tokens, 0 of them, and a null ``same``; an empty text has an empty list.
    Repeated rows give repeated results; a null doc_id stays null; extra columns are ignored; an
    empty table gives an empty result. Texts are encoded whole, however long.
    """
    path = vocabulary or vocab.vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for piece in slices(batch, "text", 2_000_000):
                texts = piece["text"].to_pylist()
                ids = enc.encode(texts)
                n = [len(x) for x in ids]
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                same = [None if t is None else enc.vocab.decode(x.tolist()) == t.encode() for t, x in zip(texts, ids, strict=True)]
                tokens = list_array(flat, n, pa.int32())
                if None in texts:
                    tokens = pa.ListArray.from_arrays(tokens.offsets, tokens.values, mask=pa.array([t is None for t in texts]))
                yield pa.RecordBatch.from_arrays([piece["doc_id"], pa.array(n, pa.int32()), tokens, pa.array(same, pa.bool_())], schema=ENCODED)

    return pick(df, "doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens int, tokens array<int>, same boolean")


def decode(df: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, text from doc_id, tokens; null tokens give a null text, none an empty one. Bytes that are
    no UTF-8, which only lists made elsewhere hold, become U+FFFD. Repeated rows give repeated results;
    a null doc_id stays null; extra columns are ignored; an empty table gives an empty result; long
    lists are decoded whole."""
    path = vocabulary or vocab.vocabulary_path()
    out = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.load(path)
        for b in batches:
            texts = [None if x is None else v.decode(x).decode("utf-8", "replace") for x in b["tokens"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(texts, pa.string())], schema=out)

    return pick(df, "doc_id", "tokens").mapInArrow(run, "doc_id bigint, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir))
