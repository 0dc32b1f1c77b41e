"""Exact token counts of every prefix of every text.

Within a word, dynamic programming over its prefixes keeps the last token of each: the one token
ending there that is compatible with the last token of what comes before it. A prefix of the text
ends inside one word of the pre-split, so its count is that of the whole words before it and of
the word's own prefix; where cutting changes the pre-split itself (runs of white space,
contractions) the cut words are counted as they would be split then. What is stored per text is
the change of the count at each character; truncation and budget questions read only that."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vocab
from .common import documents, pick, slices

NAME = "op3_token_counts"
SQL = None
REMEMBERED = 250_000
#: Budget whose cut the query reports, beside what is stored.
BUDGET = 2048
SCHEMA = "doc_id bigint, n_chars int, n_tokens int, cut int, width int, changes binary"
RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int32()), ("n_tokens", pa.int32()), ("cut", pa.int32()), ("width", pa.int32()), ("changes", pa.binary())]
)


def word_prefixes(v: vocab.Vocab, word: bytes) -> list[int]:
    """Token counts of the prefixes of 1, 2, ... bytes of one word."""
    n = len(word)
    last, count = [0] * (n + 1), [0] * (n + 1)
    done, known, valid = 0, v.known_pairs, v.valid
    for end, (token, length) in v.automaton.iter(word.decode("latin-1")):
        if end < done:
            continue
        start = end + 1 - length
        if start:
            ok = known.get(last[start] << vocab.SHIFT | token)
            if ok is None:
                ok = valid(last[start], token)
            if not ok:
                continue
        done = end + 1
        last[done], count[done] = token, count[start] + 1
    return count[1:]


class Counter:
    """Counts the prefixes of texts, remembering words."""

    def __init__(self, path: str):
        self.vocab = vocab.load(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def word(self, w: str) -> bytes:
        """Changes of the count over the prefixes of 1, 2, ... characters of a word of the pre-split,
        each cut as a text that ends there is split."""
        raw = w.encode()
        counts = word_prefixes(self.vocab, raw)
        if len(raw) != len(w):  # only the ends of characters are cuts
            counts = [c for c, after in zip(counts, raw[1:] + b" ", strict=True) if after & 0xC0 != 0x80]
        if w in ("'re", "'ve", "'ll"):  # cut after the second sign these are two words
            counts[1] = 2
        return array("h", map(sub, counts, [0, *counts])).tobytes()

    def learn(self, words: set[str]) -> None:
        if len(self.known) > REMEMBERED:  # words that are met again come back from the older half
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        known.update((w, older[w]) for w in words if w in older)
        for w in words:
            if w not in known:
                known[w] = self.word(w)

    def changes(self, texts: list[str]) -> list[np.ndarray]:
        """Per text, the change of the token count at each character."""
        split = [self.vocab.splitter.findall(t) for t in texts]
        unique: set[str] = set()
        for words in split:
            unique.update(words)
        self.learn(unique)
        get, out = self.known.__getitem__, []
        for words in split:
            found = np.frombuffer(b"".join(map(get, words)), np.int16)
            if any(map(str.isspace, words)):
                found = self.spaces(words, found.copy())
            out.append(found)
        return out

    def spaces(self, words: list[str], found: np.ndarray) -> np.ndarray:
        """A run of white space is split before its last sign where a word follows, but a text cut
        at the end of the run has it in one piece: the count there is that of the whole run."""
        at = 0
        for i, w in enumerate(words[:-1]):
            at += len(w)
            if w.isspace() and words[i + 1][0].isspace():
                run = w + words[i + 1][0]
                whole = int(self._last(run))
                split = int(found[at - len(w) : at + 1].sum())
                if whole != split:
                    found[at] += whole - split
                    if at + 1 < len(found):
                        found[at + 1] -= whole - split
        return found

    def _last(self, run: str) -> int:
        if run not in self.known:
            self.known[run] = self.word(run)
        return np.frombuffer(self.known[run], np.int16).sum()


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def store(df: DataFrame, budget: int = BUDGET, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_chars, n_tokens, cut, width, changes of every row.

    changes holds, little-endian in ``width`` bytes each, by how much the exact token count of the
    prefix changes at each character; cut is the length of the longest prefix with at most
    ``budget`` tokens. A null text has 0 characters and tokens and null changes, an empty one
    empty changes. Repeated rows give repeated results; a null doc_id stays null; extra columns
    are ignored; an empty table gives an empty result. Texts are read whole, however long.
    """
    path = vocabulary or vocab.vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            for piece in slices(batch, "text", 2_000_000):
                texts = piece["text"].to_pylist()
                rows = []
                for t, c in zip(texts, count.changes([t or "" for t in texts]), strict=True):
                    upto = np.cumsum(c, dtype=np.int64)
                    fits = np.flatnonzero(upto <= budget)
                    narrow = not len(c) or (c.min() >= -128 and c.max() <= 127)
                    kept = None if t is None else (c.astype(np.int8) if narrow else c).tobytes()
                    rows.append((len(c), int(upto[-1]) if len(c) else 0, int(fits[-1]) + 1 if len(fits) else 0, 1 if narrow else 2, kept))
                cols = list(zip(*rows, strict=True))
                arrays = [pa.array(c, f.type) for c, f in zip(cols, list(RESULT)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([piece["doc_id"], *arrays], schema=RESULT)

    return pick(df, "doc_id", "text").mapInArrow(run, SCHEMA)


def counts_of(changes: bytes, width: int) -> np.ndarray:
    """The exact token count of the prefix of 1, 2, ... characters."""
    return np.cumsum(np.frombuffer(changes, np.int8 if width == 1 else np.int16), dtype=np.int64)


def tokens_at(stored: DataFrame, chars: int) -> DataFrame:
    """doc_id, tokens: the exact count of each text's first ``chars`` characters (all of a shorter
    text), from the store alone. Null and empty texts have 0, as any text has where ``chars`` is 0.
    Repeated rows give repeated results; a null doc_id stays null; extra columns are ignored; an empty
    store gives an empty result."""
    return _asked(stored, lambda c: int(c[min(chars, len(c)) - 1]) if len(c) and chars > 0 else 0, "tokens")


def cut_at(stored: DataFrame, budget: int) -> DataFrame:
    """doc_id, chars: the length of the longest prefix of each text with at most ``budget`` tokens, the
    last of equally good ones. Null and empty texts have 0. Repeated rows give repeated results; a
    null doc_id stays null; extra columns are ignored; an empty store gives an empty result."""

    def longest(c: np.ndarray) -> int:
        fits = np.flatnonzero(c <= budget)
        return int(fits[-1]) + 1 if len(fits) else 0

    return _asked(stored, longest, "chars")


def _asked(stored: DataFrame, answer, name: str) -> DataFrame:  # noqa: ANN001
    @F.pandas_udf("int")
    def ask(changes, width):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([0 if c is None else answer(counts_of(c, w)) for c, w in zip(changes, width, strict=True)], dtype="int32")

    asked: Column = ask("changes", "width")
    return pick(stored, "doc_id", "changes", "width").select("doc_id", asked.alias(name))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(documents(spark, sf_dir))
