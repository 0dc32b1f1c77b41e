"""Words and shingles as hashes, for whole batches of texts at once."""

from __future__ import annotations

import numpy as np
import xxhash

REMEMBERED = 250_000
_STRIP = "\"'`.,;:!?()[]{}<>|#%&*$~^+=_-…“”‘’«»¿¡"
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose output bits all depend on all input bits."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Words:
    """Hashes of words, remembered in two halves so that frequent words stay. With ``plain`` words
    are compared as they are; else case and punctuation at their ends don't count."""

    def __init__(self, plain: bool):
        self.plain = plain
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def _hash(self, word: str) -> int:
        if not self.plain:
            word = word.lower().strip(_STRIP) or word
        return xxhash.xxh3_64_intdigest(word)

    def hashes(self, words: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        for w in set(words).difference(known):
            h = older.get(w)
            known[w] = self._hash(w) if h is None else h
        return np.fromiter(map(known.__getitem__, words), U, len(words))


def split_hashes(words: Words, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of all texts, number of words of each text)."""
    split = [t.split() if t else [] for t in texts]
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    flat = [w for ws in split for w in ws]
    return words.hashes(flat), lengths


SHINGLE_BITS = U(48)


def bags(hashes: np.ndarray, lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count) of the distinct shingles of k words of every text, ordered by text
    and shingle. A shingle is 48 bits of hash; texts of fewer words are one shingle."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    n = len(hashes)
    at = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    room = np.repeat(lengths, lengths) - at  # words from here to the text's end
    value = np.zeros(n, U)
    for j in range(k):
        here = room > j
        part = np.zeros(n, U)
        part[: n - j] = hashes[j:]
        value = np.where(here, mix(value * U(0x9E3779B97F4A7C15) + part), value)
    first = (room >= k) | (at == 0)
    key = np.sort(text[first].astype(U) << SHINGLE_BITS | (value[first] >> U(16)))
    new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(key)))
    key = key[start]
    return (key >> SHINGLE_BITS).astype(np.int64), key & ((U(1) << SHINGLE_BITS) - U(1)), count
