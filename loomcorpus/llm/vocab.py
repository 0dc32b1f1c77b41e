"""Byte-level BPE vocabularies: loading, pre-splitting, pair compatibility, exact merging.

Nothing is trained: rank files of public tokenizers are read from a folder given as a parameter.
"""

from __future__ import annotations

import base64
import functools
import itertools
import os

import numpy as np

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The public pattern that splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Break between words in a string of bytes written as characters; no token holds it.
BREAK = "Ā"
NONE = 1 << 30
#: Bits of a token id: a pair of ids is one number.
SHIFT = 20


class Vocab:
    """A rank file with what checking and merging need; ids must be under 2^SHIFT, as those of all public vocabularies are."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = (line.split() for line in f if line.strip())
            self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.size = max(self.ranks.values()) + 1
        if self.size > 1 << SHIFT:
            raise ValueError(f"token ids must be under {1 << SHIFT}")
        self.kind, self.code = (np.uint16, "H") if self.size <= 1 << 16 else (np.uint32, "I")
        self.tokens: list[bytes] = [b""] * self.size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        left = np.arange(self.size, dtype=np.int64)
        right = left.copy()
        self.pairs: dict[int, int] = {}
        self.made = set(self.ranks)  # tokens that merging can make; all are in a trained vocabulary
        for token, rank in self.ranks.items():
            if len(token) > 1:
                parts = self._merge(token, rank)
                if len(parts) != 2:
                    self.made.discard(token)
                else:
                    left[rank], right[rank] = parts
                    self.pairs[parts[0] << SHIFT | parts[1]] = rank
        self.left, self.right = left, right
        keys = np.array(sorted(self.pairs), np.int64)
        self.pair_keys = keys
        self.pair_ranks = np.array([self.pairs[k] for k in keys.tolist()], np.int64)
        self._left, self._right = left.tolist(), right.tolist()
        self.known_pairs: dict[int, bool] = {}

    def _merge(self, word: bytes, below: int = NONE) -> list[int]:
        """Exact merging, lowest rank first, leftmost first, with ranks under ``below``."""
        ranks = self.ranks
        parts = [word[i : i + 1] for i in range(len(word))]
        if len(parts) > 256:
            return self._merge_long(parts, below)
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1], NONE)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _merge_long(self, parts: list[bytes], below: int) -> list[int]:
        """The same with a heap over a linked list, n log n for very long words."""
        import heapq

        n = len(parts)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        ranks, heap = self.ranks, []
        text: list[bytes | None] = list(parts)

        def push(i: int) -> None:
            j = after[i]
            if j < n:
                r = ranks.get(text[i] + text[j], NONE)
                if r < below:
                    heapq.heappush(heap, (r, i, len(text[i]), len(text[j])))

        for i in range(n - 1):
            push(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if text[i] is not None else n
            if j >= n or len(text[i]) != a or len(text[j]) != b:
                continue
            text[i], text[j] = text[i] + text[j], None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [ranks[t] for t in text if t is not None]

    def merge(self, word: bytes) -> list[int]:
        return self._merge(word)

    def valid(self, a: int, b: int) -> bool:
        """Whether a text that ends with token a is followed by token b in exact merging: no merge
        across the border comes before the merges that built a and b."""
        key = a << SHIFT | b
        got = self.known_pairs.get(key)
        if got is None:
            if len(self.known_pairs) > 400_000:
                self.known_pairs.clear()
            got = self.known_pairs[key] = self._compatible(a, b)
        return got

    def _compatible(self, a: int, b: int) -> bool:
        # opens the younger token first, as the pair check of the public `bpe` crate does (MIT licence)
        pairs, left, right, limit = self.pairs, self._left, self._right, NONE
        while True:
            if pairs.get(a << SHIFT | b, NONE) < limit:
                return False
            if a > b:
                limit, a = a, right[a]
                if a == limit:
                    limit, b = b + 1, left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, left[b]
                if b + 1 == limit:
                    limit, a = a, right[a]
                    if a == limit:
                        return True

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``valid`` for arrays of pairs at once."""
        n = len(a)
        ok = np.ones(n, bool)
        idx = np.arange(n)
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(n, NONE, np.int64)
        while len(idx):
            key = a << SHIFT | b
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            merged = np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)
            bad = merged < limit
            ok[idx[bad]] = False
            go = ~bad
            idx, a, b, limit = idx[go], a[go], b[go], limit[go]
            first = a > b
            la, rb = self.right[a], self.left[b]
            # the younger token opens first; where it is a single byte, the other one does
            open_a = np.where(first, la != a, rb == b)
            stuck = np.where(first, (la == a) & (rb == b), (rb == b) & (la == a))
            new_limit = np.where(open_a, a, b + 1)
            a = np.where(open_a, la, a)
            b = np.where(open_a, b, rb)
            limit = new_limit
            go = ~stuck
            idx, a, b, limit = idx[go], a[go], b[go], limit[go]
        return ok

    @functools.cached_property
    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for token in self.made:
            found.add_word(token.decode("latin-1"), (self.ranks[token], len(token)))
        found.make_automaton()
        return found

    @functools.cached_property
    def _longest(self):
        import ahocorasick

        found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token in self.made:
            found.add_word(token.decode("latin-1"), self.ranks[token])
        found.make_automaton()
        return found

    def greedy(self, joined: str) -> np.ndarray:
        """End and token of the longest match from each point on, one after the other, flat."""
        return np.fromiter(itertools.chain.from_iterable(self._longest.iter_long(joined)), np.int64)

    def exact(self, word: str, raw: bytes) -> list[int]:
        """Exact merging of a word of the pre-split; very long words go by the heap, whose time
        doesn't grow with the square of their length."""
        return self.merge(raw) if len(raw) > 256 else self.encoding.encode_ordinary(word)

    @functools.cached_property
    def splitter(self):
        import regex

        return regex.compile(PATTERN)

    @functools.cached_property
    def encoding(self):
        import tiktoken

        return tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def vocabulary_path(folder: str = TOKENIZERS, name: str = VOCABULARY) -> str:
    return os.path.join(folder, name)


@functools.lru_cache(maxsize=2)
def load(path: str) -> Vocab:
    """One vocabulary per Python worker and path."""
    return Vocab(path)


@functools.lru_cache(maxsize=2)
def encoding(path: str):
    """tiktoken's encoder of a rank file, without the tables that only checking needs."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
