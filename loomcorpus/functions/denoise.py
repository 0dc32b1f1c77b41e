"""Removal of table markup and of lines that are mostly digits.

All is done by built-in expressions, but for the search outward from words with letters: of lines over
the digit ratio, the counts of each word go to a pandas UDF, which says what stays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACES, normalize_lines, tokens

LETTERS = r"[^\p{IsAlphabetic}]"


@dataclass(frozen=True)
class DenoiserConfig:
    enabled: bool = True
    max_digit_ratio: float = 0.35
    strip_markdown: bool = True


def digits(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^0-9]", ""))


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, LETTERS, ""))


def digit_ratio(text: Column) -> Column:
    """ASCII digits as a share of digits and letters; 0 where there are none of either."""
    d, a = digits(text), letters(text)
    return F.when(d + a == 0, 0.0).otherwise(d / (d + a))


def is_table_line(line: Column) -> Column:
    cut = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    return cut.startswith("|") & (F.length(cut) - F.length(F.translate(cut, "|", "")) >= 2)


def is_table_separator(line: Column) -> Column:
    return is_table_line(line) & (F.translate(line, "|-: \t", "") == F.lit(""))


def strip_pipes(line: Column) -> Column:
    cells = F.transform(F.split(line, r"\|", -1), lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(cells, lambda c: c != F.lit("")), " ")


def gated_lines(text: Column, config: DenoiserConfig = DenoiserConfig()) -> Column:
    """Lines after the first two gates: separator rows and lines without a letter are gone, the cells
    of table rows are joined by spaces."""
    lines = F.split(normalize_lines(text), "\n", -1)
    if config.strip_markdown:
        lines = F.filter(lines, lambda x: ~is_table_separator(x))
        lines = F.transform(lines, lambda x: F.when(is_table_line(x), strip_pipes(x)).otherwise(x))
    return F.filter(lines, lambda x: letters(x) > 0)


def keep_mask(digits: np.ndarray, letters: np.ndarray, max_ratio: float) -> np.ndarray:
    """Which words of a line stay, from their digit and letter counts: those with letters and, wave by
    wave, their neighbours while the digit ratio allows it. A word's wave is its distance from the
    nearest word with letters; as waves add no letters, the ratio only grows with them."""
    n, at = len(digits), np.flatnonzero(letters > 0)
    if not len(at):
        return np.zeros(n, bool)
    i = np.arange(n)
    after = np.searchsorted(at, i)
    wave = np.minimum(np.abs(i - at[np.minimum(after, len(at) - 1)]), np.abs(i - at[np.maximum(after - 1, 0)]))
    d, a = np.cumsum(np.bincount(wave, digits)), letters.sum()
    return wave <= (np.count_nonzero(d[1:] <= max_ratio * (d[1:] + a)) if d[0] <= max_ratio * (d[0] + a) else 0)


def _waves(ratio: float):  # noqa: ANN202
    @F.pandas_udf("array<array<boolean>>")
    def waves(lines: pd.Series) -> pd.Series:
        def one(xs):  # noqa: ANN001, ANN202
            if xs is None:
                return None
            counts = [None if x is None else np.asarray(x, np.int64).reshape(-1, 2) for x in xs]
            return [None if c is None else keep_mask(c[:, 0], c[:, 1], ratio).tolist() for c in counts]

        return lines.map(one)

    return waves


def denoise(text: Column, config: DenoiserConfig = DenoiserConfig()) -> Column:
    """The denoised text; null where nothing is left (or the text is null)."""
    if not config.enabled:
        return text
    lines = gated_lines(text, config)
    over = lambda x: digit_ratio(x) > config.max_digit_ratio
    # digits and letters of each word, for lines over the ratio only; texts without one reach Python as nulls
    counts = F.transform(lines, lambda x: F.when(over(x), F.flatten(F.transform(tokens(x), lambda w: F.array(digits(w), letters(w))))))
    masks = _waves(config.max_digit_ratio)(F.when(F.exists(counts, lambda c: c.isNotNull()), counts))
    kept = lambda x, m: F.array_join(F.transform(F.filter(F.arrays_zip(tokens(x).alias("w"), m.alias("k")), lambda z: z["k"]), lambda z: z["w"]), " ")
    cleaned = F.zip_with(lines, masks, lambda x, m: F.when(m.isNull(), x).otherwise(kept(x, m)))
    return F.when(F.size(lines) > 0, F.array_join(F.when(masks.isNull(), lines).otherwise(cleaned), "\n"))


__all__ = ["SPACES", "DenoiserConfig", "denoise", "digit_ratio", "gated_lines", "keep_mask"]
