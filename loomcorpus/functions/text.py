"""Whitespace tokens, normalisation and sentences as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode White_Space.
SPACES = r"(?U)\s+"


def tokens(text: Column) -> Column:
    """Whitespace tokens without empties; null for null."""
    return F.filter(F.split(text, SPACES, -1), lambda w: w != F.lit(""))


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def normalize_whitespace(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def normalize_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")




def sentences(text: Column) -> Column:
    """Sentences of all blocks between blank lines, in order; [] for blank text, null for null."""
    blocks = F.transform(F.split(normalize_lines(text), "\n\n", -1), normalize_whitespace)
    mark = "\u0001"
    ended = F.transform(
        blocks,
        lambda b: F.split(
            F.regexp_replace(F.regexp_replace(b, r"(?<![A-Z0-9](?=\.[A-Z0-9]))\.(?!\.)", "." + mark), r"[!?]", "$0" + mark),
            mark,
            -1,
        ),
    )
    return F.filter(F.transform(F.flatten(ended), lambda s: F.trim(s)), lambda s: s != F.lit(""))


def slug_title(stem: Column) -> Column:
    """A file's stem as a title: underscores are spaces."""
    return normalize_whitespace(F.translate(stem, "_", " "))


def is_blank(text: Column) -> Column:
    """Nothing but Unicode white space."""
    return text.rlike(r"(?U)^\s*$")


def is_text_file(path: Column) -> Column:
    return F.lower(path).endswith(".txt")
