"""Portable hashes: the same numbers from Spark, SQL engines and plain Python, whatever the
partitioning. Every random choice of the library is a hash of (seed, purpose, key)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hashes are whole numbers under this; exact in a double.
SPACE = 16**13


def hash52(*parts: Column | str | int) -> Column:
    """52 bits of the MD5 of the parts joined by '|'; columns and literals alike."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    joined = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("long")


def uniform(*parts: Column | str | int) -> Column:
    """hash52 as a number in [0, 1)."""
    return hash52(*parts) / F.lit(float(SPACE))


def hash52_of(*parts: object) -> int:
    """hash52 of plain values."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16)


def epoch_seed(seed: int, epoch: int) -> int:
    return seed ^ epoch
