"""Seeded hashes of a row key: the same row gets the same draw on every engine and every retry."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPAN = 4294967296.0  # 2**32, the range of eight hex digits


def seeded_digest(key: Column | str, seed: Column | int) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat_ws("|", key.cast("string"), seed.cast("string")))


def seeded_int(key: Column | str, seed: Column | int) -> Column:
    """Integer in [0, 2**32)."""
    return F.conv(F.substring(seeded_digest(key, seed), 1, 8), 16, 10).cast("bigint")


def seeded_uniform(key: Column | str, seed: Column | int) -> Column:
    """Double in [0, 1)."""
    return seeded_int(key, seed) / F.lit(_SPAN)


def seeded_below(key: Column | str, seed: Column | int, share: float) -> Column:
    """Whether ``seeded_uniform`` is below ``share``, told by the digits without making them a number."""
    top = math.ceil(share * _SPAN)
    if top <= 0 or top >= _SPAN:
        return F.lit(top > 0)
    # digests are longer than eight digits, so one that begins with these is not below them
    return seeded_digest(key, seed) < f"{top:08x}"


def hash_fold(key: Column | str, seed: Column | int, k: int) -> Column:
    return (seeded_int(key, seed) % F.lit(k)).cast("int")
