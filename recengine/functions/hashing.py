"""Reproducible pseudo-randomness as column expressions.

``rand()``/``sample()`` depend on partitioning; these depend only on the
seed and the row's key, so results are the same under any partition count
and the DuckDB oracle can replay them:

    Spark : conv(substr(md5(concat_ws('|', seed, k...)), 1, 15), 16, 10)
    DuckDB: cast('0x' || substr(md5(concat_ws('|', seed, k...)), 1, 15) as bigint)
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _key(seed: int | str, *parts: str | Column) -> Column:
    cols = [F.lit(str(seed))] + [
        (F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return F.concat_ws("|", *cols)


def hash_hex(seed: int | str, *parts: str | Column) -> Column:
    """md5 hex of ``seed|part|...``; a stable pseudo-random sort key."""
    return F.md5(_key(seed, *parts))


def hash_int(seed: int | str, *parts: str | Column) -> Column:
    """Non-negative 60-bit integer from the md5 of ``seed|part|...``."""
    return F.conv(F.substring(hash_hex(seed, *parts), 1, 15), 16, 10).cast("bigint")


def hashed_normals(seed: int | str, width: int, *keys: Column, spread: float = 1.0) -> Column:
    """Array of ``width`` normal numbers from the hashes of the keys."""
    def uniform(salt: int, k: Column) -> Column:
        return (F.pmod(F.xxhash64(F.lit(str(seed)), F.lit(salt), *keys, k), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return F.transform(F.sequence(F.lit(1), F.lit(width)),
                       lambda k: spread * F.sqrt(-2 * F.log(uniform(1, k))) * F.cos(2 * math.pi * uniform(2, k)))
