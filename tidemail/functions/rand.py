"""Deterministic randomness.

Every draw is a pure function of (seed, name, key):

    u = int(md5(f"{seed}:{name}:{key}")[:13], 16) / 2**52      in [0, 1)

so results do not depend on partitioning, task retries or executor loss, and
the same value can be computed in SQL (DuckDB:
``('0x' || substr(md5(..), 1, 13))::BIGINT / 4503599627370496``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = float(2 ** 52)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_hex(seed: int | str, name: str, key) -> Column:
    # a null key has no part; concat with a constant head costs less than concat_ws of three
    head = f"{seed}:{name}"
    return F.md5(F.coalesce(F.concat(F.lit(head + ":"), _col(key).cast("string")), F.lit(head)))


def draw_bits(seed: int | str, name: str, key) -> Column:
    """The 52-bit integer behind :func:`uniform` (same order, exact)."""
    return F.conv(F.substring(hash_hex(seed, name, key), 1, 13), 16, 10).cast("bigint")


def uniform(seed: int | str, name: str, key) -> Column:
    """Double in [0, 1) drawn from (seed, name, key)."""
    return draw_bits(seed, name, key) / F.lit(TWO_52)
