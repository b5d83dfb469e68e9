"""Randomness that depends on row keys and a seed only, never on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TWO_32 = 4294967296.0


def _key(seed, *keys) -> Column:
    parts = [F.lit(str(seed))]
    for k in keys:
        c = k if isinstance(k, Column) else F.col(k) if isinstance(k, str) else F.lit(k)
        parts.append(c.cast("string"))
    return F.md5(F.concat_ws("|", *parts))


def hash_u32(seed, *keys) -> Column:
    """First 32 bits of md5(seed|key|...) as a non-negative long."""
    return F.conv(F.substring(_key(seed, *keys), 1, 8), 16, 10).cast("long")


def hash_uniform(seed, *keys) -> Column:
    """Uniform number in [0, 1)."""
    return hash_u32(seed, *keys) / F.lit(TWO_32)


def hash_order(seed, *keys) -> Column:
    """Full digest, for orderings that must break every tie between distinct keys."""
    return _key(seed, *keys)
