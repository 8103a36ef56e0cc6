"""Deterministic pseudo-random columns derived from row keys.

A row keeps its draw whatever the partitioning, the retry or the engine, which
``rand()`` cannot promise. Each md5 digest yields four independent 32-bit streams.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 1 << 32


def key_hash(key: str | Column, stream: int = 0, seed: int | None = None) -> Column:
    """Integer in [0, 2**32) taken from the md5 text of ``key``."""
    text = (F.col(key) if isinstance(key, str) else key).cast("string")
    if seed is not None:
        text = F.concat_ws(":", F.lit(str(seed)), text)
    digits = F.substring(F.md5(text), 1 + 8 * stream, 8)
    return F.conv(digits, 16, 10).cast("bigint")


def uniform(key: str | Column, stream: int = 0, seed: int | None = None) -> Column:
    """Double strictly between 0 and 1."""
    return (key_hash(key, stream, seed).cast("double") + F.lit(0.5)) / F.lit(float(SPAN))


def normal(key: str | Column, streams: tuple[int, int] = (0, 1), seed: int | None = None) -> Column:
    """Standard normal draw (Box-Muller over two uniform streams)."""
    radius = F.sqrt(-2.0 * F.log(uniform(key, streams[0], seed)))
    return radius * F.cos(2.0 * F.pi() * uniform(key, streams[1], seed))
