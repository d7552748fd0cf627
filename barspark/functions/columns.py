"""Null-safe column arithmetic used by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """NaN and infinities become null; missing is only ever null in this package."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def number(c: str | Column) -> Column:
    """Text to double; what does not parse (or parses to NaN/inf) is null."""
    return finite(col(c).try_cast("double"))


def stamp(c: str | Column, fmt: str | None = None) -> Column:
    c = col(c)
    return F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, null for b = 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def change(now: str | Column, before: str | Column) -> Column:
    return ratio(now, before) - 1


def clip(c: str | Column, low: Column, high: Column) -> Column:
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def typical_price(high: str = "high", low: str = "low", close: str = "close") -> Column:
    return F.coalesce((F.col(high) + F.col(low) + F.col(close)) / 3, F.col(close))


def synthetic_volume(high: str = "high", low: str = "low", scale: float = 1e7) -> Column:
    return ((F.col(high) - F.col(low)) * scale).cast("long")


def synthetic_volume_noisy(high: str = "high", low: str = "low", seed: int = 0) -> Column:
    return ((F.col(high) - F.col(low)) * 1e6 * (0.8 + 0.4 * F.rand(seed))).cast("long")


def date_range(c: str | Column, start=None, end=None) -> Column:
    """Inclusive on both sides; an open side is not tested."""
    c, keep = col(c), F.lit(True)
    if start is not None:
        keep = keep & (c >= F.lit(start).cast("timestamp"))
    if end is not None:
        keep = keep & (c <= F.lit(end).cast("timestamp"))
    return keep
