"""Targets that look ahead, and the chronological train/test cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.functions.columns import change, ratio
from barspark.functions.naming import price_return_target
from barspark.operators.series import BARS, Series, frames, join_by, numbered


def with_target(df: DataFrame, target: str, s: Series = BARS) -> tuple[DataFrame, str]:
    """The named column, any ``*return*`` column, or the return of the original or raw close."""
    found = price_return_target(df, target)
    if found:
        return df, found
    base = next((c for c in ("close_original", "close_raw") if c in df.columns), None)
    if base is None:
        raise ValueError(f"no target {target!r} and nothing to derive it from")
    return frames(df, s, lambda x, w: x.withColumn(target, change(base, F.lag(base).over(w))), back=1), target


def label_direction(df: DataFrame, target: str, horizon: int = 1, s: Series = BARS, out: str = "label") -> DataFrame:
    """1 if the target ``horizon`` rows ahead is positive, else 0; null where there is no such row."""
    def make(x: DataFrame, w) -> DataFrame:
        ahead = F.lead(target, horizon).over(w)
        return x.withColumn(out, F.when(ahead.isNotNull(), (ahead > 0).cast("int")))

    return frames(df, s, make, ahead=horizon)


def label_value(df: DataFrame, target: str, horizon: int = 1, s: Series = BARS, out: str = "label") -> DataFrame:
    return frames(df, s, lambda x, w: x.withColumn(out, F.lead(target, horizon).over(w)), ahead=horizon)


def forward_targets(df: DataFrame, price: str = "close", horizon: int = 1, s: Series = BARS) -> DataFrame:
    """Forward return, direction, price and the return normalised per symbol."""
    def make(x: DataFrame, w) -> DataFrame:
        later = F.lead(price, horizon).over(w)
        return x.withColumns({"fwd_price": later, "fwd_return": change(later, price),
                              "fwd_direction": F.signum(later - F.col(price))})

    x = frames(df, s, make, ahead=horizon)
    fit = x.groupBy(*s.keys).agg(F.avg("fwd_return").alias("_m"), F.stddev_samp("fwd_return").alias("_s"))
    z: Column = ratio(F.col("fwd_return") - F.col("_m"), F.col("_s"))
    return join_by(x, fit, list(s.keys)).withColumn("fwd_return_z", z).drop("_m", "_s")


def train_test(df: DataFrame, test_size: float = 0.2, s: Series = BARS, out: str = "split") -> DataFrame:
    """The first (1 - test_size) rows of every symbol are ``train``."""
    df = numbered(df, s)
    n = df.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("_n"))
    cut = F.floor(F.col("_n") * (1 - test_size))
    return join_by(df, n, list(s.keys), "inner").withColumn(out, F.when(F.col(s.pos) < cut, "train").otherwise("test")).drop("_n")
