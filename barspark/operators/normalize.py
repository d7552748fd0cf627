"""Fitted normalisation: parameters are one row per symbol, fit in one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.functions.columns import change, ratio
from barspark.operators.clean import PRICES, split_numeric
from barspark.operators.prepare import log_offset
from barspark.operators.quantiles import quantiles
from barspark.operators.series import BARS, Series, frames, join_by, numbered, rolling, rolling_means

KEEP = ("_raw", "_original")


def column_methods(df: DataFrame, prices: Sequence[str] = PRICES, volume: str = "volume", price_method: str = "returns",
                   volume_method: str = "log", other_method: str = "zscore", s: Series = BARS) -> dict[str, str]:
    """Method per numeric column; raw and original prices, booleans and text pass through."""
    numeric, _ = split_numeric(df, {*s.keys, s.ts, *s.tie, s.pos})

    def one(c: str) -> str:
        return price_method if c in prices else volume_method if c == volume else other_method

    return {c: one(c) for c in numeric if not c.endswith(KEEP)}


def fit_normaliser(df: DataFrame, methods: dict[str, str], s: Series = BARS) -> DataFrame:
    """Parameters per key and column in long form: ``mean, std, low, span, median, iqr, first``.

    Nulls count as the mean, so they shrink the standard deviation but not the mean.
    """
    df = numbered(df, s)
    keys, cols = list(s.keys), list(methods)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])
    long = df.select(*keys, s.pos, F.inline(pairs))
    n, known = F.count(F.lit(1)), F.count("v")
    spread = F.sqrt(F.var_samp("v") * (known - 1) / F.when(n > 1, n - 1))
    par = long.groupBy(*keys, "column").agg(
        F.coalesce(F.avg("v"), F.lit(0.0)).alias("mean"),
        F.when(spread > 0, spread).otherwise(1.0).alias("std"),
        F.coalesce(F.min("v"), F.lit(0.0)).alias("low"),
        F.when(F.max("v") > F.min("v"), F.max("v") - F.min("v")).otherwise(1.0).alias("span"),
        F.coalesce(F.max(F.when(F.col(s.pos) == 0, F.col("v"))), F.avg("v"), F.lit(0.0)).alias("first"))
    robust = [c for c, m in methods.items() if m == "robust"]
    if not robust:
        return par.withColumns({"median": F.lit(0.0), "iqr": F.lit(1.0)})
    means = df.groupBy(*keys).agg(*[F.avg(c).alias(f"_m_{c}") for c in robust])
    full = join_by(df, means, keys, "inner").select(*keys, *[F.coalesce(F.col(c), F.col(f"_m_{c}")).alias(c) for c in robust])
    q = quantiles(full, robust, (0.25, 0.5, 0.75), s)
    width = F.col("q")[2] - F.col("q")[0]
    q = q.select(*keys, "column", F.col("q")[1].alias("median"), F.when(width > 0, width).otherwise(1.0).alias("iqr"))
    return join_by(par, q, [*keys, "column"]).withColumns(
        {"median": F.coalesce("median", F.lit(0.0)), "iqr": F.coalesce("iqr", F.lit(1.0))})


_PARTS = ("mean", "std", "low", "span", "median", "iqr", "first")


def _wide(params: DataFrame, cols: Sequence[str], s: Series) -> DataFrame:
    row = F.struct(*_PARTS)
    return params.groupBy(*s.keys).agg(*[F.max(F.when(F.col("column") == c, row)).alias(f"_fit_{c}") for c in cols])


def _scaled(c: str, method: str) -> Column:
    fit = F.col(f"_fit_{c}")
    x = F.coalesce(F.col(c).cast("double"), fit["mean"])
    if method == "zscore":
        y = ratio(x - fit["mean"], fit["std"])
    elif method == "minmax":
        y = ratio(x - fit["low"], fit["span"])
    elif method == "robust":
        y = ratio(x - fit["median"], fit["iqr"])
    elif method == "pct_of_avg":
        y = F.when(fit["mean"] == 0, x).when(fit["mean"] > 0, ratio(x, fit["mean"])).otherwise(0.0)
    elif method == "log":
        y = F.ln(x + log_offset(fit["low"]))
    elif method == "pct_change":
        y = F.when(fit["first"] == 0, 0.0).otherwise(change(x, fit["first"]) * 100)
    else:
        y = x
    return F.coalesce(F.when(F.abs(y) < float("inf"), y), F.lit(0.0))


def apply_normaliser(df: DataFrame, params: DataFrame, methods: dict[str, str], s: Series = BARS) -> DataFrame:
    """Normalised copy of ``df``. With method ``returns`` a price ``c`` becomes ``c_return`` (plain);
    a return column that was there already is normalised into ``c_return_z``."""
    df = numbered(df, s)
    plain = [c for c, m in methods.items() if m == "returns"]
    x = join_by(df, _wide(params, list(methods), s), list(s.keys))
    x = x.withColumns({f"_x_{c}": F.coalesce(F.col(c).cast("double"), F.col(f"_fit_{c}")["mean"]) for c in plain})
    new: dict[str, Column] = {}
    for c, m in methods.items():
        if m != "returns":
            existing_return = c.endswith("_return") and c[: -len("_return")] in plain
            new[f"{c}_z" if existing_return else c] = _scaled(c, m)
    x = x.withColumns(new)
    if plain:
        x = frames(x, s, lambda y, w: y.withColumns(
            {f"{c}_return": F.coalesce(change(f"_x_{c}", F.lag(f"_x_{c}").over(w)), F.lit(0.0)) for c in plain}), back=1)
    return x.drop(*plain, *[f"_x_{c}" for c in plain], *[f"_fit_{c}" for c in methods])


def invert_normaliser(df: DataFrame, params: DataFrame, methods: dict[str, str], s: Series = BARS) -> DataFrame:
    """Back to the original scale for the affine methods."""
    x = join_by(df, _wide(params, list(methods), s), list(s.keys))

    def back(c: str, m: str) -> Column:
        f = F.col(f"_fit_{c}")
        return {"zscore": F.col(c) * f["std"] + f["mean"], "minmax": F.col(c) * f["span"] + f["low"],
                "robust": F.col(c) * f["iqr"] + f["median"],
                "pct_of_avg": F.when(f["mean"] > 0, F.col(c) * f["mean"]).when(f["mean"] == 0, F.col(c))}[m]

    affine = {c: m for c, m in methods.items() if m in ("zscore", "minmax", "robust", "pct_of_avg") and c in df.columns}
    return x.withColumns({c: back(c, m) for c, m in affine.items()}).drop(*[f"_fit_{c}" for c in methods])


def rolling_normalise(df: DataFrame, cols: Sequence[str], window: int = 100, s: Series = BARS) -> DataFrame:
    """(x - mean) / std over the last ``window`` rows."""
    def make(x: DataFrame, w) -> DataFrame:
        x = rolling_means(x, w, {f"_mean_{c}": (c, window) for c in cols})
        return x.withColumns({f"{c}_rz": ratio(F.col(c) - F.col(f"_mean_{c}"), rolling(F.stddev_samp, c, w, window)) for c in cols}).drop(*[f"_mean_{c}" for c in cols])

    return frames(df, s, make, back=window - 1)


class BarNormalizer(Estimator):
    """``pyspark.ml`` estimator around ``fit_normaliser``."""

    def __init__(self, price_method: str = "returns", volume_method: str = "log", other_method: str = "zscore",
                 series: Series = BARS):
        super().__init__()
        self.rule = dict(price_method=price_method, volume_method=volume_method, other_method=other_method)
        self.series = series

    def _fit(self, dataset: DataFrame) -> BarNormalizerModel:
        methods = column_methods(dataset, s=self.series, **self.rule)
        return BarNormalizerModel(fit_normaliser(dataset, methods, self.series), methods, self.series)


class BarNormalizerModel(Model):
    def __init__(self, params_table: DataFrame, methods: dict[str, str], series: Series = BARS):
        super().__init__()
        self.params_table, self.methods, self.series = params_table, methods, series

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return apply_normaliser(dataset, self.params_table, self.methods, self.series)

    def inverse_transform(self, dataset: DataFrame) -> DataFrame:
        return invert_normaliser(dataset, self.params_table, self.methods, self.series)
