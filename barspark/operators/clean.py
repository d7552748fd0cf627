"""Missing values, outliers and bar repair, per symbol."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.functions.columns import clip, number
from barspark.operators.quantiles import quantiles
from barspark.operators.series import BARS, Series, join_by, last, next_, numbered, scan, utc_micros

PRICES = ("open", "high", "low", "close")


# ---------------------------------------------------------------- missing values


def fill_forward_backward(df: DataFrame, cols: Sequence[str], s: Series = BARS, backward_first: bool = False) -> DataFrame:
    """Previous known value, else next known value (or the other way round)."""
    df = numbered(df, s)
    outs = {}
    for c in cols:
        outs[f"_p_{c}"], outs[f"_n_{c}"] = last(c), next_(c)
    x = scan(df, s, outs)
    pair = ("_n_", "_p_") if backward_first else ("_p_", "_n_")
    return x.withColumns({c: F.coalesce(*[F.col(f"{k}{c}") for k in pair]) for c in cols}).drop(*outs)


def fill_forward(df: DataFrame, cols: Sequence[str], s: Series = BARS) -> DataFrame:
    df = numbered(df, s)
    return scan(df, s, {c: last(c) for c in cols}).select(*df.columns)


def fill_backward(df: DataFrame, cols: Sequence[str], s: Series = BARS) -> DataFrame:
    df = numbered(df, s)
    return scan(df, s, {c: next_(c) for c in cols}).select(*df.columns)


def interpolate(df: DataFrame, cols: Sequence[str], s: Series = BARS, by: str = "time") -> DataFrame:
    """Straight line between the neighbouring known values, by time or by row; ends are held."""
    df = numbered(df, s)
    at = utc_micros(s.ts) if by == "time" else F.col(s.pos)
    outs = {}
    for c in cols:
        known = F.when(F.col(c).isNotNull(), F.struct(F.col(c).cast("double").alias("v"), at.alias("t")))
        outs[f"_p_{c}"], outs[f"_n_{c}"] = last(known), next_(known)
    x = scan(df, s, outs)

    def line(c: str) -> Column:
        p, n = F.col(f"_p_{c}"), F.col(f"_n_{c}")
        between = p["v"] + (n["v"] - p["v"]) * (at - p["t"]) / (n["t"] - p["t"])
        return F.coalesce(F.col(c).cast("double"), F.when(n["t"] > p["t"], between), p["v"], n["v"])

    return x.withColumns({c: line(c) for c in cols}).drop(*outs)


def fill_missing(df: DataFrame, method: str = "ffill", s: Series = BARS, prices: Sequence[str] = PRICES,
                 volume: str = "volume") -> DataFrame:
    """The cleaner's rule: prices by ``method`` (ffill, bfill, interpolate), volume 0."""
    cols = [c for c in prices if c in df.columns]
    if method == "interpolate":
        df = interpolate(df, cols, s)
    elif method in ("ffill", "bfill"):
        df = fill_forward_backward(df, cols, s, backward_first=method == "bfill")
    elif method != "none":
        raise ValueError(f"unknown method {method!r}")
    return df.withColumn(volume, F.coalesce(volume, F.lit(0).cast("double"))) if volume in df.columns else df


def column_means(df: DataFrame, cols: Sequence[str], s: Series = BARS) -> DataFrame:
    return df.groupBy(*s.keys).agg(*[F.avg(c).alias(f"_avg_{c}") for c in cols])


def fill_mean(df: DataFrame, cols: Sequence[str], s: Series = BARS) -> DataFrame:
    means = column_means(df, cols, s)
    return (join_by(df, means, list(s.keys))
            .withColumns({c: F.coalesce(F.col(c), F.col(f"_avg_{c}"), F.lit(0.0)) for c in cols})
            .drop(*[f"_avg_{c}" for c in cols]))


def modes(df: DataFrame, cols: Sequence[str], s: Series = BARS) -> DataFrame:
    """Most frequent value per key and column, the smallest of ties, from pre-counted values."""
    keys = list(s.keys)
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols])
    counted = (df.select(*keys, F.inline(pairs)).where(F.col("v").isNotNull())
               .groupBy(*keys, "c", "v").agg(F.count(F.lit(1)).alias("n")))
    best = counted.groupBy(*keys, "c").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("v")))["v"].alias("v"))
    return best.groupBy(*keys).agg(*[F.max(F.when(F.col("c") == c, F.col("v"))).alias(f"_mode_{c}") for c in cols])


def split_numeric(df: DataFrame, skip: Sequence[str]) -> tuple[list[str], list[str]]:
    numeric, other = [], []
    for f in df.schema.fields:
        if f.name in skip:
            continue
        is_num = f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte", "decimal")
        (numeric if is_num else other).append(f.name)
    return numeric, other


def fill_everything(df: DataFrame, s: Series = BARS, linear: bool = False, cols: Sequence[str] | None = None) -> DataFrame:
    """Numbers ffill, bfill, mean, 0; others ffill, bfill, mode, "UNKNOWN". No null is left but in dates a key has none of.

    ``linear`` first draws lines between known numbers (by row).
    """
    df = numbered(df, s)
    numeric, other = split_numeric(df, {*s.keys, s.ts, *s.tie, s.pos})
    if cols is not None:
        numeric, other = [c for c in numeric if c in cols], [c for c in other if c in cols]
    types = {f.name: f.dataType for f in df.schema.fields}
    if numeric:
        df = interpolate(df, numeric, s, by="row") if linear else fill_forward_backward(df, numeric, s)
        # after the two fills a column is null in all rows of a key or in none, so its mean is unknown
        df = df.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast(types[c] if not linear else "double") for c in numeric})
    if other:
        df = fill_forward_backward(df, other, s)
        blank = {c: F.lit("UNKNOWN") if types[c].typeName() == "string" else
                 F.lit(False) if types[c].typeName() == "boolean" else F.lit(None).cast(types[c]) for c in other}
        df = df.withColumns({c: F.coalesce(F.col(c), blank[c]) for c in other})
    return df


def columns_with_nulls(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Those of ``cols`` that hold any null: one narrow aggregation that saves filling full columns."""
    if not cols:
        return []
    row = df.agg(*[(F.count(c) < F.count(F.lit(1))).alias(f"_{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[f"_{i}"]]


def null_profile(df: DataFrame, s: Series = BARS, cols: Sequence[str] | None = None) -> DataFrame:
    """One row per key and column: first known row, null count and share."""
    df = numbered(df, s)
    cols = list(cols or [c for c in df.columns if c not in {*s.keys, s.ts, s.pos, *s.tie}])
    pairs = [F.struct(F.lit(c).alias("column"), F.min(F.when(F.col(c).isNotNull(), F.col(s.pos))).alias("first_valid"),
                      F.count_if(F.col(c).isNull()).alias("null_count"), F.count(F.lit(1)).alias("n_rows"))
             for c in cols]
    one = df.groupBy(*s.keys).agg(*[p.alias(f"_{i}") for i, p in enumerate(pairs)])
    return one.select(*s.keys, F.inline(F.array(*[F.col(f"_{i}") for i in range(len(pairs))]))).withColumn(
        "null_pct", F.col("null_count") / F.col("n_rows") * 100)


# ---------------------------------------------------------------- coercion and repair


def coerce_numbers(df: DataFrame, cols: Sequence[str], fill: float | None = None) -> DataFrame:
    """Text to numbers, unparsable to null (or to ``fill`` in final output)."""
    def one(c: str) -> Column:
        return number(c) if fill is None else F.coalesce(number(c), F.lit(fill))

    return df.withColumns({c: one(c) for c in cols if c in df.columns})


def repair_bars(df: DataFrame) -> DataFrame:
    """high is at least, low at most, open and close."""
    return df.withColumns({"high": F.greatest("high", "open", "close"), "low": F.least("low", "open", "close")})


def invalid_bars(df: DataFrame, s: Series = BARS) -> DataFrame:
    return df.groupBy(*s.keys).agg(
        F.count_if(F.col("high") < F.greatest("open", "close")).alias("invalid_high"),
        F.count_if(F.col("low") > F.least("open", "close")).alias("invalid_low"))


# ---------------------------------------------------------------- outliers


def outlier_stats(df: DataFrame, cols: Sequence[str], s: Series = BARS) -> DataFrame:
    """mean, std, median, q1, q3 and iqr per key and column (long form, one row each)."""
    keys = list(s.keys)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), number(c).alias("v")) for c in cols])
    moments = df.select(*keys, F.inline(pairs)).groupBy(*keys, "column").agg(
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    q = quantiles(df.withColumns({c: number(c) for c in cols}), cols, (0.25, 0.5, 0.75), s)
    q = q.select(*keys, "column", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    joined = join_by(moments, q, [*keys, "column"])
    return joined.select(
        *keys, "column", F.coalesce("mean", F.lit(0.0)).alias("mean"),
        F.when(F.col("mean").isNull(), 1.0).otherwise(F.col("std")).alias("std"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("median", "q1", "q3")],
        F.coalesce(F.col("q3") - F.col("q1"), F.lit(0.0)).alias("iqr"))


def outlier_bounds(df: DataFrame, cols: Sequence[str], method: str = "winsorize", threshold: float = 3.0,
                   s: Series = BARS) -> DataFrame:
    """Per key one ``_lo_*``/``_hi_*`` pair per column; fitted on ``df``."""
    keys = list(s.keys)
    if method == "winsorize":
        q = quantiles(df, cols, (0.01, 0.99), s)
        long = q.select(*keys, "column", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    else:
        st = outlier_stats(df, cols, s)
        if method == "zscore":
            sd = F.when(F.col("std") > 0, F.col("std")).otherwise(F.lit(1.0))
            lo, hi = F.col("mean") - threshold * sd, F.col("mean") + threshold * sd
        elif method == "iqr":
            width = F.when(F.col("iqr") > 0, F.col("iqr")).otherwise(F.lit(1.0))
            lo, hi = F.col("q1") - threshold * width, F.col("q3") + threshold * width
        else:
            raise ValueError(f"unknown method {method!r}")
        long = st.select(*keys, "column", lo.alias("lo"), hi.alias("hi"))
    pick = [F.max(F.when(F.col("column") == c, F.col(v))).alias(f"_{v}_{c}") for c in cols for v in ("lo", "hi")]
    return long.groupBy(*keys).agg(*pick)


def clamp_outliers(df: DataFrame, method: str = "winsorize", threshold: float = 3.0, cols: Sequence[str] = PRICES,
                   s: Series = BARS, bounds: DataFrame | None = None) -> DataFrame:
    """Clip to the bounds of the fitted frame (``bounds``) or of ``df`` itself."""
    cols = [c for c in cols if c in df.columns]
    b = bounds if bounds is not None else outlier_bounds(df, cols, method, threshold, s)
    x = join_by(df, b, list(s.keys))
    return x.withColumns({c: F.when(F.col(f"_lo_{c}").isNull(), F.col(c))
                         .otherwise(clip(c, F.col(f"_lo_{c}"), F.col(f"_hi_{c}"))) for c in cols}).select(*df.columns)


def outlier_counts(df: DataFrame, method: str = "winsorize", threshold: float = 3.0, cols: Sequence[str] = PRICES,
                   s: Series = BARS) -> DataFrame:
    b = outlier_bounds(df, cols, method, threshold, s)
    x = join_by(df, b, list(s.keys))
    structs = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c) < F.col(f"_lo_{c}")).alias("n_low"),
                        F.count_if(F.col(c) > F.col(f"_hi_{c}")).alias("n_high")).alias(f"_{i}")
               for i, c in enumerate(cols)]
    return x.groupBy(*s.keys).agg(*structs).select(
        *s.keys, F.inline(F.array(*[F.col(f"_{i}") for i in range(len(cols))])))


# ---------------------------------------------------------------- the cleaner


def clean_bars(df: DataFrame, s: Series = BARS, missing: str = "ffill", outliers: str = "winsorize",
               threshold: float = 3.0, volume_outliers: bool = False, repair: bool = True,
               bounds: DataFrame | None = None) -> DataFrame:
    """Coerce, fill, clamp and repair, in this order."""
    df = coerce_numbers(df, [*PRICES, "volume"])
    df = fill_missing(df, missing, s)
    if outliers != "none":
        cols = [*PRICES, "volume"] if volume_outliers else list(PRICES)
        df = clamp_outliers(df, outliers, threshold, cols, s, bounds)
    return repair_bars(df) if repair else df
