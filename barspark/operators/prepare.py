"""Price transforms and the treatments that make a feature table free of nulls.

The treatments read their wide input several times (fills, modes, size classes), so it is
written to the shared folder first instead of being computed once per branch.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.functions.columns import change
from barspark.functions.naming import categorise, find_price_columns
from barspark.operators.clean import PRICES, columns_with_nulls, fill_everything, interpolate, modes, split_numeric
from barspark.operators.series import BARS, Series, frames, join_by, last, next_, numbered, scan, stage

# ---- fixed values
DEFAULT_WARM_UP = {"short_window": 10, "medium_window": 20, "long_window": 200}
LOG_OFFSET = 1e-8
RSI_NEUTRAL, VOLATILITY_DEFAULT = 50.0, 0.01
BAND_UP, BAND_DOWN = 1.05, 0.95
# what a column is filled with is decided by the first pattern its name matches
FILL_CLASSES: list[tuple[str, str]] = [
    ("price", "open|high|low|close"),
    ("volume", "volume"),
    ("average", "sma|ema"),
    ("rsi", "rsi"),
    ("oscillator", "macd|stoch"),
    ("band", "bollinger"),
    ("volatility", "atr|volatility"),
    ("derived", "_return|_log|_pct_change"),
    ("pattern", "doji|hammer|engulfing|day_|hour_|month"),
]
# ---- end of fixed values


def _price_columns(df: DataFrame) -> list[str]:
    found = find_price_columns(df.columns)
    return [found[k] for k in PRICES if found[k]]


# ---------------------------------------------------------------- price transforms


def transform_prices(df: DataFrame, method: str = "returns", s: Series = BARS) -> DataFrame:
    """``_raw`` and ``_original`` copies plus returns, log or change-from-first of every price."""
    cols = _price_columns(df)
    df = df.withColumns({f"{c}_{k}": F.col(c) for c in cols for k in ("raw", "original")})
    if method in ("returns", "multi"):
        df = frames(df, s, lambda x, w: x.withColumns(
            {f"{c}_return": change(c, F.lag(c).over(w)) for c in cols}), back=1)
    if method in ("log", "multi"):
        low = df.groupBy(*s.keys).agg(*[F.min(c).alias(f"_min_{c}") for c in cols])
        df = join_by(df, low, list(s.keys)).withColumns({f"{c}_log": F.ln(F.col(c) + log_offset(F.col(f"_min_{c}"))) for c in cols})
        df = df.drop(*[f"_min_{c}" for c in cols])
    if method == "pct_change":
        df = numbered(df, s)
        first = df.where(F.col(s.pos) == 0).select(*s.keys, *[F.col(c).alias(f"_first_{c}") for c in cols])
        df = join_by(df, first, list(s.keys)).withColumns({
            f"{c}_pct_change": F.when(F.col(f"_first_{c}") == 0, 0.0).otherwise(change(c, f"_first_{c}") * 100)
            for c in cols}).drop(*[f"_first_{c}" for c in cols])
    return df


def log_offset(low: Column) -> Column:
    """0 for positive data, else what lifts the smallest value just above 0."""
    return F.when(low > 0, 0.0).otherwise(F.abs(low) + LOG_OFFSET)


# ---------------------------------------------------------------- treatments


def warm_up(df: DataFrame, s: Series = BARS, rules: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Per key: ``n_rows`` and the rows each window class needs before all its columns are known."""
    df = numbered(df, s)
    classes = categorise([c for c in df.columns if c not in {*s.keys, s.ts, s.pos}], rules)
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for cls, default in DEFAULT_WARM_UP.items():
        firsts = [F.min(F.when(F.col(c).isNotNull(), F.col(s.pos))) for c, k in classes.items() if k == cls]
        size = F.greatest(*firsts, F.lit(-1)) if firsts else F.lit(-1)
        aggs.append(F.when(size >= 0, size + 1).otherwise(F.lit(default)).cast("long").alias(cls))
    return df.groupBy(*s.keys).agg(*aggs)


def fill_by_type(df: DataFrame, s: Series = BARS, cols: Sequence[str] | None = None) -> DataFrame:
    """Fill every column the way its kind calls for (see ``FILL_CLASSES``); rows are kept."""
    df = numbered(df, s)
    skip = {*s.keys, s.ts, *s.tie, s.pos}
    every = [c for c in (cols or df.columns) if c not in skip]
    names = columns_with_nulls(df, every)  # no rule changes a known value
    if not names:
        return df
    types = {f.name: f.dataType for f in df.schema.fields}
    kind = {c: next((k for k, pat in FILL_CLASSES if re.search(pat, c.lower())), "rest") for c in every}
    raw = {p: next((c for c in every if p in c.lower() and "raw" in c.lower()), None) for p in PRICES}

    def base_price(c: str) -> str | None:
        return raw[next((p for p in ("open", "high", "low") if p in c), "close")]

    window = {}
    for c in names:
        m = re.match(r"[^_]+_(\d+)(?:_|$)", c)
        if kind[c] == "average" and m and base_price(c):
            window[c] = int(m.group(1))
    if window:
        df = frames(df, s, lambda x, w: x.withColumns({
            f"_est_{c}": F.avg(base_price(c)).over(w.rowsBetween(-(n - 1), 0)) for c, n in window.items()}),
            back=max(window.values()) - 1)
    filled = [c for c in names if kind[c] not in ("pattern", "derived")]
    numeric, _ = split_numeric(df, skip)
    straight = [c for c in filled if kind[c] == "rest" and c in numeric]
    if straight:
        df = interpolate(df, straight, s, by="row")
    outs = {}
    for c in filled:
        if c not in straight:
            outs[f"_p_{c}"], outs[f"_n_{c}"] = last(c), next_(c)
    df = scan(df, s, outs) if outs else df
    counted = [c for c in names if kind[c] == "pattern" and types[c].typeName() != "boolean"]
    if counted:
        df = join_by(df, modes(df, counted, s), list(s.keys))

    def held(c: str) -> Column:
        return F.coalesce(F.col(f"_p_{c}"), F.col(f"_n_{c}")) if c in names else F.col(c)

    def value(c: str) -> Column:
        k = kind[c]
        if c in straight:
            return F.col(c)
        if k == "pattern":
            if types[c].typeName() == "boolean":
                return F.coalesce(F.col(c), F.lit(False))
            return F.coalesce(F.col(c), F.col(f"_mode_{c}").cast(types[c]))
        if k == "derived":
            return F.coalesce(F.col(c), F.lit(0.0))
        before, after = F.col(f"_p_{c}"), F.col(f"_n_{c}")
        if k == "average":
            return F.coalesce(before, *([F.col(f"_est_{c}")] if c in window else []), after)
        ends = {"volume": 0.0, "rsi": RSI_NEUTRAL, "oscillator": 0.0, "volatility": VOLATILITY_DEFAULT}
        if k in ends:
            return F.coalesce(before, after, F.lit(ends[k]))
        if k == "band" and raw["close"]:
            price = held(raw["close"])
            middle = next((m for m in every if kind[m] == "band" and "middle" in m), None)
            centre = F.coalesce(held(middle), price) if middle else price
            factor = 1.0 if "middle" in c else BAND_UP if "upper" in c else BAND_DOWN
            return F.coalesce(before, after, centre * factor, F.lit(VOLATILITY_DEFAULT))
        return F.coalesce(before, after, *([F.lit(VOLATILITY_DEFAULT)] if k == "band" else []))

    helper = [*outs, *[f"_est_{c}" for c in window], *[f"_mode_{c}" for c in counted]]
    return df.withColumns({c: value(c) for c in names}).drop(*helper)


def fill_remaining(df: DataFrame, s: Series = BARS, cols: Sequence[str] | None = None) -> DataFrame:
    df = numbered(df, s)
    todo = columns_with_nulls(df, [c for c in (cols or df.columns) if c not in {*s.keys, s.ts, *s.tie, s.pos}])
    return fill_everything(df, s, linear=True, cols=todo) if todo else df


def _sized(df: DataFrame, s: Series, rules: Mapping[str, Sequence[str]] | None) -> DataFrame:
    sizes = warm_up(df, s, rules).select(*s.keys, F.col("n_rows").alias("_rows"), *[F.col(c).alias(f"_{c}") for c in DEFAULT_WARM_UP])
    return join_by(df, sizes, list(s.keys))


_SIZES = ("_rows", *[f"_{c}" for c in DEFAULT_WARM_UP])


def treat_basic(df: DataFrame, s: Series = BARS, min_points: int = 1000, trim: int | None = None,
                rules: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Cut the warm-up off long symbols and fill the rest; fill short symbols by type."""
    df = stage(_sized(numbered(df, s), s, rules))
    cut = F.lit(trim).cast("long") if trim else F.greatest(*[F.col(f"_{c}") for c in DEFAULT_WARM_UP])
    df = df.withColumn("_cut", cut)
    long_enough = F.col("_rows") > F.col("_cut") + min_points
    kept = df.where(long_enough & (F.col(s.pos) >= F.col("_cut"))).withColumn(s.pos, F.col(s.pos) - F.col("_cut"))
    return fill_remaining(kept.drop("_cut", *_SIZES), s).unionByName(
        fill_by_type(df.where(~long_enough).drop("_cut", *_SIZES), s).select(*kept.drop("_cut", *_SIZES).columns))


def treat_advanced(df: DataFrame, s: Series = BARS, min_points: int = 1000,
                   rules: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Per class: returns 0, categories mode, short back-filled, medium back-filled after the
    warm-up, long cut off (all where the symbol is long enough, else filled); then fill the rest."""
    df = stage(_sized(numbered(df, s), s, rules))
    skip = {*s.keys, s.ts, *s.tie, s.pos, *_SIZES}
    classes = categorise([c for c in df.columns if c not in skip], rules)
    has_long = "long_window" in classes.values()
    gaps = set(columns_with_nulls(df, list(classes)))
    of = {cls: [c for c, k in classes.items() if k == cls and c in gaps] for cls in
          ("returns", "categorical", "short_window", "medium_window", "long_window")}
    types = {f.name: f.dataType for f in df.schema.fields}
    roomy = {cls: F.col("_rows") > F.col(f"_{cls}") + min_points for cls in ("medium_window", "long_window")}
    if of["categorical"]:
        df = join_by(df, modes(df, of["categorical"], s), list(s.keys))
    for c in of["medium_window"]:
        df = df.withColumn(f"_lin_{c}", F.col(c))
    if of["medium_window"]:
        df = interpolate(df, [f"_lin_{c}" for c in of["medium_window"]], s, by="row")
    outs = {}
    for c in (*of["short_window"], *of["medium_window"], *of["long_window"]):
        outs[f"_p_{c}"], outs[f"_n_{c}"] = last(c), next_(c)
    df = scan(df, s, outs) if outs else df
    new: dict[str, Column] = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in of["returns"]}
    new |= {c: F.coalesce(F.col(c), F.col(f"_mode_{c}").cast(types[c])) for c in of["categorical"]}
    new |= {c: F.coalesce(F.col(f"_n_{c}"), F.col(f"_p_{c}")) for c in of["short_window"]}
    for c in of["medium_window"]:
        main = F.when(F.col(s.pos) >= F.col("_medium_window"), F.col(f"_n_{c}")).otherwise(F.col(c))
        new[c] = F.when(roomy["medium_window"], main).otherwise(F.coalesce(F.col(f"_lin_{c}"), F.lit(0.0)))
    for c in of["long_window"]:
        end = [F.lit(VOLATILITY_DEFAULT)] if "volatility" in c else []
        filled = F.coalesce(F.col(f"_p_{c}"), F.col(f"_n_{c}"), *end)
        new[c] = F.when(roomy["long_window"], F.col(c)).otherwise(filled)
    df = df.withColumns(new) if new else df
    if has_long:
        cut = F.when(roomy["long_window"], F.col("_long_window")).otherwise(F.lit(0))
        df = df.where(F.col(s.pos) >= cut).withColumn(s.pos, F.col(s.pos) - cut)
    df = df.drop(*outs, *[f"_mode_{c}" for c in of["categorical"]], *[f"_lin_{c}" for c in of["medium_window"]], *_SIZES)
    return fill_remaining(stage(df), s)


def treat_hybrid(df: DataFrame, s: Series = BARS, min_points: int = 1000,
                 rules: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Small symbols filled by type, middling ones filled (long-window columns dropped when more
    than a third of their rows would be lost), large ones treated like ``advanced``.

    The drop changes the schema, so it is decided once, on the middling symbols together.
    """
    df = stage(_sized(numbered(df, s), s, rules))
    size = F.when(F.col("_rows") < 1.5 * min_points, "small").when(F.col("_rows") < 3 * min_points, "middle").otherwise("large")
    df = df.withColumn("_size", size)

    def part(name: str) -> DataFrame:
        return df.where(F.col("_size") == name)

    skip = {*s.keys, s.ts, *s.tie, s.pos, *_SIZES, "_size"}
    classes = categorise([c for c in df.columns if c not in skip], rules)
    of = {k: [c for c, cls in classes.items() if cls == k] for k in
          ("returns", "categorical", "short_window", "medium_window", "long_window")}
    drop: list[str] = []
    if of["long_window"]:
        gap = F.greatest(*[F.col(c).isNull().cast("int") for c in of["long_window"]], F.lit(0))
        lost = part("middle").agg(F.sum(gap).alias("lost"), F.count(F.lit(1)).alias("n")).first()
        if lost["n"] and lost["lost"] > lost["n"] // 3:
            drop = of["long_window"]
    middle = part("middle")
    held = [c for k in ("short_window", "medium_window") for c in of[k]]
    outs = {}
    for c in held:
        outs[f"_p_{c}"], outs[f"_n_{c}"] = last(c), next_(c)
    middle = scan(middle, s, outs) if outs else middle
    room = F.col("_medium_window") < F.floor(F.col("_rows") / 3)
    new: dict[str, Column] = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in of["returns"]}
    for c in held:
        both = F.coalesce(F.col(f"_n_{c}"), F.col(f"_p_{c}"))
        new[c] = both if c in of["short_window"] else F.when(room, both).otherwise(F.col(c))
    types = {f.name: f.dataType for f in df.schema.fields}
    if of["categorical"]:
        middle = join_by(middle, modes(middle, of["categorical"], s), list(s.keys))
        new |= {c: F.coalesce(F.col(c), F.col(f"_mode_{c}").cast(types[c])) for c in of["categorical"]}
    middle = middle.withColumns(new) if new else middle
    middle = middle.drop(*outs, *[f"_mode_{c}" for c in of["categorical"]], "_size", *_SIZES, *drop)
    result = fill_remaining(middle, s)
    for other in (fill_by_type(part("small").drop("_size", *_SIZES), s),
                  treat_advanced(part("large").drop("_size", *_SIZES), s, min_points, rules)):
        result = result.unionByName(other.drop(*drop))
    return result


def prepare_features(df: DataFrame, mode: str = "advanced", price_method: str = "returns", s: Series = BARS,
                     min_points: int = 1000, trim: int | None = None,
                     rules: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Price transforms followed by the chosen treatment."""
    df = stage(transform_prices(df, price_method, s))
    if mode == "basic":
        return treat_basic(df, s, min_points, trim, rules)
    if mode == "hybrid":
        return treat_hybrid(df, s, min_points, rules)
    if mode == "advanced":
        return treat_advanced(df, s, min_points, rules)
    raise ValueError(f"unknown treatment {mode!r}")


__all__ = ["fill_by_type", "fill_remaining", "log_offset", "prepare_features", "transform_prices",
           "treat_advanced", "treat_basic", "treat_hybrid", "warm_up"]
