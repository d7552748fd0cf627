"""Indicators, volatility, candle patterns and calendar features for many symbols at once.

All bounded look-backs share one window pass over halo blocks, all exponential averages
one carry table; the whole feature set costs one shuffle of the bars.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from barspark.functions.columns import change, ratio
from barspark.functions.naming import find_price_columns
from barspark.operators.series import BARS, Ewm, Series, ewm, frames, numbered, mean_parts, rolling, rolling_means

# ---- fixed values: window lengths and thresholds that define the feature names
AVERAGE_WINDOWS = (5, 10, 20, 50, 200)
RATE_WINDOWS = (1, 5, 10, 20)
VOLATILITY_WINDOWS = (5, 10, 20, 30)
LEVEL_WINDOWS = (10, 20)
RSI_WINDOW = ATR_WINDOW = STOCHASTIC_WINDOW = 14
MACD_FAST, MACD_SLOW, MACD_SIGNAL = 12, 26, 9
DOJI_LIMIT = 0.0005
PERIODS_PER_YEAR = 252
# ---- end of fixed values

GROUPS = ("technical", "volatility", "patterns", "time")


def _smoothed_mix(fast: float, slow: float) -> tuple[float, float]:
    """Weights (a, b) with ``ema_slow(ema_fast(x)) = a * ema_fast(x) + b * ema_slow(x)``.

    Two one-pole filters in a row split into partial fractions; both start in the steady
    state of the first value, so this holds from the first row on.
    """
    bf, bs = 1 - 2 / (fast + 1), 1 - 2 / (slow + 1)
    a = (1 - bs) * bf / (bf - bs)
    return a, 1 - a


@dataclass
class _Layers:
    """Columns by what they need, so that all features cost two window passes.

    ``base``: windows over the bars; ``derived``: projections of those, and sums of earlier ones; ``second``: windows over
    derived columns; ``final``: projections of everything.
    """

    base: dict[str, Column] = field(default_factory=dict)
    derived: dict[str, Column] = field(default_factory=dict)
    second: dict[str, Column] = field(default_factory=dict)
    final: dict[str, Column] = field(default_factory=dict)

    def add_to(self, x: DataFrame) -> DataFrame:
        for layer in (self.base, self.derived, self.second, self.final):
            x = x.withColumns(layer) if layer else x
        names = [*self.base, *self.derived, *self.second, *self.final]
        return x.drop(*[n for n in names if n.startswith("_")])


def _technical(k: _Layers, w: WindowSpec, p: dict[str, str | None]) -> None:
    close = F.col(p["close"])
    delta = close - F.col("_pc")
    k.base |= {"_pc": F.lag(close).over(w), "_std20": rolling(F.stddev_samp, close, w, 20)}
    for n in AVERAGE_WINDOWS:
        parts, k.derived[f"sma_{n}"] = mean_parts(f"sma_{n}", close, w, n)
        k.base |= parts
    k.base |= {f"_lag{n}": F.lag(close, n).over(w) for n in RATE_WINDOWS}
    k.derived |= {"_gain": F.when(delta > 0, delta).otherwise(0.0), "_loss": F.when(delta < 0, -delta).otherwise(0.0)}
    k.second |= {"_up": rolling(F.avg, "_gain", w, RSI_WINDOW), "_down": rolling(F.avg, "_loss", w, RSI_WINDOW)}
    k.final |= {f"roc_{n}": change(close, f"_lag{n}") * 100 for n in RATE_WINDOWS}
    k.final |= {
        "rsi_14": F.when(F.col("_down") == 0, F.when(F.col("_up") > 0, 100.0))
                   .otherwise(100 - 100 / (1 + ratio("_up", "_down"))),
        "bollinger_upper": F.col("sma_20") + 2 * F.col("_std20"),
        "bollinger_lower": F.col("sma_20") - 2 * F.col("_std20"),
        "bollinger_middle": F.col("sma_20"),
    }
    if p["high"] and p["low"]:
        k.base |= {"_top": rolling(F.max, p["high"], w, STOCHASTIC_WINDOW), "_bottom": rolling(F.min, p["low"], w, STOCHASTIC_WINDOW)}
        k.derived["stoch_k"] = 100 * ratio(close - F.col("_bottom"), F.col("_top") - F.col("_bottom"))
        k.second["stoch_d"] = rolling(F.avg, "stoch_k", w, 3)


def _volatility(k: _Layers, w: WindowSpec, p: dict[str, str | None], periods: int) -> None:
    if not (p["high"] and p["low"] and p["close"]):
        return
    high, low, close, before = F.col(p["high"]), F.col(p["low"]), F.col(p["close"]), F.col("_pc")
    k.base["_pc"] = F.lag(close).over(w)
    k.derived |= {"_range": F.greatest(high - low, F.abs(high - before), F.abs(low - before)), "_ret": change(close, before)}
    k.second |= {f"volatility_{n}": rolling(F.stddev_samp, "_ret", w, n) * math.sqrt(periods) for n in VOLATILITY_WINDOWS}
    k.second["atr_14"] = rolling(F.avg, "_range", w, ATR_WINDOW)
    k.final["normalized_atr"] = ratio("atr_14", close)
    if p["open"]:
        hl, co = F.ln(ratio(high, low)), F.ln(ratio(close, p["open"]))
        k.final["gk_volatility"] = 0.5 * hl * hl - (2 * math.log(2) - 1) * co * co


def _patterns(k: _Layers, w: WindowSpec, p: dict[str, str | None]) -> None:
    if not all(p[c] for c in ("open", "high", "low", "close")):
        return
    o, h, lo, c = (F.col(p[n]) for n in ("open", "high", "low", "close"))
    po, pc = F.col("_po"), F.col("_pc")
    body = F.abs(c - o)
    bigger = body > F.abs(po - pc)

    def yes(test: Column) -> Column:
        return F.coalesce(test, F.lit(False))

    k.base |= {"_po": F.lag(o).over(w), "_pc": F.lag(c).over(w)}
    k.base |= {f"resistance_{n}": rolling(F.max, h, w, n) for n in LEVEL_WINDOWS}
    k.base |= {f"support_{n}": rolling(F.min, lo, w, n) for n in LEVEL_WINDOWS}
    k.derived["_ret"] = change(c, pc)
    k.second["_ret_before"] = F.lag("_ret").over(w)
    k.final |= {
        "doji": yes(ratio(body, c) < DOJI_LIMIT),
        "hammer": yes((F.greatest(o, c) - lo >= 2 * body) & (body > 0)),
        "bullish_engulfing": yes((o < c) & (po > pc) & (o <= pc) & (c >= po) & bigger),
        "bearish_engulfing": yes((o > c) & (po < pc) & (o >= pc) & (c <= po) & bigger),
        "price_accel": F.col("_ret") - F.col("_ret_before"),
    }
    for n in LEVEL_WINDOWS:
        k.final[f"dist_to_resistance_{n}"] = ratio(F.col(f"resistance_{n}") - c, c)
        k.final[f"dist_to_support_{n}"] = ratio(c - F.col(f"support_{n}"), c)


def time_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Calendar and session columns; hours are those of the session time zone (UTC)."""
    t = F.col(ts).cast("timestamp")
    hour, day = F.hour(t), F.weekday(t)

    def within(a: int, b: int) -> Column:
        return (hour >= a) & (hour < b)

    return df.withColumns({
        "day_of_week": day, "hour_of_day": hour, "month": F.month(t), "quarter": F.quarter(t),
        "asian_session": within(0, 8), "european_session": within(8, 16),
        "us_session": within(13, 21), "market_overlap": within(8, 16),
        **{f"day_{d}": day == d for d in range(5)},
    })


def add_features(df: DataFrame, s: Series = BARS, groups: Sequence[str] = GROUPS,
                 periods_per_year: int = PERIODS_PER_YEAR) -> DataFrame:
    """Add the feature groups; a group whose price columns are missing is left out.

    Prices must be non-null (run the cleaner first) for the exponential averages.
    """
    p = find_price_columns(df.columns)
    windowed = {"technical", "volatility", "patterns"} & set(groups)
    if p["close"] and windowed:
        df = numbered(df, s)

        def make(x: DataFrame, w: WindowSpec) -> DataFrame:
            k = _Layers()
            if "technical" in groups:
                _technical(k, w, p)
            if "volatility" in groups:
                _volatility(k, w, p, periods_per_year)
            if "patterns" in groups:
                _patterns(k, w, p)
            return k.add_to(x)

        if "technical" in groups:
            spans = {*AVERAGE_WINDOWS, MACD_FAST, MACD_SLOW, MACD_SIGNAL}
            specs = {f"ema_{n}": Ewm(p["close"], n) for n in sorted(spans)}
            df = _macd(ewm(df, s, specs, back=max(AVERAGE_WINDOWS), make=make))
        else:
            df = frames(df, s, make, back=max(VOLATILITY_WINDOWS) + 1)
    return time_features(df, s.ts) if "time" in groups else df


def _macd(df: DataFrame) -> DataFrame:
    fast, slow, sig = (F.col(f"ema_{n}") for n in (MACD_FAST, MACD_SLOW, MACD_SIGNAL))
    a1, b1 = _smoothed_mix(MACD_FAST, MACD_SIGNAL)
    a2, b2 = _smoothed_mix(MACD_SLOW, MACD_SIGNAL)
    df = df.withColumns({"macd": fast - slow, "macd_signal": a1 * fast + b1 * sig - a2 * slow - b2 * sig})
    extra = [f"ema_{n}" for n in (MACD_FAST, MACD_SLOW, MACD_SIGNAL)]
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop(*extra)


def moving_averages(df: DataFrame, s: Series = BARS, windows: Sequence[int] = AVERAGE_WINDOWS,
                    c: str = "close") -> DataFrame:
    return frames(df, s, lambda x, w: rolling_means(x, w, {f"sma_{n}": (c, n) for n in windows}),
                  back=max(windows))
