"""Ticks or bars to regular bars, higher timeframes and timelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.operators.series import BARS, Series, frames, join_by, last, numbered, scan, utc_micros

GRID_BLOCK = 8_192
_UNITS = {
    "second": 1_000_000, "sec": 1_000_000, "s": 1_000_000,
    "minute": 60_000_000, "min": 60_000_000, "m": 60_000_000,
    "hour": 3_600_000_000, "h": 3_600_000_000,
    "day": 86_400_000_000, "d": 86_400_000_000,
    "week": 604_800_000_000, "w": 604_800_000_000,
}


def rule_micros(rule: str) -> int:
    """``"1 hour"``, ``"5min"``, ``"1D"`` ... in microseconds."""
    text = rule.strip().lower()
    digits = "".join(ch for ch in text if ch.isdigit()) or "1"
    unit = "".join(ch for ch in text if ch.isalpha())
    unit = unit if unit in _UNITS else unit.rstrip("s")
    if unit not in _UNITS:
        raise ValueError(f"unknown resampling rule {rule!r}")
    return int(digits) * _UNITS[unit]


def _first(c: str, order: Sequence[str]) -> Column:
    v = F.col(c)
    return F.min(F.when(v.isNotNull(), F.struct(*order, v.alias("_v"))))["_v"]


def _last(c: str, order: Sequence[str]) -> Column:
    v = F.col(c)
    return F.max(F.when(v.isNotNull(), F.struct(*order, v.alias("_v"))))["_v"]


def _bin(s: Series, rule: str, origin: int) -> Column:
    return F.floor((utc_micros(s.ts) - F.lit(origin)) / F.lit(rule_micros(rule))).cast("long")


def _stamp(bin_: str, rule: str, origin: int) -> Column:
    return F.timestamp_micros(F.col(bin_) * rule_micros(rule) + F.lit(origin))


def grid(df: DataFrame, rule: str, s: Series = BARS, origin: int = 0) -> DataFrame:
    """Every bin between a key's first and last row: ``keys, _bin, pos``.

    Built in two steps (blocks, then the bins of a block) so that no array and no task
    holds a whole key.
    """
    keys = list(s.keys)
    bounds = df.groupBy(*keys).agg(F.min(_bin(s, rule, origin)).alias("_b0"), F.max(_bin(s, rule, origin)).alias("_b1"))
    blocks = bounds.withColumn(
        "_g", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_b1 - _b0) div {GRID_BLOCK}")))
    ).repartition(*keys, "_g")
    first = F.col("_b0") + F.col("_g") * GRID_BLOCK
    bins = F.explode(F.sequence(first, F.least(F.col("_b1"), first + (GRID_BLOCK - 1))))
    return blocks.withColumn("_bin", bins).select(*keys, "_bin", (F.col("_bin") - F.col("_b0")).alias(s.pos))


def bars_from_ticks(df: DataFrame, rule: str, price: str = "price", volume: str | None = None,
                    s: Series = BARS, origin: int = 0) -> DataFrame:
    """OHLCV per non-empty bin from single prices; volume counts ticks when none is given."""
    order = [s.ts, *s.tie]
    ohlcv = df.withColumn("_bin", _bin(s, rule, origin)).groupBy(*s.keys, "_bin").agg(
        _first(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        _last(price, order).alias("close"),
        (F.sum(volume) if volume else F.count(price)).cast("double").alias("volume"),
    )
    return ohlcv.withColumn(s.ts, _stamp("_bin", rule, origin))


def ohlcv_grid(df: DataFrame, rule: str, price: str = "price", volume: str | None = None,
               s: Series = BARS, origin: int = 0) -> DataFrame:
    """Ticks to a gap-free grid: empty bins have null prices and volume 0."""
    ohlcv = bars_from_ticks(df, rule, price, volume, s, origin).drop(s.ts)
    return (
        join_by(grid(df, rule, s, origin), ohlcv, [*s.keys, "_bin"])
        .withColumn("volume", F.coalesce("volume", F.lit(0.0)))
        .withColumn(s.ts, _stamp("_bin", rule, origin))
        .select(*s.keys, s.ts, s.pos, "open", "high", "low", "close", "volume")
    )


def resample(df: DataFrame, rule: str, s: Series = BARS, origin: int = 0) -> DataFrame:
    """Bars to coarser bars on a gap-free grid: first/max/min/last, volume sum, other numbers mean."""
    order = [s.ts, *s.tie]
    rest = [f.name for f in df.schema.fields
            if f.name not in {*s.keys, s.ts, s.pos, *s.tie, "open", "high", "low", "close", "volume"}
            and f.dataType.typeName() in ("double", "float", "integer", "long", "short")]
    aggs = [_first("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
            _last("close", order).alias("close")]
    if "volume" in df.columns:
        aggs.append(F.sum("volume").alias("volume"))
    aggs += [F.avg(c).alias(c) for c in rest]
    binned = df.withColumn("_bin", _bin(s, rule, origin)).groupBy(*s.keys, "_bin").agg(*aggs)
    out = join_by(grid(df, rule, s, origin), binned, [*s.keys, "_bin"])
    if "volume" in df.columns:
        out = out.withColumn("volume", F.coalesce("volume", F.lit(0.0)))
    return out.withColumn(s.ts, _stamp("_bin", rule, origin)).drop("_bin")


def resample_last_known(df: DataFrame, rule: str, cols: Sequence[str], s: Series = BARS, origin: int = 0) -> DataFrame:
    """Value of each column as of every bin start (latest row at or before it)."""
    order = [s.ts, *s.tie]
    # a row decides the bins that start at or after it
    at = F.ceil((utc_micros(s.ts) - F.lit(origin)) / F.lit(rule_micros(rule))).cast("long")
    known = df.withColumn("_bin", at).groupBy(*s.keys, "_bin").agg(*[_last(c, order).alias(c) for c in cols])
    g = grid(df, rule, s, origin)
    out = join_by(g, known, [*s.keys, "_bin"])
    out = scan(out, s, {c: last(c) for c in cols})
    return out.withColumn(s.ts, _stamp("_bin", rule, origin)).drop("_bin")


def gap_report(df: DataFrame, s: Series = BARS) -> DataFrame:
    """Largest distance in seconds between neighbouring rows of a key."""
    def step(x: DataFrame, w) -> DataFrame:
        return x.withColumn("_gap", (utc_micros(s.ts) - F.lag(utc_micros(s.ts)).over(w)) / 1e6)

    return frames(df, s, step, back=1).groupBy(*s.keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("_gap").alias("max_gap_seconds"))


def higher_timeframe(df: DataFrame, ratio: int, s: Series = BARS) -> DataFrame:
    """Trailing bar over the last ``ratio`` bars, null until there are that many."""
    def trail(x: DataFrame, w) -> DataFrame:
        f = w.rowsBetween(-(ratio - 1), 0)
        full = F.col(s.pos) >= ratio - 1
        return x.withColumns({
            "htf_open": F.when(full, F.first("open").over(f)),
            "htf_high": F.when(full, F.max("high").over(f)),
            "htf_low": F.when(full, F.min("low").over(f)),
            "htf_close": F.when(full, F.col("close")),
            "htf_volume": F.when(full, F.sum("volume").over(f)),
        })

    return frames(df, s, trail, back=ratio - 1)


def recent_candles(df: DataFrame, ratio: int, s: Series = BARS) -> DataFrame:
    """The last ``ratio`` raw candles as an array next to each row."""
    def collect(x: DataFrame, w) -> DataFrame:
        candle = F.struct(s.ts, "open", "high", "low", "close", "volume")
        return x.withColumn("candles", F.collect_list(candle).over(w.rowsBetween(-(ratio - 1), 0)))

    return frames(df, s, collect, back=ratio - 1)


def decision_rows(df: DataFrame, minutes: int, s: Series = BARS) -> DataFrame:
    """Rows on a full multiple of ``minutes``."""
    ts = F.col(s.ts).cast("timestamp")
    return df.where((F.minute(ts) % minutes == 0) & (F.second(ts) == 0))


def common_days(df: DataFrame, s: Series = BARS) -> DataFrame:
    """Keep the calendar days on which every key has rows."""
    key = F.struct(*s.keys)
    day = F.to_date(s.ts)
    pairs = df.select(*s.keys, day.alias("_day")).distinct()
    wanted = pairs.select(*s.keys).distinct().agg(F.count(F.lit(1)).alias("_n"))
    counts = pairs.groupBy("_day").agg(F.count(key).alias("_k"))
    # one row on the right-hand side: an equi-join on its count, not a product
    full = counts.join(wanted, counts["_k"] == wanted["_n"]).select("_day")
    return df.withColumn("_day", day).join(full, "_day", "left_semi").drop("_day")


def timeline(df: DataFrame, s: Series = BARS) -> DataFrame:
    return df.select(s.ts).distinct()


def first_of_day(df: DataFrame, s: Series = BARS) -> DataFrame:
    """First row of each key and day, by a partial aggregation instead of a sort."""
    row = F.min(F.struct(s.ts, *s.tie, F.struct(*[c for c in df.columns]).alias("_row")))["_row"]
    picked = df.groupBy(*s.keys, F.to_date(s.ts).alias("day")).agg(row.alias("_row"))
    return picked.select("day", "_row.*")


def last_rows(df: DataFrame, n: int, s: Series = BARS) -> DataFrame:
    """The latest ``n`` rows of each key."""
    df = numbered(df, s)
    ends = df.groupBy(*s.keys).agg(F.max(s.pos).alias("_end"))
    return join_by(df, ends, list(s.keys), "inner").where(F.col(s.pos) > F.col("_end") - n).drop("_end")


__all__ = [
    "bars_from_ticks", "common_days", "decision_rows", "first_of_day", "gap_report", "grid", "higher_timeframe",
    "last_rows", "ohlcv_grid", "recent_candles", "resample", "resample_last_known", "rule_micros",
    "timeline",
]
