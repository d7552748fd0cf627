"""Returns, drawdowns, trade statistics and report tables from equity curves and trades.

Equity tables carry the account keys (``run_id`` by default), a time stamp and ``equity``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.functions.columns import change, ratio
from barspark.operators.quantiles import quantiles
from barspark.operators.series import Series, frames, join_by, number_rows, numbered, rolling, rolling_means, running_max, running_sum, scan, utc_micros

# ---- fixed values
PERIODS_PER_YEAR = 252
DAYS_PER_YEAR, DAYS_PER_MONTH = 365, 30
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
# ---- end of fixed values

CURVE = Series(keys=("run_id",))
TRADES = Series(keys=("run_id",), ts="exit_time", tie=("position_id",))


def _days(a: Column, b: Column) -> Column:
    """Whole days from ``a`` to ``b``."""
    return F.floor((utc_micros(b) - utc_micros(a)) / 86_400e6).cast("long")


def _or_zero(value: Column, denominator: Column) -> Column:
    """Ratio with the convention that a zero denominator gives 0 (and an unknown one null)."""
    return F.when(denominator == 0, 0.0).otherwise(ratio(value, denominator))


# ---------------------------------------------------------------- curves


def returns(df: DataFrame, s: Series = CURVE) -> DataFrame:
    def make(x: DataFrame, w) -> DataFrame:
        before = F.lag("equity").over(w)
        return x.withColumns({"return": change("equity", before), "log_return": F.ln(ratio("equity", before))})

    return frames(df, s, make, back=1)


def drawdown_series(df: DataFrame, s: Series = CURVE) -> DataFrame:
    x = scan(numbered(df, s), s, {"peak": running_max("equity")})
    return x.withColumn("drawdown", ratio(F.col("equity") - F.col("peak"), "peak"))


def drawdown_spells(df: DataFrame, s: Series = CURVE) -> DataFrame:
    """One row per stretch below the peak: start, end, trough, depth, whole days."""
    x = df if "drawdown" in df.columns else drawdown_series(df, s)
    x = scan(x, s, {"_spell": running_sum((F.col("drawdown") == 0).cast("long"))})
    under = x.where(F.col("drawdown") < 0).groupBy(*s.keys, "_spell").agg(
        F.min(s.ts).alias("start_time"), F.max(s.ts).alias("end_time"),
        F.min(F.struct(F.col("drawdown").alias("d"), F.col(s.ts).alias("t"))).alias("_low"), F.count(F.lit(1)).alias("n_rows"))
    return under.select(*s.keys, "start_time", "end_time", F.col("_low.t").alias("trough_time"),
                        F.col("_low.d").alias("max_drawdown"), "n_rows",
                        _days(F.col("start_time"), F.col("end_time")).alias("duration_days"))


def top_drawdowns(df: DataFrame, n: int = 5, s: Series = CURVE) -> DataFrame:
    """The ``n`` deepest spells of each account, earliest first among equals.

    First the n best of each of 64 slices of an account (Spark cuts every sorted slice at n before
    and after the shuffle), then the n best of those.
    """
    order = ["max_drawdown", "start_time"]

    def best(x: DataFrame, *by: str) -> DataFrame:
        return x.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)

    spells = drawdown_spells(df, s).withColumn("_slice", F.pmod(F.xxhash64("start_time"), F.lit(64)))
    top = best(best(spells, *s.keys, "_slice").drop("rank"), *s.keys)
    return top.select(*s.keys, "rank", "max_drawdown", "start_time", "end_time", "trough_time", "duration_days")


def drawdown_summary(df: DataFrame, s: Series = CURVE) -> DataFrame:
    """Depth, longest spell (first of equals; spells under a day do not count), current, time under water."""
    x = drawdown_series(df, s)
    keys = list(s.keys)
    under = F.col("drawdown") < 0
    total = x.groupBy(*keys).agg(
        F.min("drawdown").alias("max_drawdown"), F.max_by("drawdown", F.struct(s.ts, "drawdown")).alias("current_drawdown"),
        (F.count_if(under) / F.count(F.lit(1)) * 100).alias("underwater_pct"),
        F.coalesce(F.avg(F.when(under, F.col("drawdown"))), F.lit(0.0)).alias("avg_drawdown"))
    longest = F.min(F.struct((-F.col("duration_days")).alias("d"), F.col("start_time").alias("t"), F.col("max_drawdown").alias("m")))
    spell = drawdown_spells(x, s).where("duration_days > 0").groupBy(*keys).agg(longest.alias("_l"))
    return join_by(total, spell, keys).select(
        *keys, "max_drawdown", F.coalesce(-F.col("_l.d"), F.lit(0)).alias("max_duration_days"),
        F.coalesce(F.col("_l.m"), F.lit(0.0)).alias("max_duration_drawdown"), "current_drawdown", "underwater_pct", "avg_drawdown")


def performance_summary(df: DataFrame, s: Series = CURVE, risk_free: float = 0.0, periods: int = PERIODS_PER_YEAR) -> DataFrame:
    """Return, volatility, Sharpe, Sortino, Calmar and drawdown figures, one row per account."""
    keys, r = list(s.keys), F.col("return")
    base = returns(df, s).groupBy(*keys).agg(
        F.min_by("equity", F.struct(s.ts, "equity")).alias("initial_equity"), F.max_by("equity", F.struct(s.ts, "equity")).alias("final_equity"),
        F.min(s.ts).alias("_t0"), F.max(s.ts).alias("_t1"), F.stddev_samp(r).alias("_sd"),
        F.stddev_samp(F.when(r < 0, r)).alias("_down"))
    m = join_by(base, drawdown_summary(df, s), keys, "inner")
    total = ratio("final_equity", "initial_equity") - 1
    days = F.greatest(F.lit(1), _days(F.col("_t0"), F.col("_t1")))
    m = m.withColumns({"_total": total, "trading_days": days})
    m = m.withColumns({"_ann": F.pow(1 + F.col("_total"), F.lit(DAYS_PER_YEAR) / F.col("trading_days")) - 1,
                       "_vol": F.col("_sd") * math.sqrt(periods), "_dd": F.col("_down") * math.sqrt(periods)})
    excess = F.col("_ann") - risk_free
    return m.select(
        *keys, "initial_equity", "final_equity", (F.col("_total") * 100).alias("total_return_pct"),
        (F.col("_ann") * 100).alias("annualized_return_pct"), "trading_days",
        (F.col("trading_days") / DAYS_PER_MONTH).alias("trading_months"), (F.col("_vol") * 100).alias("annualized_volatility_pct"),
        _or_zero(excess, F.col("_vol")).alias("sharpe_ratio"), _or_zero(excess, F.col("_dd")).alias("sortino_ratio"),
        (F.col("max_drawdown") * 100).alias("max_drawdown_pct"), F.col("max_duration_days").alias("max_drawdown_duration"),
        _or_zero(F.col("_ann"), F.abs("max_drawdown")).alias("calmar_ratio"), F.lit(risk_free * 100).alias("risk_free_rate_pct"))


def simple_metrics(df: DataFrame, s: Series = CURVE, risk_free: float = 0.0, periods: int = PERIODS_PER_YEAR) -> DataFrame:
    """The alternative set: annualised by row count, Sharpe with the population deviation."""
    keys, r = list(s.keys), F.col("return")
    low = drawdown_series(df, s).groupBy(*keys).agg(F.min("drawdown").alias("max_drawdown"))
    b = returns(df, s).groupBy(*keys).agg(
        (ratio(F.max_by("equity", F.struct(s.ts, "equity")), F.min_by("equity", F.struct(s.ts, "equity"))) - 1).alias("total_return"), F.count(r).alias("_n"),
        (F.stddev_samp(r) * math.sqrt(periods)).alias("annualized_volatility"),
        (ratio(F.avg(r - risk_free), F.stddev_pop(r - risk_free)) * math.sqrt(periods)).alias("sharpe_ratio"))
    b = join_by(b, low, keys, "inner").withColumn("annualized_return", F.pow(1 + F.col("total_return"), ratio(F.lit(periods), "_n")) - 1)
    return b.withColumn("calmar_ratio", ratio("annualized_return", F.abs("max_drawdown"))).select(
        *keys, "total_return", "annualized_return", "annualized_volatility", "sharpe_ratio", "max_drawdown", "calmar_ratio")


def rolling_metrics(df: DataFrame, window: int = 30, s: Series = CURVE, risk_free: float = 0.0, periods: int = PERIODS_PER_YEAR) -> DataFrame:
    daily = (1 + risk_free) ** (1 / periods) - 1

    def make(x: DataFrame, w) -> DataFrame:
        x = x.withColumn("return", change("equity", F.lag("equity").over(w)))
        x = x.withColumns({
            "rolling_return": change("equity", F.lag("equity", window).over(w)),
            "rolling_volatility": rolling(F.stddev_samp, "return", w, window) * math.sqrt(periods),
            "_top": rolling(F.max, "equity", w, window)})
        x = rolling_means(x, w, {"_mean": ("return", window)})
        return x.withColumns({
            "rolling_sharpe": ratio((F.col("_mean") - daily) * periods, "rolling_volatility"),
            "rolling_drawdown": ratio(F.col("equity") - F.col("_top"), "_top")})

    return frames(df, s, make, back=window + 1).select(
        *s.keys, s.ts, "rolling_return", "rolling_volatility", "rolling_sharpe", "rolling_drawdown")


# ---------------------------------------------------------------- periods


def period_returns(df: DataFrame, period: str = "M", s: Series = CURVE) -> DataFrame:
    """``D``: change per row; ``W`` (weeks ending on Sunday) and ``M``: last over first of the period."""
    if period == "D":
        return returns(df, s).where(F.col("return").isNotNull()).select(*s.keys, s.ts, "return")
    start = F.date_trunc({"W": "week", "M": "month"}[period], F.col(s.ts).cast("timestamp"))
    g = df.groupBy(*s.keys, start.alias("period_start")).agg(
        F.min_by("equity", F.struct(s.ts, "equity")).alias("start_equity"), F.max_by("equity", F.struct(s.ts, "equity")).alias("end_equity"))
    g = g.withColumn("return", ratio("end_equity", "start_equity") - 1)
    if period == "M":
        g = g.withColumns({"year": F.year("period_start"), "month": F.month("period_start"),
                           "month_name": F.date_format("period_start", "MMM")})
    return g


def month_end_returns(df: DataFrame, s: Series = CURVE) -> DataFrame:
    """Last equity of a month over the last of the month before (months are few per account)."""
    g = df.groupBy(*s.keys, F.year(s.ts).alias("year"), F.month(s.ts).alias("month")).agg(F.max_by("equity", F.struct(s.ts, "equity")).alias("equity"))
    w = Window.partitionBy(*s.keys).orderBy("year", "month")
    return g.withColumn("return", change("equity", F.lag("equity").over(w)))


def monthly_table(df: DataFrame, s: Series = CURVE) -> DataFrame:
    """Year x month returns in percent, compounded ``Year`` column, average row (year null)."""
    m = period_returns(df, "M", s)
    factor = 1 + F.col("return")
    # product of the month factors through logarithms, sign and zeros kept apart
    product = F.when(F.count_if(factor == 0) > 0, 0.0).otherwise(
        F.exp(F.sum(F.when(factor != 0, F.ln(F.abs(factor))))) * F.when(F.count_if(factor < 0) % 2 == 1, -1.0).otherwise(1.0))
    wide = m.groupBy(*s.keys, "year").pivot("month_name", MONTHS).agg(F.avg("return"))
    table = join_by(wide, m.groupBy(*s.keys, "year").agg((product - 1).alias("year_total")), [*s.keys, "year"], "inner")
    mean = m.groupBy(*s.keys).pivot("month_name", MONTHS).agg(F.avg("return")).withColumns(
        {"year": F.lit(None).cast("int"), "year_total": F.lit(None).cast("double")})
    table = table.unionByName(mean)
    return table.select(*s.keys, "year", *[(F.col(c) * 100).alias(c) for c in MONTHS], (F.col("year_total") * 100).alias("year_total"))


def calendar_returns(df: DataFrame, s: Series = CURVE) -> DataFrame:
    return period_returns(df, "M", s).select(*s.keys, "year", "month", "start_equity", "end_equity", "return")


def return_distribution(r: DataFrame, s: Series = CURVE, c: str = "return") -> DataFrame:
    """Mean, median, deviation, range and share of positive returns (percent)."""
    pct = r.select(*s.keys, (F.col(c) * 100).alias("r"))
    stats = pct.groupBy(*s.keys).agg(
        F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), F.min("r").alias("min"), F.max("r").alias("max"),
        (F.count_if(F.col("r") > 0) / F.count("r") * 100).alias("positive_pct"), F.count("r").alias("n"))
    med = quantiles(pct, ["r"], (0.5,), s).select(*s.keys, F.col("q")[0].alias("median"))
    return join_by(stats, med, list(s.keys))


def return_histogram(r: DataFrame, bins: int = 50, s: Series = CURVE, c: str = "return") -> DataFrame:
    """Counts in ``bins`` equal bins between the smallest and largest return (percent), last bin closed."""
    pct = r.where(F.col(c).isNotNull()).select(*s.keys, (F.col(c) * 100).alias("r"))
    edge = pct.groupBy(*s.keys).agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    x = join_by(pct, edge, list(s.keys), "inner").withColumn("bin", F.least(F.lit(bins - 1), F.floor(
        F.coalesce(ratio(F.col("r") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * bins)))
    return x.groupBy(*s.keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.first("lo").alias("_lo"), F.first("hi").alias("_hi")).select(
        *s.keys, F.col("bin").cast("long").alias("bin"), (F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins).alias("bin_start"), "n")


# ---------------------------------------------------------------- trades


def trade_metrics(t: DataFrame, s: Series = TRADES) -> DataFrame:
    """Counts, P&L, profit factor (null with ``no_losses`` when nothing was lost), holding days."""
    p = F.col("pnl")
    gain, loss = F.sum(F.when(p > 0, p)), F.abs(F.sum(F.when(p < 0, p)))
    hold = (utc_micros("exit_time") - utc_micros("entry_time")) / 86_400e6
    zero = F.lit(0.0)
    return t.groupBy(*s.keys).agg(
        F.count(F.lit(1)).alias("total_trades"), F.count_if(p > 0).alias("winning_trades"), F.count_if(p < 0).alias("losing_trades"),
        (F.count_if(p > 0) / F.count(F.lit(1)) * 100).alias("win_rate_pct"), F.sum(p).alias("total_pnl"), F.avg(p).alias("average_pnl"),
        F.coalesce(F.avg(F.when(p > 0, p)), zero).alias("average_win"), F.coalesce(F.avg(F.when(p < 0, p)), zero).alias("average_loss"),
        ratio(F.coalesce(gain, zero), F.coalesce(loss, zero)).alias("profit_factor"), F.coalesce(loss == 0, F.lit(True)).alias("no_losses"),
        F.avg(p).alias("expected_payoff"), F.avg(hold).alias("avg_holding_period_days"))


def trade_streaks(t: DataFrame, s: Series = TRADES, method: str = "time") -> DataFrame:
    """Longest runs of winning and of not winning trades by exit time."""
    x = number_rows(t.withColumn("_won", F.col("pnl") > 0), s, method=method)
    x = frames(x, s, lambda y, w: y.withColumn("_new", F.coalesce(F.col("_won") != F.lag("_won").over(w), F.lit(True)).cast("long")), back=1)
    x = scan(x, s, {"_streak": running_sum("_new")})
    runs = x.groupBy(*s.keys, "_streak", "_won").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy(*s.keys).agg(
        F.coalesce(F.max(F.when(F.col("_won"), F.col("n"))), F.lit(0)).alias("max_win_streak"),
        F.coalesce(F.max(F.when(~F.col("_won"), F.col("n"))), F.lit(0)).alias("max_loss_streak"))


def trade_summary(t: DataFrame, s: Series = TRADES) -> DataFrame:
    p = F.col("pnl")
    return t.groupBy(*s.keys).agg(
        F.count(F.lit(1)).alias("total_trades"), F.count_if(p > 0).alias("winning_trades"), F.count_if(p < 0).alias("losing_trades"),
        (F.count_if(p > 0) / F.count(F.lit(1))).alias("win_rate"), F.sum(p).alias("total_pnl"),
        F.coalesce(F.avg(F.when(p > 0, p)), F.lit(0.0)).alias("avg_profit"), F.coalesce(F.avg(F.when(p < 0, p)), F.lit(0.0)).alias("avg_loss"),
        F.max(p).alias("largest_profit"), F.min(p).alias("largest_loss"),
        ratio(-F.sum(F.when(p > 0, p)), F.sum(F.when(p < 0, p))).alias("profit_factor"),
        F.avg((utc_micros("exit_time") - utc_micros("entry_time")) / 1e6).alias("avg_trade_seconds"))


def cumulative_pnl(t: DataFrame, s: Series = TRADES, method: str = "time") -> DataFrame:
    return scan(number_rows(t, s, method=method), s, {"cumulative_pnl": running_sum("pnl")})


def trades_by(t: DataFrame, by: dict[str, Column], s: Series = TRADES) -> DataFrame:
    """Count, mean and total P&L, win rate per group, e.g. symbol, exit month or entry hour."""
    p = F.col("pnl")
    return t.groupBy(*s.keys, *[c.alias(n) for n, c in by.items()]).agg(
        F.count(F.lit(1)).alias("n_trades"), F.avg(p).alias("mean_pnl"), F.sum(p).alias("total_pnl"),
        (F.count_if(p > 0) / F.count(F.lit(1)) * 100).alias("win_rate_pct"))


def by_symbol(t: DataFrame, s: Series = TRADES) -> DataFrame:
    return trades_by(t, {"symbol": F.col("symbol")}, s)


def by_month(t: DataFrame, s: Series = TRADES) -> DataFrame:
    return trades_by(t, {"month": F.date_format(F.col("exit_time").cast("timestamp"), "yyyy-MM")}, s)


def by_entry_hour(t: DataFrame, s: Series = TRADES) -> DataFrame:
    return trades_by(t, {"entry_hour": F.hour("entry_time")}, s)


# ---------------------------------------------------------------- comparison


def compare_runs(metrics: DataFrame, runs: Sequence[str] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    out = metrics.where(F.col("run_id").isin(list(runs))) if runs else metrics
    return out.select("run_id", *columns) if columns else out


def best_run(metrics: DataFrame, by: str = "sharpe_ratio") -> DataFrame:
    """The run with the highest value (first name among equals), by one aggregation."""
    best = F.min(F.struct((-F.col(by)).alias("v"), F.col("run_id").alias("run_id")))["run_id"]
    return metrics.where(F.col(by).isNotNull()).agg(best.alias("run_id")).join(metrics, "run_id")


def sweep_table(metrics: DataFrame, value: str, shorts: Sequence[int], longs: Sequence[int]) -> DataFrame:
    """short x long table of one metric, for run ids of the form ``short/long``."""
    parts = metrics.withColumns({"short_window": F.split("run_id", "/")[0].cast("int"), "long_window": F.split("run_id", "/")[1].cast("int")})
    wide = parts.groupBy("short_window").pivot("long_window", list(longs)).agg(F.first(value))
    return wide.where(F.col("short_window").isin(list(shorts))).select("short_window", *[F.col(str(b)).alias(f"long_{b}") for b in longs])


def normalised_equity(df: DataFrame, s: Series = CURVE, base: float = 100.0) -> DataFrame:
    first = df.groupBy(*s.keys).agg(F.min_by("equity", F.struct(s.ts, "equity")).alias("_first"))
    return join_by(df, first, list(s.keys), "inner").withColumn("normalised", ratio("equity", "_first") * base).drop("_first")


def rebase_benchmark(df: DataFrame, benchmark: DataFrame, s: Series = CURVE, c: str = "benchmark") -> DataFrame:
    """Benchmark scaled to start at each account's first equity (both matched on time)."""
    x = df.join(benchmark, s.ts)
    first = x.groupBy(*s.keys).agg(F.min_by("equity", F.struct(s.ts, "equity")).alias("_e"), F.min_by(c, s.ts).alias("_b"))
    return join_by(x, first, list(s.keys), "inner").withColumn("benchmark_rebased", ratio(c, "_b") * F.col("_e")).drop("_e", "_b")


