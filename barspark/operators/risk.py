"""Position sizing, stop and target levels, portfolio limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.functions.columns import col, ratio
from barspark.operators.series import Series, number_rows, running_sum, scan

# ---- fixed values: defaults in percent or as plain numbers
RISK_PERCENT, STOP_PERCENT, TARGET_PERCENT = 2.0, 2.0, 5.0
KELLY_FRACTION, KELLY_CAP = 0.5, 0.2
TARGET_RISK_PERCENT, DEFAULT_VOLATILITY = 5.0, 0.02
ATR_MULTIPLE, RISK_REWARD = 2.0, 2.0
# ---- end of fixed values


def _long(side: str | Column) -> Column:
    return F.upper(col(side)).isin("BUY", "LONG")


def _sign(side: str | Column) -> Column:
    return F.when(_long(side), 1.0).otherwise(-1.0)


def size_fixed(size: float = 1.0) -> Column:
    return F.lit(float(size))


def size_percent(equity: str | Column, price: str | Column, percent: float) -> Column:
    return F.when(col(price) > 0, ratio(col(equity) * percent / 100, price)).otherwise(1.0)


def size_risk(equity: str | Column, price: str | Column, risk_percent: float = RISK_PERCENT,
              stop_percent: float = STOP_PERCENT) -> Column:
    """Units for which a move to the stop costs ``risk_percent`` of the equity."""
    per_unit = F.abs(col(price) * stop_percent / 100)
    return F.when(per_unit > 0, col(equity) * risk_percent / 100 / per_unit).otherwise(1.0)


def size_kelly(equity: str | Column, price: str | Column, win_rate: Column, win_loss: Column,
               fraction: float = KELLY_FRACTION) -> Column:
    edge = F.when(win_loss > 0, (win_rate * win_loss - (1 - win_rate)) / win_loss).otherwise(0.0)
    share = F.greatest(F.lit(0.0), F.least(edge * fraction, F.lit(KELLY_CAP)))
    return F.when(col(price) > 0, ratio(col(equity) * share, price)).otherwise(1.0)


def size_volatility(equity: str | Column, price: str | Column, volatility: Column | None = None,
                    volatility_20: Column | None = None, atr: Column | None = None,
                    target_risk: float = TARGET_RISK_PERCENT) -> Column:
    """The first known of volatility, volatility_20, atr/price, else 2 %."""
    known = [v for v in (volatility, volatility_20) if v is not None]
    known += [ratio(atr, price)] if atr is not None else []
    vol = F.coalesce(*known, F.lit(DEFAULT_VOLATILITY))
    return F.when(col(price) > 0, ratio(ratio(col(equity) * target_risk / 100, vol), price)).otherwise(1.0)


def stop_level(side: str | Column, price: str | Column, method: str = "percent", percent: float = STOP_PERCENT,
               atr: Column | None = None, multiple: float = ATR_MULTIPLE) -> Column:
    """``percent``, ``atr``, or ``support_resistance`` (which is the percent rule)."""
    p = col(price)
    if method == "atr":
        width = F.coalesce(atr, p * DEFAULT_VOLATILITY) if atr is not None else p * DEFAULT_VOLATILITY
        return p - _sign(side) * width * multiple
    return p * (1 - _sign(side) * percent / 100)


def target_level(side: str | Column, price: str | Column, stop: str | Column | None = None, method: str = "percent",
                 percent: float = TARGET_PERCENT, reward: float = RISK_REWARD) -> Column:
    p = col(price)
    if method == "risk_reward":
        return p + _sign(side) * F.abs(p - col(stop)) * reward
    return p * (1 + _sign(side) * percent / 100)


def position_risk(price: str | Column, size: str | Column, stop: str | Column | None = None) -> Column:
    by_percent = col(price) * col(size) * STOP_PERCENT / 100
    return by_percent if stop is None else F.coalesce(F.abs(col(price) - col(stop)) * col(size), by_percent)


def admit_positions(candidates: DataFrame, open_risk: DataFrame, groups: DataFrame | None = None,
                    max_risk: float = 0.05, max_correlated: int = 0, max_size: float | None = None) -> DataFrame:
    """Mark candidates (``account, symbol, size, price, stop_loss, equity``) with ``accepted`` and ``position_risk``.

    ``open_risk`` (``account, symbol, risk``) is what the account already carries, ``groups``
    (``symbol, group_id``) names correlated symbols. Each candidate is judged against the open
    positions; a symbol that is already open is never refused for its group.
    """
    c = candidates
    if max_size is not None:
        c = c.withColumn("size", F.least(F.col("size"), F.lit(max_size)))
    c = c.withColumn("position_risk", position_risk("price", "size", "stop_loss"))
    carried = open_risk.groupBy("account").agg(F.sum("risk").alias("_carried"))
    c = c.join(carried, "account", "left")
    total = F.coalesce("_carried", F.lit(0.0)) + F.col("position_risk")
    ok = (F.col("size") > 0) & (F.col("equity") > 0) & (ratio(total, "equity") <= max_risk)
    if groups is not None and max_correlated > 0:
        used = open_risk.join(groups, "symbol").groupBy("account", "group_id").agg(F.count_distinct("symbol").alias("_used"))
        held = open_risk.select("account", "symbol").distinct().withColumn("_held", F.lit(True))
        c = c.join(groups, "symbol", "left").join(used, ["account", "group_id"], "left").join(held, ["account", "symbol"], "left")
        ok = ok & (F.coalesce("_held", F.lit(False)) | (F.coalesce("_used", F.lit(0)) < max_correlated))
        c = c.withColumn("accepted", F.coalesce(ok, F.lit(False))).drop("_used", "_held", "group_id")
    else:
        c = c.withColumn("accepted", F.coalesce(ok, F.lit(False)))
    return c.drop("_carried")


def reduction_plan(open_risk: DataFrame, equity: DataFrame, max_risk: float = 0.05, method: str = "range") -> DataFrame:
    """Per account: how much of each position's risk to cut, largest first, until the excess is gone."""
    s = Series(keys=("account",), ts="_neg", tie=("symbol",))
    x = number_rows(open_risk.withColumn("_neg", -F.col("risk")), s, method=method)
    x = scan(x, s, {"_before": running_sum("risk", inclusive=False)})
    totals = open_risk.groupBy("account").agg(F.sum("risk").alias("total_risk")).join(equity, "account")
    totals = totals.withColumn("excess", F.when(F.col("equity") > 0, F.col("total_risk") - max_risk * F.col("equity")))
    x = x.join(totals.where("excess > 0"), "account")
    left = F.col("excess") - F.coalesce("_before", F.lit(0.0))
    cut = F.least(F.col("risk"), F.greatest(left, F.lit(0.0)))
    return x.withColumns({"reduction": cut, "percent": ratio(cut, "risk")}).where("reduction > 0").select(
        "account", "symbol", "risk", "reduction", "percent")
