"""Operators on bars of which one symbol has no name (the same results, under a null key); prediction history; long windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.operators import clean, labels, ledger, normalize, resample, signals
from barspark.plans import backtest
from barspark.operators.series import number_rows, rolling_extremes
from checks import bars_queries, trading_queries
from checks.common import EVENT_TICKS, R, bars, event_ticks, gappy, show, sql
from checks.trading_queries import SLIP, consensus, preds, signalled

Q: dict = {}
S: dict[str, str] = {}
WITHOUT = "click"


def unnamed(df: DataFrame) -> DataFrame:
    name: Column = F.col("symbol")
    return df.withColumn("symbol", F.when(name != WITHOUT, name))


def q(name: str, fn, text: str) -> None:
    """``text`` is the SQL of the same operator on named bars."""
    Q[name], S[name] = fn, f"SELECT * REPLACE (nullif(symbol, '{WITHOUT}') AS symbol) FROM ({text})"


def _normal(sp, sf):
    x = unnamed(gappy(sp, sf)).select("symbol", "ts", "pos", "close", "volume")
    methods = {"close": "zscore", "volume": "zscore"}
    return show(normalize.apply_normaliser(x, normalize.fit_normaliser(x, methods), methods).drop("pos"))


def _trades(sp, sf):
    x = unnamed(signalled(sp, sf))
    return show(ledger.mark_to_market(x, ledger.trades(x, slippage=SLIP)).drop("pos", "close"))


q("null_key_grid", lambda sp, sf: show(clean.fill_missing(resample.ohlcv_grid(unnamed(event_ticks(sp, sf)), "1 hour", s=EVENT_TICKS))), bars_queries.S["bars_hourly"])
q("null_key_split", lambda sp, sf: show(labels.train_test(unnamed(bars(sp, sf)), 0.2).select("symbol", "ts", "split")), trading_queries.S["train_test_cut"])
q("null_key_holds", lambda sp, sf: show(signals.hold_signals(unnamed(consensus(sp, sf)), 3, 12, block=128, fan=2).select("symbol", "ts", "position", "bars_held", "signal_type")), trading_queries.S["hold_limited"])
q("null_key_normalise", _normal, bars_queries.S["normalise_zscore"])
q("null_key_trades", _trades, trading_queries.S["mark_to_market"])

# the prediction history of a run, from the fixed rule that stands in for a model
Q["prediction_history"] = lambda sp, sf: show(backtest.prediction_history(preds(sp, sf).withColumnRenamed("p_up", "probability_up"), 0.5, 5, 0.6, 3, 12))
S["prediction_history"] = sql("walk", select=f"SELECT symbol, ts, direction::BIGINT AS prediction, {R('p_up')} AS confidence, was <> side AS signal_generated, side::BIGINT AS position FROM walk JOIN cons USING (symbol, pos) JOIN (SELECT symbol, pos, p_up FROM preds) USING (symbol, pos)")

# long windows over ticks: the same cost per row whatever their length
Q["rolling_extremes_long"] = lambda sp, sf: show(rolling_extremes(number_rows(event_ticks(sp, sf), EVENT_TICKS).withColumn("price", F.when(F.col("event_id") % 997 != 5, F.col("price"))), EVENT_TICKS,
                                                                  {"top": ("max", "price", 500), "low": ("min", "price", 130), "top_14": ("max", "price", 14)}).select("symbol", "event_id", "top", "low", "top_14"))
S["rolling_extremes_long"] = "SELECT symbol, event_id, " + ", ".join(f"CASE WHEN count(p) OVER {w} = {n} THEN {R(f'{f}(p) OVER {w}')} END AS {o}" for o, f, n, w in (
    (o, f, n, f"(PARTITION BY symbol ORDER BY ts, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)") for o, f, n in (("top", "max", 500), ("low", "min", 130), ("top_14", "max", 14)))) + (
    " FROM (SELECT event_type AS symbol, event_id, ts, CASE WHEN event_id % 997 <> 5 THEN value END AS p FROM events)")
