"""Signals to metrics: crossover and model-driven runs as sets of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.operators import ledger, models, performance, signals
from barspark.operators.features import add_features
from barspark.operators.series import BARS, Series, join_by, number_rows, stage


def evaluate(signalled: DataFrame, s: Series = BARS, account: Sequence[str] = (), run_id: str = "run", capital: float = ledger.DEFAULT_CAPITAL,
             reverse: str = "flip", slippage: ledger.Slippage = ledger.Slippage(), exits: ledger.Exits = ledger.Exits(), risk_free: float = 0.0) -> dict[str, DataFrame]:
    """Trades, transactions, equity and metrics of rows that carry ``signal``."""
    rows = signalled if account else signalled.withColumn("run_id", F.lit(run_id))
    keyed = s if set(account) <= set(s.keys) and account else s.by("run_id", *s.keys)
    rows = stage(rows)
    trades = stage(ledger.trades(rows, keyed, reverse, slippage=slippage, exits=exits))
    acc = tuple(account) or ("run_id",)
    equity = stage(ledger.equity_curve(ledger.mark_to_market(rows, trades, keyed), keyed, acc, capital))
    curve = Series(keys=acc)
    closed = trades.where("not is_open")
    per_trade = Series(keys=acc, ts="exit_time", tie=("position_id",))
    metrics = performance.performance_summary(equity, curve, risk_free)
    for per_account in (performance.trade_metrics(closed, per_trade), performance.trade_streaks(closed, per_trade)):
        metrics = join_by(metrics, per_account, list(acc))
    return {"trades": trades, "transactions": ledger.transactions(trades, keyed), "equity": equity, "metrics": metrics}


def crossover_run(bars: DataFrame, fast: str = "ema_20", slow: str = "sma_50", threshold: float = 0.001, s: Series = BARS, **options) -> dict[str, DataFrame]:
    """Backtest of two indicator columns; they are computed when the bars do not have them."""
    if not {fast, slow} <= set(bars.columns):
        bars = add_features(bars, s, ["technical"])
    return evaluate(signals.indicator_crossover(bars, fast, slow, threshold, s), s, **options)


def model_run(tagged: DataFrame, bars: DataFrame, features: Sequence[str], s: Series = BARS, task: str = "classification", kind: str = "forest", label: str = "label",
              probability: float = 0.5, lookback: int = 10, threshold: float = 0.7, min_hold: int = 12, max_hold: int = 288,
              capital: float = ledger.DEFAULT_CAPITAL, run_id: str = "model", **params) -> dict[str, DataFrame]:
    """Walk-forward predictions, consensus filter, hold-limited trades and their metrics.

    Rows predicted by several folds keep the latest fold's prediction.
    """
    keys = list(s.keys)
    predicted = models.walk_forward(tagged, features, task, kind, label, keep=(*keys, s.ts), **params)
    newest = predicted.groupBy(*keys, s.ts).agg(F.max_by("probability_up", "split_index").alias("probability_up"))
    rows = join_by(newest, bars.select(*keys, s.ts, "close"), [*keys, s.ts], "inner").withColumn("direction", signals.direction("probability_up", probability))
    rows = stage(number_rows(rows, s))
    held = stage(signals.hold_signals(signals.consensus(rows, "direction", lookback, threshold, s), min_hold, max_hold, s))
    trades = stage(trades_of_holds(held, s))
    acc = trades.withColumn("run_id", F.lit(run_id))
    marked = ledger.mark_to_market(held, trades, s).withColumn("run_id", F.lit(run_id))
    equity = stage(ledger.equity_curve(marked, s.by("run_id", *keys), ("run_id",), capital))
    closed = acc.where("not is_open")
    metrics = performance.performance_summary(equity).join(performance.trade_metrics(closed), "run_id", "left")
    return {"predictions": predicted, "history": _history(held, s), "trades": trades, "equity": equity, "metrics": metrics}


def prediction_history(predicted: DataFrame, probability: float = 0.5, lookback: int = 10, threshold: float = 0.7, min_hold: int = 12, max_hold: int = 288, s: Series = BARS) -> DataFrame:
    """What the strategy made of every prediction: its direction, the model's probability, whether a signal was sent, and the position after it."""
    x = signals.consensus(predicted.withColumn("direction", signals.direction("probability_up", probability)), "direction", lookback, threshold, s)
    return _history(signals.hold_signals(x, min_hold, max_hold, s), s)


def _history(held: DataFrame, s: Series) -> DataFrame:
    return held.select(*s.keys, s.ts, F.col("direction").alias("prediction"), F.col("probability_up").alias("confidence"), F.col("signal_type").isNotNull().alias("signal_generated"), "position")


def trades_of_holds(held: DataFrame, s: Series = BARS, quantity: float = 1.0) -> DataFrame:
    """Trades of entry/exit signals: the entry is the last one before each exit."""
    from barspark.operators.series import next_, scan

    keys, qty = list(s.keys), F.lit(quantity)
    leaving = F.col("signal_type").startswith("EXIT")
    x = scan(held, s, {"_exit": next_(F.when(leaving, F.struct(F.col(s.ts).alias("ts"), F.col(s.pos).alias("pos"), F.col("close").alias("close"))), inclusive=False)})
    e, side = F.col("_exit"), F.when(F.col("signal_type") == "BUY", 1).otherwise(-1)
    t = x.where(F.col("signal_type").isin("BUY", "SELL")).select(
        *keys, F.when(side > 0, "LONG").otherwise("SHORT").alias("direction"), qty.alias("quantity"), F.col("close").alias("entry_price"), F.col(s.ts).alias("entry_time"),
        e["close"].alias("exit_price"), e["ts"].alias("exit_time"), F.col(s.pos).alias("entry_pos"), e["pos"].alias("exit_pos"),
        F.when(e.isNotNull(), "TRADE").alias("exit_reason"), side.alias("side"))
    return t.withColumns({
        "is_open": F.col("exit_pos").isNull(), "pnl": (F.col("exit_price") - F.col("entry_price")) * F.col("side") * F.col("quantity"),
        "entry_commission": ledger.commission(F.col("entry_price"), F.col("quantity")), "exit_commission": ledger.commission(F.col("exit_price"), F.col("quantity")),
        "position_id": F.concat_ws("_", *keys, F.date_format(F.col("entry_time").cast("timestamp"), "yyyyMMddHHmmss"), "direction")})
