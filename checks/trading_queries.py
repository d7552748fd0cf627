"""Labels, folds, signals, trades, equity, risk, performance, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark.operators import labels, ledger, models, performance as perf, risk, select, signals, splits
from barspark.operators.clean import fill_missing
from barspark.operators.features import add_features
from barspark.operators.resample import ohlcv_grid
from barspark.operators.series import Series, stage
import checks.bars_queries  # noqa: F401 - defines the CTEs used here
from checks.common import EVENT_TICKS, R, W, _once, bars, cte, day_bars, event_ticks, over, roll, show, sql, table

Q: dict = {}
S: dict[str, str] = {}


def q(name: str, fn, select: str | None = None, *ctes: str) -> None:
    Q[name] = fn
    if select:
        S[name] = sql(*ctes, select=select)


# ---------------------------------------------------------------- labels and folds
RETS = f"SELECT *, close / nullif(lag(close) OVER ({W}), 0) - 1 AS close_return FROM bars"
cte("rets", ("bars",), RETS)


def rets(sp, sf):
    return labels.with_target(bars(sp, sf).withColumn("close_raw", F.col("close")), "close_move")[0].withColumnRenamed("close_move", "close_return").drop("close_raw")


q("target_fallback", lambda sp, sf: show(rets(sp, sf).select("symbol", "ts", "close_return")), f"SELECT symbol, ts, {R('close_return')} AS close_return FROM rets", "rets")
q("label_direction", lambda sp, sf: show(labels.label_direction(rets(sp, sf), "close_return", 3).select("symbol", "ts", "label")),
  f"SELECT symbol, ts, CASE WHEN n IS NOT NULL THEN (n > 0)::BIGINT END AS label FROM (SELECT symbol, ts, lead(close_return, 3) OVER ({W}) AS n FROM rets)", "rets")
q("label_value", lambda sp, sf: show(labels.label_value(rets(sp, sf), "close_return", 2).select("symbol", "ts", "label")),
  f"SELECT symbol, ts, {R(f'lead(close_return, 2) OVER ({W})')} AS label FROM rets", "rets")
cte("fwd", ("bars",), f"SELECT *, lead(close, 4) OVER ({W}) AS fp, lead(close, 4) OVER ({W}) / nullif(close, 0) - 1 AS fr FROM bars")
q("forward_targets", lambda sp, sf: show(labels.forward_targets(bars(sp, sf), horizon=4).select("symbol", "ts", "fwd_price", "fwd_return", "fwd_direction", "fwd_return_z"), 5),
  f"SELECT symbol, ts, {R('fp', 5)} AS fwd_price, {R('fr', 5)} AS fwd_return, sign(fp - close)::DOUBLE AS fwd_direction, {R('(fr - avg(fr) OVER (PARTITION BY symbol)) / stddev_samp(fr) OVER (PARTITION BY symbol)', 5)} AS fwd_return_z FROM fwd", "fwd")
q("train_test_cut", lambda sp, sf: show(labels.train_test(bars(sp, sf), 0.2).select("symbol", "ts", "split")),
  "SELECT symbol, ts, CASE WHEN pos < floor(count(*) OVER (PARTITION BY symbol) * 0.8) THEN 'train' ELSE 'test' END AS split FROM bars", "bars")
_FOLDS = """SELECT symbol, ts, f AS split_index, CASE WHEN ts < t0 + to_days(10) THEN 'train' ELSE 'test' END AS split_type FROM (SELECT *, s0 + to_days(5 * f) AS t0 FROM bars,
 (SELECT min(ts) AS s0, max(ts) AS s1 FROM bars), generate_series(0, 20) g(f)) WHERE ts >= t0 AND ts < t0 + to_days(15) AND t0 + to_days(15) <= s1"""
q("folds_by_time", lambda sp, sf: show(splits.time_folds(bars(sp, sf), "10D", "5D").select("symbol", "ts", "split_index", "split_type")), _FOLDS, "bars")
q("folds_expanding_window", lambda sp, sf: show(splits.fold_sizes(splits.time_folds(bars(sp, sf), "5D", "5D", max_train="20D"))),
  """SELECT f AS split_index, count(*) FILTER (ts < c) AS train_rows, count(*) FILTER (ts >= c) AS test_rows FROM (SELECT *, s0 + to_days(5 * f + 5) AS c FROM bars, (SELECT min(ts) AS s0, max(ts) AS s1 FROM bars), generate_series(0, 20) g(f))
  WHERE ts >= greatest(s0, c - to_days(20)) AND ts < c + to_days(5) AND c + to_days(5) <= s1 GROUP BY f""", "bars")
q("folds_by_rows", lambda sp, sf: show(splits.fold_sizes(splits.time_folds(bars(sp, sf), 300, 100, step=100))),
  "SELECT f AS split_index, count(*) FILTER (pos < 100 * f + 300) AS train_rows, count(*) FILTER (pos >= 100 * f + 300) AS test_rows FROM bars, (SELECT max(pos) + 1 AS n FROM bars), generate_series(0, 50) g(f) WHERE pos >= 100 * f AND pos < 100 * f + 400 AND 100 * f + 400 <= n GROUP BY f", "bars")
q("folds_n_splits", lambda sp, sf: show(splits.fold_sizes(splits.time_folds(bars(sp, sf), "10D", "4D", n_splits=4))),
  """SELECT f AS split_index, count(*) FILTER (ts < c) AS train_rows, count(*) FILTER (ts >= c) AS test_rows FROM (SELECT *, s0 + to_days((f * floor((date_diff('hour', s0, s1) // 24 - 14) / 3) + 10)::INT) AS c FROM bars,
  (SELECT min(ts) AS s0, max(ts) AS s1 FROM bars), generate_series(0, 20) g(f)) WHERE ts >= c - to_days(10) AND ts < c + to_days(4) AND c + to_days(4) <= s1 GROUP BY f""", "bars")
q("folds_k", lambda sp, sf: show(splits.expanding_folds(bars(sp, sf), 5).select("symbol", "pos", "split_index", "split_type")),
  """SELECT symbol, pos, f AS split_index, CASE WHEN pos < n - (5 - f) * sz THEN 'train' ELSE 'test' END AS split_type FROM (SELECT *, n // 6 AS sz FROM bars, (SELECT max(pos) + 1 AS n FROM bars), generate_series(0, 4) g(f)) WHERE pos < n - (4 - f) * sz""", "bars")

# ---------------------------------------------------------------- signals


def smas(sp, sf):
    return _once(sp, sf, "smas", lambda: add_features(bars(sp, sf), groups=["technical"]).select("symbol", "ts", "pos", "open", "high", "low", "close", "sma_5", "sma_20", "ema_20", "sma_50"))


def crossed(src: str, diff: str, thr: float, keep: str, ready: str = "true", part: str = "symbol") -> str:
    """SQL of the thresholded crossover with memory."""
    return f"""SELECT * EXCLUDE (side, prev), CASE WHEN side IS NOT NULL AND (prev IS NULL OR prev <> side) THEN side END AS signal, CASE WHEN side IS NOT NULL AND (prev IS NULL OR prev <> side) THEN
    CASE WHEN prev IS NOT NULL THEN 'REVERSE' WHEN side > 0 THEN 'BUY' ELSE 'SELL' END END AS signal_type FROM (SELECT *, last_value(side IGNORE NULLS) OVER (PARTITION BY {part} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
    FROM (SELECT {keep}, CASE WHEN {ready} THEN CASE WHEN {diff} > {thr} THEN 1 WHEN {diff} < -{thr} THEN -1 END END AS side FROM {src}))"""


cte("sma", ("bars",), "SELECT *, " + ", ".join(f"{roll('avg', 'close', n)} AS sma_{n}" for n in (5, 10, 20, 50)) + " FROM bars")
cte("sig", ("sma",), crossed("sma", "sma_5 - sma_20", 1.0, "symbol, ts, pos, close, sma_5, sma_20"))


def _flagship(sp, sf):
    b = fill_missing(ohlcv_grid(event_ticks(sp, sf), "1 hour", s=EVENT_TICKS))
    x = signals.crossover(add_features(b, groups=["technical"]), F.col("sma_5") - F.col("sma_20"), 1.0)
    return show(x.where("signal is not null").select("symbol", "ts", "signal_type", "close", "sma_5", "sma_20"))


_SIG = f"SELECT symbol, ts, signal_type, {R('close')} AS close, {R('sma_5')} AS sma_5, {R('sma_20')} AS sma_20 FROM sig WHERE signal IS NOT NULL"
q("flagship_crossover", _flagship, _SIG, "sig")


def signalled(sp, sf):
    return _once(sp, sf, "signalled", lambda: signals.indicator_crossover(smas(sp, sf), "sma_5", "sma_20", 1.0))


q("signal_records", lambda sp, sf: show(signals.signal_records(signalled(sp, sf), "sma_5", "sma_20", "cross").withColumn("difference", F.col("metadata")["difference"].cast("double")).drop("metadata")),
  f"SELECT symbol, ts, signal_type, 1.0 AS strength, 'cross' AS strategy_id, 'Indicator Crossover: sma_5 ' || CASE WHEN signal > 0 THEN '>' ELSE '<' END || ' sma_20' AS reason, {R('sma_5 - sma_20')} AS difference FROM sig WHERE signal IS NOT NULL", "sig")
q("signals_ma", lambda sp, sf: show(signals.ma_crossover(bars(sp, sf), 10, 50, 0.5).where("signal is not null").select("symbol", "ts", "signal_type", "short_ma", "long_ma")),
  f"SELECT symbol, ts, signal_type, {R('sma_10')} AS short_ma, {R('sma_50')} AS long_ma FROM ({crossed('sma', 'sma_10 - sma_50', 0.5, 'symbol, ts, pos, sma_10, sma_50')}) WHERE signal IS NOT NULL", "sma")


def _adj(src: str, c: str, n: int) -> str:
    return f"SELECT symbol, pos, sum(w * {c}) / sum(w) AS e{n} FROM (SELECT a.symbol, a.pos, b.{c}, pow({1 - 2 / (n + 1)!r}, a.pos - b.pos) AS w FROM {src} a JOIN {src} b ON a.symbol = b.symbol AND b.pos <= a.pos) GROUP BY 1, 2"


cte("adj12", ("bars",), _adj("bars", "close", 12))
cte("adj26", ("bars",), _adj("bars", "close", 26))
cte("macdl", ("adj12", "adj26"), "SELECT symbol, pos, e12 - e26 AS line FROM adj12 JOIN adj26 USING (symbol, pos)")
cte("macds", ("macdl",), _adj("macdl", "line", 9))
cte("hist", ("macds",), "SELECT b.symbol, b.ts, b.pos, line, e9, line - e9 AS h FROM bars b JOIN macdl USING (symbol, pos) JOIN macds USING (symbol, pos)")
q("signals_macd", lambda sp, sf: show(signals.macd_crossover(bars(sp, sf), threshold=0.5).where("signal is not null").select("symbol", "ts", "signal_type", "macd_line", "signal_line", "histogram")),
  f"SELECT symbol, ts, signal_type, {R('line')} AS macd_line, {R('e9')} AS signal_line, {R('h')} AS histogram FROM ({crossed('hist', 'h', 0.5, 'symbol, ts, pos, line, e9, h', 'pos >= 34')}) WHERE signal IS NOT NULL", "hist")
cte("adj10t", ("bars",), _adj("(SELECT symbol, pos, (high + low + close) / 3 AS tp FROM bars)", "tp", 10))
cte("adj50t", ("bars",), _adj("(SELECT symbol, pos, (high + low + close) / 3 AS tp FROM bars)", "tp", 50))
cte("ematp", ("adj10t", "adj50t"), "SELECT b.symbol, b.ts, b.pos, e10, e50 FROM bars b JOIN adj10t USING (symbol, pos) JOIN adj50t USING (symbol, pos)")
q("signals_ema_typical", lambda sp, sf: show(signals.ma_crossover(bars(sp, sf), 10, 50, 0.5, simple=False, use_close=False).where("signal is not null").select("symbol", "ts", "signal_type", "short_ma", "long_ma")),
  f"SELECT symbol, ts, signal_type, {R('e10')} AS short_ma, {R('e50')} AS long_ma FROM ({crossed('ematp', 'e10 - e50', 0.5, 'symbol, ts, pos, e10, e50', 'pos >= 49')}) WHERE signal IS NOT NULL", "ematp")
# a fixed rule stands in for a model so that both sides have the same predictions
cte("preds", ("rets",), f"SELECT *, 1 / (1 + exp(-10 * coalesce(close_return, 0))) AS p_up, coalesce(close_return, 0) AS prediction, lead(close_return) OVER ({W}) AS nxt FROM rets")


def preds(sp, sf):
    def build():
        x = labels.label_value(rets(sp, sf), "close_return", 1, out="nxt").withColumn("prediction", F.coalesce("close_return", F.lit(0.0)))
        return x.withColumn("p_up", 1 / (1 + F.exp(-10 * F.col("prediction"))))
    return _once(sp, sf, "preds", build)


q("signals_prediction", lambda sp, sf: show(signals.prediction_signals(preds(sp, sf), threshold=0.2).where("signal is not null").select("symbol", "ts", "signal_type")),
  f"SELECT symbol, ts, signal_type FROM ({crossed('preds', 'prediction', 0.2, 'symbol, ts, pos')}) WHERE signal IS NOT NULL", "preds")
q("signals_class", lambda sp, sf: show(signals.prediction_signals(preds(sp, sf).withColumn("cls", (F.col("p_up") > 0.5).cast("int")), "cls", kind="class").where("signal is not null").select("symbol", "ts", "signal_type")),
  f"SELECT symbol, ts, signal_type FROM ({crossed('preds', 'CASE WHEN p_up > 0.5 THEN 1 ELSE -1 END', 0, 'symbol, ts, pos')}) WHERE signal IS NOT NULL", "preds")
cte("dirs", ("preds",), "SELECT symbol, ts, pos, close, CASE WHEN p_up > 0.5 THEN 1 ELSE -1 END AS direction FROM preds")
_CONS = f"count(*) {over(5)} = 5 AND avg((direction = {{d}})::INT) {over(5)} >= 0.6"
cte("cons", ("dirs",), f"SELECT *, {_CONS.format(d=1)} AS buy_ok, {_CONS.format(d=-1)} AS sell_ok FROM dirs")


def consensus(sp, sf):
    return signals.consensus(preds(sp, sf).withColumn("direction", signals.direction("p_up", 0.5)), lookback=5, threshold=0.6).select("symbol", "ts", "pos", "close", "direction", "buy_ok", "sell_ok")


q("consensus", lambda sp, sf: show(consensus(sp, sf)), f"SELECT symbol, ts, pos, {R('close')} AS close, direction, buy_ok, sell_ok FROM cons", "cons")
_STEP = """SELECT c.symbol, c.pos, CASE WHEN w.side = 0 THEN CASE WHEN c.buy_ok THEN 1 WHEN c.sell_ok THEN -1 ELSE 0 END
  WHEN (w.held + 1 >= 3 AND CASE WHEN w.side > 0 THEN c.sell_ok ELSE c.buy_ok END) OR w.held + 1 >= 12 THEN 0 ELSE w.side END AS side, CASE WHEN w.side = 0 THEN 0
  WHEN (w.held + 1 >= 3 AND CASE WHEN w.side > 0 THEN c.sell_ok ELSE c.buy_ok END) OR w.held + 1 >= 12 THEN 0 ELSE w.held + 1 END AS held, w.side AS was FROM walk w JOIN cons c ON c.symbol = w.symbol AND c.pos = w.pos + 1"""
cte("walk", ("cons",), f"walk(symbol, pos, side, held, was) AS (SELECT symbol, 0::BIGINT, CASE WHEN buy_ok THEN 1 WHEN sell_ok THEN -1 ELSE 0 END, 0, 0 FROM cons WHERE pos = 0 UNION ALL {_STEP})")
q("hold_limited", lambda sp, sf: show(signals.hold_signals(consensus(sp, sf), 3, 12, block=128, fan=2).select("symbol", "ts", "position", "bars_held", "signal_type")),
  "SELECT symbol, ts, side AS position, held AS bars_held, CASE WHEN was = 0 AND side = 1 THEN 'BUY' WHEN was = 0 AND side = -1 THEN 'SELL' WHEN was = 1 AND side = 0 THEN 'EXIT_LONG' WHEN was = -1 AND side = 0 THEN 'EXIT_SHORT' END AS signal_type FROM walk JOIN cons USING (symbol, pos)", "walk")
SHORTS, LONGS = (5, 10, 15, 20, 25), (30, 40, 50, 60, 70)
cte("sweepma", ("bars",), "SELECT *, " + ", ".join(f"{roll('avg', 'close', n)} AS m{n}" for n in (*SHORTS, *LONGS)) + " FROM bars")
cte("sweep0", ("sweepma",), " UNION ALL ".join(f"SELECT '{a}/{b}' AS run_id, symbol, ts, pos, close, m{a} - m{b} AS d FROM sweepma" for a in SHORTS for b in LONGS))
cte("sweep", ("sweep0",), crossed("sweep0", "d", 0.5, "run_id, symbol, ts, pos, close", part="run_id, symbol"))
SWEEP = Series(keys=("run_id", "symbol"))


def sweep(sp, sf):
    return _once(sp, sf, "sweep", lambda: signals.sma_sweep(bars(sp, sf), SHORTS, LONGS, 0.5))


q("parameter_sweep_signals", lambda sp, sf: show(sweep(sp, sf).where("signal is not null").select("run_id", "symbol", "ts", "signal_type")),
  "SELECT run_id, symbol, ts, signal_type FROM sweep WHERE signal IS NOT NULL", "sweep")

# ---------------------------------------------------------------- trades
SLIP = ledger.Slippage("fixed", percent=0.0517)
cte("flip", ("sig",), """SELECT symbol, signal AS side, close * (1 + signal * 0.000517) AS entry_price, ts AS entry_time, pos AS entry_pos, nclose * (1 - signal * 0.000517) AS exit_price, nts AS exit_time, npos AS exit_pos,
  CASE WHEN npos IS NOT NULL THEN 'TRADE' END AS exit_reason FROM (SELECT *, lead(close) OVER w AS nclose, lead(ts) OVER w AS nts, lead(pos) OVER w AS npos FROM sig WHERE signal IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY pos))""")
_TR = f"""SELECT symbol, CASE WHEN side > 0 THEN 'LONG' ELSE 'SHORT' END AS direction, {R('entry_price')} AS entry_price, entry_time, {R('exit_price')} AS exit_price, exit_time, exit_reason, {R('(exit_price - entry_price) * side')} AS pnl,
  {R('entry_price * 0.001')} AS entry_commission, {R("CASE WHEN exit_reason = 'TRADE' THEN exit_price * 0.001 WHEN exit_reason IS NOT NULL THEN 0 END")} AS exit_commission FROM """
TRCOLS = ("symbol", "direction", "entry_price", "entry_time", "exit_price", "exit_time", "exit_reason", "pnl", "entry_commission", "exit_commission")


def flip(sp, sf):
    return _once(sp, sf, "flip", lambda: ledger.trades(signalled(sp, sf), slippage=SLIP))


q("trades_flip", lambda sp, sf: show(ledger.trades(signalled(sp, sf), slippage=SLIP).select(*TRCOLS)), _TR + "flip", "flip")
cte("odd", ("sig",), """SELECT symbol, side, close * (1 + side * 0.000517) AS entry_price, ts AS entry_time, pos AS entry_pos, nclose * (1 - side * 0.000517) AS exit_price, nts AS exit_time, npos AS exit_pos, CASE WHEN npos IS NOT NULL THEN 'TRADE' END AS exit_reason
  FROM (SELECT *, CASE WHEN n = 1 THEN signal ELSE 1 END AS side FROM (SELECT *, row_number() OVER w AS n, lead(close) OVER w AS nclose, lead(ts) OVER w AS nts, lead(pos) OVER w AS npos FROM sig WHERE signal IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY pos)) WHERE n % 2 = 1)""")
q("trades_close_only", lambda sp, sf: show(ledger.trades(signalled(sp, sf), reverse="close_only", slippage=SLIP).select(*TRCOLS)), _TR + "odd", "odd")


def _hit(src: str) -> str:
    return f"""SELECT t.*, h.pos AS hpos, h.ts AS hts, h.close AS hclose, CASE WHEN h.pos IS NULL THEN NULL WHEN (h.close - t.entry_price * (1 - t.side * 0.3)) * t.side <= 0 THEN 'STOP_LOSS' ELSE 'TAKE_PROFIT' END AS why FROM {src} t LEFT JOIN LATERAL
    (SELECT b.pos, b.ts, b.close FROM bars b WHERE b.symbol = t.symbol AND b.pos > t.entry_pos AND (t.exit_pos IS NULL OR b.pos <= t.exit_pos) AND ((b.close - t.entry_price * (1 - t.side * 0.3)) * t.side <= 0 OR (b.close - t.entry_price * (1 + t.side * 0.6)) * t.side >= 0) ORDER BY b.pos LIMIT 1) h ON true"""


cte("hits", ("flip", "bars"), _hit("flip"))
cte("stopped", ("hits",), "SELECT symbol, side, entry_price, entry_time, entry_pos, coalesce(hclose, exit_price) AS exit_price, coalesce(hts, exit_time) AS exit_time, coalesce(hpos, exit_pos) AS exit_pos, coalesce(why, exit_reason) AS exit_reason FROM hits")
EXITS = ledger.Exits(stop_percent=30.0, target_percent=60.0)


def stopped(sp, sf):
    return ledger.trades(signalled(sp, sf), slippage=SLIP, exits=EXITS)


q("trades_stops", lambda sp, sf: show(stopped(sp, sf).select(*TRCOLS)), _TR + "stopped", "stopped")
cte("hyp", ("sig",), """SELECT symbol, n, side, close * (1 + side * 0.000517) AS entry_price, ts AS entry_time, pos AS entry_pos, nclose * (1 - side * 0.000517) AS exit_price, nts AS exit_time, npos AS exit_pos, CASE WHEN npos IS NOT NULL THEN 'TRADE' END AS exit_reason
  FROM (SELECT *, CASE WHEN n = 1 THEN signal ELSE 1 END AS side FROM (SELECT *, row_number() OVER w AS n, lead(close) OVER w AS nclose, lead(ts) OVER w AS nts, lead(pos) OVER w AS npos FROM sig WHERE signal IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY pos)))""")
cte("hyph", ("hyp", "bars"), _hit("hyp"))
cte("chain", ("hyph",), "chain(symbol, n, opens, hit) AS (SELECT symbol, n, true, hpos IS NOT NULL FROM hyph WHERE n = 1 UNION ALL SELECT h.symbol, h.n, NOT (c.opens AND NOT c.hit), h.hpos IS NOT NULL FROM chain c JOIN hyph h ON h.symbol = c.symbol AND h.n = c.n + 1)")
q("trades_close_only_stops", lambda sp, sf: show(ledger.trades(signalled(sp, sf), reverse="close_only", slippage=SLIP, exits=EXITS).select(*TRCOLS)),
  _TR + "(SELECT symbol, side, entry_price, entry_time, coalesce(hclose, exit_price) AS exit_price, coalesce(hts, exit_time) AS exit_time, coalesce(why, exit_reason) AS exit_reason FROM hyph JOIN chain USING (symbol, n) WHERE opens)", "chain")
_TX = f"""SELECT symbol, ts, type, {R('price')} AS price, {R('commission')} AS commission, {R('pnl')} AS pnl FROM (SELECT symbol, entry_time AS ts, 'OPEN' AS type, entry_price AS price, entry_price * 0.001 AS commission, NULL::DOUBLE AS pnl FROM stopped
  UNION ALL SELECT symbol, exit_time, CASE WHEN exit_reason = 'TRADE' THEN 'CLOSE' ELSE exit_reason END, exit_price, CASE WHEN exit_reason = 'TRADE' THEN exit_price * 0.001 ELSE 0 END, (exit_price - entry_price) * side FROM stopped WHERE exit_pos IS NOT NULL)"""
q("transactions", lambda sp, sf: show(ledger.transactions(stopped(sp, sf)).select("symbol", "ts", "type", "price", "commission", "pnl")), _TX, "stopped")


def _orders(sp, sf):
    h = signals.hold_signals(consensus(sp, sf), 3, 12, block=128, fan=2).where("signal_type is not null")
    before = F.when(F.col("signal_type") == "EXIT_LONG", 1).when(F.col("signal_type") == "EXIT_SHORT", -1).otherwise(0)
    o = ledger.orders(h.withColumns({"position_before": before, "held": F.abs(before) * 1.0}))
    side = F.when(F.col("order_side") == "BUY", 1).otherwise(-1)
    price = ledger.Slippage("variable", percent=0.05, size_factor=0.02).price(F.col("close"), side, F.col("quantity"))
    return show(o.withColumns({"fill_price": price, "commission": ledger.commission(price, F.col("quantity"), 0.2)}).select("symbol", "ts", "order_side", "quantity", "fill_price", "commission"))


_SIDE = "CASE WHEN (was = 0 AND side = 1) OR (was = -1 AND side = 0) THEN 1 ELSE -1 END"
q("orders_and_fills", _orders, f"SELECT symbol, ts, CASE WHEN sd > 0 THEN 'BUY' ELSE 'SELL' END AS order_side, 1.0 AS quantity, {R('close * (1 + sd * 0.0007)')} AS fill_price, {R('close * (1 + sd * 0.0007) * 0.002')} AS commission FROM (SELECT *, {_SIDE} AS sd FROM walk JOIN cons USING (symbol, pos) WHERE was <> side)", "walk")
q("random_slippage", lambda sp, sf: show(signalled(sp, sf).where("signal is not null").select("symbol", "ts", ledger.Slippage("random", low=0.01, high=0.1, seed=42).price(F.col("close"), F.col("signal"), F.lit(1.0)).alias("fill_price"))))


def _fills(sp, sf):
    o = table(sp, sf, "orders")
    side = F.when(F.col("o_orderstatus") == "F", -1.0).otherwise(F.when(F.col("o_orderstatus") == "P", 1.0).otherwise(F.when(F.col("o_custkey") > 500, 1.0).otherwise(-1.0)))
    f = o.select(F.col("o_custkey").alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderkey").alias("fill_id"), side.alias("side"),
                 (F.col("o_totalprice") % 3 + 1).cast("long").cast("double").alias("quantity"), (F.col("o_totalprice") / 300007.0).alias("price"))
    return ledger.pair_fills(f).select("symbol", "ts", "fill_id", "type", "position", "entry_price", "pnl")


cte("fl", (), """SELECT o_custkey AS symbol, o_orderdate AS ts, o_orderkey AS fill_id, CASE WHEN o_orderstatus = 'F' THEN -1.0 WHEN o_orderstatus = 'P' THEN 1.0 WHEN o_custkey > 500 THEN 1.0 ELSE -1.0 END AS side,
  floor(o_totalprice % 3 + 1) AS quantity, o_totalprice / 300007.0 AS price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders""")
_NXT = """SELECT f.symbol, f.n, CASE WHEN p.position = 0 THEN f.side * f.quantity WHEN p.position * f.side > 0 THEN p.position + f.side * f.quantity WHEN f.quantity >= abs(p.position) THEN 0 ELSE p.position + f.side * f.quantity END,
 CASE WHEN p.position = 0 THEN f.price WHEN p.position * f.side > 0 THEN (p.entry * abs(p.position) + f.price * f.quantity) / (abs(p.position) + f.quantity) ELSE p.entry END,
 CASE WHEN p.position * f.side < 0 THEN (f.price - p.entry) * least(f.quantity, abs(p.position)) * sign(p.position) END,
 CASE WHEN p.position = 0 THEN 'OPEN' WHEN p.position * f.side > 0 THEN 'INCREASE' WHEN f.quantity >= abs(p.position) THEN 'CLOSE' ELSE 'DECREASE' END FROM pf p JOIN fl f ON f.symbol = p.symbol AND f.n = p.n + 1"""
cte("pf", ("fl",), f"pf(symbol, n, position, entry, pnl, type) AS (SELECT symbol, n, (side * quantity)::DOUBLE, price::DOUBLE, NULL::DOUBLE, 'OPEN' FROM fl WHERE n = 1 UNION ALL {_NXT})")
q("pair_fills", lambda sp, sf: show(_fills(sp, sf), 9), f"SELECT symbol, ts, fill_id, type, {R('position', 9)} AS position, {R('entry', 9)} AS entry_price, {R('pnl', 9)} AS pnl FROM pf JOIN fl USING (symbol, n)", "pf")

# ---------------------------------------------------------------- equity
cte("mark", ("bars", "flip"), """SELECT b.symbol, b.ts, b.pos, coalesce((b.close - t.entry_price) * t.side, 0) AS u, CASE WHEN t.symbol IS NULL THEN 0 ELSE t.side END AS position, coalesce(abs(t.entry_price), 0) AS notional, coalesce(r.pnl, 0) AS realised,
  coalesce(e.fee, 0) + coalesce(r.fee, 0) AS fees FROM bars b LEFT JOIN flip t ON t.symbol = b.symbol AND b.pos >= t.entry_pos AND (t.exit_pos IS NULL OR b.pos < t.exit_pos)
  LEFT JOIN (SELECT symbol, exit_pos, sum((exit_price - entry_price) * side) AS pnl, sum(exit_price * 0.001) AS fee FROM flip GROUP BY 1, 2) r ON r.symbol = b.symbol AND r.exit_pos = b.pos
  LEFT JOIN (SELECT symbol, entry_pos, entry_price * 0.001 AS fee FROM flip) e ON e.symbol = b.symbol AND e.entry_pos = b.pos""")


def marked(sp, sf):
    return _once(sp, sf, "marked", lambda: ledger.mark_to_market(signalled(sp, sf), flip(sp, sf)))


q("mark_to_market", lambda sp, sf: show(ledger.mark_to_market(signalled(sp, sf), flip(sp, sf)).drop("pos", "close")),
  f"SELECT symbol, ts, {R('u')} AS unrealised, position, {R('notional')} AS notional, {R('realised')} AS realised, {R('fees')} AS fees FROM mark", "mark")
cte("net", ("mark",), "SELECT symbol, ts, sum(realised - fees) OVER (PARTITION BY symbol ORDER BY pos) AS cash, u, notional, abs(position) AS open FROM mark")
cte("held_at", ("net",), """SELECT t.ts, s.symbol, n.cash, n.u, n.notional, n.open FROM (SELECT DISTINCT ts FROM net) t CROSS JOIN (SELECT DISTINCT symbol FROM net) s ASOF LEFT JOIN net n ON n.symbol = s.symbol AND n.ts <= t.ts""")
cte("eq", ("held_at",), "SELECT ts, 100000 + sum(coalesce(cash, 0)) AS cash, sum(coalesce(u, 0)) AS u, sum(coalesce(open, 0)) AS open, sum(coalesce(notional, 0)) AS notional FROM held_at GROUP BY ts")
q("equity_curve", lambda sp, sf: show(ledger.equity_curve(marked(sp, sf), capital=100_000.0).drop("account", "pos"), 3, leverage_used=6),
  f"SELECT ts, {R('cash', 3)} AS cash, {R('cash + u', 3)} AS equity, {R('u', 3)} AS unrealised_pnl, open::BIGINT AS open_positions, {R('CASE WHEN cash + u > 0 THEN notional / (cash + u) ELSE 0 END')} AS leverage_used FROM eq", "eq")
# one account per symbol for the performance tables
cte("curve", ("mark",), "SELECT symbol AS run_id, ts, pos, round(100000 + sum(realised - fees) OVER (PARTITION BY symbol ORDER BY pos) + u, 8) AS equity FROM mark")


def curve(sp, sf):
    def build():
        m = marked(sp, sf).withColumn("run_id", F.col("symbol"))
        return ledger.equity_curve(m, account=("run_id",), capital=100_000.0)
    return _once(sp, sf, "curve", build)


def closed(sp, sf):
    return flip(sp, sf).where("not is_open").withColumn("run_id", F.col("symbol"))


cte("closed", ("flip",), "SELECT *, symbol AS run_id, (exit_price - entry_price) * side AS pnl FROM flip WHERE exit_pos IS NOT NULL")
RW = "PARTITION BY run_id ORDER BY pos"
q("portfolio_summary", lambda sp, sf: show(ledger.portfolio_summary(curve(sp, sf), flip(sp, sf).withColumn("run_id", F.col("symbol")), ("run_id",), capital=100_000.0).select("run_id", "equity", "return_pct", "open_positions", "closed_positions", "realized_pnl"), 4),
  f"""SELECT run_id, {R('equity', 4)} AS equity, {R('(equity / 100000 - 1) * 100', 4)} AS return_pct, o AS open_positions, c AS closed_positions, {R('p', 4)} AS realized_pnl FROM (SELECT run_id, last(equity ORDER BY pos) AS equity FROM curve GROUP BY 1)
  JOIN (SELECT symbol AS run_id, count(*) FILTER (exit_pos IS NULL) AS o, count(*) FILTER (exit_pos IS NOT NULL) AS c, sum((exit_price - entry_price) * side) AS p FROM flip GROUP BY 1) USING (run_id)""", "curve", "flip")

# ---------------------------------------------------------------- risk
_SIZES = ("fixed", "percent", "by_risk", "kelly", "vol")


def _sizes():
    return {"fixed": risk.size_fixed(2.0), "percent": risk.size_percent("equity", "close", 10.0), "by_risk": risk.size_risk("equity", "close"),
         "kelly": risk.size_kelly("equity", "close", F.col("win_rate"), F.col("win_loss")), "vol": risk.size_volatility("equity", "close", volatility_20=F.col("volatility_20"), atr=F.col("atr_14"))}


def _sizing(sp, sf):
    x = _once(sp, sf, "vols", lambda: add_features(bars(sp, sf), groups=["volatility"]).select("symbol", "ts", "pos", "volatility_20", "atr_14"))
    s = signalled(sp, sf).where("signal is not null").join(x, ["symbol", "ts", "pos"]).withColumns({
        "equity": F.lit(10000.0), "win_rate": F.lit(0.55), "win_loss": F.lit(1.4), "side": F.when(F.col("signal") > 0, "BUY").otherwise("SELL")})
    stop = risk.stop_level("side", "close", "atr", atr=F.col("atr_14"))
    return s.withColumns(_sizes()).withColumns({"stop_pct": risk.stop_level("side", "close"), "stop_atr": stop, "target_pct": risk.target_level("side", "close")}).withColumns(
        {"target_rr": risk.target_level("side", "close", "stop_atr", "risk_reward"), "at_risk": risk.position_risk("close", "by_risk", "stop_atr")})


cte("volx", ("vol",), f"SELECT *, ({roll('stddev_samp', 'ret', 20)}) * sqrt(252) AS v20, {roll('avg', 'tr', 14)} AS atr FROM vol")
cte("sized", ("sig", "volx"), "SELECT s.symbol, s.ts, s.close AS px, s.signal AS d, x.v20, coalesce(x.atr, s.close * 0.02) AS atr, x.atr AS ratr FROM sig s JOIN volx x USING (symbol, pos) WHERE s.signal IS NOT NULL")
q("sizing_and_levels", lambda sp, sf: show(_sizing(sp, sf).select("symbol", "ts", *_SIZES, "stop_pct", "stop_atr", "target_pct", "target_rr", "at_risk"), 4),
  f"""SELECT symbol, ts, 2.0 AS fixed, {R('1000 / px', 4)} AS percent, {R('200 / (px * 0.02)', 4)} AS by_risk, {R('10000 * greatest(0, least((0.55 * 1.4 - 0.45) / 1.4 * 0.5, 0.2)) / px', 4)} AS kelly, {R('10000 * 0.05 / coalesce(v20, ratr / px, 0.02) / px', 4)} AS vol,
  {R('px * (1 - d * 0.02)', 4)} AS stop_pct, {R('px - d * atr * 2', 4)} AS stop_atr, {R('px * (1 + d * 0.05)', 4)} AS target_pct, {R('px + d * abs(px - (px - d * atr * 2)) * 2', 4)} AS target_rr, {R('abs(atr * 2) * 200 / (px * 0.02)', 4)} AS at_risk FROM sized""", "sized")


def _accounts(sp, sf):
    """Open risk per customer nation and supplier-like symbol, from the orders table."""
    o = table(sp, sf, "orders").join(table(sp, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("account")), "o_custkey")
    return o.groupBy("account", F.concat("o_orderpriority", "o_orderstatus").alias("symbol")).agg((F.sum("o_totalprice") / 1e5).alias("risk"))


_ACC = "SELECT c_nationkey AS account, o_orderpriority || o_orderstatus AS symbol, sum(o_totalprice) / 1e5 AS risk FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2"
q("risk_reduction", lambda sp, sf: show(risk.reduction_plan(_accounts(sp, sf), _accounts(sp, sf).groupBy("account").agg((F.sum("risk") * 10).alias("equity"))), 8),
  f"""SELECT account, symbol, {R('risk', 8)} AS risk, {R('cut', 8)} AS reduction, {R('cut / risk', 8)} AS percent FROM (SELECT *, least(risk, greatest(tot - 0.05 * tot * 10 - (run - risk), 0)) AS cut FROM (SELECT *, sum(risk) OVER (PARTITION BY account) AS tot,
  sum(risk) OVER (PARTITION BY account ORDER BY risk DESC, symbol) AS run FROM ({_ACC}))) WHERE cut > 1e-9""")


def _admit(sp, sf):
    acc = _accounts(sp, sf)
    groups = acc.select("symbol").distinct().withColumn("group_id", F.substring("symbol", 1, 1))
    cand = acc.groupBy("account").agg(F.max("risk").alias("price"), F.min("risk").alias("size"), (F.sum("risk") * 30).alias("equity")).withColumns(
        {"symbol": F.concat(F.lit("1-URGENT"), F.when(F.col("account") < 12, "F").otherwise("X")), "stop_loss": F.col("price") * 0.9})
    groups = groups.union(cand.where("symbol like '%X'").select("symbol").distinct().withColumn("group_id", F.lit("1")))
    return show(risk.admit_positions(cand, acc, groups, max_risk=0.06, max_correlated=3, max_size=50.0).select("account", "symbol", "size", "position_risk", "accepted"), 8)


q("risk_limits", _admit, f"""WITH a AS ({_ACC}), c AS (SELECT account, max(risk) AS price, least(min(risk), 50.0) AS size, sum(risk) * 30 AS equity, sum(risk) AS tot, CASE WHEN account < 12 THEN '1-URGENTF' ELSE '1-URGENTX' END AS symbol FROM a GROUP BY account)
  SELECT account, symbol, {R('size', 8)} AS size, {R('price * 0.1 * size', 8)} AS position_risk, size > 0 AND (tot + (price - price * 0.9) * size) / equity <= 0.06 AND (EXISTS (SELECT 1 FROM a WHERE a.account = c.account AND a.symbol = c.symbol)
  OR (SELECT count(DISTINCT symbol) FROM a WHERE a.account = c.account AND a.symbol LIKE '1%') < 3) AS accepted FROM c""")

# ---------------------------------------------------------------- performance
cte("cr", ("curve",), f"SELECT *, equity / lag(equity) OVER ({RW}) - 1 AS ret, max(equity) OVER ({RW}) AS peak FROM curve")
cte("dd", ("cr",), f"SELECT *, (equity - peak) / peak AS dd FROM cr")
cte("ddi", ("dd",), f"SELECT *, sum((dd = 0)::INT) OVER ({RW}) AS spell FROM dd")
cte("spells", ("ddi",), "SELECT run_id, min(ts) AS start_time, max(ts) AS end_time, arg_min(ts, dd) AS trough_time, min(dd) AS max_drawdown, count(*) AS n_rows, date_diff('second', min(ts), max(ts)) // 86400 AS duration_days FROM ddi WHERE dd < 0 GROUP BY run_id, spell")
q("equity_returns", lambda sp, sf: show(perf.returns(curve(sp, sf)).select("run_id", "ts", "return", "log_return")),
  f"SELECT run_id, ts, {R('ret')} AS \"return\", {R('ln(1 + ret)')} AS log_return FROM cr", "cr")
q("drawdown_series", lambda sp, sf: show(perf.drawdown_series(curve(sp, sf)).select("run_id", "ts", "peak", "drawdown"), peak=4),
  f"SELECT run_id, ts, {R('peak', 4)} AS peak, {R('dd')} AS drawdown FROM dd", "dd")
q("drawdown_spells", lambda sp, sf: show(perf.drawdown_spells(curve(sp, sf))), f"SELECT run_id, start_time, end_time, trough_time, {R('max_drawdown')} AS max_drawdown, n_rows, duration_days FROM spells", "spells")
q("top_drawdowns", lambda sp, sf: show(perf.top_drawdowns(curve(sp, sf), 5)),
  f"SELECT run_id, rank, {R('max_drawdown')} AS max_drawdown, start_time, end_time, trough_time, duration_days FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY max_drawdown, start_time) AS rank FROM spells) WHERE rank <= 5", "spells")
cte("dds", ("dd", "spells"), """SELECT run_id, min(dd) AS mdd, last(dd ORDER BY pos) AS cur, count(*) FILTER (dd < 0) / count(*) * 100 AS under, coalesce(avg(dd) FILTER (dd < 0), 0) AS avgdd,
  coalesce((SELECT max(duration_days) FROM spells s WHERE s.run_id = d.run_id), 0) AS dur, coalesce((SELECT max_drawdown FROM spells s WHERE s.run_id = d.run_id AND duration_days > 0 ORDER BY duration_days DESC, start_time LIMIT 1), 0) AS durdd FROM dd d GROUP BY run_id""")
q("drawdown_summary", lambda sp, sf: show(perf.drawdown_summary(curve(sp, sf))),
  f"SELECT run_id, {R('mdd')} AS max_drawdown, dur AS max_duration_days, {R('durdd')} AS max_duration_drawdown, {R('cur')} AS current_drawdown, {R('under')} AS underwater_pct, {R('avgdd')} AS avg_drawdown FROM dds", "dds")
cte("pm", ("cr",), """SELECT run_id, first(equity ORDER BY pos) AS e0, last(equity ORDER BY pos) AS e1, greatest(1, date_diff('second', min(ts), max(ts)) // 86400) AS days, stddev_samp(ret) AS sd, stddev_samp(ret) FILTER (ret < 0) AS dn, stddev_pop(ret) AS sdp, avg(ret) AS m, count(ret) AS n FROM cr GROUP BY run_id""")
cte("pmx", ("pm", "dds"), "SELECT *, pow(e1 / e0, 365.0 / days) - 1 AS ann, sd * sqrt(252) AS vol, pow(e1 / e0, 252.0 / n) - 1 AS ann2 FROM pm JOIN dds USING (run_id)")
q("performance_summary", lambda sp, sf: show(perf.performance_summary(curve(sp, sf), risk_free=0.02), 4),
  f"""SELECT run_id, {R('e0', 4)} AS initial_equity, {R('e1', 4)} AS final_equity, {R('(e1 / e0 - 1) * 100', 4)} AS total_return_pct, {R('ann * 100', 4)} AS annualized_return_pct, days AS trading_days, {R('days / 30', 4)} AS trading_months, {R('vol * 100', 4)} AS annualized_volatility_pct,
  {R('(ann - 0.02) / nullif(vol, 0)', 4)} AS sharpe_ratio, {R('(ann - 0.02) / nullif(dn * sqrt(252), 0)', 4)} AS sortino_ratio, {R('mdd * 100', 4)} AS max_drawdown_pct, dur AS max_drawdown_duration, {R('ann / nullif(abs(mdd), 0)', 4)} AS calmar_ratio, 2.0 AS risk_free_rate_pct FROM pmx""", "pmx")
q("simple_metrics", lambda sp, sf: show(perf.simple_metrics(curve(sp, sf)), 5),
  f"SELECT run_id, {R('e1 / e0 - 1', 5)} AS total_return, {R('ann2', 5)} AS annualized_return, {R('vol', 5)} AS annualized_volatility, {R('m / sdp * sqrt(252)', 5)} AS sharpe_ratio, {R('mdd', 5)} AS max_drawdown, {R('ann2 / abs(mdd)', 5)} AS calmar_ratio FROM pmx", "pmx")
q("rolling_metrics", lambda sp, sf: show(perf.rolling_metrics(curve(sp, sf), 30), 4),
  f"""SELECT run_id, ts, {R(f'equity / lag(equity, 30) OVER ({RW}) - 1', 4)} AS rolling_return, {R(f'({roll('stddev_samp', 'ret', 30, RW)}) * sqrt(252)', 4)} AS rolling_volatility,
  {R(f'({roll('avg', 'ret', 30, RW)}) * 252 / nullif(({roll('stddev_samp', 'ret', 30, RW)}) * sqrt(252), 0)', 4)} AS rolling_sharpe, {R(f'(equity - ({roll('max', 'equity', 30, RW)})) / ({roll('max', 'equity', 30, RW)})', 4)} AS rolling_drawdown FROM cr""", "cr")
cte("week", ("curve",), "SELECT run_id, date_trunc('week', ts) AS period_start, first(equity ORDER BY pos) AS a, last(equity ORDER BY pos) AS b FROM curve GROUP BY 1, 2")
q("weekly_returns", lambda sp, sf: show(perf.period_returns(curve(sp, sf), "W"), 4),
  f"SELECT run_id, period_start::TIMESTAMP AS period_start, {R('a', 4)} AS start_equity, {R('b', 4)} AS end_equity, {R('b / a - 1', 4)} AS \"return\" FROM week", "week")
# a long daily curve (account value driven by the orders table) for the month tables
cte("dcurve", ("day_bars",), "SELECT symbol AS run_id, ts, pos, 1000000 + close AS equity FROM day_bars")
cte("dmonth", ("dcurve",), "SELECT run_id, year(ts) AS year, month(ts) AS month, first(equity ORDER BY pos) AS a, last(equity ORDER BY pos) AS b FROM dcurve GROUP BY 1, 2, 3")


def dcurve(sp, sf):
    return day_bars(sp, sf).select(F.col("symbol").alias("run_id"), "ts", "pos", (1000000 + F.col("close")).alias("equity"))


q("monthly_returns", lambda sp, sf: show(perf.calendar_returns(dcurve(sp, sf)), 5, start_equity=2, end_equity=2),
  f"SELECT run_id, year, month, {R('a', 2)} AS start_equity, {R('b', 2)} AS end_equity, {R('b / a - 1', 5)} AS \"return\" FROM dmonth", "dmonth")
q("month_end_returns", lambda sp, sf: show(perf.month_end_returns(dcurve(sp, sf)), 5, equity=2),
  f"SELECT run_id, year, month, {R('b', 2)} AS equity, {R('b / lag(b) OVER (PARTITION BY run_id ORDER BY year, month) - 1', 5)} AS \"return\" FROM dmonth", "dmonth")
_MM = ", ".join(f"{R(f'avg(b / a - 1) FILTER (month = {i + 1}) * 100', 5)} AS {m}" for i, m in enumerate(perf.MONTHS))
q("monthly_table", lambda sp, sf: show(perf.monthly_table(dcurve(sp, sf)), 5),
  f"SELECT run_id, year, {_MM}, {R('(product(b / a) - 1) * 100', 5)} AS year_total FROM dmonth GROUP BY run_id, year UNION ALL SELECT run_id, NULL, {_MM}, NULL FROM dmonth GROUP BY run_id", "dmonth")
cte("pct", ("cr",), "SELECT run_id, ret * 100 AS r FROM cr WHERE ret IS NOT NULL")
q("return_distribution", lambda sp, sf: show(perf.return_distribution(perf.period_returns(curve(sp, sf), "D")), 5),
  f"SELECT run_id, {R('avg(r)', 5)} AS mean, {R('median(r)', 5)} AS median, {R('stddev_samp(r)', 5)} AS std, {R('min(r)', 5)} AS min, {R('max(r)', 5)} AS max, {R('count(*) FILTER (r > 0) / count(*) * 100', 5)} AS positive_pct, count(*) AS n FROM pct GROUP BY run_id", "pct")
q("return_histogram", lambda sp, sf: show(perf.return_histogram(perf.period_returns(curve(sp, sf), "D")).select("run_id", "bin", "n")),
  "SELECT run_id, least(49, floor((r - lo) / (hi - lo) * 50))::BIGINT AS bin, count(*) AS n FROM (SELECT *, min(r) OVER (PARTITION BY run_id) AS lo, max(r) OVER (PARTITION BY run_id) AS hi FROM pct) GROUP BY 1, 2", "pct")
_TM = f"""count(*) AS total_trades, count(*) FILTER (pnl > 0) AS winning_trades, count(*) FILTER (pnl < 0) AS losing_trades, {{win}}, {R('sum(pnl)', 4)} AS total_pnl"""
q("trade_metrics", lambda sp, sf: show(perf.trade_metrics(closed(sp, sf)), 4),
  f"""SELECT run_id, {_TM.format(win=R('count(*) FILTER (pnl > 0) / count(*) * 100', 4) + ' AS win_rate_pct')}, {R('avg(pnl)', 4)} AS average_pnl, {R('coalesce(avg(pnl) FILTER (pnl > 0), 0)', 4)} AS average_win, {R('coalesce(avg(pnl) FILTER (pnl < 0), 0)', 4)} AS average_loss,
  {R('sum(pnl) FILTER (pnl > 0) / abs(sum(pnl) FILTER (pnl < 0))', 4)} AS profit_factor, count(*) FILTER (pnl < 0) = 0 AS no_losses, {R('avg(pnl)', 4)} AS expected_payoff, {R('avg(epoch_us(exit_time) - epoch_us(entry_time)) / 86400e6', 4)} AS avg_holding_period_days FROM closed GROUP BY run_id""", "closed")
cte("runs", ("closed",), """SELECT run_id, won, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY exit_time) - row_number() OVER (PARTITION BY run_id, won ORDER BY exit_time) AS island FROM (SELECT *, pnl > 0 AS won FROM closed)) GROUP BY run_id, won, island""")
q("trade_streaks", lambda sp, sf: show(perf.trade_streaks(closed(sp, sf))), "SELECT run_id, coalesce(max(n) FILTER (won), 0) AS max_win_streak, coalesce(max(n) FILTER (NOT won), 0) AS max_loss_streak FROM runs GROUP BY run_id", "runs")
q("trade_summary", lambda sp, sf: show(perf.trade_summary(closed(sp, sf)), 4),
  f"""SELECT run_id, {_TM.format(win=R('count(*) FILTER (pnl > 0) / count(*)', 4) + ' AS win_rate')}, {R('avg(pnl) FILTER (pnl > 0)', 4)} AS avg_profit, {R('avg(pnl) FILTER (pnl < 0)', 4)} AS avg_loss, {R('max(pnl)', 4)} AS largest_profit, {R('min(pnl)', 4)} AS largest_loss,
  {R('-sum(pnl) FILTER (pnl > 0) / sum(pnl) FILTER (pnl < 0)', 4)} AS profit_factor, {R('avg(epoch_us(exit_time) - epoch_us(entry_time)) / 1e6', 4)} AS avg_trade_seconds FROM closed GROUP BY run_id""", "closed")
q("cumulative_pnl", lambda sp, sf: show(perf.cumulative_pnl(closed(sp, sf)).select("run_id", "exit_time", "cumulative_pnl"), 6),
  f"SELECT run_id, exit_time, {R('sum(pnl) OVER (PARTITION BY run_id ORDER BY exit_time)', 6)} AS cumulative_pnl FROM closed", "closed")
_BY = f"count(*) AS n_trades, {R('avg(pnl)', 4)} AS mean_pnl, {R('sum(pnl)', 4)} AS total_pnl, {R('count(*) FILTER (pnl > 0) / count(*) * 100', 4)} AS win_rate_pct"
for _n, _fn, _g in (("trades_by_symbol", perf.by_symbol, "symbol AS symbol"), ("trades_by_month", perf.by_month, "strftime(exit_time, '%Y-%m') AS month"), ("trades_by_entry_hour", perf.by_entry_hour, "hour(entry_time) AS entry_hour")):
    q(_n, lambda sp, sf, fn=_fn: show(fn(closed(sp, sf)), 4), f"SELECT run_id, {_g}, {_BY} FROM closed GROUP BY 1, 2", "closed")
q("normalised_equity", lambda sp, sf: show(perf.normalised_equity(curve(sp, sf)).select("run_id", "ts", "normalised")),
  f"SELECT run_id, ts, {R(f'equity / first_value(equity) OVER ({RW}) * 100')} AS normalised FROM curve", "curve")
q("benchmark_rebased", lambda sp, sf: show(perf.rebase_benchmark(curve(sp, sf), bars(sp, sf).where("symbol = 'view'").select("ts", F.col("close").alias("benchmark"))).select("run_id", "ts", "benchmark_rebased"), 4),
  f"SELECT run_id, ts, {R('b / first_value(b) OVER w * first_value(equity) OVER w', 4)} AS benchmark_rebased FROM (SELECT c.*, b.close AS b FROM curve c JOIN bars b ON b.ts = c.ts AND b.symbol = 'view') WINDOW w AS (PARTITION BY run_id ORDER BY ts)", "curve", "bars")

# ---------------------------------------------------------------- sweep results
cte("swtr", ("sweep",), "SELECT run_id, symbol, signal AS side, close AS entry, lead(close) OVER (PARTITION BY run_id, symbol ORDER BY pos) AS leave FROM sweep WHERE signal IS NOT NULL")
cte("swpnl", ("swtr",), "SELECT run_id, sum((leave - entry) * side) - sum(entry * 0.001) - sum(coalesce(leave, 0) * 0.001) AS net, count(leave) AS trades FROM swtr GROUP BY run_id")


def sweep_metrics(sp, sf):
    """Net result per run; added up as decimals, so that the order of the rows doesn't show in the last digit."""
    t = ledger.trades(sweep(sp, sf), SWEEP)
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(30,12)")), F.lit(0)).cast("double")
    return t.groupBy("run_id").agg((total("pnl") - total("entry_commission") - total("exit_commission")).alias("net"), F.count("exit_pos").alias("trades"))


q("sweep_compare", lambda sp, sf: show(perf.compare_runs(sweep_metrics(sp, sf), None, ["net", "trades"]), 3), f"SELECT run_id, {R('net', 3)} AS net, trades FROM swpnl", "swpnl")
q("sweep_best", lambda sp, sf: show(perf.best_run(sweep_metrics(sp, sf), "net"), 3), f"SELECT run_id, {R('net', 3)} AS net, trades FROM swpnl ORDER BY swpnl.net DESC, run_id LIMIT 1", "swpnl")
q("sweep_table", lambda sp, sf: show(perf.sweep_table(sweep_metrics(sp, sf), "net", SHORTS, LONGS), 3),
  "SELECT split_part(run_id, '/', 1)::BIGINT AS short_window, " + ", ".join(f"{R(f'max(net) FILTER (run_id LIKE {chr(39)}%/{b}{chr(39)})', 3)} AS long_{b}" for b in LONGS) + " FROM swpnl GROUP BY 1", "swpnl")
cte("swmark", ("sweep", "bars"), """SELECT s.run_id, s.symbol, s.ts, s.pos, s.close, last_value(CASE WHEN signal IS NOT NULL THEN close END IGNORE NULLS) OVER w AS entry, last_value(signal IGNORE NULLS) OVER w AS side,
  last_value(CASE WHEN signal IS NOT NULL THEN close END IGNORE NULLS) OVER (PARTITION BY run_id, symbol ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pentry, last_value(signal IGNORE NULLS) OVER (PARTITION BY run_id, symbol ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pside, signal
  FROM sweep s WINDOW w AS (PARTITION BY run_id, symbol ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
cte("swnet", ("swmark",), """SELECT run_id, symbol, ts, sum(CASE WHEN signal IS NULL THEN 0 ELSE coalesce((close - pentry) * pside, 0) - close * 0.001 * CASE WHEN pside IS NULL THEN 1 ELSE 2 END END) OVER (PARTITION BY run_id, symbol ORDER BY pos) + coalesce((close - entry) * side, 0) AS v FROM swmark""")
cte("swcurve", ("swnet",), "SELECT t.run_id, t.ts, 10000 + sum(coalesce(n.v, 0)) AS equity FROM (SELECT DISTINCT run_id, ts FROM swnet) t CROSS JOIN (SELECT DISTINCT symbol FROM swnet) s ASOF LEFT JOIN swnet n ON n.run_id = t.run_id AND n.symbol = s.symbol AND n.ts <= t.ts GROUP BY 1, 2")
cte("swret", ("swcurve",), "SELECT *, equity / lag(equity) OVER (PARTITION BY run_id ORDER BY ts) - 1 AS ret FROM swcurve")
def _sweep_equity(sp, sf):
    t = stage(ledger.trades(sweep(sp, sf), SWEEP))
    return stage(ledger.equity_curve(ledger.mark_to_market(sweep(sp, sf), t, SWEEP), SWEEP, ("run_id",)))


q("sweep_sharpe", lambda sp, sf: show(perf.simple_metrics(_sweep_equity(sp, sf)).select("run_id", "total_return", "sharpe_ratio"), 4),
  f"SELECT run_id, {R('last(equity ORDER BY ts) / first(equity ORDER BY ts) - 1', 4)} AS total_return, {R('avg(ret) / stddev_pop(ret) * sqrt(252)', 4)} AS sharpe_ratio FROM swret GROUP BY run_id", "swret")

# ---------------------------------------------------------------- metrics of fixed predictions
cte("pl", ("preds",), "SELECT symbol, ts, pos, (nxt > 0)::INT AS label, (prediction > 0)::INT AS cls, p_up, nxt, prediction FROM preds WHERE nxt IS NOT NULL")


def pl(sp, sf):
    return preds(sp, sf).where("nxt is not null").select("symbol", "ts", "pos", (F.col("nxt") > 0).cast("int").alias("label"), (F.col("prediction") > 0).cast("int").alias("cls"), F.col("p_up").alias("probability_up"), "nxt", "prediction")


_CM = "SELECT symbol, count(*) AS n, avg((label = cls)::INT) AS acc, count(*) FILTER (label = 1 AND cls = 1) AS tp, count(*) FILTER (cls = 1) AS np, count(*) FILTER (label = 1) AS ny FROM pl GROUP BY symbol"
q("classification_metrics", lambda sp, sf: show(models.classification_metrics(pl(sp, sf), ["symbol"], prediction="cls")),
  f"SELECT symbol, n, {R('acc')} AS accuracy, {R('coalesce(tp / nullif(np, 0), 0)')} AS precision, {R('coalesce(tp / nullif(ny, 0), 0)')} AS recall, {R('coalesce(2 * tp / nullif(np + ny, 0), 0)')} AS f1 FROM ({_CM})", "pl")
q("roc_auc", lambda sp, sf: show(models.roc_auc(pl(sp, sf), ["symbol"])),
  f"SELECT symbol, {R('(sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0))')} AS roc_auc FROM (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY p_up) + (count(*) OVER (PARTITION BY symbol, p_up) - 1) / 2 AS r FROM pl) GROUP BY symbol", "pl")
q("regression_metrics", lambda sp, sf: show(models.regression_metrics(pl(sp, sf), ["symbol"], "nxt"), 4),
  f"""SELECT symbol, count(*) AS n, {R('avg(pow(nxt - prediction, 2))', 4)} AS mse, {R('avg(abs(nxt - prediction))', 4)} AS mae, {R('sqrt(avg(pow(nxt - prediction, 2)))', 4)} AS rmse, {R('1 - avg(pow(nxt - prediction, 2)) / var_pop(nxt)', 4)} AS r2,
  {R('avg((sign(nxt) = sign(prediction))::INT)', 4)} AS sign_agreement FROM pl GROUP BY symbol""", "pl")
q("weighted_metrics", lambda sp, sf: show(models.weighted_metrics(pl(sp, sf), ["symbol"], prediction="cls")),
  f"""SELECT symbol, {R('sum(tp) / sum(ny)')} AS accuracy, {R('sum(coalesce(tp / nullif(np, 0), 0) * ny) / sum(ny)')} AS precision, {R('sum(coalesce(tp / nullif(ny, 0), 0) * ny) / sum(ny)')} AS recall, {R('sum(coalesce(2 * tp / nullif(np + ny, 0), 0) * ny) / sum(ny)')} AS f1_score FROM
  (SELECT symbol, c, count(*) FILTER (label = c AND cls = c) AS tp, count(*) FILTER (cls = c) AS np, count(*) FILTER (label = c) AS ny FROM pl, (VALUES (0), (1)) v(c) GROUP BY symbol, c) GROUP BY symbol""", "pl")
q("step_direction_accuracy", lambda sp, sf: show(models.step_direction_accuracy(pl(sp, sf), label="nxt")),
  f"SELECT symbol, {R('avg((a = b)::INT)')} AS direction_accuracy FROM (SELECT symbol, nxt - lag(nxt) OVER ({W}) > 0 AS a, prediction - lag(prediction) OVER ({W}) > 0 AS b FROM pl) WHERE a IS NOT NULL GROUP BY symbol", "pl")
q("metrics_by_regime", lambda sp, sf: show(models.metrics_by_regime(pl(sp, sf).drop("prediction").withColumnRenamed("cls", "prediction").withColumn(
    "market_regime", F.when(F.hour("ts") < 8, "night").otherwise("day")), task="classification").select("market_regime", "n", "accuracy")),
  f"SELECT CASE WHEN hour(ts) < 8 THEN 'night' ELSE 'day' END AS market_regime, count(*) AS n, {R('avg((label = cls)::INT)')} AS accuracy FROM pl GROUP BY 1", "pl")
q("fold_summary", lambda sp, sf: show(models.fold_summary(models.regression_metrics(pl(sp, sf), ["symbol"], "nxt"), ["mae", "sign_agreement"]), 4),
  " UNION ALL ".join(f"SELECT '{m}' AS metric, {R('avg(v)', 4)} AS mean, {R('stddev_pop(v)', 4)} AS std_pop, {R('stddev_samp(v)', 4)} AS std, {R('min(v)', 4)} AS min, {R('max(v)', 4)} AS max FROM (SELECT symbol, {e} AS v FROM pl GROUP BY symbol)" for m, e in (("mae", "avg(abs(nxt - prediction))"), ("sign_agreement", "avg((sign(nxt) = sign(prediction))::INT)"))), "pl")
q("compare_datasets", lambda sp, sf: show(models.compare_datasets(models.regression_metrics(pl(sp, sf), ["symbol"], "nxt").withColumn("model", F.lit("momentum")).unionByName(
    models.regression_metrics(pl(sp, sf).withColumn("prediction", -F.col("prediction")), ["symbol"], "nxt").withColumn("model", F.lit("reversal"))).withColumnRenamed("symbol", "dataset"), ["sign_agreement", "rmse"], ["momentum", "reversal"]), 4),
  f"""SELECT symbol AS dataset, {R('avg((sign(nxt) = sign(prediction))::INT)', 4)} AS momentum_sign_agreement, {R('sqrt(avg(pow(nxt - prediction, 2)))', 4)} AS momentum_rmse, {R('avg((sign(nxt) = sign(-prediction))::INT)', 4)} AS reversal_sign_agreement,
  {R('sqrt(avg(pow(nxt + prediction, 2)))', 4)} AS reversal_rmse FROM pl GROUP BY symbol""", "pl")
q("target_correlation", lambda sp, sf: show(select.target_correlation(bars(sp, sf), ["open", "high", "low", "volume"], "close")),
  " UNION ALL ".join(f"SELECT '{c}' AS feature, {R(f'corr({c}, close)')} AS correlation FROM bars" for c in ("open", "high", "low", "volume")), "bars")
q("feature_metadata", lambda sp, sf: show(select.feature_metadata(rets(sp, sf))),
  " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS category, count(*) FILTER ({c} IS NULL) AS nan_count, {R(f'count(*) FILTER ({c} IS NULL) / count(*) * 100')} AS nan_pct FROM rets" for c, k in
                     (("open", "raw_price"), ("high", "raw_price"), ("low", "raw_price"), ("close", "raw_price"), ("volume", "volume"), ("close_return", "transformed_price"))), "rets")
