"""Sources, typing, missing values, outliers, grids, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark.functions import columns as C
from barspark.functions import naming as N
from barspark.operators import clean, features, normalize, prepare, resample
from barspark.operators.models import align_inputs
from barspark.operators.quantiles import quantiles
from barspark.operators.series import BARS, Ewm, Series, ewm, number_rows, scan, running_sum
from checks.common import (CTES, EVENT_TICKS, ORDER_TICKS, R, W, bars, bfill, cte, day_bars, event_ticks, ffill, gappy, order_ticks, over, roll,
                           show, sql, table)

Q: dict = {}
S: dict[str, str] = {}
PX = ("open", "high", "low", "close")


def q(name: str, fn, select: str | None = None, *ctes: str) -> None:
    Q[name] = fn
    if select:
        S[name] = sql(*ctes, select=select)


RPX = ", ".join(f"{R(c)} AS {c}" for c in PX)

# ---------------------------------------------------------------- grids and bars
q("bars_hourly", lambda sp, sf: show(clean.fill_missing(resample.ohlcv_grid(event_ticks(sp, sf), "1 hour", s=EVENT_TICKS))),
  f"SELECT symbol, ts, pos, {RPX}, volume FROM bars", "bars")
q("bars_daily", lambda sp, sf: show(clean.fill_missing(resample.ohlcv_grid(order_ticks(sp, sf), "1 day", s=ORDER_TICKS))),
  f"SELECT symbol, ts, pos, {RPX}, volume FROM day_bars", "day_bars")
q("bars_per_user", lambda sp, sf: show(resample.bars_from_ticks(
    table(sp, sf, "events").select(F.col("user_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value"),
    "6 hours", price="value", s=Series(keys=("user_id",), tie=("event_id",))).drop("_bin")),
  f"""SELECT user_id, make_timestamp((epoch_us(ts) // 21600000000) * 21600000000) AS ts, {R('first(value ORDER BY ts, event_id)')} AS open,
  {R('max(value)')} AS high, {R('min(value)')} AS low, {R('last(value ORDER BY ts, event_id)')} AS close, count(value)::DOUBLE AS volume
  FROM events GROUP BY user_id, epoch_us(ts) // 21600000000""")


def _resample4(sp, sf):
    x = gappy(sp, sf).withColumn("spread", F.col("high") - F.col("low"))
    return show(resample.resample(x, "4 hours"))


q("resample_4h", _resample4, f"""SELECT g.symbol, make_timestamp(g.bin * 14400000000) AS ts, g.bin - g.b0 AS pos, {R('open')} AS open, {R('high')} AS high,
  {R('low')} AS low, {R('close')} AS close, coalesce(volume, 0) AS volume, {R('spread')} AS spread FROM
  (SELECT symbol, b0, unnest(generate_series(b0, b1)) AS bin FROM (SELECT symbol, min(epoch_us(ts)) // 14400000000 AS b0, max(epoch_us(ts)) // 14400000000 AS b1 FROM gappy GROUP BY symbol)) g
  LEFT JOIN (SELECT symbol, epoch_us(ts) // 14400000000 AS bin, first(open ORDER BY pos) FILTER (open IS NOT NULL) AS open, max(high) AS high, min(low) AS low,
   last(close ORDER BY pos) FILTER (close IS NOT NULL) AS close, sum(volume) AS volume, avg(high - low) AS spread FROM gappy GROUP BY 1, 2) a
  ON a.symbol = g.symbol AND a.bin = g.bin""", "gappy")
q("last_known_grid", lambda sp, sf: show(resample.resample_last_known(event_ticks(sp, sf), "1 hour", ["price"], EVENT_TICKS)),
  f"""SELECT g.symbol, g.ts, g.pos, {R('t.price')} AS price FROM gappy g ASOF LEFT JOIN
  (SELECT event_type AS symbol, ts, value AS price FROM events) t ON t.symbol = g.symbol AND t.ts <= g.ts""", "gappy")
q("gap_report", lambda sp, sf: show(resample.gap_report(number_rows(event_ticks(sp, sf), EVENT_TICKS, "1 hour"), EVENT_TICKS)),
  f"""SELECT symbol, count(*) AS n_rows, {R('max(gap)')} AS max_gap_seconds FROM (SELECT event_type AS symbol,
  (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id)) / 1e6 AS gap FROM events) GROUP BY symbol""")
q("row_numbers_time", lambda sp, sf: number_rows(event_ticks(sp, sf), EVENT_TICKS, "1 hour").select("symbol", "event_id", "pos"),
  "SELECT event_type AS symbol, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos FROM events")
q("row_numbers_range", lambda sp, sf: number_rows(order_ticks(sp, sf), ORDER_TICKS, method="range").select("symbol", "o_orderkey", "pos"),
  "SELECT o_orderpriority AS symbol, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders")
q("running_total_orders", lambda sp, sf: show(scan(number_rows(order_ticks(sp, sf), ORDER_TICKS, method="range"), ORDER_TICKS,
                                                {"total": running_sum("price")}, block=512).select("symbol", "o_orderkey", "total"), 2),
  f"""SELECT o_orderpriority AS symbol, o_orderkey, {R('sum(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey)', 2)} AS total FROM orders""")
q("higher_timeframe", lambda sp, sf: show(resample.higher_timeframe(bars(sp, sf), 4).select("symbol", "ts", *[f"htf_{c}" for c in (*PX, "volume")])),
  f"""SELECT symbol, ts, {R(f'CASE WHEN pos >= 3 THEN first_value(open) {over(4)} END')} AS htf_open, {R(f'CASE WHEN pos >= 3 THEN max(high) {over(4)} END')} AS htf_high,
  {R(f'CASE WHEN pos >= 3 THEN min(low) {over(4)} END')} AS htf_low, {R('CASE WHEN pos >= 3 THEN close END')} AS htf_close,
  {R(f'CASE WHEN pos >= 3 THEN sum(volume) {over(4)} END')} AS htf_volume FROM bars""", "bars")
q("decision_rows", lambda sp, sf: show(resample.decision_rows(
    event_ticks(sp, sf).withColumn("ts", F.date_trunc("minute", "ts")), 15, EVENT_TICKS)),
  f"SELECT event_type AS symbol, date_trunc('minute', ts) AS ts, event_id, {R('value')} AS price FROM events WHERE minute(ts) % 15 = 0")
q("recent_candles", lambda sp, sf: show(resample.recent_candles(bars(sp, sf), 6).select(
    "symbol", "ts", F.size("candles").alias("n"), F.col("candles")[0]["open"].alias("first_open"),
    F.aggregate("candles", F.lit(0.0), lambda a, c: a + c["close"]).alias("sum_close"))),
  f"SELECT symbol, ts, count(*) {over(6)} AS n, {R(f'first_value(open) {over(6)}')} AS first_open, {R(f'sum(close) {over(6)}')} AS sum_close FROM bars", "bars")
q("common_days", lambda sp, sf: show(resample.common_days(order_ticks(sp, sf), ORDER_TICKS), 2),
  f"""SELECT o_orderpriority AS symbol, o_orderdate AS ts, o_orderkey, {R('o_totalprice', 2)} AS price FROM orders WHERE o_orderdate::DATE IN
  (SELECT o_orderdate::DATE FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders))""")
q("timeline", lambda sp, sf: show(resample.timeline(order_ticks(sp, sf))), "SELECT DISTINCT o_orderdate AS ts FROM orders")
q("first_of_day", lambda sp, sf: show(resample.first_of_day(event_ticks(sp, sf), EVENT_TICKS).drop("day")),
  f"""SELECT symbol, ts, event_id, {R('price')} AS price FROM (SELECT event_type AS symbol, ts, event_id, value AS price,
  row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""")
q("last_250_bars", lambda sp, sf: show(resample.last_rows(bars(sp, sf), 250).select("symbol", "ts", "close")),
  f"SELECT symbol, ts, {R('close')} AS close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY pos DESC) <= 250", "bars")

# ---------------------------------------------------------------- typing and projections
q("number_coercion", lambda sp, sf: show(table(sp, sf, "orders").select(
    "o_orderkey", C.number(F.when(F.col("o_orderstatus") == "F", F.col("o_orderstatus")).otherwise(F.col("o_totalprice").cast("string"))).alias("price"),
    F.coalesce(C.number("o_orderpriority"), F.lit(0.0)).alias("filled")), 2),
  f"SELECT o_orderkey, {R("CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END", 2)} AS price, coalesce(try_cast(o_orderpriority AS DOUBLE), 0.0) AS filled FROM orders")
q("timestamp_coercion", lambda sp, sf: show(table(sp, sf, "orders").select("o_orderkey", C.stamp(F.when(F.col("o_orderstatus") == "P", "never").otherwise(
    F.date_format("o_orderdate", "yyyy/MM/dd")), "yyyy/MM/dd").alias("ts"))),
  "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS ts FROM orders")
q("price_priority", lambda sp, sf: show(gappy(sp, sf).select("symbol", "ts", F.col("close").alias("close_raw"), F.col("open").alias("close_original"),
                                                          F.lit(1.5).alias("close")).transform(lambda d: d.select("symbol", "ts", N.price_of(d).alias("price"))).where("price is not null")),
  f"SELECT symbol, ts, {R('coalesce(close, open, 1.5)')} AS price FROM gappy WHERE coalesce(close, open, 1.5) > 0", "gappy")
q("typical_price", lambda sp, sf: show(bars(sp, sf).select("symbol", "ts", C.typical_price().alias("price"))),
  f"SELECT symbol, ts, {R('(high + low + close) / 3')} AS price FROM bars", "bars")
q("date_range", lambda sp, sf: show(table(sp, sf, "orders").where(C.date_range("o_orderdate", "1996-01-01", "1997-12-31")).select("o_orderkey", "o_orderdate")),
  "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31'")
q("synthetic_volume", lambda sp, sf: show(bars(sp, sf).select("symbol", "ts", C.synthetic_volume().alias("volume"))),
  "SELECT symbol, ts, trunc((high - low) * 1e7)::BIGINT AS volume FROM bars", "bars")
q("synthetic_volume_noisy", lambda sp, sf: show(bars(sp, sf).select("symbol", "ts", C.synthetic_volume_noisy(seed=42).alias("volume"))))
_BROKEN = "SELECT symbol, ts, pos, open, close AS high, open AS low, close FROM bars"
q("repair_bars", lambda sp, sf: show(clean.repair_bars(bars(sp, sf).withColumns({"high": F.col("close"), "low": F.col("open")})).select("symbol", "ts", *PX)),
  f"SELECT symbol, ts, {R('open')} AS open, {R('greatest(high, open, close)')} AS high, {R('least(low, open, close)')} AS low, {R('close')} AS close FROM ({_BROKEN})", "bars")
q("invalid_bars", lambda sp, sf: show(clean.invalid_bars(bars(sp, sf).withColumns({"high": F.col("close"), "low": F.col("open")}))),
  f"SELECT symbol, count(*) FILTER (high < greatest(open, close)) AS invalid_high, count(*) FILTER (low > least(open, close)) AS invalid_low FROM ({_BROKEN}) GROUP BY symbol", "bars")
q("align_inputs", lambda sp, sf: show(align_inputs(gappy(sp, sf), ["close", "close_raw", "high_original", "missing_one", "volume"], ["symbol", "ts"])),
  f"SELECT symbol, ts, {R('coalesce(close, 0)')} AS close, {R('coalesce(close, 0)')} AS close_raw, {R('coalesce(high, 0)')} AS high_original, 0.0 AS missing_one, volume FROM gappy", "gappy")
q("case_folding", lambda sp, sf: show(N.restore_names(N.lower_names(bars(sp, sf).select(F.col("symbol").alias("Symbol"), F.col("ts").alias("Date"), F.col("close").alias("Close")))
                                                      .withColumn("twice", F.col("close") * 2), ["Symbol", "Date", "Close"])),
  f"SELECT symbol AS Symbol, ts AS Date, {R('close')} AS Close, {R('close * 2')} AS twice FROM bars", "bars")
q("dataset_names", lambda sp, sf: table(sp, sf, "orders").groupBy("o_orderstatus").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b")).select(
    N.dataset_name(F.concat(F.lit("GBP"), "o_orderstatus"), F.lit("5_Minute"), F.col("a"), F.col("b")).alias("file")).select(
    "file", *[c.alias(k) for k, c in N.dataset_columns(F.col("file")).items()], N.derived_name(F.col("file"), "feature_importance").alias("derived")),
  """SELECT 'raw_' || base || '.csv' AS file, 'raw' AS kind, sym AS symbol, '5m' AS timeframe, d0 AS start_date, d1 AS end_date, 'feature_importance_' || base || '.csv' AS derived
  FROM (SELECT *, sym || '_5m_' || d0 || '_' || d1 AS base FROM (SELECT 'GBP' || o_orderstatus AS sym, strftime(min(o_orderdate), '%Y%m%d') AS d0, strftime(max(o_orderdate), '%Y%m%d') AS d1 FROM orders GROUP BY o_orderstatus))""")

# ---------------------------------------------------------------- missing values
q("fill_forward_backward", lambda sp, sf: show(clean.fill_missing(gappy(sp, sf), "ffill").drop("pos")), f"SELECT symbol, ts, {RPX}, volume FROM bars", "bars")
q("fill_backward_forward", lambda sp, sf: show(clean.fill_missing(gappy(sp, sf), "bfill").drop("pos")),
  "SELECT symbol, ts, " + ", ".join(f"{R(f'coalesce({bfill(c)}, {ffill(c)})')} AS {c}" for c in PX) + ", volume FROM gappy", "gappy")


def _line(c: str, at: str) -> str:
    p = f"last_value(CASE WHEN {c} IS NOT NULL THEN {at} END IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    n = f"first_value(CASE WHEN {c} IS NOT NULL THEN {at} END IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return f"CASE WHEN {c} IS NOT NULL THEN {c} ELSE coalesce({ffill(c)} + ({bfill(c)} - {ffill(c)}) * ({at} - {p}) / ({n} - {p}), {ffill(c)}, {bfill(c)}) END"


cte("holes", (), "SELECT event_type AS symbol, ts, event_id, epoch_us(ts) AS us, CASE WHEN value <= 60 THEN value END AS close, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos FROM events")


def _holes(sp, sf):
    """Ticks at irregular times, prices above 60 unknown."""
    t = event_ticks(sp, sf).withColumn("close", F.when(F.col("price") <= 60, F.col("price")))
    return number_rows(t, EVENT_TICKS, "1 hour")


q("interpolate_time", lambda sp, sf: show(clean.interpolate(_holes(sp, sf), ["close"], EVENT_TICKS, by="time").select("symbol", "ts", "event_id", "close")),
  f"SELECT symbol, ts, event_id, {R(_line('close', 'us'))} AS close FROM holes", "holes")
q("interpolate_rows", lambda sp, sf: show(clean.interpolate(gappy(sp, sf), ["open", "close"], by="row").select("symbol", "ts", "open", "close")),
  f"SELECT symbol, ts, {R(_line('open', 'pos'))} AS open, {R(_line('close', 'pos'))} AS close FROM gappy", "gappy")
q("fill_mean", lambda sp, sf: show(clean.fill_mean(gappy(sp, sf), ["close"]).select("symbol", "ts", "close")),
  f"SELECT symbol, ts, {R('coalesce(close, avg(close) OVER (PARTITION BY symbol))')} AS close FROM gappy", "gappy")


def _mixed(sp, sf):
    g = gappy(sp, sf)
    kind = F.when(F.col("close") > F.col("open"), "up").when(F.col("close") < F.col("open"), "down")
    never = F.lit(None).cast("double")
    return g.select("symbol", "ts", "pos", "close", kind.alias("kind"), never.alias("never"))


_MIXED = "(SELECT symbol, ts, pos, close, CASE WHEN close > open THEN 'up' WHEN close < open THEN 'down' END AS kind FROM gappy)"
q("fill_everything", lambda sp, sf: show(clean.fill_everything(_mixed(sp, sf)).drop("pos")),
  f"SELECT symbol, ts, {R(f'coalesce({ffill('close')}, {bfill('close')})')} AS close, coalesce({ffill('kind')}, {bfill('kind')}, 'UNKNOWN') AS kind, 0.0 AS never FROM {_MIXED}", "gappy")
q("fill_remaining", lambda sp, sf: show(prepare.fill_remaining(_mixed(sp, sf)).drop("pos")),
  f"SELECT symbol, ts, {R(_line('close', 'pos'))} AS close, coalesce({ffill('kind')}, {bfill('kind')}, 'UNKNOWN') AS kind, 0.0 AS never FROM {_MIXED}", "gappy")
q("modes", lambda sp, sf: clean.modes(_mixed(sp, sf), ["kind"]).withColumnRenamed("_mode_kind", "kind"),
  f"SELECT symbol, kind FROM (SELECT symbol, kind, row_number() OVER (PARTITION BY symbol ORDER BY count(*) DESC, kind) AS rn FROM {_MIXED} WHERE kind IS NOT NULL GROUP BY symbol, kind) WHERE rn = 1", "gappy")
q("null_profile", lambda sp, sf: show(clean.null_profile(_mixed(sp, sf), cols=["close", "kind"])),
  " UNION ALL ".join(f"SELECT symbol, '{c}' AS \"column\", min(pos) FILTER ({c} IS NOT NULL) AS first_valid, count(*) FILTER ({c} IS NULL) AS null_count, count(*) AS n_rows, {R(f'count(*) FILTER ({c} IS NULL) / count(*) * 100')} AS null_pct FROM {_MIXED} GROUP BY symbol" for c in ("close", "kind")), "gappy")

# ---------------------------------------------------------------- outliers and quantiles
_QS = ", ".join(f"{R(f'quantile_cont(v, {p})')} AS {n}" for n, p in (("q01", 0.01), ("q25", 0.25), ("q50", 0.5), ("q99", 0.99)))
q("exact_quantiles_ticks", lambda sp, sf: show(quantiles(event_ticks(sp, sf), ["price"], (0.01, 0.25, 0.5, 0.99), EVENT_TICKS).select(
    "symbol", *[F.col("q")[i].alias(n) for i, n in enumerate(("q01", "q25", "q50", "q99"))])), f"SELECT symbol, {_QS} FROM (SELECT event_type AS symbol, value AS v FROM events) GROUP BY symbol")
_ST = ("SELECT symbol, '{c}' AS \"column\", avg({c}) AS mean, stddev_samp({c}) AS std, median({c}) AS median, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, "
       "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr, quantile_cont({c}, 0.01) AS p1, quantile_cont({c}, 0.99) AS p99 FROM bars GROUP BY symbol")
cte("st", ("bars",), " UNION ALL ".join(_ST.format(c=c) for c in ("close", "volume")))
q("outlier_stats", lambda sp, sf: show(clean.outlier_stats(bars(sp, sf), ["close", "volume"])),
  "SELECT symbol, \"column\", " + ", ".join(f"{R(c)} AS {c}" for c in ("mean", "std", "median", "q1", "q3", "iqr")) + " FROM st", "st")


def _clamp(lo: str, hi: str) -> str:
    return (f"SELECT b.symbol, b.ts, {R(f'least(greatest(b.close, {lo.format(t='c')}), {hi.format(t='c')})')} AS close, "
            f"{R(f'least(greatest(b.volume, {lo.format(t='v')}), {hi.format(t='v')})')} AS volume FROM bars b JOIN st c ON c.symbol = b.symbol AND c.\"column\" = 'close' JOIN st v ON v.symbol = b.symbol AND v.\"column\" = 'volume'")


for _m, _k, _lo, _hi in (("zscore", 2.0, "{t}.mean - 2.0 * {t}.std", "{t}.mean + 2.0 * {t}.std"), ("iqr", 1.5, "({t}.q1 - 1.5 * {t}.iqr)", "({t}.q3 + 1.5 * {t}.iqr)"),
                         ("winsorize", 3.0, "{t}.p1", "{t}.p99")):
    q(f"clamp_{_m}", lambda sp, sf, m=_m, k=_k: show(clean.clamp_outliers(bars(sp, sf), m, k, ["close", "volume"]).select("symbol", "ts", "close", "volume")), _clamp(_lo, _hi), "st")
q("outlier_counts", lambda sp, sf: show(clean.outlier_counts(bars(sp, sf), "zscore", 2.0, ["close", "volume"])),
  " UNION ALL ".join(f"SELECT b.symbol, '{c}' AS \"column\", count(*) FILTER (b.{c} < mean - 2.0 * std) AS n_low, count(*) FILTER (b.{c} > mean + 2.0 * std) AS n_high FROM bars b JOIN st ON st.symbol = b.symbol AND st.\"column\" = '{c}' GROUP BY b.symbol" for c in ("close", "volume")), "st")
q("clean_bars", lambda sp, sf: show(clean.clean_bars(gappy(sp, sf)).drop("pos")),
  "WITH wz AS (SELECT b.symbol, b.ts, b.volume, " + ", ".join(f"least(greatest({c}, lo_{c}), hi_{c}) AS {c}" for c in PX) + " FROM bars b JOIN (SELECT symbol, "
  + ", ".join(f"quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}" for c in PX) + f" FROM bars GROUP BY symbol) z USING (symbol)) SELECT symbol, ts, volume, {R('open')} AS open, "
  f"{R('greatest(high, open, close)')} AS high, {R('least(low, open, close)')} AS low, {R('close')} AS close FROM wz", "bars")
S["clean_bars"] = sql("bars", select="").rstrip() + ", " + S["clean_bars"].split("WITH wz", 1)[1].join(["wz", ""])

# ---------------------------------------------------------------- features
SPANS = (5, 9, 10, 12, 20, 26, 50, 200)
cte("ema", ("bars",), "ema(symbol, pos, " + ", ".join(f"e{n}" for n in SPANS) + ", sig) AS (SELECT symbol, pos, " + ", ".join("close" for _ in SPANS) + ", 0.0::DOUBLE FROM bars WHERE pos = 0 UNION ALL SELECT symbol, pos, "
    + ", ".join(f"n{n}" for n in SPANS) + ", 0.2 * (n12 - n26) + 0.8 * sig FROM (SELECT b.symbol, b.pos, ema.sig, "
    + ", ".join(f"{2 / (n + 1)!r} * b.close + {1 - 2 / (n + 1)!r} * ema.e{n} AS n{n}" for n in SPANS) + " FROM ema JOIN bars b ON b.symbol = ema.symbol AND b.pos = ema.pos + 1))")
q("feature_ema", lambda sp, sf: show(features.add_features(bars(sp, sf), groups=["technical"]).select("symbol", "ts", *[f"ema_{n}" for n in features.AVERAGE_WINDOWS])),
  "SELECT symbol, ts, " + ", ".join(f"{R(f'e{n}')} AS ema_{n}" for n in features.AVERAGE_WINDOWS) + " FROM ema JOIN bars USING (symbol, pos)", "ema")
q("feature_macd", lambda sp, sf: show(features.add_features(bars(sp, sf), groups=["technical"]).select("symbol", "ts", "macd", "macd_signal", "macd_hist")),
  f"SELECT symbol, ts, {R('e12 - e26')} AS macd, {R('sig')} AS macd_signal, {R('e12 - e26 - sig')} AS macd_hist FROM ema JOIN bars USING (symbol, pos)", "ema")
q("feature_sma", lambda sp, sf: show(features.moving_averages(bars(sp, sf)).select("symbol", "ts", *[f"sma_{n}" for n in features.AVERAGE_WINDOWS])),
  "SELECT symbol, ts, " + ", ".join(f"{R(roll('avg', 'close', n))} AS sma_{n}" for n in features.AVERAGE_WINDOWS) + " FROM bars", "bars")
cte("tech", ("bars",), f"""SELECT *, CASE WHEN pd > 0 THEN pd ELSE 0 END AS gain, CASE WHEN pd < 0 THEN -pd ELSE 0 END AS loss FROM (SELECT *, close - lag(close) OVER ({W}) AS pd FROM bars)""")
cte("tech2", ("tech",), f"""SELECT *, {roll('avg', 'gain', 14)} AS up, {roll('avg', 'loss', 14)} AS down, {roll('max', 'high', 14)} AS h14, {roll('min', 'low', 14)} AS l14,
  {roll('avg', 'close', 20)} AS m20, {roll('stddev_samp', 'close', 20)} AS s20 FROM tech""")
cte("tech3", ("tech2",), "SELECT *, 100 * (close - l14) / nullif(h14 - l14, 0) AS stoch_k FROM tech2")
_ROC = ", ".join(f"{R(f'(close / nullif(lag(close, {n}) OVER ({W}), 0) - 1) * 100')} AS roc_{n}" for n in features.RATE_WINDOWS)
_TECH = [*[f"roc_{n}" for n in features.RATE_WINDOWS], "rsi_14", "bollinger_upper", "bollinger_lower", "bollinger_middle", "stoch_k", "stoch_d"]
q("feature_technical", lambda sp, sf: show(features.add_features(bars(sp, sf), groups=["technical"]).select("symbol", "ts", *_TECH), 5),
  f"""SELECT symbol, ts, {_ROC.replace(', 6)', ', 5)')}, {R("CASE WHEN down = 0 THEN CASE WHEN up > 0 THEN 100.0 END ELSE 100 - 100 / (1 + up / down) END", 5)} AS rsi_14,
  {R('m20 + 2 * s20', 5)} AS bollinger_upper, {R('m20 - 2 * s20', 5)} AS bollinger_lower, {R('m20', 5)} AS bollinger_middle, {R('stoch_k', 5)} AS stoch_k, {R(roll('avg', 'stoch_k', 3), 5)} AS stoch_d FROM tech3""", "tech3")
cte("vol", ("bars",), f"""SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, close / nullif(pc, 0) - 1 AS ret FROM (SELECT *, lag(close) OVER ({W}) AS pc, lag(open) OVER ({W}) AS po FROM bars)""")
_LN = "CASE WHEN {a} > 0 AND {b} > 0 THEN ln({a} / {b}) END"
q("feature_volatility", lambda sp, sf: show(features.add_features(bars(sp, sf), groups=["volatility"]).drop("pos", *PX, "volume"), 5),
  "SELECT symbol, ts, " + ", ".join(f"{R(f'{roll('stddev_samp', 'ret', n)} * sqrt(252)', 5)} AS volatility_{n}".replace("END * sqrt", "END) * sqrt").replace("(round(CASE", "(round((CASE") for n in features.VOLATILITY_WINDOWS)
  + f""", {R(roll('avg', 'tr', 14), 5)} AS atr_14, {R(f'({roll('avg', 'tr', 14)}) / nullif(close, 0)', 5)} AS normalized_atr,
  {R(f"0.5 * pow({_LN.format(a='high', b='low')}, 2) - (2 * ln(2) - 1) * pow({_LN.format(a='close', b='open')}, 2)", 5)} AS gk_volatility FROM vol""", "vol")
_LV = ", ".join(f"""{R(roll('max', 'high', n), 5)} AS resistance_{n}, {R(roll('min', 'low', n), 5)} AS support_{n}, {R(f'(({roll('max', 'high', n)}) - close) / nullif(close, 0)', 5)} AS dist_to_resistance_{n},
  {R(f'(close - ({roll('min', 'low', n)})) / nullif(close, 0)', 5)} AS dist_to_support_{n}""" for n in (10, 20))
q("feature_patterns", lambda sp, sf: show(features.add_features(bars(sp, sf), groups=["patterns"]).drop("pos", *PX, "volume"), 5),
  f"""SELECT symbol, ts, coalesce(abs(close - open) / nullif(close, 0) < 0.0005, false) AS doji, (greatest(open, close) - low >= 2 * abs(close - open)) AND abs(close - open) > 0 AS hammer,
  coalesce(open < close AND po > pc AND open <= pc AND close >= po AND abs(close - open) > abs(po - pc), false) AS bullish_engulfing,
  coalesce(open > close AND po < pc AND open >= pc AND close <= po AND abs(close - open) > abs(po - pc), false) AS bearish_engulfing,
  {R(f'ret - lag(ret) OVER ({W})', 5)} AS price_accel, {_LV} FROM vol""", "vol")
q("feature_time", lambda sp, sf: show(features.time_features(bars(sp, sf)).drop("pos", *PX, "volume")),
  """SELECT symbol, ts, isodow(ts) - 1 AS day_of_week, hour(ts) AS hour_of_day, month(ts) AS month, quarter(ts) AS quarter, hour(ts) < 8 AS asian_session,
  hour(ts) BETWEEN 8 AND 15 AS european_session, hour(ts) BETWEEN 13 AND 20 AS us_session, hour(ts) BETWEEN 8 AND 15 AS market_overlap, """
  + ", ".join(f"isodow(ts) = {d + 1} AS day_{d}" for d in range(5)) + " FROM bars", "bars")
q("ewm_adjusted", lambda sp, sf: show(ewm(bars(sp, sf), BARS, {"e20": Ewm("close", 20, adjust=True)}).select("symbol", "ts", "e20")),
  f"SELECT symbol, ts, {R('num / den')} AS e20 FROM adj JOIN bars USING (symbol, pos)")
cte("adj", ("bars",), f"adj(symbol, pos, num, den) AS (SELECT symbol, pos, close, 1.0::DOUBLE FROM bars WHERE pos = 0 UNION ALL SELECT b.symbol, b.pos, b.close + {1 - 2 / 21!r} * num, 1 + {1 - 2 / 21!r} * den FROM adj JOIN bars b ON b.symbol = adj.symbol AND b.pos = adj.pos + 1)")
S["ewm_adjusted"] = sql("adj", select=f"SELECT symbol, ts, {R('num / den')} AS e20 FROM adj JOIN bars USING (symbol, pos)")

# ---------------------------------------------------------------- transforms and normalisation
q("transform_multi", lambda sp, sf: show(prepare.transform_prices(bars(sp, sf).select("symbol", "ts", "pos", "open", "close"), "multi").drop("pos")),
  "SELECT symbol, ts, " + ", ".join(f"{R(c)} AS {c}, {R(c)} AS {c}_raw, {R(c)} AS {c}_original, {R(f'{c} / nullif(lag({c}) OVER ({W}), 0) - 1')} AS {c}_return, "
  f"{R(f'ln({c} + CASE WHEN min({c}) OVER (PARTITION BY symbol) > 0 THEN 0 ELSE abs(min({c}) OVER (PARTITION BY symbol)) + 1e-8 END)')} AS {c}_log" for c in ("open", "close")) + " FROM bars", "bars")
q("transform_from_first", lambda sp, sf: show(prepare.transform_prices(bars(sp, sf).select("symbol", "ts", "pos", "close"), "pct_change").select("symbol", "ts", "close_pct_change")),
  f"SELECT symbol, ts, {R(f'CASE WHEN first_value(close) OVER ({W}) = 0 THEN 0 ELSE (close / first_value(close) OVER ({W}) - 1) * 100 END')} AS close_pct_change FROM bars", "bars")


def _norm(method):
    def run(sp, sf):
        g = gappy(sp, sf).select("symbol", "ts", "pos", "close", "volume")
        rule = {"close": method, "volume": method}
        return show(normalize.apply_normaliser(g, normalize.fit_normaliser(g, rule), rule).drop("pos"))
    return run


_FILL = "(SELECT symbol, ts, pos, volume, coalesce(close, avg(close) OVER (PARTITION BY symbol)) AS close FROM gappy)"
_P = "OVER (PARTITION BY symbol)"
_NORMS = {
    "zscore": "({c} - avg({c}) {p}) / coalesce(nullif(stddev_samp({c}) {p}, 0), 1)",
    "minmax": "({c} - min({c}) {p}) / coalesce(nullif(max({c}) {p} - min({c}) {p}, 0), 1)",
    "robust": "({c} - median({c}) {p}) / coalesce(nullif(quantile_cont({c}, 0.75) {p} - quantile_cont({c}, 0.25) {p}, 0), 1)",
    "pct_of_avg": "{c} / coalesce(nullif(avg({c}) {p}, 0), 1)",
    "log": "ln({c} + CASE WHEN min({c}) {p} > 0 THEN 0 ELSE abs(min({c}) {p}) + 1e-8 END)",
}
for _m, _e in _NORMS.items():
    q(f"normalise_{_m}", _norm(_m), f"SELECT symbol, ts, {R(_e.format(c='close', p=_P))} AS close, {R(_e.format(c='volume', p=_P))} AS volume FROM {_FILL}", "gappy")


def _default_norm(sp, sf):
    b = bars(sp, sf).withColumns({"close_raw": F.col("close"), "close_original": F.col("close"), "up": F.col("close") > F.col("open"), "spread": F.col("high") - F.col("low")})
    model = normalize.BarNormalizer().fit(b)
    return show(model.transform(b).select("symbol", "ts", "close_return", "close_raw", "close_original", "up", "volume", "spread"))


q("normalise_default", _default_norm, f"""SELECT symbol, ts, {R(f'coalesce(close / nullif(lag(close) OVER ({W}), 0) - 1, 0)')} AS close_return, {R('close')} AS close_raw, {R('close')} AS close_original, close > open AS up,
  {R(_NORMS['log'].format(c='volume', p=_P))} AS volume, {R(_NORMS['zscore'].format(c='(high - low)', p=_P))} AS spread FROM bars""", "bars")


def _inverse(sp, sf):
    b = bars(sp, sf).select("symbol", "ts", "pos", "close", "volume", "high")
    rule = {"close": "zscore", "volume": "minmax", "high": "robust"}
    fit = normalize.fit_normaliser(b, rule)
    return show(normalize.invert_normaliser(normalize.apply_normaliser(b, fit, rule), fit, rule).drop("pos"))


q("normalise_inverse", _inverse, f"SELECT symbol, ts, {R('close')} AS close, volume, {R('high')} AS high FROM bars", "bars")
q("rolling_normalise", lambda sp, sf: show(normalize.rolling_normalise(bars(sp, sf), ["close"], 100).select("symbol", "ts", "close_rz")),
  f"SELECT symbol, ts, {R(f'(close - ({roll('avg', 'close', 100)})) / nullif(({roll('stddev_samp', 'close', 100)}), 0)')} AS close_rz FROM bars", "bars")
q("normaliser_table", lambda sp, sf: show(normalize.fit_normaliser(day_bars(sp, sf), {"volume": "robust"}).drop("first")),
  f"""SELECT symbol, 'volume' AS "column", {R('avg(volume)')} AS mean, {R('stddev_samp(volume)')} AS std, min(volume) AS low, max(volume) - min(volume) AS span, {R('median(volume)')} AS median,
  {R('quantile_cont(volume, 0.75) - quantile_cont(volume, 0.25)')} AS iqr FROM day_bars GROUP BY symbol""", "day_bars")
q("categories", lambda sp, sf: table(sp, sf, "events").select("event_type").distinct().select(
    F.concat("event_type", F.lit("_sma_20")).alias("feature")).union(bars(sp, sf).select(F.concat("symbol", F.lit("_close_return")))).distinct().withColumn(
    "category", N.category_column(F.col("feature"), N.IMPORTANCE_CATEGORIES)),
  "SELECT DISTINCT event_type || '_sma_20' AS feature, 'Moving Averages' AS category FROM events UNION ALL SELECT DISTINCT event_type || '_close_return', 'Transformed Price' FROM events")
assert CTES


# ---------------------------------------------------------------- rows and values that must not get lost
_SPOILT = (10, 300)  # rows with the spike and the NaN


def _spiked_whole(sp, sf):
    """All rows; null only where an average's own window holds the spike or the NaN."""
    x = bars(sp, sf).withColumn("close", F.when(F.col("pos") == 10, 1e18).when(F.col("pos") == 300, float("nan")).otherwise(F.col("close")))
    x = features.moving_averages(x, windows=(20, 50, 200))
    return show(x.select("symbol", "pos", *[F.when(~F.expr(" or ".join(f"pos between {p} and {p + n - 1}" for p in _SPOILT)), F.col(f"sma_{n}")).alias(f"sma_{n}") for n in (20, 50, 200)]))


q("sma_after_spike_whole", _spiked_whole, "SELECT symbol, pos, " + ", ".join(
    f"CASE WHEN pos NOT BETWEEN 10 AND {9 + n} AND pos NOT BETWEEN 300 AND {299 + n} THEN {R(roll('avg', 'close', n))} END AS sma_{n}" for n in (20, 50, 200)) + " FROM bars", "bars")


def _timeless(sp, sf):
    x = table(sp, sf, "events").select(F.when(F.col("event_id") % 7 > 0, F.col("event_type")).alias("symbol"), F.when(F.col("event_id") % 5 > 0, F.col("ts").cast("timestamp")).alias("ts"), "event_id")
    return number_rows(x, EVENT_TICKS, "1 hour").select("symbol", "event_id", "pos")


q("null_time_rows", _timeless, """SELECT symbol, event_id, row_number() OVER (PARTITION BY symbol ORDER BY ts NULLS FIRST, event_id) - 1 AS pos FROM
  (SELECT CASE WHEN event_id % 7 > 0 THEN event_type END AS symbol, CASE WHEN event_id % 5 > 0 THEN ts END AS ts, event_id FROM events)""")
q("quantiles_heavy_tail", lambda sp, sf: show(quantiles(table(sp, sf, "orders").select(F.col("o_orderpriority").alias("symbol"), F.when(F.col("o_orderkey") % 1000 == 7, 1e30).otherwise(F.pow("o_totalprice", F.lit(3))).alias("v")), ["v"], (0.01, 0.5, 0.99))
  .select("symbol", *[F.round(F.col("q")[i] / 1e12, 4).alias(f"q{i}") for i in range(3)])),
  "SELECT o_orderpriority AS symbol, " + ", ".join(f"round(quantile_cont(v, {p}) / 1e12, 4) + 0.0 AS q{i}" for i, p in enumerate((0.01, 0.5, 0.99))) +
  " FROM (SELECT o_orderpriority, CASE WHEN o_orderkey % 1000 = 7 THEN 1e30 ELSE pow(o_totalprice, 3) END AS v FROM orders) GROUP BY 1")
q("synthetic_volume_noisy_bounds", lambda sp, sf: bars(sp, sf).withColumn("volume", C.synthetic_volume_noisy(seed=42)).select("symbol", "ts", ((F.col("volume") >= F.floor((F.col("high") - F.col("low")) * 0.8e6)) & (F.col("volume") <= (F.col("high") - F.col("low")) * 1.2e6)).alias("within")).transform(show),
  "SELECT symbol, ts, TRUE AS within FROM bars", "bars")
