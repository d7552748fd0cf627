"""Streams over the given tables, run to the end of the data and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.operators import signals
from barspark.plans import live as plan
from barspark.operators.series import shared_folder
from barspark.sources import files
from barspark.streaming import live
from checks import bars_queries
from checks.common import CTES, R, W, bars, cte, show, sql, table
from checks.trading_queries import preds, smas

Q: dict = {}
S: dict[str, str] = {}


def q(name: str, fn, select: str | None = None, *ctes: str) -> None:
    Q[name] = fn
    if select:
        S[name] = sql(*ctes, select=select)


def drain(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return its output table."""
    spark = df.sparkSession
    where = f"{shared_folder(spark)}/barspark/stream-{uuid.uuid4().hex}"
    if mode == "append":
        live.append_bars(df, f"{where}/out", f"{where}/state", availableNow=True).awaitTermination()
    else:
        def save(batch: DataFrame, n: int) -> None:
            batch.write.mode("overwrite").parquet(f"{where}/out")
        df.writeStream.outputMode(mode).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{where}/out")


def stream_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def stream_of(df: DataFrame) -> DataFrame:
    """A staged table as a stream."""
    where = f"{shared_folder(df.sparkSession)}/barspark/{uuid.uuid4().hex}"
    df.write.parquet(where)
    return df.sparkSession.readStream.schema(df.schema).parquet(where)


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    return stream_table(spark, sf, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"))


_BARS = """SELECT symbol, make_timestamp(b * {us}) AS ts, {o} AS open, {h} AS high, {l} AS low, {c} AS close, count(*) AS volume FROM (SELECT event_type AS symbol, ts, value AS price, epoch_us(ts) // {us} {k} AS b FROM events {x}) GROUP BY symbol, b
  HAVING (b * {us} + {w}) <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - 300000000 FROM events)"""
_PX = dict(o=R("first(price ORDER BY ts)"), h=R("max(price)"), l=R("min(price)"), c=R("last(price ORDER BY ts)"))
q("stream_bars_tumbling", lambda sp, sf: show(drain(live.stream_bars(ticks(sp, sf), "30 minutes")).drop("bar_end")), _BARS.format(us=1_800_000_000, w=1_800_000_000, k="", x="", **_PX))
q("stream_bars_sliding", lambda sp, sf: show(drain(live.stream_bars(ticks(sp, sf), "1 hour", "30 minutes")).drop("bar_end")),
  _BARS.format(us=1_800_000_000, w=3_600_000_000, k="- s", x=", (VALUES (0), (1)) v(s)", **_PX))


def messages(df: DataFrame) -> DataFrame:
    """Every event as a bid and an ask message (price -/+ 0.05), plus a heartbeat line and a broken one."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))

    def msg(kind: str, d: float):
        p = F.struct(F.col("event_type").alias("epic"), F.lit("MINUTE").alias("resolution"), F.lit("classic").alias("type"), F.lit(kind).alias("priceType"), ms.alias("t"),
                     (F.col("value") + d).alias("o"), (F.col("value") + d + 1).alias("h"), (F.col("value") + d - 1).alias("l"), (F.col("value") + d).alias("c"))
        return F.to_json(F.struct(F.lit("ohlc.event").alias("destination"), p.alias("payload")))

    lines = F.array(msg("bid", -0.05), msg("ask", 0.05), F.lit('{"destination": "ping"}'), F.lit("{broken"))
    return df.select(F.explode(lines).alias("value"))


q("stream_parse", lambda sp, sf: drain(live.parse_messages(messages(stream_table(sp, sf, "events")))).groupBy("epic", "price_type").agg(F.count("*").alias("n"), F.round(F.sum("c"), 3).alias("sum_c")),
  f"SELECT event_type AS epic, k AS price_type, count(*) AS n, round(sum(value + d), 3) AS sum_c FROM events, (VALUES ('bid', -0.05), ('ask', 0.05)) v(k, d) GROUP BY 1, 2")
_PAIR = f"""SELECT a.event_type AS epic, 'MINUTE' AS resolution, make_timestamp(a.ms * 1000) AS ts, {R('(a.value + b.value) / 2')} AS open, {R('(a.value + b.value) / 2 + 1')} AS high, {R('(a.value + b.value) / 2 - 1')} AS low, {R('(a.value + b.value) / 2')} AS close,
 {R('b.value - a.value + 0.1')} AS spread FROM (SELECT *, epoch_us(ts) // 1000 AS ms FROM events) a JOIN (SELECT *, epoch_us(ts) // 1000 AS ms FROM events) b ON a.event_type = b.event_type AND a.ms = b.ms"""
q("stream_pair_quotes", lambda sp, sf: show(drain(live.pair_quotes(live.parse_messages(messages(stream_table(sp, sf, "events"))))).drop("volume")), _PAIR)


def _halves(sp, sf):
    """Bids of all events first, asks of some; then, in a second batch, the asks that were missing, most of them after the watermark."""
    live.use_rocksdb(sp)
    e = table(sp, sf, "events")
    lines, where = messages(e.withColumn("event_type", F.concat("event_type", F.lit("#"), F.col("event_id").cast("string")))), f"{shared_folder(sp)}/barspark/halves-{uuid.uuid4().hex}"
    lines = lines.withColumn("later", F.col("value").contains('"priceType":"ask"') & (F.regexp_extract("value", r"#([0-9]+)", 1).cast("long") % 5 == 0))
    lines = lines.withColumn("value", F.regexp_replace("value", "#[0-9]+", ""))
    for n, part in enumerate((lines.where("not later"), lines.where("later"))):
        part.select("value").coalesce(1).write.mode("append").text(where)
    stream = sp.readStream.option("maxFilesPerTrigger", 1).text(where)
    ev = drain(live.quote_events(live.parse_messages(stream)))
    return ev.groupBy("epic", "status", F.coalesce("price_type", F.lit("both")).alias("side")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.coalesce("b_c", "a_c")), 3).alias("sum_c"))


q("stream_unmatched_quotes", _halves, """WITH e AS (SELECT event_type AS epic, epoch_us(ts) // 1000 AS ms, event_id % 5 = 0 AS later, value FROM events), w AS (SELECT max(ms) - 300000 AS mark FROM e),
  r AS (SELECT epic, 'paired' AS status, 'both' AS side, value - 0.05 AS c FROM e, w WHERE NOT later OR ms > mark
        UNION ALL SELECT epic, 'expired', 'bid', value - 0.05 FROM e, w WHERE later AND ms <= mark UNION ALL SELECT epic, 'late', 'ask', value + 0.05 FROM e, w WHERE later AND ms <= mark)
  SELECT epic, status, side, count(*) AS n, round(sum(c), 3) AS sum_c FROM r GROUP BY ALL""")


def _live_plan(sp, sf):
    """Hourly bars as bid and ask messages through the whole chain; the score is a projection of two features."""
    b = bars(sp, sf)
    quote = lambda kind, d: F.struct(F.col("symbol").alias("epic"), F.lit("HOUR").alias("resolution"), F.lit("classic").alias("type"), F.lit(kind).alias("priceType"), F.unix_millis("ts").alias("t"),
                                     *[(F.col(c) + d).alias(c[0]) for c in ("open", "high", "low", "close")])
    line = lambda kind, d: F.to_json(F.struct(F.lit("ohlc.event").alias("destination"), quote(kind, d).alias("payload")))
    lines = b.select(F.explode(F.array(line("bid", -0.05), line("ask", 0.05))).alias("value"))
    folder = f"{shared_folder(sp)}/barspark/live-{uuid.uuid4().hex}"
    made = plan.run(stream_of(lines), folder, lambda x: x.withColumn("probability_up", F.col("rsi_14") / 100), probability=0.5, lookback=5, threshold=0.6, min_hold=3, max_hold=12, max_positions=9)
    scored = sp.read.parquet(made["scored"])
    sent = sp.read.parquet(made["signals"]).select("symbol", "ts", "signal_type")
    return show(scored.select("symbol", "ts", "rsi_14", "direction").join(sent, ["symbol", "ts"], "left"), 5)



q("stream_latest", lambda sp, sf: show(drain(live.latest(ticks(sp, sf), "symbol"), "complete")),
  f"SELECT event_type AS symbol, max(ts) AS ts, {R('last(value ORDER BY ts)')} AS price FROM events GROUP BY 1")


def _upserted(sp, sf):
    """Ticks in five micro-batches, each changing the last tick of some symbols; a row per symbol and second."""
    where = f"{shared_folder(sp)}/barspark/upserts-{uuid.uuid4().hex}"
    e = table(sp, sf, "events").select(F.concat("event_type", F.lit("/"), (F.col("user_id") % 50).cast("string")).alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), (F.col("event_id") % 5).alias("part"))
    for n in range(5):
        e.where(F.col("part") == n).drop("part").coalesce(1).write.mode("append").parquet(f"{where}/in")
    x = live.latest(sp.readStream.schema(e.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in"), "symbol")
    live.upsert(x, f"{where}/out", f"{where}/state", availableNow=True).awaitTermination()
    return show(live.read_upserts(sp, f"{where}/out", x.schema, ["symbol"]))


q("stream_latest_upserts", _upserted, f"SELECT event_type || '/' || (user_id % 50) AS symbol, max(ts) AS ts, {R('last(value ORDER BY ts, value)')} AS price FROM events GROUP BY 1")


def _states(sp, sf):
    e = stream_table(sp, sf, "events")
    return e.select(F.col("event_type").alias("account"), F.col("ts").cast("timestamp").alias("ts"), (1000 + F.col("value")).alias("equity"), F.col("value").alias("cash"),
                    F.get_json_object("props", "$.k").cast("long").alias("open_positions"), F.lit(0).cast("long").alias("pending_orders"))


q("stream_summary", lambda sp, sf: show(drain(live.periodic_summary(_states(sp, sf)))),
  f"""SELECT event_type AS account, make_timestamp((b + 1) * 60000000) AS ts, {R('1000 + last(value ORDER BY ts)')} AS equity, {R('last(value ORDER BY ts)')} AS cash, last((props->>'$.k')::BIGINT ORDER BY ts) AS open_positions, 0::BIGINT AS pending_orders
  FROM (SELECT *, epoch_us(ts) // 60000000 AS b FROM events) GROUP BY event_type, b HAVING (b + 1) * 60000000 <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - 60000000 FROM events)""")


_SMA_WINDOWS, _EMA_SPANS = (5, 10, 20, 50, 200), (5, 10, 12, 20, 26, 50, 200)
_SOME = ["symbol", "ts", "close", "n_seen", *[f"sma_{n}" for n in _SMA_WINDOWS], *[f"ema_{n}" for n in _EMA_SPANS], "macd", "rsi_14", "volatility_20", "atr_14"]


def _live(sp, sf, warm: bool) -> DataFrame:
    """Features of the bars as a stream; ``warm`` seeds it with the bars before a day."""
    live.use_rocksdb(sp)
    b = bars(sp, sf)
    cut = F.lit("2024-01-16").cast("timestamp")
    return drain(live.live_features(stream_of(b.where(F.col("ts") >= cut)), b.where(F.col("ts") < cut)) if warm else live.live_features(stream_of(b)))


def _features(sp, sf, warm=False):
    return show(_live(sp, sf, warm).select(*_SOME), 5)


_EMA = ", ".join(f"{R(f'e{n}', 5)} AS ema_{n}" for n in _EMA_SPANS)
_LIVE = (f"SELECT symbol, b.ts, {R('b.close', 5)} AS close, pos + 1 AS n_seen, " + ", ".join(f"{R(f's{n}', 5)} AS sma_{n}" for n in _SMA_WINDOWS)
         + f", {_EMA}, {R('e12 - e26', 5)} AS macd, {R('CASE WHEN down = 0 THEN CASE WHEN up > 0 THEN 100.0 END ELSE 100 - 100 / (1 + up / down) END', 5)} AS rsi_14, {R('v20', 5)} AS volatility_20, {R('atr', 5)} AS atr_14 FROM lv b JOIN ema USING (symbol, pos)")
cte("lv", ("tech2", "volx"), f"SELECT t.symbol, t.ts, t.pos, t.close, t.up, t.down, x.v20, x.atr, " + ", ".join(
    f"CASE WHEN t.pos >= {n - 1} THEN avg(t.close) OVER (PARTITION BY t.symbol ORDER BY t.pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END AS s{n}" for n in _SMA_WINDOWS) + " FROM tech2 t JOIN volx x USING (symbol, pos)")
q("stream_features", _features, _LIVE + " WHERE pos >= 4", "lv", "ema")
q("stream_features_warm", lambda sp, sf: _features(sp, sf, True), _LIVE + " WHERE b.ts >= TIMESTAMP '2024-01-16'", "lv", "ema")

# every feature column: the batch features' own SQL, side by side
_GROUPS = ("feature_sma", "feature_ema", "feature_macd", "feature_technical", "feature_volatility", "feature_patterns", "feature_time")
_DIGITS = {"normalized_atr": 3} | {c: 6 for c in (*[f"{k}_{n}" for k in ("sma", "ema") for n in _SMA_WINDOWS], "macd", "macd_signal", "macd_hist")}


def _all_features(sp, sf, warm: bool) -> DataFrame:
    made = _live(sp, sf, warm)
    return show(made.drop("open", "high", "low", "close", "n_seen", "late_bars", *[f"ema_{n}" for n in _EMA_SPANS if n not in _SMA_WINDOWS]), 5, **_DIGITS)


def _side_by_side(where: str) -> str:
    joined = " JOIN ".join(f"({bars_queries.S[n]}) {n}" + (" USING (symbol, ts)" if i else "") for i, n in enumerate(_GROUPS))
    return f"SELECT * REPLACE ({R('normalized_atr', 3)} AS normalized_atr) FROM {joined} {where}"  # up to 100 here: five digits fall on a rounding edge


q("stream_features_all", lambda sp, sf: _all_features(sp, sf, False), _side_by_side("WHERE (symbol, ts) IN (SELECT (symbol, ts) FROM (SELECT event_type AS symbol, time_bucket(INTERVAL 1 HOUR, min(ts)) AS t0 FROM events GROUP BY 1) f JOIN "
  "(SELECT unnest(generate_series(4, 10000)) AS k) n ON true, LATERAL (SELECT t0 + k * INTERVAL 1 HOUR AS ts) z)"))
q("stream_features_all_warm", lambda sp, sf: _all_features(sp, sf, True), _side_by_side("WHERE ts >= TIMESTAMP '2024-01-16'"))


def _live_signals(sp, sf):
    live.use_rocksdb(sp)
    p = preds(sp, sf).select(F.concat(F.lit("book of "), "symbol").alias("account"), "symbol", "ts", signals.direction("p_up", 0.5).alias("direction"))
    return show(drain(live.live_signals(stream_of(p), 5, 0.6, 3, 12, 5)).drop("account", "open_positions"))


_RSI = "CASE WHEN down = 0 THEN CASE WHEN up > 0 THEN 100.0 END ELSE 100 - 100 / (1 + up / down) END"
cte("ldirs", ("tech2",), f"SELECT symbol, ts, pos - 4 AS pos, {_RSI} AS rsi, CASE WHEN {_RSI} > 50 THEN 1 ELSE -1 END AS direction FROM tech2 WHERE pos >= 4")
cte("lcons", ("ldirs",), CTES["cons"][1].split("MATERIALIZED (", 1)[1][:-1].replace("FROM dirs", "FROM ldirs"))
cte("lwalk", ("lcons",), CTES["walk"][1].replace("walk", "lwalk").replace("cons", "lcons"))
q("live_plan", _live_plan, f"""SELECT symbol, ts, {R('rsi', 5)} AS rsi_14, direction::BIGINT AS direction, CASE WHEN was = 0 AND side = 1 THEN 'BUY' WHEN was = 0 AND side = -1 THEN 'SELL' WHEN was = 1 AND side = 0 THEN 'EXIT_LONG'
  WHEN was = -1 AND side = 0 THEN 'EXIT_SHORT' END AS signal_type FROM lwalk JOIN lcons USING (symbol, pos)""", "lwalk")
# one account per symbol and five places: the limit never binds, so every symbol follows the batch rule
q("stream_signals", _live_signals, """SELECT symbol, ts, CASE WHEN was = 0 AND side = 1 THEN 'BUY' WHEN was = 0 AND side = -1 THEN 'SELL' WHEN was = 1 THEN 'EXIT_LONG' ELSE 'EXIT_SHORT' END AS signal_type,
  CASE WHEN was = 0 THEN 0 ELSE 1 + lag(held) OVER (PARTITION BY symbol ORDER BY pos) END AS bars_held FROM walk JOIN cons USING (symbol, pos) QUALIFY was <> side""", "walk")


def _live_limited(sp, sf):
    """Two accounts with one place each, for several symbols."""
    live.use_rocksdb(sp)
    account = F.when(F.col("symbol") < "l", "early").otherwise("late")
    p = preds(sp, sf).select(account.alias("account"), "symbol", "ts", signals.direction("p_up", 0.5).alias("direction"))
    return show(drain(live.live_signals(stream_of(p), 5, 0.6, 3, 12, 1)))


# row by row over an account's bars in time order; the open positions are a list of (symbol, side, entry row)
cte("rowsof", ("cons",), """SELECT CASE WHEN symbol < 'l' THEN 'early' ELSE 'late' END AS account, symbol, ts, pos, buy_ok, sell_ok, row_number() OVER (PARTITION BY symbol < 'l' ORDER BY ts, symbol) AS k FROM cons""")
_MINE = "list_filter(w.held, lambda h: h.symbol = r.symbol)[1]"
_OUT = f"({_MINE} IS NOT NULL AND (r.pos - {_MINE}.entry >= 12 OR (r.pos - {_MINE}.entry >= 3 AND CASE WHEN {_MINE}.side > 0 THEN r.sell_ok ELSE r.buy_ok END)))"
_IN = f"({_MINE} IS NULL AND (r.buy_ok OR r.sell_ok) AND len(w.held) < 1)"
_ONE = "{'symbol': r.symbol, 'side': CASE WHEN r.buy_ok THEN 1 ELSE -1 END, 'entry': r.pos}"
cte("limited", ("rowsof",), f"""limited(account, k, symbol, ts, signal_type, bars_held, held) AS (
  SELECT DISTINCT account, 0::BIGINT, NULL::VARCHAR, NULL::TIMESTAMP, NULL::VARCHAR, 0::BIGINT, CAST([] AS STRUCT(symbol VARCHAR, side INTEGER, entry BIGINT)[]) FROM rowsof
  UNION ALL SELECT r.account, r.k, r.symbol, r.ts, CASE WHEN {_OUT} THEN CASE WHEN {_MINE}.side > 0 THEN 'EXIT_LONG' ELSE 'EXIT_SHORT' END WHEN {_IN} THEN CASE WHEN r.buy_ok THEN 'BUY' ELSE 'SELL' END END,
    CASE WHEN {_OUT} THEN r.pos - {_MINE}.entry ELSE 0 END, CASE WHEN {_OUT} THEN list_filter(w.held, lambda h: h.symbol <> r.symbol) WHEN {_IN} THEN list_append(w.held, {_ONE}) ELSE w.held END
  FROM limited w JOIN rowsof r ON r.account = w.account AND r.k = w.k + 1)""")
q("stream_signals_limited", _live_limited, "SELECT account, symbol, ts, signal_type, bars_held, len(held) AS open_positions FROM limited WHERE signal_type IS NOT NULL", "limited")
_Z = "({c} - avg({c}) OVER (PARTITION BY symbol)) / stddev_samp({c}) OVER (PARTITION BY symbol)"
q("live_batch_preparation", lambda sp, sf: show(live.simplify_batch(smas(sp, sf).select("symbol", "ts", "pos", "close", "sma_5", "sma_20")).drop("pos")),
  f"""SELECT symbol, ts, {R('close')} AS close, {R('close_return')} AS close_return, {R(_Z.format(c='sma_5'))} AS sma_5, {R(_Z.format(c='sma_20'))} AS sma_20 FROM (SELECT symbol, ts, close, """
  + ", ".join(f"coalesce(first_value({c} IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value({c} IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS {c}" for c in ("close_return", "sma_5", "sma_20"))
  + f" FROM (SELECT *, close / nullif(lag(close) OVER ({W}), 0) - 1 AS close_return FROM sma))", "sma")


# ---------------------------------------------------------------- files


def _folder(sp) -> str:
    return f"{shared_folder(sp)}/barspark/files-{uuid.uuid4().hex}"


def _csv_round_trip(sp, sf):
    """Bars written as CSV per symbol and read back tolerantly."""
    where = _folder(sp)
    b = bars(sp, sf).select(F.col("symbol"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Date"), F.col("open").alias("Open"), F.col("high").alias("High"),
                            F.col("low").alias("Low"), F.col("close").alias("Close"), F.col("volume").alias("Volume"))
    files.write_bars(b, where, "csv")
    return show(files.read_bars_csv(sp, where).select("symbol", "ts", "open", "high", "low", "close", "volume"))


_RP = ", ".join(f"{R(c)} AS {c}" for c in ("open", "high", "low", "close"))
q("read_bars_csv", _csv_round_trip, f"SELECT symbol, ts, {_RP}, volume FROM bars", "bars")


def _vendor(sp, sf):
    """Price documents per symbol, written and read as JSON."""
    where = _folder(sp)
    quote = lambda c: F.struct((F.col(c) - 0.01234).alias("bid"), (F.col(c) + 0.01236).alias("ask"))
    row = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("snapshotTimeUTC"), *[quote(c).alias(f"{c}Price") for c in ("open", "high", "low", "close")], F.col("volume").alias("lastTradedVolume"))
    docs = bars(sp, sf).groupBy(F.col("symbol").alias("instrument"), F.to_date("ts").alias("day")).agg(F.collect_list(row).alias("prices")).withColumn("resolution", F.lit("HOUR")).drop("day")
    docs.write.json(where)
    return show(files.read_vendor_json(sp, where, multi_line=False))


q("read_vendor_json", _vendor, "SELECT symbol, 'HOUR' AS timeframe, ts, " + ", ".join(f"{R(f'({c} - 0.01234 + {c} + 0.01236) / 2', 5)} AS {c}" for c in ("open", "high", "low", "close")) + ", volume FROM bars", "bars")


def _store(sp, sf):
    where = _folder(sp)
    files.save_features(smas(sp, sf), where, "averages", "h1")
    return show(files.load_features(sp, where, "averages", "h1", ["view", "click"]).select("symbol", "timeframe", "feature_set", "ts", "sma_20"))


q("feature_store", _store, f"SELECT symbol, 'h1' AS timeframe, 'averages' AS feature_set, ts, {R('sma_20')} AS sma_20 FROM sma WHERE symbol IN ('view', 'click')", "sma")


def _records(sp, sf):
    where = _folder(sp)
    b = bars(sp, sf).select("symbol", "ts", "close")
    files.append_records(b, where, "trade")
    files.append_records(b.select("symbol"), where, "order")
    return show(files.read_records(sp, where, "trade", b.schema).drop("logged_at"))


q("record_log", _records, f"SELECT symbol, ts, {R('close')} AS close FROM bars", "bars")


def _mixed_folder(sp, sf) -> str:
    """Bars of each symbol in a file of its own: columns in another order for some, and names of three kinds."""
    where = _folder(sp)
    b = bars(sp, sf).select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Date"), *[F.col(c).alias(c.title()) for c in ("open", "high", "low", "close", "volume")])
    plain, turned = ["Date", "Open", "High", "Low", "Close", "Volume"], ["Volume", "Low", "Date", "Close", "High", "Open"]
    names = sorted(r[0] for r in b.select("symbol").distinct().collect())  # event types: a handful
    for i, n in enumerate(names):
        b.where(F.col("symbol") == n).select(*(turned if i % 2 else plain)).coalesce(1).write.option("header", True).csv(f"{where}/{n.upper()}_5m.csv")
    return where


q("read_mixed_headers", lambda sp, sf: show(files.read_bars_csv(sp, f"{_mixed_folder(sp, sf)}/*.csv").select("ts", "open", "high", "low", "close", "volume")),
  f"SELECT ts, {_RP}, volume FROM bars", "bars")


def _named(sp, sf):
    """Files whose names do not follow the naming rule, one per symbol; all but one are asked for."""
    where = _folder(sp)
    b = bars(sp, sf).select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Date"), *[F.col(c).alias(c.title()) for c in ("open", "high", "low", "close", "volume")])
    names = sorted(r[0] for r in b.select("symbol").distinct().collect())  # event types: a handful
    for i, n in enumerate(names):
        part = b.where(F.col("symbol") == n).drop("symbol").coalesce(1)
        part.write.option("header", True).csv(f"{where}/tmp{i}")
        for f in sp.read.format("binaryFile").load(f"{where}/tmp{i}/*.csv").select("path").collect():
            jvm = sp.sparkContext._jvm
            old, new = jvm.org.apache.hadoop.fs.Path(f["path"]), jvm.org.apache.hadoop.fs.Path(f"{where}/{n}_5m.csv")
            old.getFileSystem(sp.sparkContext._jsc.hadoopConfiguration()).rename(old, new)
    return show(files.read_symbols(sp, where, names[:-1]).select("symbol", "ts", "open", "high", "low", "close", "volume"))


q("read_symbols", _named, f"SELECT symbol, ts, {_RP}, volume FROM bars WHERE symbol < (SELECT max(symbol) FROM bars)", "bars")
