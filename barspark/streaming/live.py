"""Live bars: message parsing, bid/ask pairing, streaming bars, stateful features and signals."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from barspark.operators import features
from barspark.operators.series import BARS, Ewm, Series, ewm, frames, join_by, numbered, stage
from barspark.operators.clean import column_means, fill_forward_backward, split_numeric
from barspark.functions.columns import change, ratio
from barspark.sources.schema import MESSAGE
from barspark.streaming import sliding

# ---- fixed values
EVENT_DESTINATION = "ohlc.event"
PAIRING_DELAY = "300 seconds"
MIN_ROWS = 5
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# ---- end of fixed values
OUTPUT_ROWS = 4096  # rows handed on at a time


# ---------------------------------------------------------------- messages to bars


def parse_messages(raw: DataFrame, c: str = "value") -> DataFrame:
    """Price messages of a text column; other destinations and malformed lines are left out."""
    m = raw.select(F.from_json(F.col(c).cast("string"), MESSAGE).alias("m")).select("m.destination", "m.payload.*")
    m = m.where((F.col("destination") == EVENT_DESTINATION) & F.col("priceType").isNotNull() & F.col("t").isNotNull())
    return m.select("epic", "resolution", F.lower("priceType").alias("price_type"), F.timestamp_millis("t").alias("ts"), "o", "h", "l", "c")


QUOTE_EVENTS = ("epic string, resolution string, ts timestamp, status string, price_type string, "
                "b_o double, b_h double, b_l double, b_c double, a_o double, a_h double, a_l double, a_c double")

_QUOTE_COLUMNS = [part.split()[0] for part in QUOTE_EVENTS.split(", ")]


class QuotePairs(StatefulProcessor):
    """Waiting halves of bid/ask pairs of one instrument, with an event-time timer at the earliest of them.

    A half leaves the state when its other side comes, or when the watermark has passed it (``expired``). One that comes after the watermark has
    passed its time is ``late`` and never waits. Of several waiting messages for the same side and time the last one counts.
    The state is read and written once per micro-batch; it holds what came within the watermark's delay and has no other side yet.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, side string, o double, h double, l double, c double")

    def _read(self) -> dict[int, tuple]:
        return {r[0]: (r[1], *r[2:]) for r in self.waiting.get()}

    def _write(self, waiting: dict[int, tuple]) -> None:
        if waiting:
            self.waiting.put([(us, *half) for us, half in waiting.items()])
            self.handle.registerTimer(min(waiting) // 1000)
        else:
            self.waiting.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        passed, waiting = timerValues.getCurrentWatermarkInMs(), self._read()
        for pdf in rows:
            out = []
            for us, side, *prices in zip(pdf["us"].tolist(), pdf["price_type"].tolist(), *[pdf[c].tolist() for c in "ohlc"]):
                if us // 1000 <= passed:
                    out.append(self._row(key, us, "late", side, prices))
                    continue
                other = waiting.get(us)
                if other is None or other[0] == side:
                    waiting[us] = (side, *prices)
                else:
                    del waiting[us]
                    bid, ask = (prices, other[1:]) if side == "bid" else (other[1:], prices)
                    out.append((*key, us, "paired", None, *bid, *ask))
            yield self._frame(out)
        self._write(waiting)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed, waiting = timerValues.getCurrentWatermarkInMs(), self._read()
        gone = sorted(us for us in waiting if us // 1000 <= passed)
        out = [self._row(key, us, "expired", waiting[us][0], waiting.pop(us)[1:]) for us in gone]
        self._write(waiting)
        yield self._frame(out)

    @staticmethod
    def _row(key: Any, us: int, status: str, side: str, prices) -> tuple:
        none = [None] * 4
        return (*key, us, status, side, *(prices if side == "bid" else none), *(prices if side == "ask" else none))

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        pdf = pd.DataFrame(out, columns=_QUOTE_COLUMNS)
        pdf["ts"] = pd.to_datetime(pdf["ts"].astype("int64"), unit="us")
        return pdf

    def close(self) -> None:
        pass


def quote_events(messages: DataFrame, delay: str = PAIRING_DELAY) -> DataFrame:
    """What becomes of every quote of a message stream, ``status`` paired, expired or late; the source is read once.

    Both sides meet in one keyed state per instrument. The watermark follows the newest message by ``delay``: a half whose time it passes
    has waited that long without its other side. Late messages are kept and told apart, so the watermark's own column doesn't go into the state operator.
    """
    use_rocksdb(messages.sparkSession)
    x = messages.where(F.col("price_type").isin("bid", "ask")).withWatermark("ts", delay)
    x = x.select("epic", "resolution", F.unix_micros("ts").alias("us"), "price_type", *"ohlc")
    return x.groupBy("epic", "resolution").transformWithStateInPandas(statefulProcessor=QuotePairs(), outputStructType=QUOTE_EVENTS, outputMode="append", timeMode="eventTime")


def pair_quotes(messages: DataFrame, delay: str = PAIRING_DELAY) -> DataFrame:
    """Bid and ask of the same bar to a midpoint bar; on a stream unmatched sides leave the state after ``delay`` (see ``quote_events``)."""
    if messages.isStreaming:
        j = quote_events(messages, delay).where("status = 'paired'")
    else:
        def side(kind: str, p: str) -> DataFrame:
            return messages.where(F.col("price_type") == kind).select("epic", "resolution", "ts", *[F.col(c).alias(f"{p}_{c}") for c in "ohlc"])

        j = side("bid", "b").join(side("ask", "a"), ["epic", "resolution", "ts"])
    mids = {n: (F.col(f"b_{c}") + F.col(f"a_{c}")) / 2 for n, c in (("open", "o"), ("high", "h"), ("low", "l"), ("close", "c"))}
    j = j.withColumns(mids)
    return j.select("epic", "resolution", "ts", *mids, (F.col("a_c") - F.col("b_c")).alias("spread"),
                    ((F.col("high") - F.col("low")) * 1e7).cast("long").alias("volume"))


def stream_bars(ticks: DataFrame, width: str, slide: str | None = None, delay: str = "5 minutes", key: str = "symbol", price: str = "price", ts: str = "ts") -> DataFrame:
    """Tumbling or sliding OHLCV bars of a stream; a bar is final once the watermark has passed it.

    Of ticks at the same time the lowest opens and the highest closes a bar.
    """
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    x = ticks.withWatermark(ts, delay) if ticks.isStreaming else ticks
    return x.groupBy(key, w.alias("w")).agg(
        F.min_by(price, F.struct(ts, price)).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, F.struct(ts, price)).alias("close"),
        F.count(price).alias("volume")).select(key, F.col("w.start").alias("ts"), F.col("w.end").alias("bar_end"), "open", "high", "low", "close", "volume")


def latest(bars: DataFrame, key: str = "epic", ts: str = "ts") -> DataFrame:
    """Last row per key (for update or complete output)."""
    rest = [c for c in bars.columns if c != key]
    return bars.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(ts, *[c for c in rest if c != ts])).alias("r")).select(key, "r.*")


def periodic_summary(states: DataFrame, every: str = "60 seconds", delay: str = "60 seconds", ts: str = "ts") -> DataFrame:
    """Open positions, equity, cash and pending orders at the end of every period, per account."""
    x = states.withWatermark(ts, delay) if states.isStreaming else states
    return x.groupBy("account", F.window(ts, every).alias("w")).agg(
        F.max_by(F.struct("equity", "cash", "open_positions", "pending_orders"), F.struct(ts, "equity", "cash", "open_positions", "pending_orders")).alias("s")).select(
        "account", F.col("w.end").alias("ts"), "s.*")


def append_bars(bars: DataFrame, path: str, checkpoint: str, **trigger):
    """Streaming append to a parquet table (exactly once through the checkpoint)."""
    return bars.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def upsert(df: DataFrame, path: str, checkpoint: str, **trigger):
    """Stream changed rows (update output) into a table that is read by ``read_upserts``; no trigger rewrites what is there.

    A micro-batch writes its rows under its own number, over what an earlier try of the same batch may have left: a batch that runs again after a
    failure changes nothing. A number's rows say which of a key's rows is the newest.
    """
    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/_batch={number}")

    return df.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).foreachBatch(save).start()


def read_upserts(spark, path: str, schema, keys: Sequence[str]) -> DataFrame:
    """The newest row of every key; null is a key like any other."""
    x = spark.read.schema(StructType([*schema.fields, StructField("_batch", LongType())])).option("basePath", path).parquet(f"{path}/_batch=*")
    rest = [c for c in x.columns if c not in (*keys, "_batch")]
    return x.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*keys, "r.*")


def simplify_batch(df: DataFrame, s: Series = BARS, prices: Sequence[str] = ("open", "high", "low", "close"), keep: Sequence[str] = ("volume", "spread")) -> DataFrame:
    """The light preparation of a live batch: price returns, bfill then ffill, z-score of the indicators.

    Meant for ``foreachBatch``; means and deviations are those of the batch, per symbol.
    """
    cols = [c for c in prices if c in df.columns]
    x = frames(df, s, lambda y, w: y.withColumns({f"{c}_return": change(c, F.lag(c).over(w)) for c in cols}), back=1)
    numeric, _ = split_numeric(x, {*s.keys, s.ts, s.pos, *s.tie})
    x = fill_forward_backward(x, numeric, s, backward_first=True)
    scaled = [c for c in numeric if c not in cols and c not in keep and "return" not in c]
    if not scaled:
        return x
    dev = x.groupBy(*s.keys).agg(*[F.stddev_samp(c).alias(f"_sd_{c}") for c in scaled])
    x = join_by(join_by(x, column_means(x, scaled, s), list(s.keys), "inner"), dev, list(s.keys), "inner")
    new = {c: F.when(F.col(f"_sd_{c}") > 0, ratio(F.col(c) - F.col(f"_avg_{c}"), F.col(f"_sd_{c}"))).otherwise(F.col(c)) for c in scaled}
    return x.withColumns(new).drop(*[f"_avg_{c}" for c in scaled], *[f"_sd_{c}" for c in scaled])


# ---------------------------------------------------------------- stateful features


_STATE = "last long, seen long, late long, windows array<array<double>>, averages array<double>"
BAR_COLUMNS = ("symbol", "ts", "open", "high", "low", "close")
FEATURE_SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, n_seen long, late_bars long, " + ", ".join(f"{n} {t}" for n, t in sliding.NAMES)
FEATURE_COLUMNS = [part.split()[0] for part in FEATURE_SCHEMA.split(", ")]


class LiveFeatures(StatefulProcessor):
    """The batch features of every symbol, one bar at a time, from what is inside the windows (``sliding.SeriesFeatures``).

    The state of a symbol is the values in its longest windows and its running averages, about 330 numbers, whatever came before. Bars of a batch
    are taken in time order; one that is not later than the last one seen is left out and counted in ``late_bars``.
    """

    def __init__(self, min_rows: int = MIN_ROWS):
        self.min_rows = min_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("sliding", _STATE)

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        """One row of ``feature_seed``."""
        r = initialState.iloc[0]
        series = sliding.SeriesFeatures()
        for o, h, lo, c in zip(r["opens"], r["highs"], r["lows"], r["closes"]):
            series.add(float(o), float(h), float(lo), float(c))
        series.resume([*r["averages"], series.open])
        self.state.update((int(r["last"]), int(r["seen"]), 0, series.windows(), series.averages()))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last, seen, late, windows, averages = self.state.get() if self.state.exists() else (None, 0, 0, None, ())
        series = sliding.SeriesFeatures() if windows is None else sliding.SeriesFeatures.restored(seen, windows, averages)
        # a symbol's bars of one micro-batch, six numbers each, are ordered here: the source's trigger bounds them
        parts = [(p["us"].to_numpy(np.int64), p[["open", "high", "low", "close"]].to_numpy(np.float64)) for p in rows]
        us, prices = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        out = []
        for i in np.argsort(us, kind="stable").tolist():
            at = int(us[i])
            if last is not None and at <= last:
                late += 1
                continue
            last, bar = at, prices[i].tolist()
            values = series.add(*bar)
            if series.seen >= self.min_rows:
                out.append((key[0], at, *bar, series.seen, late, *values))
            if len(out) == OUTPUT_ROWS:
                yield self._frame(out)
                out = []
        self.state.update((last, series.seen, late, series.windows(), series.averages()))
        yield self._frame(out)

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        pdf = pd.DataFrame(out, columns=FEATURE_COLUMNS)
        pdf["ts"] = pd.to_datetime(pdf["ts"].astype("int64"), unit="us")
        return pdf

    def close(self) -> None:
        pass


def feature_seed(history: DataFrame, s: Series = BARS) -> DataFrame:
    """What a stream needs to go on after ``history``: one row per symbol with its last ``sliding.LOOK_BACK`` bars and running averages.

    Made by the batch operators over the whole history; only these rows reach the state.
    """
    x = ewm(numbered(history, s), s, {f"_e{n}": Ewm("close", n) for n in sorted({*sliding.EMA_SPANS, features.MACD_SIGNAL})})
    a1, b1 = features._smoothed_mix(features.MACD_FAST, features.MACD_SIGNAL)
    a2, b2 = features._smoothed_mix(features.MACD_SLOW, features.MACD_SIGNAL)
    fast, slow, sig = (F.col(f"_e{n}") for n in (features.MACD_FAST, features.MACD_SLOW, features.MACD_SIGNAL))
    averages = F.array(*[F.col(f"_e{n}") for n in sliding.EMA_SPANS], a1 * fast + b1 * sig - a2 * slow - b2 * sig)
    x = stage(x.select("symbol", s.pos, F.unix_micros(F.col(s.ts).cast("timestamp")).alias("us"), "open", "high", "low", "close", averages.alias("averages")))
    end = x.groupBy("symbol").agg(F.max(s.pos).alias("_end"))
    bar = F.struct(s.pos, "us", "open", "high", "low", "close", "averages")
    kept = join_by(x, end, ["symbol"], "inner").where(F.col(s.pos) > F.col("_end") - sliding.LOOK_BACK).groupBy("symbol").agg(F.sort_array(F.collect_list(bar)).alias("bars"))
    newest = F.element_at("bars", -1)
    return kept.select("symbol", newest["us"].alias("last"), (newest[s.pos] + 1).alias("seen"), *[F.col(f"bars.{c}").alias(f"{c}s") for c in ("open", "high", "low", "close")], newest["averages"].alias("averages"))


def live_features(bars: DataFrame, history: DataFrame | None = None, min_rows: int = MIN_ROWS) -> DataFrame:
    """Every column of ``features.add_features`` for a bar stream (``symbol, ts, open, high, low, close``), going on from ``history`` when given.

    ``n_seen`` counts the bars of the symbol, ``late_bars`` those left out so far because they were not later than one before.
    """
    use_rocksdb(bars.sparkSession)
    start = feature_seed(history).groupBy("symbol") if history is not None else None
    x = bars.select("symbol", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "open", "high", "low", "close")
    made = x.groupBy("symbol").transformWithStateInPandas(statefulProcessor=LiveFeatures(min_rows), outputStructType=FEATURE_SCHEMA, outputMode="append", timeMode="none", initialState=start)
    return features.time_features(made)


# ---------------------------------------------------------------- stateful signals


SIGNAL_SCHEMA = ("account string, symbol string, ts timestamp, signal_type string, bars_held int, open_positions int")

SIGNAL_COLUMNS = [part.split()[0] for part in SIGNAL_SCHEMA.split(", ")]
_CANDIDATES = "account string, symbol string, us long, n long, buy_ok boolean, sell_ok boolean"
_CANDIDATE_COLUMNS = [part.split()[0] for part in _CANDIDATES.split(", ")]


class Consensus(StatefulProcessor):
    """Rows of one symbol that an account may act on: a consensus, or the last bar a position entered on an earlier one can be held.

    A position is entered on a consensus, left on the opposite one, or ``max_hold`` bars after its entry; at all other rows nothing can happen
    whatever the account holds. The state is the last directions, and the numbers of consensus rows within ``max_hold`` bars.
    """

    def __init__(self, lookback: int, threshold: float, max_hold: int):
        self.lookback, self.threshold, self.max_hold = lookback, threshold, max_hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("recent", "n long, directions array<int>, entries array<long>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n, recent, entries = self.state.get() if self.state.exists() else (0, (), ())
        recent, entries = deque(recent, self.lookback), deque(entries)
        parts = [(p["us"].to_numpy(np.int64), p["direction"].to_numpy(np.int64)) for p in rows]
        us, direction = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        out = []
        for i in np.argsort(us, kind="stable").tolist():
            recent.append(int(direction[i]))
            buy, sell = (len(recent) == self.lookback and recent.count(side) / self.lookback >= self.threshold for side in (1, -1))
            last = bool(entries) and entries[0] == n - self.max_hold
            if last:
                entries.popleft()
            if buy or sell:
                entries.append(n)
            if buy or sell or last:
                out.append((*key, int(us[i]), n, buy, sell))
            n += 1
        self.state.update((n, list(recent), list(entries)))
        yield pd.DataFrame(out, columns=_CANDIDATE_COLUMNS)

    def close(self) -> None:
        pass


class LiveSignals(StatefulProcessor):
    """Entries and exits of an account with a bound on its open positions; only the rows of ``Consensus`` come here.

    The limit couples the symbols of an account, so the account is the state key; the state is its open positions, at most ``max_positions``.
    """

    def __init__(self, min_hold: int, max_hold: int, max_positions: int):
        self.min_hold, self.max_hold, self.max_positions = min_hold, max_hold, max_positions

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", "symbol string, side int, entry long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = {r[0]: (r[1], r[2]) for r in self.open.get()}
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["us", "symbol"])
        out = []
        for symbol, us, n, buy, sell in zip(*[pdf[c].tolist() for c in ("symbol", "us", "n", "buy_ok", "sell_ok")]):
            kind = None
            if symbol in held:
                side, entry = held[symbol]
                bars = n - entry
                if bars >= self.max_hold or (bars >= self.min_hold and (sell if side > 0 else buy)):
                    kind = "EXIT_LONG" if side > 0 else "EXIT_SHORT"
                    del held[symbol]
            elif (buy or sell) and len(held) < self.max_positions:
                bars, kind, held[symbol] = 0, "BUY" if buy else "SELL", (1 if buy else -1, n)
            if kind:
                out.append((key[0], symbol, us, kind, bars, len(held)))
        if held:
            self.open.put([(k, *v) for k, v in held.items()])
        else:
            self.open.clear()
        pdf = pd.DataFrame(out, columns=SIGNAL_COLUMNS)
        pdf["ts"] = pd.to_datetime(pdf["ts"].astype("int64"), unit="us")
        yield pdf

    def close(self) -> None:
        pass


def live_signals(scored: DataFrame, lookback: int = 10, threshold: float = 0.7, min_hold: int = 12, max_hold: int = 288, max_positions: int = 5) -> DataFrame:
    """Signals of a scored stream (``account, symbol, ts, direction``): the consensus per symbol, then the limit per account on what is left."""
    use_rocksdb(scored.sparkSession)
    x = scored.select("account", "symbol", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "direction").groupBy("account", "symbol")
    found = x.transformWithStateInPandas(statefulProcessor=Consensus(lookback, threshold, max_hold), outputStructType=_CANDIDATES, outputMode="append", timeMode="none")
    return found.groupBy("account").transformWithStateInPandas(
        statefulProcessor=LiveSignals(min_hold, max_hold, max_positions), outputStructType=SIGNAL_SCHEMA, outputMode="append", timeMode="none")


def use_rocksdb(spark) -> None:
    """State store needed by the stateful processors."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
