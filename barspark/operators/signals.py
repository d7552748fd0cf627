"""Indicator values or predictions to trading signals."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.functions.columns import typical_price
from barspark.operators.series import BARS, SCAN_BLOCK, Ewm, Series, block_starts, by_group, ewm, frames, join_by, last, numbered, rolling_means, scan, stage

BUY, SELL, REVERSE, EXIT_LONG, EXIT_SHORT = "BUY", "SELL", "REVERSE", "EXIT_LONG", "EXIT_SHORT"


# ---------------------------------------------------------------- crossovers


def crossover(df: DataFrame, difference: Column, threshold: float = 0.0, s: Series = BARS,
              ready: Column | None = None) -> DataFrame:
    """Mark the rows where the wanted side changes.

    The side is +1 above ``threshold``, -1 below ``-threshold`` and undecided in between; a row
    gets ``signal`` (+1/-1) and ``signal_type`` when its side differs from the last decided one.
    """
    df = numbered(df, s)
    side = F.when(difference > threshold, 1).when(difference < -threshold, -1)
    if ready is not None:
        side = F.when(ready, side)
    x = scan(df.withColumn("_side", side), s, {"_before": last("_side", inclusive=False)})
    new = F.col("_side").isNotNull() & (F.col("_before").isNull() | (F.col("_side") != F.col("_before")))
    kind = F.when(F.col("_before").isNotNull(), REVERSE).when(F.col("_side") > 0, BUY).otherwise(SELL)
    return x.withColumns({"signal": F.when(new, F.col("_side")), "signal_type": F.when(new, kind)}).drop("_side", "_before")


def indicator_crossover(df: DataFrame, fast: str = "ema_20", slow: str = "sma_50", threshold: float = 0.001,
                        s: Series = BARS) -> DataFrame:
    return crossover(df, F.col(fast) - F.col(slow), threshold, s)


def ma_crossover(df: DataFrame, short: int = 10, long: int = 50, threshold: float = 0.0, simple: bool = True,
                 use_close: bool = True, s: Series = BARS) -> DataFrame:
    """Short against long moving average of close or typical price, after ``long`` rows."""
    df = numbered(df, s).withColumn("_price", F.col("close") if use_close else typical_price())
    if simple:
        df = frames(df, s, lambda x, w: rolling_means(x, w, {"short_ma": ("_price", short), "long_ma": ("_price", long)}), back=long)
    else:
        df = ewm(df, s, {"short_ma": Ewm("_price", short, adjust=True), "long_ma": Ewm("_price", long, adjust=True)})
    return crossover(df.drop("_price"), F.col("short_ma") - F.col("long_ma"), threshold, s,
                     ready=F.col(s.pos) >= long - 1)


def macd_crossover(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, threshold: float = 0.0,
                   s: Series = BARS) -> DataFrame:
    """Sign of the MACD histogram (weighted averages with start correction), after the warm-up."""
    df = ewm(numbered(df, s), s, {"_fast": Ewm("close", fast, adjust=True), "_slow": Ewm("close", slow, adjust=True)})
    df = df.withColumn("macd_line", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    df = ewm(df, s, {"signal_line": Ewm("macd_line", signal, adjust=True)})
    df = df.withColumn("histogram", F.col("macd_line") - F.col("signal_line"))
    return crossover(df, F.col("histogram"), threshold, s, ready=F.col(s.pos) >= slow + signal - 1)


def sma_sweep(df: DataFrame, shorts: Sequence[int], longs: Sequence[int], threshold: float = 0.0,
              s: Series = BARS) -> DataFrame:
    """Crossover signals for every (short, long) pair; ``run_id`` names the pair.

    Each average is computed once, one scan carries the sides of all pairs, and rows are unfolded by the last projection: the bars are
    shuffled once per pass, whatever the number of pairs.
    """
    windows = sorted({*shorts, *longs})
    df = frames(numbered(df, s), s, lambda x, w: rolling_means(x, w, {f"_ma{n}": ("close", n) for n in windows}),
                back=max(windows))
    pairs = [(a, b) for a in shorts for b in longs if a < b]
    difference = {f"_d{i}": F.when(F.col(s.pos) >= b - 1, F.col(f"_ma{a}") - F.col(f"_ma{b}")) for i, (a, b) in enumerate(pairs)}
    df = df.withColumns(difference).withColumns({f"_s{i}": F.when(F.col(f"_d{i}") > threshold, 1).when(F.col(f"_d{i}") < -threshold, -1) for i in range(len(pairs))})
    # one scan carries the last side of every pair; rows are unfolded after it
    df = scan(df.drop(*difference), s, {f"_b{i}": last(f"_s{i}", inclusive=False) for i in range(len(pairs))})

    def run(i: int, a: int, b: int) -> Column:
        now, before = F.col(f"_s{i}"), F.col(f"_b{i}")
        new = now.isNotNull() & (before.isNull() | (now != before))
        kind = F.when(before.isNotNull(), REVERSE).when(now > 0, BUY).otherwise(SELL)
        return F.struct(F.lit(f"{a}/{b}").alias("run_id"), F.lit(a).alias("short_window"), F.lit(b).alias("long_window"), F.col(f"_ma{a}").alias("short_ma"), F.col(f"_ma{b}").alias("long_ma"),
                        F.when(new, now).alias("signal"), F.when(new, kind).alias("signal_type"))

    made = [*[f"_ma{n}" for n in windows], *[f"_{k}{i}" for k in "sb" for i in range(len(pairs))]]
    return df.select("*", F.inline(F.array(*[run(i, a, b) for i, (a, b) in enumerate(pairs)]))).drop(*made)


def prediction_signals(df: DataFrame, prediction: str = "prediction", threshold: float = 0.0, kind: str = "regression",
                       s: Series = BARS) -> DataFrame:
    """Same state rule on a predicted value, or on a predicted class (1 up, 0 or -1 down)."""
    p = F.col(prediction).cast("double")
    diff = p if kind == "regression" else F.when(p > 0, 1.0).otherwise(-1.0)
    return crossover(df, diff, threshold if kind == "regression" else 0.0, s)


def signal_records(df: DataFrame, fast: str, slow: str, strategy: str, s: Series = BARS) -> DataFrame:
    """The signal rows as event records with strength, reason and metadata."""
    rows = df.where(F.col("signal").isNotNull())
    sign = F.when(F.col("signal") > 0, ">").otherwise("<")
    values = F.map_from_arrays(
        F.array(F.lit("fast_value"), F.lit("slow_value"), F.lit("difference")),
        F.array(F.col(fast).cast("string"), F.col(slow).cast("string"), (F.col(fast) - F.col(slow)).cast("string")))
    return rows.select(
        *s.keys, s.ts, "signal_type", F.lit(1.0).alias("strength"), F.lit(strategy).alias("strategy_id"),
        F.concat_ws(" ", F.lit(f"Indicator Crossover: {fast}"), sign, F.lit(slow)).alias("reason"),
        values.alias("metadata"))


# ---------------------------------------------------------------- model predictions


def direction(probability: str | Column, threshold: float = 0.55) -> Column:
    p = F.col(probability) if isinstance(probability, str) else probability
    return F.when(p > threshold, 1).otherwise(-1)


def consensus(df: DataFrame, direction_col: str = "direction", lookback: int = 10, threshold: float = 0.7,
              s: Series = BARS) -> DataFrame:
    """``buy_ok``/``sell_ok``: the share of the last ``lookback`` directions reaches ``threshold``."""
    def make(x: DataFrame, w) -> DataFrame:
        f = w.rowsBetween(-(lookback - 1), 0)
        full = F.count(direction_col).over(f) == lookback

        def share(d: int) -> Column:
            return F.coalesce(full & (F.avg((F.col(direction_col) == d).cast("double")).over(f) >= threshold), F.lit(False))

        return x.withColumns({"buy_ok": share(1), "sell_ok": share(-1)})

    return frames(df, s, make, back=lookback - 1)


class HoldRule:
    """Entry on consensus; exit on the opposite consensus after ``min_hold`` bars or at ``max_hold``.

    What a block of bars does depends only on the first row at which the position is free again. From every row there is one jump: to the next
    entry and on to the row after its exit. Doubling the jumps (J, J after J, ...) takes all rows of a block to its end at once, so a
    block is a table from first free row to first free row of the next block; tables are composed along a key, and then the
    trades of every block are the orbit of its own first free row. No step loops over bars.
    """

    def __init__(self, min_hold: int = 12, max_hold: int = 288):
        self.first, self.most = max(1, min_hold), max(1, max_hold)

    def jumps(self, buy: np.ndarray, sell: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of ``n`` rows and the ``max_hold`` rows after them, as far as there are any: side, exit row, next entry, next free row.

        The exit of an entry without one is the row after the last possible one. From a row after the n-th the jump stays.
        """
        size = len(buy)
        rows = np.arange(n)

        def next_of(flags: np.ndarray) -> np.ndarray:
            at = np.where(flags, np.arange(len(flags)), size + self.most)
            return np.append(np.minimum.accumulate(at[::-1])[::-1], np.full(self.first + 1, size + self.most))

        side = np.where(buy[:n], 1, np.where(sell[:n], -1, 0))
        against = np.where(side > 0, next_of(sell)[rows + self.first], next_of(buy)[rows + self.first])
        leave = np.minimum(rows + self.most, against)
        leave[leave >= size] = n + self.most  # not over yet when the rows end
        entry = next_of(side != 0)[:n]
        entry[entry >= n] = n
        jump = np.concatenate((np.where(entry < n, np.append(leave, n)[entry] + 1, n), np.arange(n, n + self.most + 2)))
        return side, leave, entry, jump

    def table(self, buy: np.ndarray, sell: np.ndarray, n: int, first_pos: int) -> np.ndarray:
        """Per first free row (0 to ``max_hold`` + 1): that of the next block, and entry row and side of the trade that reaches into it (side 0: none)."""
        side, leave, entry, jump = self.jumps(buy, sell, n)
        last = np.where(np.arange(len(jump)) < n, np.arange(len(jump)), -1)  # the last row inside the block on the way
        while True:
            again = jump[jump]
            if np.array_equal(again, jump):
                break
            last, jump = np.where(last[jump] >= 0, last[jump], last), again
        starts = np.minimum(np.arange(self.most + 2), len(jump) - 1)
        end, via = jump[starts] - n, last[starts]
        at = np.where(via >= 0, np.append(entry, n)[via], n)
        open_ = (at < n) & (end > 0)
        return np.stack([end, np.where(open_, at + first_pos, 0), np.where(open_, np.append(side, 0)[np.minimum(at, n)], 0)])

    def trades(self, buy: np.ndarray, sell: np.ndarray, n: int, free: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entry rows, exit rows and sides of the trades that begin in the block."""
        side, leave, entry, jump = self.jumps(buy, sell, n)
        way = np.array([min(free, len(jump) - 1)])
        while way[-1] < n:  # twice as many steps of the way each time
            way, jump = np.concatenate((way, jump[way])), jump[jump]
        at = entry[way[way < n]]
        at = np.unique(at[at < n])
        return at, leave[at], side[at]


def hold_signals(df: DataFrame, min_hold: int = 12, max_hold: int = 288, s: Series = BARS,
                 block: int = SCAN_BLOCK // 8, fan: int = 256) -> DataFrame:
    """Add ``position`` (-1/0/1 after the row), ``bars_held`` and ``signal_type``; needs ``buy_ok``/``sell_ok``."""
    rule, keys, block = HoldRule(min_hold, max_hold), list(s.keys), max(block, max_hold + 2)
    df = numbered(df, s)
    own, inside = s.block(block), F.pmod(F.col(s.pos), F.lit(block))
    slim = df.select(*keys, s.pos, F.coalesce("buy_ok", F.lit(False)).alias("_buy"), F.coalesce("sell_ok", F.lit(False)).alias("_sell"), own.alias("_own"),
                     F.explode(F.array_compact(F.array(own, F.when((inside < rule.most) & (own > 0), own - 1)))).alias("_blk"))
    key_fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    table = ", ".join(f"{c} array<bigint>" for c in ("_free", "_entry", "_side"))

    def ordered(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, int]:
        n = int((t.column("_own").to_numpy() == t.column("_blk").to_numpy()).sum())
        return t, t.column("_buy").to_numpy(zero_copy_only=False), t.column("_sell").to_numpy(zero_copy_only=False), n

    def named(t: pa.Table, columns: list[str], **more) -> pa.Table:
        return pa.table({**{c: t.column(c).slice(0, 1) for c in columns}, **{k: pa.array([v.tolist()], pa.list_(pa.int64())) for k, v in more.items()}})

    def to_table(t: pa.Table) -> pa.Table:
        t, buy, sell, n = ordered(t)
        return named(t, [*keys, "_blk"], **dict(zip(("_free", "_entry", "_side"), rule.table(buy, sell, n, t.column(s.pos)[0].as_py()))))

    tables = stage(by_group(slim, [*keys, "_blk"], [s.pos], to_table, f"{key_fields}, _blk bigint, {table}"))
    # a state is (first free row, entry row and side of the trade that reaches in)
    per_block = block_starts(tables, s, {"_free": "array<bigint>", "_entry": "array<bigint>", "_side": "array<bigint>"}, lambda f, g: [[c[i] for i in f[0]] for c in g],
                             lambda f, at: [c[at[0]] for c in f], [0, 0, 0], "array<bigint>", fan)

    def walk(t: pa.Table) -> pa.Table:
        t, buy, sell, n = ordered(t)
        free, entered, held = t.column("_start")[0].as_py()
        at, leave, side = rule.trades(buy, sell, n, free)
        first = t.column(s.pos)[0].as_py()
        if held:  # the trade that reaches in from the block before
            at, leave, side = np.append(entered - first, at), np.append(free - 1, leave), np.append(held, side)
        position, since, kind = np.zeros(n, np.int32), np.zeros(n, np.int32), np.full(n, None, object)
        rows = np.arange(n)
        if len(at):
            trade = np.searchsorted(at, rows, "right") - 1
            within = (trade >= 0) & (rows < leave[trade])
            position[within], since[within] = side[trade[within]], (rows - at[trade])[within]
            new, out = at >= 0, leave < n
            kind[at[new]] = np.where(side[new] > 0, BUY, SELL)
            kind[leave[out]] = np.where(side[out] > 0, EXIT_LONG, EXIT_SHORT)
        t = t.slice(0, n)
        return pa.table({**{c: t.column(c) for c in (*keys, s.pos)}, "position": position, "bars_held": since, "signal_type": pa.array(kind, pa.string())})

    made = f"{key_fields}, `{s.pos}` bigint, position int, bars_held int, signal_type string"
    walked = by_group(join_by(slim, per_block, [*keys, "_blk"], "inner"), [*keys, "_blk"], [s.pos], walk, made)
    return join_by(df, walked, [*keys, s.pos], "inner")

