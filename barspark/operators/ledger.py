"""Signals to orders, trades, transactions and the equity curve."""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.operators.series import BARS, SCAN_BLOCK, Series, block_starts, by_groups, frames, join_by, last, next_, number_rows, numbered, running_sum, scan, stage

# ---- fixed values
DEFAULT_COMMISSION_PERCENT = 0.1
DEFAULT_CAPITAL = 10_000.0
MONEY_DECIMALS = 8  # sums of changes are rounded so that a flat account stays exactly flat
# ---- end of fixed values


@dataclass(frozen=True)
class Slippage:
    """Percent by which buys fill higher and sells lower: fixed, growing with size, or random."""

    kind: str = "none"  # none | fixed | variable | random
    percent: float = 0.0
    size_factor: float = 0.0
    low: float = 0.0
    high: float = 0.0
    seed: int = 0

    def percent_of(self, quantity: Column) -> Column:
        if self.kind == "fixed":
            return F.lit(self.percent)
        if self.kind == "variable":
            return F.lit(self.percent) + self.size_factor * quantity
        if self.kind == "random":
            return self.low + (self.high - self.low) * F.rand(self.seed)
        return F.lit(0.0)

    def price(self, base: Column, side: Column, quantity: Column) -> Column:
        """``side`` is +1 for buys and -1 for sells."""
        return base * (1 + side * self.percent_of(quantity) / 100)


def commission(price: Column, quantity: Column, percent: float = DEFAULT_COMMISSION_PERCENT) -> Column:
    return price * quantity * (percent / 100)


def orders(df: DataFrame, s: Series = BARS, quantity: float = 1.0) -> DataFrame:
    """One order per signal row: side of the order given the position before it (``position_before``:
    +1/0/-1, ``held``: its quantity). REVERSE sells when long, otherwise buys; EXIT_* closes all."""
    st = F.col("signal_type")
    side = (F.when(st == "BUY", "BUY").when(st == "SELL", "SELL")
            .when(st == "REVERSE", F.when(F.col("position_before") > 0, "SELL").otherwise("BUY"))
            .when((st == "EXIT_LONG") & (F.col("held") > 0), "SELL")
            .when((st == "EXIT_SHORT") & (F.col("held") > 0), "BUY"))
    amount = F.when(st.startswith("EXIT"), F.col("held")).otherwise(F.lit(quantity))
    return df.where(st.isNotNull()).withColumns({"order_side": side, "quantity": amount}).where("order_side is not null")


# ---------------------------------------------------------------- trades


@dataclass(frozen=True)
class Exits:
    """Stop and target in percent of the entry fill."""

    stop_percent: float | None = None
    target_percent: float | None = None


def trades(df: DataFrame, s: Series = BARS, reverse: str = "flip", quantity: float = 1.0, slippage: Slippage = Slippage(),
           commission_percent: float = DEFAULT_COMMISSION_PERCENT, exits: Exits = Exits()) -> DataFrame:
    """Pair crossover signals (column ``signal``, +1/-1) into trades.

    ``flip``: every signal closes the open trade and opens the opposite one.
    ``close_only``: a reversal only closes; the next one opens, always long after the first trade.
    A stop or target ends a trade at the first later close beyond its level (up to and including
    the bar of the next signal, where marking comes first), without slippage or commission.
    """
    df = numbered(df, s)
    keys, qty = list(s.keys), F.lit(float(quantity))
    sig = F.col("signal")
    x = scan(df.withColumn("_one", F.when(sig.isNotNull(), F.lit(1).cast("long"))), s, {"_nth": running_sum("_one")})
    side = sig if reverse == "flip" else F.when(sig.isNotNull(), F.when(F.col("_nth") == 1, sig).otherwise(F.lit(1)))
    x = x.withColumn("_dir", side.cast("int"))
    x = x.withColumn("_fill", F.when(sig.isNotNull(), slippage.price(F.col("close"), F.col("_dir"), qty)))
    entry = F.when(sig.isNotNull(), F.struct(F.col(s.pos).alias("pos"), F.col("_dir").alias("dir"), F.col("_fill").alias("fill")))
    after = F.when(sig.isNotNull(), F.struct(F.col(s.ts).alias("ts"), F.col(s.pos).alias("pos"), F.col("close").alias("close")))
    x = scan(x, s, {"_prior": last(entry, inclusive=False), "_next": next_(after, inclusive=False)})

    def level(fill: Column, d: Column, percent: float | None, sign: int) -> Column:
        return fill * (1 + sign * d * percent / 100) if percent is not None else F.lit(None).cast("double")

    p = F.col("_prior")
    opened = x.where(sig.isNotNull()).withColumns({
        "stop_loss": level(F.col("_fill"), F.col("_dir"), exits.stop_percent, -1),
        "take_profit": level(F.col("_fill"), F.col("_dir"), exits.target_percent, 1)})
    if exits.stop_percent is not None or exits.target_percent is not None:
        stop = (F.col("close") - level(p["fill"], p["dir"], exits.stop_percent, -1)) * p["dir"] <= 0
        target = (F.col("close") - level(p["fill"], p["dir"], exits.target_percent, 1)) * p["dir"] >= 0
        why = F.when(stop, "STOP_LOSS").when(target, "TAKE_PROFIT")
        hits = x.where(p.isNotNull()).withColumn("_why", why).where("_why is not null").groupBy(*keys, p["pos"].alias(s.pos)).agg(
            F.min(F.struct(F.col(s.pos).alias("pos"), F.col(s.ts).alias("ts"), F.col("close").alias("close"), F.col("_why").alias("why"))).alias("_hit"))
        opened = join_by(opened, hits, [*keys, s.pos])
    else:
        empty = f"struct<pos:bigint,ts:{df.schema[s.ts].dataType.simpleString()},close:double,why:string>"
        opened = opened.withColumn("_hit", F.lit(None).cast(empty))
    if reverse == "close_only":
        # after a stop the next signal opens again, so opens are the odd signals since the last stop
        opened = scan(opened, s, {"_stopped": last(F.when(F.col("_hit").isNotNull(), F.col("_nth")), inclusive=False)})
        opened = opened.where((F.col("_nth") - F.coalesce("_stopped", F.lit(0))) % 2 == 1)
    elif reverse != "flip":
        raise ValueError(f"unknown reverse rule {reverse!r}")
    hit, nxt, d = F.col("_hit"), F.col("_next"), F.col("_dir")
    price = F.when(hit.isNotNull(), hit["close"]).otherwise(slippage.price(nxt["close"], -d, qty))
    t = opened.select(
        *keys, F.when(d > 0, "LONG").otherwise("SHORT").alias("direction"), qty.alias("quantity"),
        F.col("_fill").alias("entry_price"), F.col(s.ts).alias("entry_time"), price.alias("exit_price"),
        F.coalesce(hit["ts"], nxt["ts"]).alias("exit_time"), F.col(s.pos).alias("entry_pos"),
        F.coalesce(hit["pos"], nxt["pos"]).alias("exit_pos"),
        F.when(hit.isNotNull(), hit["why"]).when(nxt.isNotNull(), "TRADE").alias("exit_reason"),
        "stop_loss", "take_profit", d.alias("side"))
    return t.withColumns({
        "is_open": F.col("exit_pos").isNull(),
        "pnl": (F.col("exit_price") - F.col("entry_price")) * F.col("side") * F.col("quantity"),
        "entry_commission": commission(F.col("entry_price"), F.col("quantity"), commission_percent),
        "exit_commission": F.when(F.col("exit_reason") == "TRADE", commission(F.col("exit_price"), F.col("quantity"), commission_percent))
                            .when(F.col("exit_reason").isNotNull(), 0.0),
        "position_id": F.concat_ws("_", *keys, F.date_format(F.col("entry_time").cast("timestamp"), "yyyyMMddHHmmss"), "direction"),
    })


def transactions(t: DataFrame, s: Series = BARS) -> DataFrame:
    """OPEN and CLOSE/STOP_LOSS/TAKE_PROFIT rows of a trades table."""
    def row(kind: Column, ts: str, price: str, fee: str, pnl: Column, pos: str) -> Column:
        return F.struct(F.col(ts).alias("ts"), kind.alias("type"), F.col(price).alias("price"), F.col(fee).alias("commission"),
                        pnl.alias("pnl"), F.col(pos).alias("pos"))

    kind = F.when(F.col("exit_reason") == "TRADE", "CLOSE").otherwise(F.col("exit_reason"))
    both = F.array(row(F.lit("OPEN"), "entry_time", "entry_price", "entry_commission", F.lit(None).cast("double"), "entry_pos"),
                   row(kind, "exit_time", "exit_price", "exit_commission", F.col("pnl"), "exit_pos"))
    return t.select(*s.keys, "position_id", "quantity", F.inline(both)).where(F.col("type").isNotNull())


UNITS = 100_000_000  # quantities are counted in units of 1e-8, so that sums of them are exact


class FillBlocks:
    """What blocks of fills do to the position they start with, many blocks at once.

    A position stays as it is plus the sum of the fills, up to the fill that brings it to nothing or beyond: there it is closed, and what follows
    doesn't depend on it any more. So a block is a step function of the size of a long and of a short position, with an end for each step and, above the
    last step, the position plus the block's sum. The closing fill of a position opened at a row is the next one whose sum is at or
    below (above) that before it; these jumps, doubled, lead from every row to the end of the block.

    Block g has the rows from ``edges[g]`` to ``edges[g + 1]``. A node is the state before a block's first row or after a row: one more than rows in each block.
    """

    def __init__(self, side: np.ndarray, units: np.ndarray, edges: np.ndarray) -> None:
        blocks, sizes = np.arange(len(edges) - 1), np.diff(edges)
        self.side, self.units, self.edges, self.longest = side, units, edges, int(sizes.max(initial=0))
        self.block = np.repeat(blocks, sizes + 1)
        self.head, self.tail = edges[:-1] + blocks, edges[1:] + blocks
        self.first, self.last = self.head[self.block], self.tail[self.block]  # of a node's block
        self.node = np.arange(len(self.block))
        self.before = np.arange(len(side)) + np.repeat(blocks, sizes)  # node before each row; the next one is after it
        step, self.opens = np.zeros((2, len(self.node)), np.int64)  # opens: direction of a position opened after a node, 0 if none is
        step[self.before + 1], self.opens[self.before] = side * units, side * (units > 0)
        total = np.cumsum(step)
        self.sums = total - total[self.first]
        to = np.where(self.opens > 0, self._next(self.sums), np.where(self.opens < 0, self._next(-self.sums), np.minimum(self.node + 1, self.last)))
        self.closes = np.where(to > self.last, self.node, to)  # flat at a node: node at which it is flat again; the same if it stays open

    def _next(self, v: np.ndarray) -> np.ndarray:
        """Per node the next one with a value at or below its own, beyond the block if it has none, by halving over tables of minima."""
        least = [v]
        while self.longest >> len(least) and len(least[-1]) > 1 << (len(least) - 1):
            k = 1 << (len(least) - 1)
            least.append(np.minimum(least[-1][:-k], least[-1][k:]))
        at = self.node + 1
        for level in reversed(range(len(least))):
            table = least[level]
            inside = at < len(table)
            skip = np.zeros(len(v), bool)
            skip[inside] = table[at[inside]] > v[inside]
            at = at + np.where(skip, 1 << level, 0)
        return at

    def tables(self) -> list[pa.Array]:
        """Per block: sum, end of a flat start, steps for long, ends for long, steps for short, ends for short."""
        end = self.closes
        while not np.array_equal(end[end], end):
            end = end[end]
        stays = (self.closes == self.node) & (self.node < self.last)
        held = np.where(stays, self.sums[self.last] - self.sums, 0)[end]
        out = [pa.array(self.sums[self.tail]), pa.array(held[self.head])]
        for sums in (self.sums, -self.sums):
            low, shift = sums.copy(), 1
            while shift <= self.longest:  # smallest so far in the block
                low[shift:] = np.where((self.node - self.first)[shift:] >= shift, np.minimum(low[shift:], low[:-shift]), low[shift:])
                shift *= 2
            new = np.flatnonzero((low[1:] < low[:-1]) & (self.block[1:] == self.block[:-1])) + 1
            of, ends = self.block[new], held[new]
            last = np.append((ends[1:] != ends[:-1]) | (of[1:] != of[:-1]), True) if len(new) else np.zeros(0, bool)
            offsets = pa.array(np.searchsorted(of[last], np.arange(len(self.edges))).astype(np.int32))
            out += [pa.ListArray.from_arrays(offsets, pa.array(v[last])) for v in (-sums[new], ends)]
        return out

    def walk(self, price: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
        """Type, position, and the entry price as ``_a`` times that of the start plus ``_b`` (``_a0``, ``_b0``: before the fill), from each block's start position."""
        flat, held = np.where(start == 0, self.head, -1), start[self.block] + self.sums
        gone = np.flatnonzero((self.node > self.first) & (start != 0)[self.block] & (held * np.sign(start)[self.block] <= 0))
        flat[self.block[gone[::-1]]] = gone[::-1]  # the first one stays
        way, jump = flat[flat >= 0], self.closes
        while len(more := np.union1d(way, jump[way])) > len(way):  # twice as many closes each time
            way, jump = more, jump[jump]
        is_flat = np.zeros(len(self.node), bool)
        is_flat[way] = True
        since = np.maximum.accumulate(np.where(is_flat, self.node, -1))
        held = np.where(is_flat, 0, np.where(since < self.first, held, self.sums - self.sums[np.maximum(since, 0)]))
        before, after = held[self.before], held[self.before + 1]
        opening, closing = before == 0, (before != 0) & (after == 0)
        adding = ~opening & (np.sign(before) == self.side)
        kind = np.select([opening, closing, adding], ["OPEN", "CLOSE", "INCREASE"], "DECREASE")
        size = np.maximum(np.abs(after), 1).astype(float)
        a = np.where(opening, 0.0, np.where(adding, np.abs(before) / size, 1.0))
        b = np.where(opening, price, np.where(adding, price * self.units / size, 0.0))
        inner, shift = (self.node - self.first)[self.before], 1
        while shift < self.longest:  # all prefixes of the chains of a x + b by doubling
            far = inner[shift:] >= shift
            b[shift:] = np.where(far, a[shift:] * b[:-shift] + b[shift:], b[shift:])
            a[shift:] = np.where(far, a[shift:] * a[:-shift], a[shift:])
            shift *= 2
        closed = np.where(adding | opening, 0, np.minimum(self.units, np.abs(before))) * np.sign(before) / UNITS
        a0, b0 = (np.where(inner == 0, none, np.append(none, v[:-1])) for v, none in ((a, 1.0), (b, 0.0)))
        return {"type": kind, "position": after / UNITS, "_a": a, "_b": b, "_a0": a0, "_b0": b0, "_closed": closed}


class FillBlock(FillBlocks):
    """One block of fills."""

    def __init__(self, side: np.ndarray, units: np.ndarray) -> None:
        super().__init__(side, units, np.array([0, len(side)]))

    def table(self) -> list:
        return [c[0].as_py() for c in self.tables()]

    def walk(self, price: np.ndarray, start: int) -> dict[str, np.ndarray]:
        return super().walk(price, np.array([start]))


def _at(f: list, position: int) -> int:
    """The position after the block function ``f``."""
    if not position:
        return f[1]
    steps, ends = f[2:4] if position > 0 else f[4:6]
    i = bisect_left(steps, abs(position))
    return ends[i] if i < len(steps) else position + f[0]


def _then(f: list, g: list) -> list:
    """First ``f``, then ``g``: where f closes, g takes its end; beyond, g's own steps, moved by f's sum."""
    out = [f[0] + g[0], _at(g, f[1])]
    for i, sign in ((2, 1), (4, -1)):
        top = f[i][-1] if f[i] else 0
        moved = [(t - sign * f[0], e) for t, e in zip(g[i], g[i + 1]) if t - sign * f[0] > top]
        steps, ends = [*f[i], *[t for t, _ in moved]], [*[_at(g, e) for e in f[i + 1]], *[e for _, e in moved]]
        last = [k for k in range(len(ends)) if k + 1 == len(ends) or ends[k + 1] != ends[k]]
        out += [[steps[k] for k in last], [ends[k] for k in last]]
    return out


def pair_fills(fills: DataFrame, s: Series = Series(tie=("fill_id",)), block: int = SCAN_BLOCK, method: str = "range") -> DataFrame:
    """General pairing: OPEN, INCREASE (weighted entry), DECREASE, CLOSE for any quantities.

    Expects ``side`` (+1/-1), ``quantity`` (counted in units of 1e-8), ``price``. A closing fill larger than the position only closes it.
    Every block of fills becomes a function of the position it starts with (``FillBlocks``, many keys' blocks in one call); the functions are composed along a key, which gives every
    block its start. Then the entry price within a block is linear in that of its start, and these lines are chained in the same way. One
    pass whatever the fills: nothing is counted or repeated first.
    """
    keys, columns = list(s.keys), fills.columns
    group = [*keys, "_blk"]
    rows = stage(number_rows(fills, s, method=method).withColumn("_blk", s.block(block)))
    key_fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    steps = {"_sum": "bigint", "_flat": "bigint", "_long": "array<bigint>", "_long_end": "array<bigint>", "_short": "array<bigint>", "_short_end": "array<bigint>"}

    def read(t: pa.Table, edges: np.ndarray) -> FillBlocks:
        units = np.rint(t.column("quantity").to_numpy().astype(float) * UNITS).astype(np.int64)
        return FillBlocks(np.sign(t.column("side").to_numpy()).astype(np.int64), units, edges)

    def to_functions(t: pa.Table, edges: np.ndarray) -> pa.Table:
        return pa.table({**{c: t.column(c).take(pa.array(edges[:-1])) for c in group}, **dict(zip(steps, read(t, edges).tables()))})

    slim = rows.select(*group, s.pos, "side", "quantity")
    functions = stage(by_groups(slim, group, [s.pos], to_functions, f"{key_fields}, _blk bigint, " + ", ".join(f"{n} {k}" for n, k in steps.items())))
    start = block_starts(functions, s, steps, _then, _at, 0, "bigint")

    def walk(t: pa.Table, edges: np.ndarray) -> pa.Table:
        start = t.column("_start").to_numpy()[edges[:-1]]
        return pa.table({**{c: t.column(c) for c in (*group, s.pos)}, **read(t, edges).walk(t.column("price").to_numpy().astype(float), start)})

    walked = by_groups(join_by(rows.select(*group, s.pos, "side", "quantity", "price"), start, group, "inner"), group, [s.pos],
        walk, f"{key_fields}, _blk bigint, `{s.pos}` bigint, type string, position double, _a double, _b double, _a0 double, _b0 double, _closed double")
    walked = stage(walked)
    lines = walked.groupBy(*group).agg(F.max_by(F.struct("_a", "_b"), s.pos).alias("_line")).select(*group, F.col("_line._a").alias("_a"), F.col("_line._b").alias("_b"))
    entry = block_starts(lines, s, {"_a": "double", "_b": "double"}, lambda f, g: [g[0] * f[0], g[0] * f[1] + g[1]], lambda f, e: f[0] * e + f[1], 0.0, "double")
    made = join_by(walked, entry, group, "inner")
    pnl = F.when(F.col("type").isin("CLOSE", "DECREASE"), (F.col("price") - (F.col("_a0") * F.col("_start") + F.col("_b0"))) * F.col("_closed"))
    both = join_by(rows, made.drop("_blk"), [*keys, s.pos], "inner")
    return both.select(*columns, "type", "position", (F.col("_a") * F.col("_start") + F.col("_b")).alias("entry_price"), pnl.alias("pnl"))


# ---------------------------------------------------------------- equity


def mark_to_market(df: DataFrame, t: DataFrame, s: Series = BARS) -> DataFrame:
    """Bars with the trade in force, its unrealised P&L and the cash flows of the bar."""
    df = numbered(df, s)
    keys = list(s.keys)
    entry = t.select(*keys, F.col("entry_pos").alias(s.pos), F.struct(
        "exit_pos", "side", "quantity", "entry_price").alias("_trade"), "entry_commission")
    leave = t.where("exit_pos is not null").groupBy(*keys, F.col("exit_pos").alias(s.pos)).agg(
        F.sum("pnl").alias("_realised"), F.sum("exit_commission").alias("_fee"))
    x = join_by(join_by(df.select(*keys, s.ts, s.pos, "close"), entry, [*keys, s.pos]), leave, [*keys, s.pos])
    x = scan(x, s, {"_trade": last("_trade")})
    tr = F.col("_trade")
    live = tr.isNotNull() & (tr["exit_pos"].isNull() | (F.col(s.pos) < tr["exit_pos"]))
    return x.withColumns({
        "position": F.when(live, tr["side"]).otherwise(0),
        "unrealised": F.when(live, (F.col("close") - tr["entry_price"]) * tr["side"] * tr["quantity"]).otherwise(0.0),
        "notional": F.when(live, F.abs(tr["entry_price"] * tr["quantity"])).otherwise(0.0),
        "realised": F.coalesce("_realised", F.lit(0.0)),
        "fees": F.coalesce("entry_commission", F.lit(0.0)) + F.coalesce("_fee", F.lit(0.0)),
    }).drop("_trade", "_realised", "_fee", "entry_commission")


def equity_curve(marked: DataFrame, s: Series = BARS, account: tuple[str, ...] = (), capital: float = DEFAULT_CAPITAL) -> DataFrame:
    """Account value per time stamp over all symbols of an account (``account`` keys, e.g. run_id).

    Every bar contributes the change of its symbol's value, so a symbol without a bar at some time
    simply keeps its value there.
    """
    d = frames(marked, s, lambda x, w: x.withColumns({
        f"_d_{c}": F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0.0)) for c in ("unrealised", "notional")} | {
        "_d_open": F.abs("position") - F.coalesce(F.abs(F.lag("position").over(w)), F.lit(0))}), back=1)
    acc = Series(keys=account or ("account",), ts=s.ts)
    if not account:
        d = d.withColumn("account", F.lit("all"))
    per_ts = d.groupBy(*acc.keys, s.ts).agg(
        F.sum(F.col("realised") - F.col("fees")).alias("_cash"), F.sum("_d_unrealised").alias("_u"),
        F.sum("_d_notional").alias("_not"), F.sum("_d_open").alias("_open"))
    run = scan(number_rows(per_ts, acc), acc, {c: running_sum(c) for c in ("_cash", "_u", "_not", "_open")})
    cash, unrealised = (F.round(c, MONEY_DECIMALS) for c in (F.lit(capital) + F.col("_cash"), F.col("_u")))
    equity = F.round(F.lit(capital) + F.col("_cash") + F.col("_u"), MONEY_DECIMALS)
    return run.select(
        *acc.keys, s.ts, acc.pos, cash.alias("cash"), equity.alias("equity"),
        unrealised.alias("unrealised_pnl"), F.col("_open").cast("long").alias("open_positions"),
        F.when(equity > 0, F.col("_not") / equity).otherwise(0.0).alias("leverage_used"))


def portfolio_summary(curve: DataFrame, t: DataFrame, account: tuple[str, ...], capital: float = DEFAULT_CAPITAL, ts: str = "ts") -> DataFrame:
    end = curve.groupBy(*account).agg(F.max_by(F.struct("equity", "cash", "unrealised_pnl", "leverage_used"), F.struct(ts, "equity", "cash")).alias("e"))
    n = t.groupBy(*account).agg(
        F.count_if("is_open").alias("open_positions"), F.count_if(~F.col("is_open")).alias("closed_positions"),
        F.coalesce(F.sum(F.when(~F.col("is_open"), F.col("pnl"))), F.lit(0.0)).alias("realized_pnl"))
    return join_by(end, n, list(account)).select(
        *account, F.col("e.equity").alias("equity"), F.col("e.cash").alias("cash"), F.lit(capital).alias("initial_capital"),
        ((F.col("e.equity") / capital - 1) * 100).alias("return_pct"), "open_positions", "closed_positions",
        F.col("e.unrealised_pnl").alias("unrealized_pnl"), "realized_pnl", F.col("e.leverage_used").alias("leverage_used"))


__all__ = ["Exits", "Slippage", "commission", "equity_curve", "mark_to_market", "orders", "pair_fills",
           "portfolio_summary", "trades", "transactions"]
