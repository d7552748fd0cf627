"""Repair of conversations: the cheapest edits that leave an optional system turn and then user/assistant pairs.

Rows of a conversation are classed by role initial and first fault (blank, duplicate, truncated), and equal consecutive classes
are one run. Four states read the kept roles: nothing yet, after a system turn, after a user turn, after an assistant
turn. One row is a min-plus transition between them (insertions before it included); a run of n rows is its n-th power, made from cached
binary powers. Costs are carried backwards over the runs; then the choices are unrolled forwards, taking the ASCII-least edit that is still
cheapest, so the audit is the least of all cheapest ones.

Rows are ordered by a range partitioning on (conversation, turn, role, text), so a long conversation is spread over tasks and written as
chunks. What meets in one task per conversation are its runs, which are no larger than the audit (a letter a row) that has to come
out of it; texts only pass through, in order, where the repaired conversation is hashed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from barspark.llm.common import pick, stage
from barspark.operators.series import join_by

# ---- fixed values: prices of edits, white space, legal neighbours
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")
# ---- end of fixed values
NEVER = 1 << 60
AFTER = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}  # state and role initial to state
STATES = ("", "s", "u", "a")
ENDS = ("", "a")
NEXT_ROLE = {"": "u", "s": "u", "u": "a", "a": "u"}  # the only role that may be inserted or given in a state
NAMES = {"u": "user", "a": "assistant"}
CHUNK_BYTES, CHUNK_ROWS = 1 << 18, 1 << 14
UNROLL = 1 << 10  # rows of a run whose costs are held at a time

Matrix = tuple[tuple[int, ...], ...]


# ---------------------------------------------------------------- min-plus


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def apply(m: Matrix, v: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(m[i][k] + v[k] for k in range(4)) for i in range(4))


def _matrix(cells: dict[tuple[str, str], int]) -> Matrix:
    return tuple(tuple(min(cells.get((p, q), NEVER), NEVER) for q in STATES) for p in STATES)


def _inserts() -> Matrix:
    """Cheapest insertions from state to state."""
    one = _matrix({(p, p): 0 for p in STATES} | {(p, AFTER[p, r]): INSERT for p, r in NEXT_ROLE.items()})
    return times(times(one, one), times(one, one))


def edits(symbol: str, state: str) -> Iterator[tuple[str, int, str]]:
    """(letter, cost, state after) of the edits that read one row, in ASCII order. ``d`` must go; a capital letter is truncated."""
    yield "D", DELETE, state
    if symbol != "d":
        extra = TRUNCATED if symbol.isupper() else 0
        if (state, symbol.lower()) in AFTER:
            yield "K", KEEP + extra, AFTER[state, symbol.lower()]
        yield "R", REROLE + extra, AFTER[state, NEXT_ROLE[state]]


@lru_cache(maxsize=None)
def power(symbol: str, k: int) -> Matrix:
    """The transition of 2^k rows of one symbol, insertions included. There are nine symbols."""
    if k:
        return times(power(symbol, k - 1), power(symbol, k - 1))
    cells: dict[tuple[str, str], int] = {}
    for p in STATES:
        for _, cost, q in edits(symbol, p):
            cells[p, q] = min(cost, cells.get((p, q), NEVER))
    return times(_inserts(), _matrix(cells))


def before_run(symbol: str, n: int, v: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to the end before ``n`` rows of a symbol, from those after them."""
    for k in range(n.bit_length()):
        if n >> k & 1:
            v = apply(power(symbol, k), v)
    return v


FINISH = tuple(min(c for c, q in zip(row, STATES) if q in ENDS) for row in _inserts())  # costs to the end after the last row


def unroll(symbol: str, n: int, state: str, after: tuple[int, ...]) -> tuple[str, str]:
    """(audit, state at the end) of ``n`` rows of a symbol; ``after`` are the costs behind them."""
    out = []
    for at in range(0, n, UNROLL):
        here = min(UNROLL, n - at)
        costs = [before_run(symbol, n - at - here, after)]
        for _ in range(here):
            costs.append(apply(power(symbol, 0), costs[-1]))
        costs.reverse()
        for now, then in zip(costs, costs[1:]):
            state = _row(symbol, state, now, then, out)
    return "".join(out), state


def _row(symbol: str, state: str, now: tuple[int, ...], then: tuple[int, ...], out: list[str]) -> str:
    """Append the least cheapest edits up to and including the one that reads the row; the state after it."""
    while True:
        left = now[STATES.index(state)]
        fits = {e: q for e, cost, q in edits(symbol, state) if cost + then[STATES.index(q)] == left}
        if "D" in fits:
            out.append("D")
            return state
        given = AFTER[state, NEXT_ROLE[state]]
        if INSERT + now[STATES.index(given)] == left:
            out.append("I")
            state = given
            continue
        e = min(fits)
        out.append(e)
        return fits[e]


def cheapest(runs: list[tuple[str, int]]) -> tuple[int, list[str], list[str]]:
    """Cost, and per run the audit of its rows and the state before it; insertions at the end belong to the last run. No runs: 0 and nothing."""
    costs = [FINISH]
    for symbol, n in reversed(runs):
        costs.append(before_run(symbol, n, costs[-1]))
    costs.reverse()
    out, before, state = [], [], ""
    for (symbol, n), after in zip(runs, costs[1:]):
        before.append(state)
        audit, state = unroll(symbol, n, state, after)
        out.append(audit)
    while out and state not in ENDS:
        out[-1] += "I"
        state = AFTER[state, NEXT_ROLE[state]]
    return costs[0][0], out, before


# ---------------------------------------------------------------- rows


def without_space(text: Column) -> Column:
    """Text without white space at its end."""
    return F.rtrim(text, F.lit(SPACE))


def ordered_chunks(turns: DataFrame, chunk_bytes: int = CHUNK_BYTES, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(conv_id, part, number, symbols, lengths, roles, texts, figures): chunks of the rows in order; only rows that may stay carry texts.

    Rows are ordered by turn (nulls first), then role and text; equal rows are one row with a count up to here.
    """
    rows = turns.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumns({"_h1": F.xxhash64("role", "text"), "_h2": F.xxhash64("text", "role")})
    rows = stage(rows)
    filled = without_space(F.col("text")) != ""
    order = F.struct(F.col("turn").isNotNull(), "turn")
    firsts = rows.where(filled).groupBy("conv_id", "_h1", "_h2").agg(F.min(order).alias("_first"))
    x = join_by(rows, firsts, ["conv_id", "_h1", "_h2"])
    fault = F.when(~filled, "blank").when(~F.col("_first").eqNullSafe(order), "duplicate").when(~F.right(without_space(F.col("text")), F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    x = x.select("conv_id", "turn", "role", "text", "n", fault.alias("fault"))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = x.repartitionByRange(parts, "conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = x.schema["conv_id"].dataType.simpleString()
    conv = to_arrow_type(x.schema["conv_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, chunk = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            for conv_id, turn, role, text, n, fault in zip(*[c.to_pylist() for c in batch.columns]):
                while n:  # the copies of a row may fill more than one chunk
                    if chunk is None or chunk.conv_id != conv_id or chunk.full(chunk_bytes, chunk_rows):
                        if chunk:
                            yield chunk.batch(part, number, conv)
                            number += 1
                        chunk = _Chunk(conv_id)
                    took = 1 if fault in ("", "truncated") else min(n, chunk_rows)
                    chunk.add(turn, role, text, fault, took)
                    n, fault = n - took, fault if fault == "blank" else "duplicate"
        if chunk:
            yield chunk.batch(part, number, conv)

    return stage(x.mapInArrow(run, f"conv_id {kind}, {_CHUNK}"))


_FIGURES = ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high")
_CHUNK = ("part int, number int, symbols string, lengths array<bigint>, roles array<string>, texts array<string>, first string, last string, " + ", ".join(f"{f} bigint" for f in _FIGURES))


class _Chunk:
    """Consecutive rows of one conversation. ``turns`` counts distinct known turns, ``low`` and ``high`` bound them."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.symbols, self.lengths, self.roles, self.texts = conv_id, [], [], [], []
        self.first = self.last = self.low = self.high = None
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.size = self.rows = 0

    def full(self, chunk_bytes: int, chunk_rows: int) -> bool:
        return self.size >= chunk_bytes or self.rows >= chunk_rows

    def add(self, turn, role: str, text: str, fault: str, n: int) -> None:
        initial = role[:1]
        if self.rows:
            self.illegal += self.last + initial not in LEGAL
        else:
            self.first = initial
        self.illegal += (n - 1) * (initial + initial not in LEGAL)
        self.last = initial
        self.rows += n
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if fault:
            setattr(self, fault, getattr(self, fault) + n)
        symbol = "d"
        if fault not in ("blank", "duplicate"):
            symbol = initial if initial in ("s", "u", "a") else "x"
            symbol = symbol.upper() if fault else symbol
            self.roles.append(role)
            self.texts.append(text)
            self.size += len(text)
        if self.symbols and self.symbols[-1] == symbol:
            self.lengths[-1] += n
        else:
            self.symbols.append(symbol)
            self.lengths.append(n)

    def batch(self, part: int, number: int, conv: pa.DataType) -> pa.RecordBatch:
        cells = [self.conv_id, part, number, "".join(self.symbols), self.lengths, self.roles, self.texts, self.first, self.last, *[getattr(self, f) for f in _FIGURES]]
        kinds = [conv, pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.string(), *[pa.int64()] * len(_FIGURES)]
        names = ["conv_id", "part", "number", "symbols", "lengths", "roles", "texts", "first", "last", *_FIGURES]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], names)


_SUMS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def solved(chunks: DataFrame) -> DataFrame:
    """(conv_id, part, number, audit, state, figures): the audit of every chunk and the state before it; the conversation's figures stand at its first chunk."""
    x = chunks.drop("roles", "texts")
    conv = x.schema["conv_id"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("part", "ascending"), ("number", "ascending")])
        c = {n: t.column(n).to_pylist() for n in t.column_names if n != "conv_id"}
        runs = [list(zip(s, n)) for s, n in zip(c["symbols"], c["lengths"])]
        cost, audits, before = cheapest([r for one in runs for r in one])
        ends = list(accumulate([len(one) for one in runs], initial=0))
        illegal = sum(c["illegal"]) + sum(a + b not in LEGAL for a, b in zip(c["last"], c["first"][1:]))
        low, high = [v for v in c["low"] if v is not None], [v for v in c["high"] if v is not None]
        known = sum(c["turns"]) - sum(a == b for a, b in zip(high, low[1:]))  # a turn may go on in the next chunk
        sums = (high[-1] - low[0] + 1 - known if low else 0, *[sum(c[f]) for f in ("blank", "duplicate", "truncated")], illegal, cost)
        cols = [t.column("conv_id"), t.column("part"), t.column("number"), pa.array(["".join(audits[a:b]) for a, b in zip(ends, ends[1:])], pa.string()),
                pa.array([before[a] for a in ends[:-1]], pa.string()), *[pa.array([v] + [0] * (t.num_rows - 1), pa.int64()) for v in sums]]
        return pa.Table.from_arrays(cols, ["conv_id", "part", "number", "audit", "state", *_SUMS])

    return x.groupBy("conv_id").applyInArrow(run, f"conv_id {conv}, part int, number int, audit string, state string, " + ", ".join(f"{f} bigint" for f in _SUMS))


def repaired_turns(roles: list[str], texts: list[str], runs: list[tuple[str, int]], audit: str, state: str) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits of one chunk. ``roles`` and ``texts`` leave out rows that must go."""
    out_roles, out_texts = [], []
    symbols = (s for s, n in runs for _ in range(n))
    kept = iter(zip(roles, texts))
    for e in audit:
        role, text = "", ""
        if e != "I" and next(symbols) != "d":
            role, text = next(kept)
        if e != "D":
            to = role[:1] if e == "K" else NEXT_ROLE[state]
            state = AFTER[state, to]
            out_roles.append(role if e == "K" else NAMES[to])
            out_texts.append(text)
    return out_roles, out_texts


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Repaired conversations in chunks: (conv_id, part, number, audit, roles, texts, gaps, blank, duplicate, truncated, illegal, cost).

    Within a conversation chunks are ordered by (part, number); the figures stand at its first chunk and are zero at the others. ``audit`` has a
    letter for every edit: Keep, Rerole, Delete, Insert. Null roles and texts count as empty (a null role has no initial, a null text is
    blank), a null conv_id is a conversation, null turns come first, rows of one turn are ordered by role and text. Other columns take
    no part; a conversation without rows doesn't appear, and an empty table gives no rows.
    """
    x = pick(turns, conv_id=conv_id, turn=turn, role=role, text=text).withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    chunks = ordered_chunks(x)
    kind = x.schema["conv_id"].dataType.simpleString()
    x = chunks.select("part", "number", "symbols", "lengths", "roles", "texts").join(solved(chunks), ["part", "number"])
    kept, inputs = ["conv_id", "part", "number", "audit", *_SUMS], ["roles", "texts", "symbols", "lengths", "audit", "state"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in inputs])
            made = [repaired_turns(roles, texts, list(zip(symbols, lengths)), audit, state) for roles, texts, symbols, lengths, audit, state in rows]
            cols = [b.column(b.schema.get_field_index(c)) for c in kept] + [pa.array([m[i] for m in made], pa.list_(pa.string())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(cols, [*kept, "roles", "texts"])

    return x.select(*kept, *[c for c in inputs if c not in kept]).mapInArrow(run, f"conv_id {kind}, part int, number int, audit string, " + ", ".join(f"{f} bigint" for f in _SUMS) + ", roles array<string>, texts array<string>")


class _Digest:
    def __init__(self, row: dict) -> None:
        self.conv_id, self.figures = row["conv_id"], {f: row[f] for f in _SUMS}
        self.audit, self.sha, self.between = [], hashlib.sha256(), b""

    def add(self, row: dict) -> None:
        self.audit.append(row["audit"])
        for role, text in zip(row["roles"], row["texts"]):
            self.sha.update(self.between + f"{role}:{text}".encode())
            self.between = b"\n"

    def row(self) -> dict:
        return {"conv_id": self.conv_id, **self.figures, "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest()}


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) per conversation of ``repair``; its texts pass through once, in order."""
    kind = repaired.schema["conv_id"].dataType
    x = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")
    schema = pa.schema([("conv_id", to_arrow_type(kind)), *[(f, pa.int64()) for f in _SUMS], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = None
        for b in batches:
            done = []
            for row in b.to_pylist():
                if one is None or row["conv_id"] != one.conv_id:
                    if one:
                        done.append(one.row())
                    one = _Digest(row)
                one.add(row)
            yield pa.RecordBatch.from_pylist(done, schema)
        if one:
            yield pa.RecordBatch.from_pylist([one.row()], schema)

    return x.mapInArrow(run, f"conv_id {kind.simpleString()}, " + ", ".join(f"{f} bigint" for f in _SUMS) + ", audit string, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """Conversation rows with faults by crc32 of ``conv_id:turn`` modulo 20 (nulls a space): 0 drops, 1 empties, 2 strips ends of sentences, 3 repeats, 4 makes it the user's."""
    x = pick(turns, conv_id="conv_id", turn="turn", role="role", text="text").withColumns({c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")})
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    x = x.withColumn("_c", (F.crc32(name.cast("binary")) % 20).cast("int")).where("_c <> 0")
    text = F.when(F.col("_c") == 1, "").when(F.col("_c") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    x = x.withColumns({"text": text, "role": F.when(F.col("_c") == 4, "user").otherwise(F.col("role"))})
    return x.withColumn("_copy", F.explode(F.when(F.col("_c") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_c", "_copy")
