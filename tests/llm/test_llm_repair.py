"""Conversation repair against a row-by-row search over all edits."""

import hashlib
import random

import pytest

from pyspark.sql import functions as F

from barspark.llm import repair
from barspark.llm import queries as Q

GO = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def inserted(best):
    for _ in range(4):
        for q in list(best):
            for name in ("user", "assistant"):
                if name[0] in GO[q]:
                    cost, audit, out = best[q]
                    new, to = (cost + 5, audit + "I", (*out, f"{name}:")), GO[q][name[0]]
                    if to not in best or new[:2] < best[to][:2]:
                        best[to] = new
    return best


def cheapest(rows):
    """(cost, audit, repaired) of (fault, role, text) rows: per state the least (cost, audit) of every edit sequence."""
    best = inserted({"": (0, "", ())})
    for fault, role, text in rows:
        now = {}

        def put(q, cost, audit, out):
            if q not in now or (cost, audit) < now[q][:2]:
                now[q] = (cost, audit, out)

        for q, (cost, audit, out) in best.items():
            put(q, cost + 2, audit + "D", out)
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                if role[:1] in GO[q]:
                    put(GO[q][role[:1]], cost + extra, audit + "K", (*out, f"{role}:{text}"))
                for name in ("user", "assistant"):
                    if name[0] in GO[q]:
                        put(GO[q][name[0]], cost + 1 + extra, audit + "R", (*out, f"{name}:{text}"))
        best = inserted(now)
    return min((best[q] for q in ("", "a") if q in best), key=lambda b: b[:2])


def expected(rows):
    """All figures of one conversation's (turn, role, text) rows."""
    rows = sorted(((t, r or "", x or "") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults, space = set(), [], " \t\n\x0b\x0c\r"
    for _, role, text in rows:
        kind = "blank" if not text.strip(space) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(space)[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(kind)
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, out = cheapest([(f, r, x) for f, (_, r, x) in zip(faults, rows)])
    return gaps, *[faults.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha("\n".join(out))


def got_of(df):
    x = repair.repair(df)
    return {r.conv_id: tuple(r)[1:] for r in repair.digests(x).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def made(n, seed, longest=9):
    rng = random.Random(seed)
    roles, texts = ["system", "user", "user", "assistant", "assistant", "tool", None, "", "u"], ["A.", "B!", "C?", "D", "E", "", " \t", None, "F. \n", "G,"]
    return [(c, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for c in [None, *range(n)] for _ in range(rng.randint(1, longest))]


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"part": F.lit("x"), "number": F.lit(1), "n": F.lit(2), "_h1": F.lit(3)}).repartition(3)


def by_conv(rows):
    out = {}
    for c, *r in rows:
        out.setdefault(c, []).append(tuple(r))
    return out


def test_against_search(spark):
    rows = made(400, 1)
    assert got_of(table(spark, rows)) == {c: expected(r) for c, r in by_conv(rows).items()}


def test_long_conversation_in_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(repair.ordered_chunks, "__defaults__", (40, 7))
    rng = random.Random(2)
    rows = [(c, i // 2, rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["Yes.", "No", "", f"{i}."])) for c, n in ((1, 3000), (2, 50), (3, 1)) for i in range(n)]
    rows += [(2, 7, "user", "again.")] * 100 + [(2, 7, "user", " ")] * 100
    assert got_of(table(spark, rows)) == {c: expected(r) for c, r in by_conv(rows).items()}


@pytest.mark.parametrize("symbol", ["u", "a", "s", "x", "U", "X", "d"])
def test_powers_are_repeated_steps(symbol):
    v = repair.FINISH
    for n in range(70):
        assert repair.before_run(symbol, n, repair.FINISH) == v
        v = repair.apply(repair.power(symbol, 0), v)


def test_run_longer_than_a_block(monkeypatch):
    runs = [("s", 1), ("u", 5), ("d", 4), ("a", 90), ("U", 33), ("x", 41), ("d", 3)]
    whole = repair.cheapest(runs)
    monkeypatch.setattr(repair, "UNROLL", 7)
    assert repair.cheapest(runs) == whole
    assert repair.cheapest([(s, 1) for s, n in runs for _ in range(n)])[:1] == whole[:1]
    assert "".join(repair.cheapest([(s, 1) for s, n in runs for _ in range(n)])[1]) == "".join(whole[1])


def test_query_and_edges(spark, tmp_path):
    rows = [r for r in made(200, 3) if r[0] is not None] + [(None, 1, "user", "x"), (-5, None, None, None)]
    table(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: tuple(r)[1:] for r in Q.op13_conversation_repair(spark, str(tmp_path)).collect()}
    import zlib

    want = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if h == 1 else "".join(x for x in text if x not in ".!?") if h == 2 else text
        want[c] += [(t, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    assert any(not r for r in want.values())
    assert got == {c: expected(r) if r else (0, 0, 0, 0, 0, 0, "", sha("")) for c, r in want.items()}
    assert repair.digests(repair.repair(table(spark, []))).count() == 0
