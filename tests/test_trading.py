import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import collect, make_bars, to_spark
from pyspark.sql import functions as F

from barspark.operators import labels, ledger, performance as perf, risk, select, signals, splits
from barspark.operators.series import Series
from barspark.plans import backtest


def test_periods_and_folds():
    assert splits.parse_period("2Q") == dt.timedelta(days=180) and splits.parse_period("40") == 40
    a, b = dt.datetime(2024, 1, 1), dt.datetime(2024, 4, 9)
    folds = splits.fold_ranges(a, b, 100, "30D", "10D", "15D")
    assert len(folds) == 4 and folds[1].train_start == dt.datetime(2024, 1, 16)
    assert [f.train_start for f in splits.fold_ranges(a, b, 100, 50, 20, 10)] == [0, 10, 20, 30]
    assert len(splits.fold_ranges(a, b, 100, "30D", "10D", n_splits=5)) == 5
    with pytest.raises(ValueError):
        splits.fold_ranges(a, b, 100, 90, 20, n_splits=3)
    with pytest.raises(ValueError):
        splits.fold_ranges(a, b, 100, "30D", "60D", n_splits=1000)
    k = splits.expanding_ranges(74_522, 5)
    assert [(f.train_end, f.test_end - f.train_end) for f in k][0] == (12_422, 12_420)


def test_sparse_folds_are_left_out(spark):
    pdf = pd.DataFrame({"symbol": "A", "ts": pd.to_datetime(["2024-01-01", "2024-01-02", "2024-03-01", "2024-03-02"]), "v": range(4)})
    got = splits.time_folds(to_spark(spark, pdf), "5D", "5D")
    assert got.count() == 0


def walk_crossover(diff, thr):
    state, out = 0, []
    for d in diff:
        side = 1 if d > thr else -1 if d < -thr else 0
        if side and side != state:
            out.append(("REVERSE" if state else "BUY" if side > 0 else "SELL", side))
            state = side
        else:
            out.append((None, None))
    return out


def test_crossover_equals_walk(spark):
    pdf = make_bars(500)
    got = collect(signals.crossover(to_spark(spark, pdf), F.col("close") - F.col("open"), 0.4))
    for sym, g in pdf.groupby("symbol"):
        assert got[got.symbol == sym]["signal_type"].tolist() == [k for k, _ in walk_crossover(g["close"] - g["open"], 0.4)]


@pytest.mark.parametrize("block,fan", [(16, 2), (50, 3), (8192, 256)])
def test_hold_rule_equals_walk(spark, block, fan):
    rng = np.random.default_rng(7)
    pdf = make_bars(400)[["symbol", "ts", "pos", "close"]]
    pdf["buy_ok"], pdf["sell_ok"] = rng.random(len(pdf)) < 0.3, rng.random(len(pdf)) < 0.3
    got = collect(signals.hold_signals(to_spark(spark, pdf), 4, 9, block=block, fan=fan))
    want = []
    for _, g in pdf.groupby("symbol"):
        side = held = 0
        for b, s in zip(g["buy_ok"], g["sell_ok"]):
            kind = None
            if side == 0:
                side, held = (1, 0) if b else (-1, 0) if s else (0, 0)
                kind = {1: "BUY", -1: "SELL"}.get(side)
            else:
                held += 1
                if held >= 9 or (held >= 4 and (s if side > 0 else b)):
                    kind, side, held = ("EXIT_LONG" if side > 0 else "EXIT_SHORT"), 0, 0
            want.append((side, held, kind))
    assert list(zip(got["position"], got["bars_held"], got["signal_type"])) == want


def simulate(g, reverse, stop, target):
    """Bar by bar: mark and exit first, then the signal."""
    pos, out, n = None, [], 0
    for _, r in g.iterrows():
        if pos:
            d = pos["side"]
            why = "STOP_LOSS" if (r.close - pos["fill"] * (1 - d * stop / 100)) * d <= 0 else "TAKE_PROFIT" if (r.close - pos["fill"] * (1 + d * target / 100)) * d >= 0 else None
            if why:
                out.append((*pos.values(), r.ts, r.close, why))
                pos = None
        if not np.isnan(r.signal):
            n += 1
            if pos:
                out.append((*pos.values(), r.ts, r.close, "TRADE"))
                pos = {"side": int(r.signal), "ts": r.ts, "fill": r.close} if reverse == "flip" else None
            else:
                pos = {"side": int(r.signal) if reverse == "flip" or n == 1 else 1, "ts": r.ts, "fill": r.close}
    return out


@pytest.mark.parametrize("reverse", ["flip", "close_only"])
@pytest.mark.parametrize("stop,target", [(1.0, 1.5), (50.0, 50.0)])
def test_trades_equal_simulation(spark, reverse, stop, target):
    x = signals.crossover(to_spark(spark, make_bars(600)), F.col("close") - F.col("open"), 0.5)
    got = ledger.trades(x, reverse=reverse, exits=ledger.Exits(stop, target)).where("not is_open").toPandas().sort_values(["symbol", "entry_time"])
    pdf = collect(x)
    want = [t for _, g in pdf.groupby("symbol") for t in simulate(g, reverse, stop, target)]
    cols = ["side", "entry_time", "entry_price", "exit_time", "exit_price", "exit_reason"]
    assert got[cols].values.tolist() == [list(t) for t in want]


def test_equity_over_symbols_with_different_spans(spark):
    pdf = make_bars(200)
    pdf = pdf[~((pdf.symbol == "BBB") & (pdf.pos >= 120))]
    x = signals.crossover(to_spark(spark, pdf), F.col("close") - F.col("open"), 0.5)
    t = ledger.trades(x)
    curve = collect(ledger.equity_curve(ledger.mark_to_market(x, t), capital=1000.0), "ts")
    tp = t.toPandas()
    net = tp["pnl"].sum() - tp["entry_commission"].sum() - tp["exit_commission"].sum()
    last = {s: g["close"].iloc[-1] for s, g in pdf.groupby("symbol")}
    openp = sum((last[r.symbol] - r.entry_price) * r.side for r in tp[tp.is_open].itertuples())
    assert len(curve) == 200 and abs(curve["equity"].iloc[-1] - (1000 + net + openp)) < 1e-6
    assert curve["open_positions"].iloc[-1] == tp["is_open"].sum()


def test_pair_fills_increase_decrease(spark):
    rows = [("A", "2024-01-01", 1, 1.0, 2.0, 10.0), ("A", "2024-01-02", 2, 1.0, 2.0, 20.0), ("A", "2024-01-03", 3, -1.0, 1.0, 30.0), ("A", "2024-01-04", 4, -1.0, 9.0, 25.0), ("A", "2024-01-05", 5, -1.0, 1.0, 25.0)]
    df = spark.createDataFrame(rows, "symbol string, ts string, fill_id long, side double, quantity double, price double").withColumn("ts", F.col("ts").cast("timestamp"))
    got = ledger.pair_fills(df).orderBy("fill_id").collect()
    assert [(r["type"], r["position"], r["entry_price"], r["pnl"]) for r in got] == [
        ("OPEN", 2.0, 10.0, None), ("INCREASE", 4.0, 15.0, None), ("DECREASE", 3.0, 15.0, 15.0), ("CLOSE", 0.0, 15.0, 30.0), ("OPEN", -1.0, 25.0, None)]


def walked(side, quantity, price, held=0.0, entry=0.0):
    out = []
    for s, q, p in zip(side, quantity, price):
        pnl = None
        if held == 0:
            kind, held, entry = "OPEN", s * q, p
        elif held * s > 0:
            kind, entry = "INCREASE", (entry * abs(held) + p * q) / (abs(held) + q)
            held += s * q
        else:
            kind, pnl = "CLOSE" if q >= abs(held) else "DECREASE", (p - entry) * min(q, abs(held)) * np.sign(held)
            held = 0.0 if kind == "CLOSE" else held + s * q
        out.append((kind, held, entry, pnl))
    return out


def test_block_functions_of_fills_compose():
    """Functions of blocks, one after the other and composed, against a walk from the same start."""
    rng = np.random.default_rng(4)
    for case in range(400):
        n = int(rng.integers(1, 40))
        side, q, price = rng.choice([-1, 1], n) if case % 3 else np.ones(n, int), rng.choice([0, 1, 2, 3, 0.5, 7], n), rng.uniform(1, 9, n)
        cuts = np.unique([0, n, *rng.integers(0, n + 1, 4)])
        blocks = [(a, b, ledger.FillBlock(side[a:b], np.rint(q[a:b] * ledger.UNITS).astype(np.int64))) for a, b in zip(cuts, cuts[1:])]
        whole = None
        for _, _, f in blocks:
            whole = f.table() if whole is None else ledger._then(whole, f.table())
        for start in (0.0, 1.0, -1.0, 2.5, -4.0, 40.0, -40.0):
            want, at, entry = walked(side, q, price, start, 5.0), int(start * ledger.UNITS), 5.0
            for a, b, f in blocks:
                w = f.walk(price[a:b], at)
                for i in range(b - a):
                    kind, held, e, pnl = want[a + i]
                    assert (w["type"][i], w["position"][i]) == (kind, held) and abs(w["_a"][i] * entry + w["_b"][i] - e) < 1e-9
                    if pnl is not None:
                        assert abs((price[a + i] - w["_a0"][i] * entry - w["_b0"][i]) * w["_closed"][i] - pnl) < 1e-9
                at, entry = ledger._at(f.table(), at), w["_a"][-1] * entry + w["_b"][-1]
                assert at == round(want[b - 1][1] * ledger.UNITS)
            assert ledger._at(whole, int(start * ledger.UNITS)) == at


def test_many_blocks_of_fills_at_once():
    """Blocks of many keys in one call: each as on its own, whatever its neighbours are and how long."""
    rng = np.random.default_rng(6)
    sizes = np.concatenate((rng.integers(1, 30, 3_000), [700, 1, 1, 2]))
    edges = np.concatenate(([0], np.cumsum(sizes)))
    n = int(edges[-1])
    side, units = rng.choice([-1, 1], n), rng.integers(0, 9, n) * ledger.UNITS // 2
    price, start = rng.uniform(1, 9, n), rng.integers(-6, 7, len(sizes)) * ledger.UNITS
    price[edges[50]:edges[60]] = np.inf
    many = ledger.FillBlocks(side, units, edges)
    tables, walk = many.tables(), many.walk(price, start)
    for g in [*range(45, 70), *range(0, len(sizes), 7), *range(len(sizes) - 4, len(sizes))]:
        a, b = edges[g], edges[g + 1]
        one = ledger.FillBlock(side[a:b], units[a:b])
        assert [c[g].as_py() for c in tables] == one.table()
        for name, values in one.walk(price[a:b], start[g]).items():
            np.testing.assert_array_equal(walk[name][a:b], values)


def test_only_increasing_fills_in_many_blocks(spark):
    n = 400
    pdf = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2024-01-01", periods=n, freq="1min"), "fill_id": np.arange(n), "side": 1.0, "quantity": 1.0 + np.arange(n) % 3, "price": 100.0 + np.arange(n)})
    got = ledger.pair_fills(to_spark(spark, pdf), block=20).toPandas().sort_values("fill_id")
    want = walked(pdf.side, pdf.quantity, pdf.price)
    assert got["type"].tolist() == [w[0] for w in want] and got["pnl"].isna().all()
    np.testing.assert_allclose(got[["position", "entry_price"]].to_numpy(), [w[1:3] for w in want], rtol=1e-12)


@pytest.mark.parametrize("block", [40, 65_536])
def test_pair_fills_in_blocks_equals_one_walk(spark, block):
    """One hot key in many blocks gives what a single walk gives."""
    rng = np.random.default_rng(11)
    n = 1500
    pdf = pd.DataFrame({"symbol": np.where(rng.random(n) < 0.9, "HOT", "COLD"), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 500, n), unit="min"), "fill_id": np.arange(n),
                        "side": np.where(rng.random(n) < 0.55, 1.0, -1.0), "quantity": rng.integers(1, 6, n).astype(float), "price": 100 + rng.random(n)})
    got = ledger.pair_fills(to_spark(spark, pdf), block=block).toPandas().sort_values(["symbol", "ts", "fill_id"])
    want = []
    for _, g in pdf.sort_values(["symbol", "ts", "fill_id"]).groupby("symbol"):
        held = entry = 0.0
        for r in g.itertuples():
            pnl = None
            if held == 0:
                kind, held, entry = "OPEN", r.side * r.quantity, r.price
            elif held * r.side > 0:
                kind, entry = "INCREASE", (entry * abs(held) + r.price * r.quantity) / (abs(held) + r.quantity)
                held += r.side * r.quantity
            else:
                pnl = (r.price - entry) * min(r.quantity, abs(held)) * np.sign(held)
                kind = "CLOSE" if r.quantity >= abs(held) else "DECREASE"
                held = 0.0 if kind == "CLOSE" else held + r.side * r.quantity
            want.append((kind, held, entry, pnl))
    assert got["type"].tolist() == [w[0] for w in want]
    np.testing.assert_allclose(got["position"], [w[1] for w in want])
    np.testing.assert_allclose(got["pnl"].to_numpy(float), np.array([w[3] for w in want], float))


def test_risk_reduction(spark):
    r = spark.createDataFrame([("m", "A", 50.0), ("m", "B", 30.0), ("m", "C", 20.0), ("n", "A", 1.0)], "account string, symbol string, risk double")
    e = spark.createDataFrame([("m", 1000.0), ("n", 1000.0)], "account string, equity double")
    got = {x["symbol"]: x["reduction"] for x in risk.reduction_plan(r, e, 0.03).collect()}
    assert got == {"A": 50.0, "B": 20.0}


def test_drawdowns_and_streaks(spark):
    eq = [100, 110, 99, 105, 120, 90, 95, 130, 129]
    pdf = pd.DataFrame({"run_id": "r", "ts": pd.date_range("2024-01-01", periods=9), "equity": np.array(eq, float), "pos": range(9)})
    df = to_spark(spark, pdf)
    spells = collect(perf.drawdown_spells(df), "start_time")
    np.testing.assert_allclose(spells["max_drawdown"], [-0.1, -0.25, -1 / 130])
    assert spells["duration_days"].tolist() == [1, 1, 0]
    s = perf.drawdown_summary(df).first()
    assert s["max_duration_days"] == 1 and abs(s["max_duration_drawdown"] + 0.1) < 1e-12 and abs(s["current_drawdown"] + 1 / 130) < 1e-12
    assert perf.top_drawdowns(df, 1).first()["max_drawdown"] == pytest.approx(-0.25)
    t = spark.createDataFrame([("r", f"p{i}", f"2024-01-0{i + 1}", p) for i, p in enumerate([1.0, 2.0, -1.0, 0.0, -3.0, 4.0])], "run_id string, position_id string, exit_time string, pnl double").withColumn("exit_time", F.col("exit_time").cast("timestamp"))
    r = perf.trade_streaks(t).first()
    assert (r["max_win_streak"], r["max_loss_streak"]) == (2, 3)


def test_selection_rules(spark):
    imp = spark.createDataFrame([(f"f{i}", 1.0 / (i + 1), "A" if i < 6 else "B") for i in range(10)] + [("flat", 0.0, "B"), ("close_raw", 1e-3, "P"), ("close_return", 0.02, "T")], "feature string, importance double, category string")
    top = select.select_features(imp, select.Selection("top_n", n=3))
    assert top == ["f0", "f1", "f2", "close_raw", "close_return"]
    assert "close_return" not in select.select_features(imp, select.Selection("top_n", n=3, keep_target=False))
    assert len(select.select_features(imp, select.Selection("threshold", 0.3, min_features=1))) == 3 + 2
    cum = select.select_features(imp, select.Selection("cumulative", 0.5, min_features=1))
    assert cum[:2] == ["f0", "close_raw"] or cum[0] == "f0"
    assert "flat" not in select.select_features(imp, select.Selection("threshold", 0.0, min_features=20, balance=True))
    bal = select.select_features(imp, select.Selection("top_n", n=6, balance=True, favoured=("B",)))
    assert any(f in bal for f in ("f6", "f7"))


def test_label_last_rows_are_unknown(spark):
    got = collect(labels.label_direction(to_spark(spark, make_bars(50)), "close", 2))
    assert got["label"].isna().sum() == 4


def test_backtest_tables(spark):
    out = backtest.crossover_run(to_spark(spark, make_bars(300)), "sma_5", "sma_20", 0.1)
    m = out["metrics"].first()
    assert m["run_id"] == "run" and m["total_trades"] == out["trades"].where("not is_open").count()
    assert out["transactions"].where("type = 'OPEN'").count() == out["trades"].count()
    assert isinstance(perf.CURVE, Series)
