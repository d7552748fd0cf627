import numpy as np
import pandas as pd
import pytest
from conftest import collect, make_bars, to_spark
from pyspark.sql import functions as F

from barspark.operators import series as S
from barspark.operators.features import _smoothed_mix


@pytest.fixture(scope="module")
def pdf():
    return make_bars(700, ("AAA", "BBB", "CCC"), holes=0.2)


@pytest.mark.parametrize("block", [7, 64, 5000])
def test_scans_do_not_depend_on_block_size(spark, pdf, block):
    df = to_spark(spark, pdf).repartition(5)
    got = collect(S.scan(df, S.BARS, {"p": S.last("close"), "b": S.last("close", inclusive=False), "n": S.next_("close"), "a": S.next_("close", inclusive=False),
                                      "t": S.running_sum("volume"), "m": S.running_max("high"), "w": S.running_min("low")}, block=block))
    g = pdf.groupby("symbol")
    want = pd.DataFrame({"p": g["close"].ffill(), "n": g["close"].bfill(), "t": g["volume"].cumsum(), "m": g["high"].cummax(), "w": g["low"].cummin()})
    want["b"] = want.groupby(pdf["symbol"])["p"].shift()
    want["a"] = want.groupby(pdf["symbol"])["n"].shift(-1)
    for c in want:
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-12)


@pytest.mark.parametrize("block", [16, 100, 4096])
def test_frames_see_neighbours_across_blocks(spark, pdf, block):
    df = to_spark(spark, pdf)
    got = collect(S.frames(df, S.BARS, lambda x, w: x.withColumns({"sma": S.rolling(F.avg, "high", w, 12), "ahead": F.lead("high", 3).over(w), "back": F.lag("high", 11).over(w)}),
                           back=12, ahead=3, block=block))
    g = pdf.groupby("symbol")["high"]
    np.testing.assert_allclose(got["sma"], g.transform(lambda s: s.rolling(12).mean()), rtol=1e-12)
    np.testing.assert_allclose(got["ahead"], g.shift(-3))
    np.testing.assert_allclose(got["back"], g.shift(11))
    with pytest.raises(ValueError):
        S.frames(df, S.BARS, lambda x, w: x, back=block + 1, block=block)


def test_rolling_needs_all_values(spark, pdf):
    got = collect(S.frames(to_spark(spark, pdf), S.BARS, lambda x, w: x.withColumn("m", S.rolling(F.avg, "close", w, 4)), back=4, block=32))
    np.testing.assert_allclose(got["m"], pdf.groupby("symbol")["close"].transform(lambda s: s.rolling(4).mean()))


@pytest.mark.parametrize("block,adjust", [(32, False), (256, True), (2048, False)])
def test_exponential_averages_equal_pandas(spark, block, adjust, monkeypatch):
    monkeypatch.setattr(S, "EWM_BLOCK", block)
    pdf = make_bars(900)
    spans = (2, 5, 20, 200)
    got = collect(S.ewm(to_spark(spark, pdf), S.BARS, {f"e{n}": S.Ewm("close", n, adjust) for n in spans}))
    for n in spans:
        want = pdf.groupby("symbol")["close"].transform(lambda s: s.ewm(span=n, adjust=adjust).mean())
        np.testing.assert_allclose(got[f"e{n}"], want, rtol=1e-10)


def test_smoothed_average_is_a_mix():
    x = pd.Series(np.random.default_rng(1).normal(size=400)).cumsum()
    a, b = _smoothed_mix(12, 9)
    want = x.ewm(span=12, adjust=False).mean().ewm(span=9, adjust=False).mean()
    np.testing.assert_allclose(a * x.ewm(span=12, adjust=False).mean() + b * x.ewm(span=9, adjust=False).mean(), want)


@pytest.mark.parametrize("method", ["time", "range"])
def test_row_numbers(spark, pdf, method):
    shuffled = pdf.drop(columns="pos").sample(frac=1, random_state=3)
    got = collect(S.number_rows(to_spark(spark, shuffled), S.BARS, "6 hours", method))
    assert got["pos"].tolist() == pdf["pos"].tolist()


def test_row_numbers_when_one_bucket_holds_everything(spark):
    pdf = pd.DataFrame({"symbol": "HOT", "ts": pd.Timestamp("2024-01-01"), "id": range(5000)})
    s = S.Series(tie=("id",))
    got = collect(S.number_rows(to_spark(spark, pdf), s, method="range"), "id")
    assert (got["pos"] == got["id"]).all()


def test_a_symbol_is_not_changed_by_others(spark, pdf):
    spec = {"e": S.Ewm("high", 20)}
    alone = collect(S.ewm(to_spark(spark, pdf[pdf.symbol == "BBB"]), S.BARS, spec))
    together = collect(S.ewm(to_spark(spark, pdf), S.BARS, spec))
    np.testing.assert_allclose(alone["e"], together.loc[together.symbol == "BBB", "e"], rtol=1e-13)


def test_no_window_is_keyed_by_symbol_alone(spark, pdf):
    """The plan partitions the bar rows by (symbol, block)."""
    from barspark.operators.features import add_features

    plan = add_features(to_spark(spark, pdf.dropna()), groups=["technical", "volatility", "patterns"])._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_key" in line for line in windows) and "struct(symbol, symbol" in plan and "_blk, _blk" in plan  # the key is (symbol, block)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("n", [1, 2, 5, 37, 50, 200])
def test_long_means_forget_what_left_the_window(spark, n):
    pdf = make_bars(900, symbols=("A",))
    pdf.loc[10, "close"] = 1e18
    pdf.loc[[300, 301], "close"] = np.nan
    df = to_spark(spark, pdf)
    df = df.withColumn("close", F.when(F.col("pos") == 500, float("nan")).otherwise(F.col("close")))
    got = collect(S.frames(df, S.BARS, lambda x, w: S.rolling_means(x, w, {"m": ("close", n)}), back=n, block=256))
    known = pdf["close"].mask(pdf["pos"] == 500)
    want = np.array([known[max(0, i - n + 1):i + 1].mean() if i >= n - 1 and known[i - n + 1:i + 1].notna().all() else np.nan for i in range(len(known))])
    np.testing.assert_allclose(got["m"].astype(float), want, rtol=1e-9)


@pytest.mark.parametrize("method", ["time", "range"])
def test_rows_without_time_or_key_are_numbered(spark, method):
    df = spark.createDataFrame([("A", 5, 1), ("A", None, 2), ("A", 3, 3), (None, 1, 4), (None, None, 5)], "symbol string, s long, id long")
    df = df.select("symbol", F.timestamp_seconds("s").alias("ts"), "id")
    s = S.Series(tie=("id",))
    got = {r.id: r.pos for r in S.number_rows(df, s, method=method).collect()}
    assert got == {2: 0, 3: 1, 1: 2, 5: 0, 4: 1}
    run = {r.id: r.n for r in S.scan(S.number_rows(df, s, method=method), s, {"n": S.running_sum("id")}, block=1).collect()}
    assert run == {2: 2, 3: 5, 1: 6, 5: 5, 4: 9}


def test_short_span_next_to_a_long_look_back(spark):
    pdf = make_bars(2600, symbols=("A",))
    specs = {"fast": S.Ewm("close", 1.5)}
    back = S.ewm_block(specs) + 100
    got = collect(S.ewm(to_spark(spark, pdf), S.BARS, specs, back=back, make=lambda x, w: x.withColumn("old", F.lag("close", back).over(w))))
    np.testing.assert_allclose(got["old"].astype(float), pdf["close"].shift(back))
    np.testing.assert_allclose(got["fast"], pdf["close"].ewm(span=1.5, adjust=False).mean(), rtol=1e-9)
