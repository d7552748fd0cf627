"""Sliding windows one value at a time against pandas, and state that is put away and taken up again."""

import numpy as np
import pandas as pd
import pytest
from conftest import make_bars, to_spark

from barspark.operators.series import by_group
from barspark.streaming import sliding


def values(n, seed, holes):
    rng = np.random.default_rng(seed)
    x = rng.normal(100, 5, n)
    x[rng.integers(0, n, 2)] = 1e12  # gone without a trace once it has left a window
    return [None if holes and rng.random() < 0.05 else float(v) for v in x]


@pytest.mark.parametrize("holes", [False, True])
@pytest.mark.parametrize("n", [2, 3, 14, 50])
def test_means_and_deviations(n, holes):
    x = values(400, n, holes)
    series = pd.Series([np.nan if v is None else v for v in x])
    mean, dev = sliding.Mean(n), sliding.Deviation(n)
    for i, v in enumerate(x):
        mean.push(v)
        dev.push(v)
        window = series.iloc[max(0, i - n + 1):i + 1]
        if i < n - 1 or window.isna().any():
            assert mean.value() is None and dev.value() is None
        else:
            assert mean.value() == pytest.approx(window.sum() / n, rel=1e-12)
            assert dev.value() == pytest.approx(np.std(window.to_numpy(), ddof=1), rel=1e-9)


@pytest.mark.parametrize("n", [1, 2, 14, 60])
def test_extremes(n):
    x = np.random.default_rng(n).integers(0, 30, 300).astype(float)
    top, low = sliding.Extreme(n, 1), sliding.Extreme(n, -1)
    for i, v in enumerate(x):
        top.push(v)
        low.push(v)
        window = x[max(0, i - n + 1):i + 1]
        assert (top.value(), low.value()) == ((None, None) if i < n - 1 else (window.max(), window.min()))


def test_state_taken_up_again_goes_on_alike():
    bars = make_bars(330, ("A",))[["open", "high", "low", "close"]].to_numpy().tolist()
    whole, cut = sliding.SeriesFeatures(), sliding.SeriesFeatures()
    for i, b in enumerate(bars):
        want = whole.add(*b)
        if i % 37 == 5:
            cut = sliding.SeriesFeatures.restored(cut.seen, cut.windows(), cut.averages())
        got = cut.add(*b)
        assert len(got) == len(sliding.NAMES)
        for (name, _), g, w in zip(sliding.NAMES, got, want):
            assert g == w or g == pytest.approx(w, rel=1e-9, abs=1e-9), name
    assert sum(map(len, cut.windows())) + len(cut.averages()) < 340


def test_groups_larger_and_smaller_than_a_batch(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"symbol": np.where(rng.random(30_000) < 0.8, "big", None), "k": rng.integers(0, 3000, 30_000), "v": np.arange(30_000)})
    pdf.loc[pdf.symbol == "big", "k"] = 1
    df = to_spark(spark, pdf).repartition(5)

    def size(t):
        import pyarrow as pa

        v = t.column("v").to_pylist()
        assert v == sorted(v)
        return pa.table({"symbol": t.column("symbol").slice(0, 1), "k": t.column("k").slice(0, 1), "n": [t.num_rows], "s": [sum(v)]})

    got = by_group(df, ["symbol", "k"], ["v"], size, "symbol string, k long, n long, s long").toPandas().fillna("none").set_index(["symbol", "k"]).sort_index()
    want = pdf.fillna("none").groupby(["symbol", "k"]).v.agg(["size", "sum"]).sort_index()
    assert got.index.equals(want.index) and (got.n == want["size"]).all() and (got.s == want["sum"]).all()
