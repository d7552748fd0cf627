import numpy as np
import pandas as pd
import pytest
from conftest import collect, make_bars, to_spark
from pyspark.sql import functions as F

from barspark.functions import naming as N
from barspark.operators import clean, features, normalize, prepare, resample
from barspark.operators.quantiles import quantiles
from barspark.operators.series import BARS


def test_grid_and_resample_equal_pandas(spark):
    rng = np.random.default_rng(0)
    t = pd.DataFrame({"symbol": "AAA", "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 200_000, 400)), unit="s"), "price": rng.random(400)}).drop_duplicates("ts")
    got = collect(resample.ohlcv_grid(to_spark(spark, t), "10 min"))
    want = t.set_index("ts")["price"].resample("10min").ohlc()
    assert len(got) == len(want) and (got["pos"] == range(len(got))).all()
    for c in ("open", "high", "low", "close"):
        np.testing.assert_allclose(got[c], want[c])
    np.testing.assert_allclose(got["volume"], t.set_index("ts")["price"].resample("10min").count())


def test_grid_spans_several_grid_blocks(spark, monkeypatch):
    monkeypatch.setattr(resample, "GRID_BLOCK", 10)
    t = pd.DataFrame({"symbol": ["A", "A", "B"], "ts": pd.to_datetime(["2024-01-01 00:00", "2024-01-03 05:00", "2024-01-01 07:30"]), "price": [1.0, 2.0, 3.0]})
    got = collect(resample.grid(to_spark(spark, t), "1 hour"), "symbol", "pos")
    assert got.groupby("symbol")["pos"].agg(["min", "max", "count"]).values.tolist() == [[0, 53, 54], [0, 0, 1]]


def test_rules():
    assert resample.rule_micros("5min") == 300_000_000 and resample.rule_micros("2 hours") == 7_200_000_000 and resample.rule_micros("1D") == 86_400_000_000
    with pytest.raises(ValueError):
        resample.rule_micros("3 parsecs")


@pytest.mark.parametrize("method", ["ffill", "bfill", "interpolate"])
def test_missing_values(spark, method):
    pdf = make_bars(200, holes=0.3)
    pdf.loc[[0, 1, 399], "close"] = np.nan
    got = collect(clean.fill_missing(to_spark(spark, pdf), method))
    g = pdf.groupby("symbol")["close"]
    if method == "interpolate":
        want = g.transform(lambda s: s.interpolate().ffill().bfill())
    else:
        want = g.transform(lambda s: s.ffill().bfill() if method == "ffill" else s.bfill().ffill())
    np.testing.assert_allclose(got["close"], want)


def test_text_prices_and_empty_column(spark):
    df = spark.createDataFrame([("A", "1.5", None), ("A", "x", None), ("A", "nan", None)], "symbol string, close string, volume double")
    out = clean.coerce_numbers(df, ["close"]).collect()
    assert [r["close"] for r in out] == [1.5, None, None]
    assert clean.outlier_stats(df.withColumn("ts", F.lit("2024-01-01").cast("timestamp")), ["volume"]).first()["std"] == 1.0


@pytest.mark.parametrize("method,thr", [("zscore", 1.5), ("iqr", 0.5), ("winsorize", 3.0)])
def test_outliers_equal_pandas(spark, method, thr):
    pdf = make_bars(150)
    got = collect(clean.clamp_outliers(to_spark(spark, pdf), method, thr))

    def clamp(s):
        if method == "zscore":
            return s.clip(s.mean() - thr * s.std(), s.mean() + thr * s.std())
        q1, q3 = s.quantile(0.25), s.quantile(0.75)
        return s.clip(q1 - thr * (q3 - q1), q3 + thr * (q3 - q1)) if method == "iqr" else s.clip(s.quantile(0.01), s.quantile(0.99))

    np.testing.assert_allclose(got["close"], pdf.groupby("symbol")["close"].transform(clamp))


@pytest.mark.parametrize("parts", [1, 3, 64])
def test_quantiles_with_ties_and_outliers(spark, parts):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"symbol": "A", "ts": pd.Timestamp("2024-01-01"), "v": np.concatenate([rng.integers(0, 9, 500), [1e9, -1e9]]).astype(float)})
    q = quantiles(to_spark(spark, pdf), ["v"], (0.0, 0.01, 0.37, 0.5, 1.0), parts=parts).first()["q"]
    np.testing.assert_allclose(q, np.percentile(pdf["v"], [0, 1, 37, 50, 100]))


def test_features_equal_pandas(spark):
    pdf = make_bars(420)
    got = collect(features.add_features(to_spark(spark, pdf)))
    x, g = pdf[pdf.symbol == "AAA"].reset_index(drop=True), got[got.symbol == "AAA"].reset_index(drop=True)
    c, d = x["close"], x["close"].diff()
    up, down = d.clip(lower=0).fillna(0).rolling(14).mean(), (-d).clip(lower=0).fillna(0).rolling(14).mean()
    macd = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    want = {"sma_200": c.rolling(200).mean(), "ema_50": c.ewm(span=50, adjust=False).mean(), "rsi_14": 100 - 100 / (1 + up / down), "macd_signal": macd.ewm(span=9, adjust=False).mean(),
            "bollinger_upper": c.rolling(20).mean() + 2 * c.rolling(20).std(), "roc_10": c.pct_change(10) * 100, "volatility_30": c.pct_change().rolling(30).std() * np.sqrt(252),
            "resistance_20": x["high"].rolling(20).max(), "price_accel": c.pct_change().diff()}
    for name, w in want.items():
        np.testing.assert_allclose(g[name].to_numpy(float), w, rtol=1e-8, atol=1e-9, err_msg=name)
    assert g["rsi_14"].dropna().between(0, 100).all() and (g["atr_14"].dropna() >= 0).all()
    assert (g["day_of_week"] == x["ts"].dt.dayofweek).all() and (g["european_session"] == x["ts"].dt.hour.between(8, 15)).all()


def test_feature_groups_and_prefixed_columns(spark):
    pdf = make_bars(60).rename(columns={c: f"price_{c}" for c in ("open", "high", "low", "close")})
    out = features.add_features(to_spark(spark, pdf), groups=["technical", "patterns"])
    assert {"sma_5", "stoch_k", "doji"} <= set(out.columns) and "atr_14" not in out.columns
    bare = features.add_features(to_spark(spark, pdf[["symbol", "ts", "pos", "price_close"]]), groups=["technical", "volatility", "patterns"])
    assert "sma_5" in bare.columns and not {"stoch_k", "atr_14", "doji"} & set(bare.columns)


def test_categories():
    got = N.categorise(["open", "close_return", "sma_50", "sma_5", "rsi_14", "day_3", "quarter", "spread", "x_pct_change"])
    assert got == {"open": "price", "close_return": "price", "sma_50": "long_window", "sma_5": "short_window", "rsi_14": "medium_window", "day_3": "categorical",
                   "quarter": "categorical", "spread": "other", "x_pct_change": "returns"}


# ---------------------------------------------------------------- treatments


@pytest.fixture(scope="module")
def featured(spark):
    df = features.add_features(to_spark(spark, make_bars(400)), groups=["technical", "volatility"])
    return prepare.stage(prepare.transform_prices(df))


def test_warm_up(featured):
    r = prepare.warm_up(featured).where("symbol = 'AAA'").first()
    assert (r["n_rows"], r["short_window"], r["medium_window"], r["long_window"]) == (400, 11, 20, 200)


def one(df, sym="AAA"):
    return df.where(F.col("symbol") == sym).toPandas().sort_values("ts").reset_index(drop=True)


def test_basic_cuts_or_fills(featured):
    x = one(featured)
    cut = one(prepare.treat_basic(featured, min_points=100))
    pd.testing.assert_frame_equal(cut.drop(columns="pos"), x.iloc[200:].reset_index(drop=True)[cut.columns].drop(columns="pos"), check_dtype=False)
    kept = one(prepare.treat_basic(featured, min_points=1000))
    assert len(kept) == 400 and not kept.isna().any().any()
    np.testing.assert_allclose(kept["sma_20"], x["sma_20"].ffill().fillna(x["close_raw"].rolling(20, min_periods=1).mean()))
    np.testing.assert_allclose(kept["rsi_14"], x["rsi_14"].ffill().bfill())
    np.testing.assert_allclose(kept["bollinger_upper"], x["bollinger_upper"].ffill().bfill())


def test_advanced_by_class(featured):
    x = one(featured)
    got = one(prepare.treat_advanced(featured, min_points=100))
    assert len(got) == 200 and not got.isna().any().any() and got["pos"].tolist() == list(range(200))
    np.testing.assert_allclose(got["sma_5"], x["sma_5"].bfill().ffill()[200:])
    short = one(prepare.treat_advanced(featured, min_points=1000))
    assert len(short) == 400 and not short.isna().any().any()
    np.testing.assert_allclose(short["sma_20"], x["sma_20"].interpolate(limit_direction="both"))
    np.testing.assert_allclose(short["sma_200"], x["sma_200"].ffill().bfill())
    np.testing.assert_allclose(short["volatility_20"], x["volatility_20"].ffill().bfill())


def test_hybrid_branches(featured):
    assert len(one(prepare.treat_hybrid(featured, min_points=300))) == 400          # small
    middle = prepare.treat_hybrid(featured, min_points=200)                          # middle, long columns lose over a third
    assert "sma_200" not in middle.columns and len(one(middle)) == 400 and not one(middle).isna().any().any()
    assert len(one(prepare.treat_hybrid(featured, min_points=100))) == 200           # large


def test_band_and_empty_columns(spark):
    pdf = make_bars(50, ("AAA",))
    pdf["close_raw"] = pdf["close"]
    for c in ("bollinger_upper", "bollinger_middle", "atr_14", "rsi_14", "macd", "sma_20"):
        pdf[c] = np.nan
    got = collect(prepare.fill_by_type(to_spark(spark, pdf)))
    np.testing.assert_allclose(got["bollinger_middle"], pdf["close"])
    np.testing.assert_allclose(got["bollinger_upper"], pdf["close"] * 1.05)
    np.testing.assert_allclose(got["sma_20"], pdf["close"].rolling(20, min_periods=1).mean())
    assert (got["atr_14"] == 0.01).all() and (got["rsi_14"] == 50).all() and (got["macd"] == 0).all()


# ---------------------------------------------------------------- normalisation


def test_normaliser_protocol(spark):
    pdf = make_bars(120)
    pdf["flat"], pdf["up"], pdf["tag"] = 3.0, pdf["close"] > pdf["open"], "t"
    pdf["close_raw"] = pdf["close"]
    df = to_spark(spark, pdf)
    model = normalize.BarNormalizer().fit(df)
    out = collect(model.transform(df))
    assert (out["flat"] == 0).all() and (out["up"] == pdf["up"]).all() and (out["tag"] == "t").all()
    np.testing.assert_allclose(out["close_raw"], pdf["close"])
    np.testing.assert_allclose(out["close_return"], pdf.groupby("symbol")["close"].pct_change().fillna(0))
    np.testing.assert_allclose(out["volume"], np.log(pdf["volume"]))
    assert "close" not in out.columns


def test_inverse(spark):
    df = to_spark(spark, make_bars(80))
    rule = {"close": "zscore", "high": "minmax", "low": "robust", "volume": "pct_of_avg"}
    fit = normalize.fit_normaliser(df, rule)
    back = collect(normalize.invert_normaliser(normalize.apply_normaliser(df, fit, rule), fit, rule))
    np.testing.assert_allclose(back[list(rule)], collect(df)[list(rule)])
