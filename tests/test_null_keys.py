"""A null key is a key like any other: every operator gives the same for it as for a name."""

import numpy as np
import pandas as pd
import pytest
from conftest import make_bars, to_spark

from pyspark.sql import functions as F

from barspark.operators import clean, features, labels, ledger, normalize, performance, prepare, resample, signals, splits
from barspark.operators.series import BARS, Series, ewm, Ewm, last, number_rows, scan
from barspark.streaming import live

NAME = "ZZZ"  # what the null stands for
TICKS = Series(tie=("n",))
CURVE = Series(keys=("account",))


def held(x):
    return signals.hold_signals(signals.consensus(x.withColumn("direction", F.when(F.col("close") > F.col("open"), 1).otherwise(-1)), lookback=3, threshold=0.6), 2, 6, block=64, fan=2)


def crossed(x):
    return signals.indicator_crossover(features.moving_averages(x, windows=(3, 9)), "sma_3", "sma_9", 0.0)


def fills(x):
    side = F.when(F.col("pos") % 3 == 0, -1.0).otherwise(1.0)
    return ledger.pair_fills(x.select("symbol", "ts", F.col("pos").alias("fill_id"), side.alias("side"), (F.col("pos") % 4 + 1).cast("double").alias("quantity"), F.col("close").alias("price")))


def marked(x):
    signalled = crossed(x)
    return ledger.mark_to_market(signalled, ledger.trades(signalled))


def curve(x):
    return x.select(F.col("symbol").alias("account"), "ts", (1000 + F.col("close") * 10).alias("equity"), (F.col("close") * 3).alias("benchmark"))


def normal(x):
    methods = {"open": "zscore", "high": "minmax", "low": "robust", "close": "pct_of_avg"}
    par = normalize.fit_normaliser(x, methods)
    return normalize.apply_normaliser(x, par, methods)


def back(x):
    methods = {"open": "zscore", "high": "minmax", "low": "robust"}
    par = normalize.fit_normaliser(x, methods)
    return normalize.invert_normaliser(normalize.apply_normaliser(x, par, methods), par, methods)


def featured(x):
    return features.add_features(x, groups=["technical", "volatility"])


OPERATORS = {
    "grid": lambda x: resample.ohlcv_grid(x.select("symbol", "ts", F.col("pos").alias("n"), F.col("close").alias("price")), "4 hours", s=TICKS),
    "resample": lambda x: resample.resample(x, "3 hours"), "last_known": lambda x: resample.resample_last_known(x, "2 hours", ["close"]), "gaps": resample.gap_report,
    "higher": lambda x: resample.higher_timeframe(x, 4), "last_rows": lambda x: resample.last_rows(x, 7), "first_of_day": resample.first_of_day, "decisions": lambda x: resample.decision_rows(x, 120),
    "numbers": lambda x: number_rows(x.drop("pos")), "numbers_by_range": lambda x: number_rows(x.drop("pos"), method="range"), "scan": lambda x: scan(x, BARS, {"l": last("close", inclusive=False)}, block=16),
    "ewm": lambda x: ewm(x, BARS, {"e": Ewm("close", 5)}), "features": features.add_features,
    "fill": lambda x: clean.fill_missing(holes(x), "ffill"), "fill_mean": lambda x: clean.fill_mean(holes(x), ["close"]), "fill_everything": lambda x: clean.fill_everything(holes(x)),
    "stats": lambda x: clean.outlier_stats(x, ["close"]), "clamp": lambda x: clean.clamp_outliers(spiked(x), "zscore", 2.0), "winsorize": lambda x: clean.clamp_outliers(spiked(x)), "counts": lambda x: clean.outlier_counts(spiked(x)),
    "nulls": lambda x: clean.null_profile(holes(x)), "clean": lambda x: clean.clean_bars(holes(x)),
    "prices": lambda x: prepare.transform_prices(x, "multi"), "from_first": lambda x: prepare.transform_prices(x, "pct_change"), "basic": lambda x: prepare.prepare_features(featured(x), "basic", min_points=10, price_method="returns"),
    "advanced": lambda x: prepare.prepare_features(featured(x), "advanced", min_points=10), "hybrid": lambda x: prepare.prepare_features(featured(x), "hybrid", min_points=10), "warm_up": lambda x: prepare.warm_up(featured(x)),
    "normal": normal, "inverse": back, "rolling_normal": lambda x: normalize.rolling_normalise(x, ["close"], 20),
    "direction": lambda x: labels.label_direction(x, "close"), "forward": labels.forward_targets, "train_test": labels.train_test, "folds": lambda x: splits.expanding_folds(x, 3),
    "crossover": crossed, "macd": signals.macd_crossover, "holds": held, "trades": lambda x: ledger.trades(crossed(x), exits=ledger.Exits(0.5, 0.5)).drop("position_id"),
    "close_only": lambda x: ledger.trades(crossed(x), reverse="close_only", exits=ledger.Exits(0.5, 0.5)).drop("position_id"), "marked": marked, "equity": lambda x: ledger.equity_curve(marked(x)), "fills": fills,
    "summary": lambda x: performance.performance_summary(curve(x), CURVE), "simple": lambda x: performance.simple_metrics(curve(x), CURVE), "rolling": lambda x: performance.rolling_metrics(curve(x), 10, CURVE),
    "monthly": lambda x: performance.monthly_table(curve(x), CURVE), "drawdowns": lambda x: performance.top_drawdowns(curve(x), 3, CURVE), "histogram": lambda x: performance.return_histogram(performance.returns(curve(x), CURVE), 5, CURVE),
    "distribution": lambda x: performance.return_distribution(performance.returns(curve(x), CURVE), CURVE), "normalised": lambda x: performance.normalised_equity(curve(x), CURVE),
    "live_batch": lambda x: live.simplify_batch(features.moving_averages(x, windows=(3, 5))),
}


def holes(x):
    return x.withColumn("close", F.when(F.col("pos") % 7 != 3, F.col("close")))


def spiked(x):
    return x.withColumn("close", F.when(F.col("pos") == 50, 1e9).otherwise(F.col("close")))


def rows(df):
    pdf = df.toPandas()
    for c in ("symbol", "account"):
        if c in pdf:
            pdf[c] = pdf[c].fillna(NAME)
    return pdf[sorted(pdf.columns)].sort_values([c for c in ("symbol", "account", "ts", "pos", "column", "bin", "year", "month", "start_time", "entry_time", "split_index", "split_type") if c in pdf]).reset_index(drop=True)


@pytest.fixture(scope="module")
def pair(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("keys"))
    named = to_spark(spark, make_bars(260, ("AAA", NAME), seed=3))
    named.write.parquet(f"{top}/a")
    named.withColumn("symbol", F.when(F.col("symbol") != NAME, F.col("symbol"))).write.parquet(f"{top}/b")
    return spark.read.parquet(f"{top}/a"), spark.read.parquet(f"{top}/b")


@pytest.mark.parametrize("name", OPERATORS)
def test_null_key(pair, name):
    want, got = (rows(OPERATORS[name](x)) for x in pair)
    keys = want.get("symbol", want.get("account", pd.Series([NAME])))
    assert len(want) and keys.isin([NAME, "all"]).any()  # an equity curve is that of all symbols
    for c in want.columns:
        if want[c].dtype.kind == "f":
            np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-9, atol=1e-9, err_msg=c)
    others = [c for c in want.columns if want[c].dtype.kind != "f"]
    pd.testing.assert_frame_equal(got[others], want[others])
