import json

import numpy as np
import pandas as pd
import pytest
from conftest import collect, make_bars, to_spark
from pyspark.sql import functions as F

from barspark.operators import features, models, signals
from barspark.sources import files
from barspark.streaming import live
from checks.stream_queries import drain


def test_bar_files_with_names(spark, tmp_path):
    (tmp_path / "raw_GBPUSD_m5_20240101_20240102.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-01 00:00:00,1,2,0.5,1.5,10\n2024-01-01 00:05:00,x,2,0.5,1.5,\n")
    (tmp_path / "raw_EURUSD_m5_20240101_20240102.csv").write_text("Date,Open,High,Low,Close,Volume\nbad,1,2,0.5,1.5,10\n")
    got = files.read_symbols(spark, str(tmp_path), ["GBPUSD"]).orderBy("ts").collect()
    assert [(r["symbol"], r["timeframe"], r["open"], r["volume"]) for r in got] == [("GBPUSD", "m5", 1.0, 10.0), ("GBPUSD", "m5", None, None)]
    assert files.read_symbols(spark, str(tmp_path), ["EURUSD"]).first()["ts"] is None


def test_vendor_documents(spark, tmp_path):
    q = {"bid": 1.0, "ask": 1.00004}
    doc = {"instrument": "GBPUSD", "resolution": "M5", "prices": [{"snapshotTimeUTC": "2024-01-01T00:00:00", "openPrice": q, "highPrice": q, "lowPrice": q, "closePrice": q, "lastTradedVolume": 7}]}
    (tmp_path / "p.json").write_text(json.dumps(doc, indent=1))
    r = files.read_vendor_json(spark, str(tmp_path / "p.json")).first()
    assert r["symbol"] == "GBPUSD" and r["close"] == 1.00002 and r["volume"] == 7


def test_run_bundle_and_selection(spark, tmp_path):
    df = spark.createDataFrame([(1.0,), (2.0,)], "equity double")
    files.save_run(str(tmp_path / "runs"), "a", equity=df)
    files.save_run(str(tmp_path / "runs"), "b", equity=df.limit(1))
    files.save_run(str(tmp_path / "runs"), "a", equity=df)
    assert files.load_run(spark, str(tmp_path / "runs"), "a", ["equity"])["equity"].count() == 2
    assert files.load_run(spark, str(tmp_path / "runs"), "b", ["equity"])["equity"].count() == 1
    files.save_selection(spark, str(tmp_path / "sel"), ["x", "y"])
    assert [r["feature"] for r in spark.read.parquet(str(tmp_path / "sel/selected_features")).orderBy("rank").collect()] == ["x", "y"]


def test_model_round_trip(spark, tmp_path):
    df = features.add_features(to_spark(spark, make_bars(150)), groups=["technical"]).dropna(subset=["rsi_14", "sma_5"]).withColumn("label", (F.col("roc_1") > 0).cast("int"))
    m = models.model_pipeline(["rsi_14", "sma_5"], label="label", numTrees=5, maxDepth=3).fit(df)
    models.save_model(m, str(tmp_path / "m"), ["rsi_14", "sma_5"], "label", note=1)
    again, names, target, meta = models.load_model(spark, str(tmp_path / "m"))
    assert names == ["rsi_14", "sma_5"] and target == "label" and meta == {"note": 1}
    a, b = (collect(models.predict(x, df).select("symbol", "ts", "probability_up")) for x in (m, again))
    pd.testing.assert_frame_equal(a, b)


def test_pairing_ignores_order_and_noise(spark, tmp_path):
    def msg(kind, t, c):
        return json.dumps({"destination": "ohlc.event", "payload": {"epic": "GBP", "resolution": "MINUTE", "priceType": kind, "t": t, "o": c, "h": c + 1, "l": c - 1, "c": c}})

    lines = [msg("ask", 2000, 2.2), msg("bid", 1000, 1.0), '{"destination":"ping"}', "{", msg("bid", 2000, 2.0), msg("ask", 1000, 1.2), msg("bid", 3000, 9.0)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines))
    got = collect(drain(live.pair_quotes(live.parse_messages(spark.readStream.text(str(tmp_path / "in"))))), "ts")
    np.testing.assert_allclose(got["close"], [1.1, 2.1])
    np.testing.assert_allclose(got["spread"], [0.2, 0.2])


def test_stream_features_over_batches_equal_batch(spark, tmp_path):
    pdf = make_bars(260)
    for k, part in enumerate(np.array_split(np.arange(260), 4)):
        to_spark(spark, pdf[pdf.pos.isin(part)]).coalesce(1).write.parquet(str(tmp_path / f"in/b{k}"))
    stream = spark.readStream.schema("symbol string, ts timestamp, open double, high double, low double, close double, volume double, pos long").option(
        "recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = collect(drain(live.live_features(stream, min_rows=1)))
    want = collect(features.add_features(to_spark(spark, pdf), groups=["technical", "volatility"]))
    want = collect(features.add_features(to_spark(spark, pdf)))
    made = [c for c in want.columns if c not in (*pdf.columns, "symbol", "ts")]
    assert len(made) > 55 and set(made) <= set(got.columns)
    for c in made:
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-9, atol=1e-8, err_msg=c)


def test_live_signals_respect_the_limit(spark, tmp_path):
    pdf = make_bars(120, ("A", "B", "C"))[["symbol", "ts", "pos", "close"]]
    pdf["account"], pdf["direction"] = "m", np.where(np.random.default_rng(2).random(len(pdf)) > 0.5, 1, -1)
    to_spark(spark, pdf).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("symbol string, ts timestamp, pos long, close double, account string, direction long").parquet(str(tmp_path / "in"))
    got = drain(live.live_signals(stream, 4, 0.75, 3, 8, 1)).toPandas()
    assert len(got) and got["open_positions"].max() == 1
    free = drain(live.live_signals(stream, 4, 0.75, 3, 8, 3)).toPandas()
    batch = collect(signals.hold_signals(signals.consensus(to_spark(spark, pdf), lookback=4, threshold=0.75), 3, 8)).dropna(subset=["signal_type"])
    a = free.sort_values(["symbol", "ts"])[["symbol", "ts", "signal_type"]].values.tolist()
    assert a == batch[["symbol", "ts", "signal_type"]].values.tolist()


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.4), (0, 1, 0.8)], "label int, prediction int, probability_up double")
    m = models.classification_metrics(df).first()
    assert (m["accuracy"], m["precision"], m["recall"], m["f1"]) == (0.5, 0.5, 0.5, 0.5)
    assert models.roc_auc(df).first()["roc_auc"] == pytest.approx(0.625)
