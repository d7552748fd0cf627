"""A cross-section of the registered queries against their SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from checks.compare import TABLES, rows_of

SF = "/root/testdata/sf0.001"
NAMES = ["bars_hourly", "resample_4h", "last_known_grid", "exact_quantiles_ticks", "feature_ema", "feature_technical", "normalise_robust", "folds_by_time", "signals_macd",
         "hold_limited", "trades_close_only_stops", "equity_curve", "performance_summary", "monthly_table", "roc_auc", "stream_bars_tumbling",
         "sma_after_spike_whole", "null_time_rows", "quantiles_heavy_tail", "read_mixed_headers", "read_symbols", "drop_correlated_nulls", "predict_keeps_rows", "synthetic_volume_noisy_bounds", "random_slippage_bounds",
         "null_key_grid", "null_key_trades", "null_key_split", "null_key_holds", "null_key_normalise", "prediction_history", "rolling_extremes_long", "select_essentials", "select_balanced_capped", "pair_fills",
         "stream_pair_quotes", "stream_unmatched_quotes", "stream_features_all", "stream_features_all_warm", "stream_signals_limited", "stream_latest_upserts", "live_plan"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(entry.oracle_sql()[name])
    want = rows_of([d[0] for d in res.description], res.fetchall())
    assert got[0] == want[0] and got[1] == want[1]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
