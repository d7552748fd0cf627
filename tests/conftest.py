import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false")
         .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
         .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def make_bars(n=300, symbols=("AAA", "BBB"), freq="1h", seed=42, holes=0.0):
    """Random walks with valid bars; ``holes`` is the share of null closes."""
    rng, out = np.random.default_rng(seed), []
    for k, sym in enumerate(symbols):
        close = 100 + 10 * k + rng.normal(0, 1, n).cumsum()
        open_ = close + rng.normal(0, 0.5, n)
        df = pd.DataFrame({"symbol": sym, "ts": pd.date_range("2024-01-01", periods=n, freq=freq), "open": open_, "high": np.maximum(open_, close) + rng.random(n),
                           "low": np.minimum(open_, close) - rng.random(n), "close": close, "volume": rng.integers(100, 1000, n).astype(float)})
        df["pos"] = np.arange(n)
        if holes:
            df.loc[rng.random(n) < holes, "close"] = np.nan
        out.append(df)
    return pd.concat(out, ignore_index=True)


def to_spark(spark, pdf):
    """NaN becomes null."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(pdf, schema=_ddl(pdf))
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _ddl(pdf):
    kinds = {"f": "double", "i": "long", "b": "boolean", "M": "timestamp"}
    return ", ".join(f"`{c}` {kinds.get(pdf[c].dtype.kind, 'string')}" for c in pdf.columns)


def collect(df, *order):
    return df.toPandas().sort_values(list(order or ("symbol", "ts"))).reset_index(drop=True)
