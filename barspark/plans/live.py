"""Price messages to signals on a stream: parse, pair, all features, model, signals.

Every step is a query of its own over the table the step before appends to, so each has one stateful operator and its own
checkpoint, a step can be started anew without the others, and bars, scored rows and signals can be read while the streams run. The file sink
keeps a log of its batches: a row is in each table exactly once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.operators import signals
from barspark.streaming import live

def _appended(df: DataFrame, folder: str, name: str, trigger: dict) -> DataFrame:
    """Start appending a stream to a table; that table as a stream of its own."""
    rows, jvm = f"{folder}/{name}/rows", df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(rows)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)  # a stream reads a folder that is there
    query = live.append_bars(df, rows, f"{folder}/{name}/state", **trigger)
    if "availableNow" in trigger:
        query.awaitTermination()
    return df.sparkSession.readStream.schema(df.schema).parquet(rows)


def bars_of_messages(raw: DataFrame, c: str = "value") -> DataFrame:
    """Midpoint bars of a stream of message lines; both sides are paired in one state."""
    b = live.pair_quotes(live.parse_messages(raw, c))
    return b.select(F.col("epic").alias("symbol"), "ts", "open", "high", "low", "close", "spread")


def run(raw: DataFrame, folder: str, score: Callable[[DataFrame], DataFrame], history: DataFrame | None = None, account: str = "main", probability: float = 0.5, lookback: int = 10,
        threshold: float = 0.7, min_hold: int = 12, max_hold: int = 288, max_positions: int = 5, trigger: dict | None = None) -> dict[str, str]:
    """Start the whole chain; the folders of its tables: bars, scored, signals.

    ``score`` adds ``probability_up`` to feature rows: ``lambda x: models.predict(model, x)``, or any projection. ``history`` are bars before the
    stream, from which windows and averages go on. With ``availableNow`` (the default) every step runs to the end of its input.
    """
    trigger = trigger or {"availableNow": True}
    bars = _appended(bars_of_messages(raw), folder, "bars", trigger)
    scored = score(live.live_features(bars, history)).withColumn("direction", signals.direction("probability_up", probability))
    scored = _appended(scored, folder, "scored", trigger)
    found = live.live_signals(scored.withColumn("account", F.lit(account)), lookback, threshold, min_hold, max_hold, max_positions)
    _appended(found, folder, "signals", trigger)
    return {n: f"{folder}/{n}/rows" for n in ("bars", "scored", "signals")}
