"""Time one long series: ``python -m checks.long_series [bars]`` (default 10 million one-minute bars of one symbol), bars per second as JSON."""

from __future__ import annotations

import json
import sys
import time

from pyspark.sql import functions as F

from barspark.operators.features import add_features
from barspark.operators.series import BARS, Ewm, drop_staged, ewm, stage
from barspark.operators.signals import indicator_crossover
from checks.compare import session


def main(argv: list[str]) -> None:
    n = int(argv[0]) if argv else 10_000_000
    spark = session()
    x = spark.range(n).withColumnsRenamed({"id": "pos"})
    close = 100 + 10 * F.sin(F.col("pos") / 5000) + (F.xxhash64("pos") % 1000) / 2000
    bars = stage(x.select(F.lit("ONE").alias("symbol"), F.timestamp_seconds(F.col("pos") * 60).alias("ts"), "pos", close.alias("close")).withColumns(
        {"open": F.col("close") - 0.1, "high": F.col("close") + 0.3, "low": F.col("close") - 0.3, "volume": F.lit(1.0)}))
    took = {}
    for name, run in (("averages", lambda: ewm(bars, BARS, {f"ema_{k}": Ewm("close", k) for k in (5, 10, 20, 50, 200)})), ("features", lambda: add_features(bars)),
                      ("crossover", lambda: indicator_crossover(add_features(bars, groups=["technical"]), "ema_20", "sma_50", 0.001))):
        t0 = time.time()
        run().write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t0, 1)
    print(json.dumps({"bars": n, "seconds": took, "bars_per_second": {k: round(n / v) for k, v in took.items()}}))
    drop_staged(spark)


if __name__ == "__main__":
    main(sys.argv[1:])
