"""Exact quantiles per key without holding a key's values in one buffer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barspark.operators.series import BARS, Series, join_by, stage


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], s: Series = BARS, parts: int | None = None) -> DataFrame:
    """``keys, column, q`` with ``q[i]`` the linearly interpolated quantile ``probs[i]``.

    1. equal values are counted together (partial aggregation);
    2. the counted values are range-partitioned on key, column and value (and written, since counts and values must see the same
       bounds), so parts hold like numbers of values whatever their spread;
    3. running counts over the parts (``parts`` rows per key and column at most) give the rank range of each, and only parts that
       hold a wanted rank are looked at value by value.
    """
    keys = [*s.keys, "column"]
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])
    long = df.select(*s.keys, F.inline(pairs)).where(F.col("v").isNotNull())
    counted = long.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    binned = stage(counted.repartitionByRange(parts, *keys, "v").withColumn("_bin", F.spark_partition_id()))
    ranks = [F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)]
    per_bin = binned.groupBy(*keys, "_bin").agg(F.sum("n").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    per_bin = per_bin.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_top": (F.sum("_n").over(whole) - 1).cast("double")})
    # wanted 0-based ranks: the two neighbours of p * (n - 1)
    wanted = per_bin.withColumn("_r", F.explode(F.array(*ranks))).withColumn("_x", F.col("_r.p") * F.col("_top"))
    wanted = wanted.withColumn("_k", F.explode(F.array_distinct(F.array(F.floor("_x"), F.ceil("_x")))))
    wanted = wanted.where((F.col("_k") >= F.col("_before")) & (F.col("_k") < F.col("_before") + F.col("_n")))
    wanted = wanted.select(*keys, "_bin", "_before", F.col("_r.i").alias("_i"), "_x", "_k")
    hit = join_by(binned, wanted.select(*keys, "_bin", "_before").distinct(), [*keys, "_bin"], "inner")
    upto = Window.partitionBy(*keys, "_bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    hit = hit.withColumn("_end", F.col("_before") + F.sum("n").over(upto)).withColumn("_start", F.col("_end") - F.col("n"))
    found = join_by(hit.drop("_before"), wanted.drop("_before"), [*keys, "_bin"], "inner").where(
        (F.col("_k") >= F.col("_start")) & (F.col("_k") < F.col("_end")))
    weight = F.when(F.col("_k") == F.floor("_x"), 1 - (F.col("_x") - F.floor("_x"))).otherwise(F.col("_x") - F.floor("_x"))
    each = found.groupBy(*keys, "_i").agg(F.sum(F.col("v") * weight).alias("q"))
    pick = [F.max(F.when(F.col("_i") == i, F.col("q"))) for i in range(len(probs))]
    return each.groupBy(*keys).agg(F.array(*pick).alias("q"))
