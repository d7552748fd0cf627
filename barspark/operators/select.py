"""Feature importance and selection.

Importance tables have one row per feature column, a few hundred at most, so plain windows
and small Python sets over them are fine; everything that touches bar rows is a Spark job.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.functions.columns import ratio
from barspark.functions.naming import IMPORTANCE_CATEGORIES, METADATA_CATEGORIES, category_column, price_return_target
from barspark.operators.clean import null_profile, split_numeric
from barspark.operators.labels import label_value
from barspark.operators.models import importances, model_pipeline, regression_metrics
from barspark.operators.series import BARS, Series, stage
from barspark.operators.splits import expanding_folds

# ---- fixed values
ESSENTIAL = ["open_raw", "high_raw", "low_raw", "close_raw", "open_original", "high_original", "low_original",
             "close_original", "Date", "date", "timestamp"]
CONSTANT_LIMIT = 1e-10
DEFAULT_SHARE = 0.2
# ---- end of fixed values


def validate(df: DataFrame, target: str, s: Series = BARS) -> str:
    """The usable target column; raises when the data cannot be analysed."""
    if not df.limit(1).count():
        raise ValueError("no data")
    found = price_return_target(df, target)
    if found is None:
        raise ValueError(f"no target {target!r} and no return column")
    numeric, _ = split_numeric(df, {*s.keys, s.ts, s.pos})
    if found not in numeric:
        raise ValueError(f"target {found!r} is not numeric")
    if len(numeric) < 3:
        raise ValueError("at least two numeric features are needed")
    return found


def usable_features(df: DataFrame, target: str, s: Series = BARS) -> list[str]:
    """Numeric columns without nulls that are not constant, found in one aggregation."""
    numeric, _ = split_numeric(df, {*s.keys, s.ts, s.pos, *s.tie, target})
    tests = [((F.count(F.lit(1)) == F.count(c)) & (F.min(c) < F.max(c))).alias(c) for c in numeric]
    row = df.agg(*tests).first()
    return [c for c in numeric if row[c]]


def category_totals(imp: DataFrame) -> DataFrame:
    return imp.groupBy("category").agg(F.sum("importance").alias("importance"), F.count(F.lit(1)).alias("n_features"))


def with_category(imp: DataFrame) -> DataFrame:
    return imp.withColumn("category", category_column(F.col("feature"), IMPORTANCE_CATEGORIES))


def feature_metadata(df: DataFrame, s: Series = BARS) -> DataFrame:
    """column, category, nan_count and nan_pct of every categorised column, over all symbols."""
    prof = null_profile(df, s).groupBy("column").agg(F.sum("null_count").alias("nan_count"), F.sum("n_rows").alias("_n"))
    out = prof.withColumn("category", category_column(F.col("column"), METADATA_CATEGORIES, None)).where("category is not null")
    return out.select("column", "category", "nan_count", (F.col("nan_count") / F.col("_n") * 100).alias("nan_pct"))


# ---------------------------------------------------------------- importance


def forest_importance(df: DataFrame, target: str = "close_return", lookback: int = 1, n_splits: int = 5, s: Series = BARS,
                      features: Sequence[str] | None = None, **params) -> tuple[DataFrame, DataFrame]:
    """Expanding folds, a forest per fold on standardised features: mean importances and fold metrics."""
    target = validate(df, target, s)
    features = list(features or usable_features(df, target, s))
    labelled = label_value(df, target, lookback, s).where("label is not null")
    tagged = stage(expanding_folds(labelled, n_splits, s))
    imp = scores = None
    for f in range(n_splits):
        rows = tagged.where(F.col("split_index") == f)
        model = model_pipeline(features, "forest", "regression", **params).fit(rows.where("split_type = 'train'"))
        one = importances(model, features, df.sparkSession)
        m = regression_metrics(model.transform(rows.where("split_type = 'test'"))).withColumn("fold", F.lit(f + 1))
        imp = one if imp is None else imp.unionByName(one)
        scores = m if scores is None else scores.unionByName(m)
    mean = imp.groupBy("feature").agg(F.avg("importance").alias("importance"))
    return with_category(mean), scores.select("fold", "mse", "mae", "r2", F.col("n").alias("test_samples"))


def single_fit_importance(df: DataFrame, features: Sequence[str], label: str, kind: str = "forest", task: str = "regression", **params) -> DataFrame:
    model = model_pipeline(features, kind, task, label, **params).fit(df.where(F.col(label).isNotNull()))
    return importances(model, features, df.sparkSession)


# ---------------------------------------------------------------- selection


@dataclass(frozen=True)
class Selection:
    method: str = "threshold"  # threshold | top_n | cumulative | share
    threshold: float = 0.01
    n: int | None = None
    min_features: int = 10
    max_features: int = 50
    target: str = "close_return"
    keep_target: bool = True
    balance: bool = False
    favoured: tuple[str, ...] = ()


def selection(imp: DataFrame, rule: Selection = Selection()) -> DataFrame:
    """(feature, place, why) of the features kept from ``feature, importance[, category]``, places from 0.

    Every condition is a column over the importance table. Features that don't vary (``CONSTANT_LIMIT``) count for nothing but may be
    essential or the target. ``leading``: among the first of the method's number by importance. ``essential``: always kept. ``balance``: a
    category with fewer kept features than the average one gets its best others, as many as the average (half of it if not favoured);
    if that is too many, both parts are cut in proportion. ``target``: kept last, or left out.
    """
    by_rank, whole = Window.orderBy(F.desc("importance"), "feature"), Window.partitionBy()
    category = F.col("category") if "category" in imp.columns else F.lit(None).cast("string")
    x = imp.select("feature", "importance", category.alias("category")).withColumns({"live": F.col("importance") > CONSTANT_LIMIT, "rank": F.row_number().over(by_rank)})
    upto = by_rank.rowsBetween(Window.unboundedPreceding, 0)
    value = F.when(F.col("live"), F.col("importance"))
    x = x.withColumns({"live_rank": F.count(value).over(upto), "n_live": F.count(value).over(whole), "share": ratio(F.sum(value).over(upto), F.sum(value).over(whole))})
    n = F.col("n_live").cast("long")
    least, most = F.lit(rule.min_features), F.lit(rule.max_features)
    limit = rule.threshold if 0 < rule.threshold <= 1 else 0.9
    wanted = {"top_n": F.lit(rule.n) if rule.n else F.least(most, F.floor(n / 2)),
              "threshold": F.greatest(least, F.count_if(F.col("live") & (F.col("importance") >= rule.threshold)).over(whole)),
              "cumulative": F.greatest(least, F.lit(1), F.count_if(F.col("live") & (F.col("share") <= limit)).over(whole))}
    wanted = wanted.get(rule.method, F.greatest(least, F.floor(n * DEFAULT_SHARE)))
    x = x.withColumn("wanted", wanted if rule.method == "top_n" else F.least(most, wanted))
    essential = F.array_position(F.array(*[F.lit(c) for c in ESSENTIAL]), F.col("feature"))
    x = x.withColumn("leading", F.col("live") & (F.col("live_rank") <= F.col("wanted")))
    x = x.withColumn("why", F.when(F.col("leading"), "leading").when(essential > 0, "essential"))
    x = x.withColumn("order", F.when(F.col("leading"), F.col("live_rank")).when(essential > 0, F.lit(1 << 20) + essential))
    if rule.balance and "category" in imp.columns:
        x = _balanced(x, rule)
    target = F.col("feature") == rule.target
    if rule.keep_target:
        x = x.withColumns({"order": F.coalesce("order", F.when(target, F.lit(1 << 30))), "why": F.coalesce("why", F.when(target, F.lit("target")))})
        kept = F.col("live") | target
    else:
        kept = F.col("live") & ~target
    x = x.where(F.col("order").isNotNull() & kept)
    return x.select("feature", (F.row_number().over(Window.orderBy("order")) - 1).alias("place"), "why")


def _balanced(x: DataFrame, rule: Selection) -> DataFrame:
    """Fill ``order`` and ``why`` for features that top up a small category, and take back what is too many."""
    whole, own = Window.partitionBy(), Window.partitionBy("category")
    x = x.withColumn("first", F.min("rank").over(own)).withColumn("mean", F.greatest(F.lit(1), F.floor(F.count("order").over(whole) / F.count_if(F.col("rank") == F.col("first")).over(whole))))
    room = F.when(F.col("category").isin(list(rule.favoured)), F.col("mean")).otherwise(F.greatest(F.lit(1), F.floor(F.col("mean") / 2)))
    nth = F.count_if(F.col("order").isNull()).over(own.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("more", F.col("order").isNull() & (F.count("order").over(own) < F.col("mean")) & (nth <= room))
    x = x.withColumn("order", F.when(F.col("more"), F.lit(1 << 25) + F.col("first") * (1 << 12) + F.col("rank")).otherwise(F.col("order")))
    n, extra = F.count("order").over(whole), F.count_if("more").over(whole)
    x = x.withColumns({"n": n, "extra": extra, "why": F.when(F.col("more"), "balance").otherwise(F.col("why"))})
    old = F.floor(F.lit(rule.max_features) * (F.col("n") - F.col("extra")) / F.col("n"))
    within = F.row_number().over(Window.partitionBy("more", F.col("order").isNull()).orderBy("order"))
    stays = (F.col("n") <= rule.max_features) | (F.when(F.col("more"), within <= F.lit(rule.max_features) - old).otherwise(within <= old))
    return x.withColumn("stays", stays).withColumn("order", F.when(F.col("stays"), F.col("order"))).withColumn("why", F.when(F.col("stays"), F.col("why")))


def select_features(imp: DataFrame, rule: Selection = Selection()) -> list[str]:
    """Names to keep, in order (see ``selection``)."""
    return [r["feature"] for r in selection(imp, rule).orderBy("place").collect()]


def apply_selection(df: DataFrame, features: Sequence[str], s: Series = BARS) -> DataFrame:
    """Key and time columns plus the selected ones that exist."""
    head = [*s.keys, s.ts]
    return df.select(*head, *[c for c in features if c in df.columns and c not in head])


def selected_by_category(imp: DataFrame, features: Sequence[str]) -> DataFrame:
    return imp.where(F.col("feature").isin(list(features))).groupBy("category").agg(F.sort_array(F.collect_list("feature")).alias("features"))


# ---------------------------------------------------------------- correlation


def pair_correlation(a: str, b: str) -> Column:
    """Correlation over the rows that know both; null where either does not vary there."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    both = x.isNotNull() & y.isNotNull()
    spread = F.sqrt(F.var_pop(F.when(both, x))) * F.sqrt(F.var_pop(F.when(both, y)))
    return F.try_divide(F.covar_pop(x, y), spread)


def target_correlation(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Correlation of every feature with the target, all in one aggregation."""
    pairs = [F.struct(F.lit(c).alias("feature"), pair_correlation(c, target).alias("correlation")).alias(f"_{i}") for i, c in enumerate(features)]
    return df.agg(*pairs).select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(features))])))


def select_by_correlation(corr: DataFrame, threshold: float = 0.05, min_features: int = 5, n: int = 20) -> list[str]:
    """|corr| at or above the threshold, else the ``n`` strongest when that leaves too few."""
    rows = sorted(corr.where("correlation is not null").collect(), key=lambda r: (-abs(r["correlation"]), r["feature"]))
    chosen = [r["feature"] for r in rows if abs(r["correlation"]) >= threshold]
    return chosen if len(chosen) >= min_features else [r["feature"] for r in rows[:n]]


def drop_correlated(df: DataFrame, features: Sequence[str], threshold: float = 0.9) -> list[str]:
    """Leave out every feature that correlates above the threshold with an earlier one.

    Each pair over the rows that know both values (see ``pairwise_correlations``).
    """
    high = pairwise_correlations(df, features).where(F.abs("correlation") > threshold).select("later").distinct().collect()  # feature numbers
    late = {r["later"] for r in high}
    return [f for j, f in enumerate(features) if j not in late]


def pairwise_correlations(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(earlier, later, correlation) of every two features by number, each over the rows that know both; null where either does not vary.

    Tasks multiply masked matrices of their rows, taken about the columns' means, and Spark adds up features x features numbers.
    """
    d = len(features)
    x = df.select(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    means = x.agg(*[F.avg(F.when(~F.isnan(c), F.col(c))) for c in x.columns]).first()
    centre = np.array([m or 0.0 for m in means])

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, d, d))
        for batch in batches:
            v = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - centre
            known = ~np.isnan(v)
            v = np.where(known, v, 0.0)
            k = known.astype(float)
            total += np.stack([k.T @ k, v.T @ k, (v * v).T @ k, v.T @ v])
        at = np.arange(d * d)
        yield pa.RecordBatch.from_arrays([pa.array(at // d), pa.array(at % d), *[pa.array(t.ravel()) for t in total]], ["a", "b", "n", "s", "ss", "sp"])

    m = x.mapInArrow(moments, "a long, b long, n double, s double, ss double, sp double").groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss", "sp")])
    left, right = m.where("a < b"), m.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("s").alias("s2"), F.col("ss").alias("ss2"))
    both = left.join(right, ["a", "b"])
    spread = [F.greatest(F.lit(0.0), F.col("n") * F.col(q) - F.col(v) * F.col(v)) for v, q in (("s", "ss"), ("s2", "ss2"))]
    least = 1e-12 * F.col("n")
    varies = (spread[0] > least * F.col("ss")) & (spread[1] > least * F.col("ss2"))
    return both.select(F.col("a").alias("earlier"), F.col("b").alias("later"),
                       F.when(varies, F.try_divide(F.col("n") * F.col("sp") - F.col("s") * F.col("s2"), F.sqrt(spread[0]) * F.sqrt(spread[1]))).alias("correlation"))


# ---------------------------------------------------------------- wrappers around model fits


def recursive_elimination(df: DataFrame, features: Sequence[str], label: str, keep: int, kind: str = "forest", task: str = "regression",
                          step: int = 1, **params) -> DataFrame:
    """Drop the least important feature(s) until ``keep`` are left; rank 1 is kept, score = 1 / rank."""
    left, dropped = list(features), []
    while len(left) > keep:
        imp = {r["feature"]: r["importance"] for r in single_fit_importance(df, left, label, kind, task, **params).collect()}
        worst = sorted(left, key=lambda f: (imp[f], f))[: min(step, len(left) - keep)]
        dropped.append(worst)
        left = [f for f in left if f not in worst]
    ranks = [(f, 1) for f in left] + [(f, i + 2) for i, w in enumerate(reversed(dropped)) for f in w]
    return df.sparkSession.createDataFrame([(f, r, 1.0 / r) for f, r in ranks], "feature string, rank int, score double")


def forward_selection(tagged: DataFrame, features: Sequence[str], label: str, n: int, kind: str = "forest", task: str = "regression", **params) -> list[str]:
    """Greedily add the feature with the best mean fold score (ROC AUC, or -mse)."""
    from barspark.operators.models import cross_validate

    chosen: list[str] = []
    while len(chosen) < n:
        best = None
        for f in (f for f in features if f not in chosen):
            m = cross_validate(tagged, [*chosen, f], task, kind, label, **params)
            value = m.agg(F.avg("roc_auc" if task == "classification" else -F.col("mse"))).first()[0]
            if best is None or value > best[0]:
                best = (value, f)
        chosen.append(best[1])
    return chosen
