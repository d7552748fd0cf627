"""Tree models (MLlib), predictions, evaluation and walk-forward runs."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.functions.columns import ratio
from barspark.operators.series import BARS, Series, frames, number_rows, running_sum, scan, stage

# ---- fixed values: model parameters
FOREST = dict(numTrees=100, maxDepth=10, minInstancesPerNode=2, seed=42)
BOOSTED = dict(maxIter=100, maxDepth=5, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42)
# ---- end of fixed values


def tree_model(kind: str, task: str, label: str = "label", **params):
    """``forest`` or ``boosted``, ``classification`` or ``regression``."""
    cls = {("forest", "classification"): RandomForestClassifier, ("forest", "regression"): RandomForestRegressor,
           ("boosted", "classification"): GBTClassifier, ("boosted", "regression"): GBTRegressor}[kind, task]
    base = FOREST if kind == "forest" else BOOSTED
    return cls(featuresCol="features", labelCol=label, **{**base, **params})


def model_pipeline(features: Sequence[str], kind: str = "forest", task: str = "classification", label: str = "label",
                   scale: bool = True, **params) -> Pipeline:
    """Assemble, standardise on the training rows, fit trees. No row is left out: nulls and non-finite inputs count as 0 (as in ``align_inputs``)."""
    known = ", ".join(f"CASE WHEN `{f}` IS NULL OR isnan(CAST(`{f}` AS DOUBLE)) OR abs(CAST(`{f}` AS DOUBLE)) = double('Infinity') THEN 0D ELSE CAST(`{f}` AS DOUBLE) END AS `_in_{f}`" for f in features)
    stages = [SQLTransformer(statement=f"SELECT *, {known} FROM __THIS__"),
              VectorAssembler(inputCols=[f"_in_{f}" for f in features], outputCol="raw_features" if scale else "features", handleInvalid="error")]
    if scale:
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True))
    return Pipeline(stages=[*stages, tree_model(kind, task, label, **params)])


def align_inputs(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the model's columns in its order: missing ones 0 (``_raw``/``_original`` from the base
    column), null and non-finite values 0."""
    present = {c.lower(): c for c in df.columns}

    def one(f: str):
        name = next((present[n] for n in (f.lower(), f.lower().removesuffix("_raw").removesuffix("_original")) if n in present), None)
        if name is None:
            return F.lit(0.0).alias(f)
        v = F.col(name).cast("double")
        return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v).alias(f)

    return df.select(*keep, *[one(f) for f in features])


def predict(model: PipelineModel, df: DataFrame, task: str = "classification") -> DataFrame:
    """``prediction`` and ``probability_up``; a regression value is squashed to a pseudo-probability."""
    out = model.transform(df)
    up = vector_to_array("probability")[1] if task == "classification" else 1 / (1 + F.exp(-F.col("prediction")))
    out = out.withColumn("probability_up", up)
    return out.drop("raw_features", "features", "rawPrediction", "probability", *[c for c in out.columns if c.startswith("_in_")])


def predicted_direction(df: DataFrame, task: str = "classification", threshold: float = 0.5) -> DataFrame:
    test = F.col("probability_up") > threshold if task == "classification" else F.col("prediction") > 0
    return df.withColumn("direction", F.when(test, 1).otherwise(-1))


def importances(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """One row per feature, as many as the model has inputs."""
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, importance double")


def save_model(model: PipelineModel, path: str, features: Sequence[str], target: str, **metadata) -> None:
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    row = [(list(features), target, json.dumps(metadata, default=str))]
    spark.createDataFrame(row, "features array<string>, target string, metadata string").write.mode("overwrite").parquet(f"{path}/meta")


def load_model(spark, path: str) -> tuple[PipelineModel, list[str], str, dict]:
    meta = spark.read.parquet(f"{path}/meta").first()
    return PipelineModel.load(f"{path}/model"), list(meta["features"]), meta["target"], json.loads(meta["metadata"])


# ---------------------------------------------------------------- evaluation


def classification_metrics(df: DataFrame, by: Sequence[str] = (), label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy, precision, recall and f1 of class 1 (0 where undefined)."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    c = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(y == p).alias("_ok"), F.count_if(y & p).alias("_tp"),
                            F.count_if(p).alias("_p"), F.count_if(y).alias("_y"))
    z = F.lit(0.0)
    c = c.withColumns({"accuracy": ratio("_ok", "n"), "precision": F.coalesce(ratio("_tp", "_p"), z), "recall": F.coalesce(ratio("_tp", "_y"), z)})
    return c.withColumn("f1", F.coalesce(ratio(2 * F.col("_tp"), F.col("_p") + F.col("_y")), z)).drop("_ok", "_tp", "_p", "_y")


def roc_auc(df: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "probability_up", method: str = "range") -> DataFrame:
    """Area under the ROC curve by ranks, ties at their average rank.

    Equal scores are counted together first; the running count of negatives goes through a
    block scan over the range-partitioned scores, so no group is sorted in one task.
    """
    keys = tuple(by) or ("_all",)
    x = df if by else df.withColumn("_all", F.lit(0))
    c = x.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("_score")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) != 1).alias("_neg"))
    s = Series(keys=keys, ts="_score")
    c = scan(number_rows(c, s, method=method), s, {"_below": running_sum("_neg", inclusive=False)})
    a = c.groupBy(*keys).agg(
        F.sum(F.col("_pos") * (F.coalesce("_below", F.lit(0)) + F.col("_neg") / 2)).alias("_u"), F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
    return a.select(*by, ratio("_u", F.col("_p") * F.col("_n")).alias("roc_auc"))


def regression_metrics(df: DataFrame, by: Sequence[str] = (), label: str = "label", prediction: str = "prediction") -> DataFrame:
    """mse, rmse, mae, r2 (1 - SSE/SST) and the share of agreeing signs."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    e = y - p
    m = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
                            F.var_pop(y).alias("_var"), F.avg((F.signum(y) == F.signum(p)).cast("double")).alias("sign_agreement"))
    return m.withColumns({"rmse": F.sqrt("mse"), "r2": 1 - ratio("mse", "_var")}).drop("_var")


def weighted_metrics(df: DataFrame, by: Sequence[str] = (), label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and class-weighted precision, recall and f1, from the confusion counts."""
    by = list(by)
    cm = df.groupBy(*by, F.col(label).cast("double").alias("y"), F.col(prediction).cast("double").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    per = cm.withColumn("_c", F.explode(F.array_distinct(F.array("y", "p")))).groupBy(*by, "_c").agg(
        F.sum(F.when((F.col("y") == F.col("_c")) & (F.col("p") == F.col("_c")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("p") == F.col("_c"), F.col("n")).otherwise(0)).alias("np"),
        F.sum(F.when(F.col("y") == F.col("_c"), F.col("n")).otherwise(0)).alias("ny"))
    z = F.lit(0.0)
    prec, rec = F.coalesce(ratio("tp", "np"), z), F.coalesce(ratio("tp", "ny"), z)
    f1 = F.coalesce(ratio(2 * F.col("tp"), F.col("np") + F.col("ny")), z)
    total = F.sum("ny")
    return per.groupBy(*by).agg(ratio(F.sum("tp"), total).alias("accuracy"), ratio(F.sum(prec * F.col("ny")), total).alias("precision"),
                                ratio(F.sum(rec * F.col("ny")), total).alias("recall"), ratio(F.sum(f1 * F.col("ny")), total).alias("f1_score"))


def step_direction_accuracy(df: DataFrame, s: Series = BARS, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Share of steps on which label and prediction both rise or both do not."""
    def make(x: DataFrame, w) -> DataFrame:
        same = ((F.col(label) - F.lag(label).over(w)) > 0) == ((F.col(prediction) - F.lag(prediction).over(w)) > 0)
        return x.withColumn("_same", same)

    return frames(df, s, make, back=1).groupBy(*s.keys).agg(F.avg(F.col("_same").cast("double")).alias("direction_accuracy"))


def metrics_by_regime(df: DataFrame, regime: str = "market_regime", task: str = "regression") -> DataFrame:
    return regression_metrics(df, [regime]) if task == "regression" else classification_metrics(df, [regime])


def fold_summary(metrics: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean, population and sample deviation, min and max of per-fold metrics, one row per metric."""
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns])
    return metrics.select(*by, F.inline(rows)).groupBy(*by, "metric").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std_pop"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))


def compare_datasets(metrics: DataFrame, values: Sequence[str], models: Sequence[str]) -> DataFrame:
    """One row per data set, the values of every model side by side."""
    return metrics.groupBy("dataset").pivot("model", list(models)).agg(*[F.first(v).alias(v) for v in values])


# ---------------------------------------------------------------- folds


def walk_forward(tagged: DataFrame, features: Sequence[str], task: str = "classification", kind: str = "forest", label: str = "label",
                 keep: Sequence[str] = ("symbol", "ts"), fit: Callable[[DataFrame], PipelineModel] | None = None, **params) -> DataFrame:
    """Fit on each fold's training rows, predict its test rows; all predictions with ``split_index``.

    The loop is over folds (a handful); training and scoring are Spark jobs. The tagged rows and the predictions are
    staged, so that neither is made again for every fold or metric.
    """
    tagged = stage(tagged)
    folds = sorted(r["split_index"] for r in tagged.select("split_index").distinct().collect())
    fit = fit or (lambda train: model_pipeline(features, kind, task, label, **params).fit(train))
    out = None
    for f in folds:
        rows = tagged.where(F.col("split_index") == f).where(F.col(label).isNotNull())
        model = fit(rows.where("split_type = 'train'"))
        scored = predict(model, rows.where("split_type = 'test'"), task).select("split_index", *keep, label, "prediction", "probability_up")
        out = scored if out is None else out.unionByName(scored)
    return stage(out) if out is not None else predict_nothing(tagged, keep, label)


def predict_nothing(tagged: DataFrame, keep: Sequence[str], label: str) -> DataFrame:
    return tagged.where(F.lit(False)).select("split_index", *keep, label, F.lit(0.0).alias("prediction"), F.lit(0.0).alias("probability_up"))


def cross_validate(tagged: DataFrame, features: Sequence[str], task: str = "classification", kind: str = "forest", label: str = "label", **kw) -> DataFrame:
    """Metrics per fold."""
    p = walk_forward(tagged, features, task, kind, label, **kw)
    if task == "regression":
        return regression_metrics(p, ["split_index"], label)
    return classification_metrics(p, ["split_index"], label).join(roc_auc(p, ["split_index"], label), "split_index", "left")
