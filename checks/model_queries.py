"""Training, importance, treatments and pipelines: iterative, so checked by structure and by the tests."""

from __future__ import annotations


from pyspark.sql import functions as F

from barspark.operators import labels, models, prepare, select, splits
from barspark.operators.features import add_features
from barspark.plans import backtest, pipeline
from checks.common import _once, bars, gappy, show, sql
from checks.trading_queries import rets

Q: dict = {}
S: dict[str, str] = {}
BASE = ["sma_5", "sma_20", "rsi_14", "roc_1", "roc_5", "volatility_5", "stoch_k", "gk_volatility"]


def table_(sp, sf):
    """All features and the next bar's direction and return; rows with a label. Unknown inputs count as 0 in the models."""
    def build():
        x = add_features(rets(sp, sf).drop("pos"))
        x = labels.label_direction(x, "close_return", 1)
        x = labels.label_value(x, "close_return", 1, out="next_return")
        return x.dropna(subset=["label", "next_return"]).drop("pos")  # numbered anew
    return _once(sp, sf, "model_table", build)


def inputs(sp, sf) -> list[str]:
    """Every numeric or boolean feature column."""
    own = {"symbol", "ts", "pos", "open", "high", "low", "close", "volume", "label", "next_return"}
    return [f.name for f in table_(sp, sf).schema.fields if f.name not in own and f.dataType.typeName() in ("double", "float", "integer", "long", "boolean")]


def folds(sp, sf):
    return _once(sp, sf, "model_folds", lambda: splits.time_folds(table_(sp, sf), "10D", "5D"))


def _fit_predict(kind: str, task: str, **params):
    def run(sp, sf):
        x = labels.train_test(table_(sp, sf), 0.2)
        label = "label" if task == "classification" else "next_return"
        m = models.model_pipeline(inputs(sp, sf), kind, task, label, **params).fit(x.where("split = 'train'"))
        return show(models.predicted_direction(models.predict(m, x.where("split = 'test'"), task), task).select("symbol", "ts", label, "prediction", "probability_up", "direction"))
    return run


Q["model_forest_classifier"] = _fit_predict("forest", "classification")
Q["model_forest_regressor"] = _fit_predict("forest", "regression")
Q["model_boosted_classifier"] = _fit_predict("boosted", "classification")
Q["model_boosted_regressor"] = _fit_predict("boosted", "regression")


def _importance(sp, sf):
    def build():
        names = inputs(sp, sf)
        return select.with_category(models.importances(models.model_pipeline(names, "forest", "regression", "next_return").fit(table_(sp, sf)), names, sp))
    return _once(sp, sf, "importance", build)


def _fold_importance(sp, sf, part: int):
    names = [("importance_folds", 0), ("importance_fold_scores", 1)]
    made: list = []

    def build(i: int):
        if not made:
            made.extend(select.forest_importance(table_(sp, sf).drop("label", "next_return"), features=inputs(sp, sf)))
        return made[i]
    both = [_once(sp, sf, n, lambda i=i: build(i)) for n, i in names]
    return both[part]


def _cv(sp, sf, task: str):
    def build():
        kw = {} if task == "classification" else {"label": "next_return"}
        return models.cross_validate(folds(sp, sf), inputs(sp, sf), task, **kw)
    return _once(sp, sf, f"cv_{task}", build)


def _walk(sp, sf):
    return _once(sp, sf, "walk_forward", lambda: models.walk_forward(folds(sp, sf), inputs(sp, sf), "classification"))


q = Q.__setitem__
q("feature_importance", lambda sp, sf: show(_importance(sp, sf)))
q("importance_folds", lambda sp, sf: show(_fold_importance(sp, sf, 0)))
q("importance_fold_scores", lambda sp, sf: show(_fold_importance(sp, sf, 1)))
q("importance_category_totals", lambda sp, sf: show(select.category_totals(_importance(sp, sf))))
q("select_features", lambda sp, sf: sp.createDataFrame(list(enumerate(select.select_features(_importance(sp, sf), select.Selection("cumulative", 0.8)))), "rank long, feature string"))
q("recursive_elimination", lambda sp, sf: show(select.recursive_elimination(table_(sp, sf), inputs(sp, sf), "next_return", 10, step=15)))
q("forward_selection", lambda sp, sf: sp.createDataFrame(list(enumerate(select.forward_selection(folds(sp, sf), BASE, "next_return", 2, numTrees=20, maxDepth=5))), "rank long, feature string"))
q("drop_correlated", lambda sp, sf: sp.createDataFrame([(f,) for f in select.drop_correlated(table_(sp, sf), inputs(sp, sf))], "feature string"))
q("walk_forward", lambda sp, sf: show(_walk(sp, sf)))
q("cross_validation", lambda sp, sf: show(_cv(sp, sf, "classification")))
q("cross_validation_summary", lambda sp, sf: show(models.fold_summary(_cv(sp, sf, "regression"), ["mse", "mae", "r2"])))

# what is fixed whatever the trees are: rows of each fold, symbol and split; nothing lost on the way through a model
_FOLDS = """WITH {bars}, l AS (SELECT symbol, ts FROM bars QUALIFY lead(pos) OVER (PARTITION BY symbol ORDER BY pos) IS NOT NULL AND pos > 0),
  e AS (SELECT min(ts) AS a, max(ts) AS b FROM l), f AS (SELECT i, a + INTERVAL (5 * i) DAY AS s FROM e, range(0, 1000) t(i) WHERE a + INTERVAL (5 * i + 15) DAY <= b)
SELECT CAST(i AS BIGINT) AS split_index, symbol, count(*) AS n_rows FROM l JOIN f ON ts >= s + INTERVAL 10 DAY AND ts < s + INTERVAL 15 DAY GROUP BY 1, 2"""
q("walk_forward_rows", lambda sp, sf: show(_walk(sp, sf).groupBy("split_index", "symbol").agg(F.count(F.lit(1)).alias("n_rows"))))
S["walk_forward_rows"] = _FOLDS.replace("WITH {bars}", sql("bars", select="").rstrip())


def _kept(sp, sf):
    x = add_features(bars(sp, sf), groups=["technical"]).withColumn("label", (F.col("pos") % 2).cast("double"))
    m = models.model_pipeline(["sma_200", "rsi_14", "roc_20"], label="label").fit(x)
    return models.predict(m, x).groupBy("symbol").agg(F.count("prediction").alias("predicted"), F.count(F.lit(1)).alias("n_rows"))


q("predict_keeps_rows", _kept)
S["predict_keeps_rows"] = sql("bars", select="SELECT symbol, count(*) AS predicted, count(*) AS n_rows FROM bars GROUP BY symbol")

_COLS = ["volume", "open", "high", "low", "close", "spread"]
q("drop_correlated_nulls", lambda sp, sf: sp.createDataFrame([(f,) for f in select.drop_correlated(gappy(sp, sf).withColumn("spread", F.col("high") - F.col("low")), _COLS, 0.8)], "feature string"))
S["drop_correlated_nulls"] = sql("gappy", select="SELECT 'volume' AS feature" + "".join(
    f" UNION ALL SELECT '{b}' FROM (SELECT *, high - low AS spread FROM gappy) HAVING " + " AND ".join(f"coalesce(abs(corr({a}, {b})), 0) <= 0.8" for a in _COLS[:j]) for j, b in enumerate(_COLS) if j))


def _raw(sp, sf):
    return _once(sp, sf, "raw_features", lambda: prepare.transform_prices(add_features(bars(sp, sf), groups=["technical", "volatility"])))


for _mode, _points in (("basic", 400), ("advanced", 400), ("hybrid", 300)):
    Q[f"treatment_{_mode}"] = lambda sp, sf, m=_mode, n=_points: show(prepare.prepare_features(add_features(bars(sp, sf), groups=["technical", "volatility"]), m, min_points=n), 5)
Q["fill_by_type"] = lambda sp, sf: show(prepare.fill_by_type(_raw(sp, sf)), 5)
Q["warm_up_sizes"] = lambda sp, sf: show(prepare.warm_up(_raw(sp, sf)))
Q["pipeline_prepared"] = lambda sp, sf: show(pipeline.prepare_bars(gappy(sp, sf), min_points=400).drop("pos"), 5)
Q["backtest_crossover"] = lambda sp, sf: show(backtest.crossover_run(bars(sp, sf), "sma_5", "sma_20", 1.0)["metrics"], 4)
Q["backtest_model"] = lambda sp, sf: show(backtest.model_run(folds(sp, sf), bars(sp, sf), inputs(sp, sf), lookback=5, threshold=0.6, min_hold=3, max_hold=24)["metrics"], 4)


def _first_known(*rows: int) -> str:
    """Rows until all columns of a class are known, from the rows each of them needs; columns that never are don't count."""
    return f"(SELECT max(w) FROM (VALUES {', '.join(f'({r})' for r in rows)}) v(w) WHERE w <= n_rows)"


S["warm_up_sizes"] = sql("bars", select=f"""SELECT symbol, n_rows, {_first_known(5, 10, 2, 6, 11, 1)} AS short_window, {_first_known(20, 14, 16, 6, 11, 15, 1)} AS medium_window,
  {_first_known(50, 200, 21, 31, 1)} AS long_window FROM (SELECT symbol, count(*) AS n_rows FROM bars GROUP BY symbol)""")
