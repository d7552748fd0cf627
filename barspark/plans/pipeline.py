"""Raw bars to model-ready features: the batch pipeline as one chain of lazy steps.

Each stage that feeds several branches of the next one is written to the shared folder, so the
raw data is read once per run instead of once per branch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from barspark.operators.clean import clean_bars
from barspark.operators.features import add_features
from barspark.operators.normalize import BarNormalizer, BarNormalizerModel
from barspark.operators.prepare import prepare_features
from barspark.operators.select import Selection, apply_selection, feature_metadata, forest_importance, select_features
from barspark.operators.series import BARS, Series, stage


@dataclass(frozen=True)
class Prepared:
    features: DataFrame
    normaliser: BarNormalizerModel
    metadata: DataFrame
    selected: list[str] | None = None
    importance: DataFrame | None = None
    fold_scores: DataFrame | None = None


def prepare_bars(raw: DataFrame, s: Series = BARS, missing: str = "ffill", outliers: str = "winsorize", mode: str = "advanced",
                 price_method: str = "returns", min_points: int = 1000) -> DataFrame:
    """Clean, generate features, transform prices and treat missing values."""
    clean = stage(clean_bars(raw, s, missing, outliers))
    featured = stage(add_features(clean, s))
    return prepare_features(featured, mode, price_method, s, min_points)


def run(raw: DataFrame, s: Series = BARS, select: Selection | None = None, n_splits: int = 5, **options) -> Prepared:
    """The whole pipeline; with ``select`` also importance analysis and feature selection."""
    prepared = stage(prepare_bars(raw, s, **options))
    model = BarNormalizer(series=s).fit(prepared)
    normal = stage(model.transform(prepared))
    meta = feature_metadata(normal, s)
    if select is None:
        return Prepared(normal, model, meta)
    importance, scores = forest_importance(normal, select.target, n_splits=n_splits, s=s)
    importance = stage(importance)
    chosen = select_features(importance, select)
    return Prepared(apply_selection(normal, chosen, s), model, meta, chosen, importance, scores)
