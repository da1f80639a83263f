"""Stage plan: features -> fold predictions -> metric cube -> ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.operators import forecast, metrics, ranking
from demandloom.sources.sinks import write_table


def build_predictions(features: DataFrame, target: str) -> DataFrame:
    """All baselines on all folds from the active rows of the feature table."""
    return write_table(forecast.fold_predictions(features.where(F.col("is_active"))), target)


def evaluate(predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metric cube and the balanced ranking over it."""
    cube = metrics.metrics(predictions)
    return cube, ranking.balanced_ranking(cube)
