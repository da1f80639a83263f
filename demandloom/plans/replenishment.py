"""Stage plan: deployment forecast, calibration and stock state -> recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame

from demandloom.operators import forecast, inventory
from demandloom.sources.parameters import POLICY
from demandloom.sources.sinks import write_table
from demandloom.sources.tables import through_date


def build_recommendations(
    active: DataFrame, predictions: DataFrame, state: DataFrame, cutoff: str, target: str, policy: dict = POLICY
) -> DataFrame:
    """One decision per series from data up to ``cutoff`` and validation residuals."""
    future = forecast.deployment_forecast(forecast.last_values(through_date(active, cutoff)))
    inputs = inventory.decision_inputs(future, state, inventory.calibrate(predictions, policy["minimum_series_observations"]))
    return write_table(inventory.recommend(inputs, policy), target)
