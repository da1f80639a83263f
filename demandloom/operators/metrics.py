"""Forecast metrics: one pass to per-series errors, then the metric cube by grouping sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.functions.columns import improvement_percent, ratio
from demandloom.operators.joins import checked_join
from demandloom.sources.parameters import HORIZON_SPECS, SEGMENTS, SERIES

CUBE_KEYS = ["fold", "horizon", "horizon_days", "evaluation_type", "segment_type", "segment_value"]
MEASURES = [
    "mae", "rmse", "wape", "bias", "aggregate_bias", "actual_sum", "forecast_sum", "observations",
    "rmsse", "rmsse_defined_series", "rmsse_undefined_series",
]


def error_columns() -> dict[str, Column]:
    """MAE, RMSE, WAPE and bias of prediction rows, as aggregates."""
    error = F.col("forecast") - F.col("actual")
    absolute = F.sum(F.abs(error))
    return {
        "mae": F.avg(F.abs(error)),
        "rmse": F.sqrt(F.avg(error * error)),
        "wape": ratio(absolute, F.sum("actual")),
        "bias": F.avg(error),
        "aggregate_bias": F.sum(error),
        "actual_sum": F.sum("actual"),
        "forecast_sum": F.sum("forecast"),
        "observations": F.count(F.lit(1)),
    }


def basic_metrics(predictions: DataFrame, *keys: str) -> DataFrame:
    return predictions.groupBy(*keys).agg(*[column.alias(name) for name, column in error_columns().items()])


def horizon_slices() -> Column:
    return F.array(*[
        F.struct(F.lit(n).alias("horizon"), F.lit(d).alias("horizon_days"), F.lit(a).alias("is_aggregate"))
        for n, d, a in HORIZON_SPECS
    ])


def series_errors(predictions: DataFrame) -> DataFrame:
    """Error sums per fold, model, horizon slice and series.

    The cube is built from these rows, so its grouping sets never touch daily rows again.
    Aggregate slices compare the horizon's totals; their scale grows with the days.
    """
    applicable = F.filter(horizon_slices(), lambda s: F.col("horizon_day") <= s["horizon_days"])
    sliced = predictions.select("*", F.inline(applicable))
    error = F.col("forecast") - F.col("actual")
    total_error = F.sum(error)
    is_total = F.col("is_aggregate")
    grouped = sliced.groupBy(
        "fold", "model_name", "horizon", "horizon_days", "is_aggregate", *SERIES, *[c for c in SEGMENTS if c not in SERIES]
    ).agg(
        F.count(F.lit(1)).alias("_days"),
        F.sum("actual").alias("actual_sum"),
        F.sum("forecast").alias("forecast_sum"),
        F.sum(F.abs(error)).alias("_abs"),
        F.sum(error * error).alias("_sq"),
        total_error.alias("_total"),
        F.max("rmsse_scale").alias("_scale"),
    )
    scaled_total = F.abs("_total") / F.sqrt(F.col("horizon_days") * F.col("_scale"))
    scaled_daily = F.sqrt(F.col("_sq") / F.col("_days") / F.col("_scale"))
    return grouped.withColumns({
        "n": F.when(is_total, F.lit(1)).otherwise(F.col("_days")),
        "abs_error": F.when(is_total, F.abs("_total")).otherwise(F.col("_abs")),
        "sq_error": F.when(is_total, F.col("_total") * F.col("_total")).otherwise(F.col("_sq")),
        "series_rmsse": F.when(is_total, scaled_total).otherwise(scaled_daily),
    }).drop("_days", "_abs", "_sq", "_total", "_scale")


def metric_cube(errors: DataFrame) -> DataFrame:
    """(fold | combined) x model x horizon x (overall | segment) metrics."""
    segments = F.array(
        F.struct(F.lit("overall").alias("segment_type"), F.lit("all").alias("segment_value")),
        *[F.struct(F.lit(c).alias("segment_type"), F.col(c).alias("segment_value")) for c in SEGMENTS],
    )
    rows = errors.select("*", F.inline(segments))
    keys = ["model_name", "horizon", "horizon_days", "is_aggregate", "segment_type", "segment_value"]
    n = F.sum("n")
    cube = rows.groupingSets([["fold", *keys], keys], "fold", *keys).agg(
        ratio(F.sum("abs_error"), n).alias("mae"),
        F.sqrt(ratio(F.sum("sq_error"), n)).alias("rmse"),
        ratio(F.sum("abs_error"), F.sum("actual_sum")).alias("wape"),
        ratio(F.sum("forecast_sum") - F.sum("actual_sum"), n).alias("bias"),
        (F.sum("forecast_sum") - F.sum("actual_sum")).alias("aggregate_bias"),
        F.sum("actual_sum").alias("actual_sum"),
        F.sum("forecast_sum").alias("forecast_sum"),
        n.alias("observations"),
        F.avg("series_rmsse").alias("rmsse"),
        F.count("series_rmsse").alias("rmsse_defined_series"),
        F.count_if(F.col("series_rmsse").isNull()).alias("rmsse_undefined_series"),
        F.grouping("fold").alias("_all"),
    )
    return cube.select(
        F.when(F.col("_all") == 1, F.lit("combined")).otherwise(F.col("fold")).alias("fold"),
        "model_name", "horizon", "horizon_days",
        F.when(F.col("is_aggregate"), "aggregate").otherwise("daily").alias("evaluation_type"),
        "segment_type", "segment_value", *MEASURES,
    )


def metrics(predictions: DataFrame) -> DataFrame:
    return metric_cube(series_errors(predictions))


def metric_slice(cube: DataFrame, horizon: str, fold: str = "combined", segment_type: str = "overall") -> DataFrame:
    return cube.where(
        (F.col("fold") == fold) & (F.col("horizon") == horizon) & (F.col("segment_type") == segment_type)
    )


def primary_folds(cube: DataFrame) -> DataFrame:
    """Overall 30-day daily rows of the individual folds."""
    return cube.where(
        (F.col("fold") != "combined") & (F.col("horizon") == "days_1_30_daily") & (F.col("segment_type") == "overall")
    )


def compare_to_benchmarks(cube: DataFrame, candidate: str, benchmarks: tuple[str, ...] = ("mean_28", "zero")) -> DataFrame:
    """Candidate rows next to each benchmark's on the six cube keys, with improvements."""
    result = cube.where(F.col("model_name") == candidate)
    for name in benchmarks:
        columns = {f"{name}_{m}": F.col(m) for m in ("mae", "rmse", "wape", "rmsse", "bias")}
        side = cube.where(F.col("model_name") == name).select(*CUBE_KEYS, *[c.alias(a) for a, c in columns.items()])
        result = checked_join(result, side, CUBE_KEYS, "left", "one_to_one")
    improvements = {
        f"{m}_improvement_vs_{name}_pct": improvement_percent(F.col(f"{name}_{m}"), F.col(m))
        for name in benchmarks for m in ("mae", "rmse", "wape", "rmsse")
    }
    first = benchmarks[0]
    improvements[f"absolute_bias_improvement_vs_{first}_pct"] = improvement_percent(
        F.abs(f"{first}_bias"), F.abs("bias")
    )
    return result.withColumns(improvements)


def reconcile(predictions: DataFrame, reported: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Metrics recomputed straight from prediction rows against the reported cube."""
    names = ["mae", "rmse", "wape", "bias"]
    again = basic_metrics(predictions, "fold", "model_name").select(
        "fold", "model_name", *[F.col(n).alias(f"_{n}") for n in names], F.col("observations").alias("_n")
    )
    daily = primary_folds(reported).select("fold", "model_name", *names, "observations")
    joined = again.join(daily, ["fold", "model_name"], "full_outer")
    close = F.lit(True)
    for name in names:
        close = close & (F.abs(F.col(name) - F.col(f"_{name}")) <= tolerance)
    return joined.select(
        "fold", "model_name", F.coalesce(close, F.lit(False)).alias("metrics_match"),
        F.coalesce(F.col("observations") == F.col("_n"), F.lit(False)).alias("rows_match"),
    )


def fold_stability(comparison: DataFrame) -> DataFrame:
    """Range, sign consistency and metric wins of the fold improvements."""
    gain = F.col("mae_improvement_vs_mean_28_pct")
    wins = sum(
        (F.max(F.when(F.col("fold") == "combined", F.col(f"{m}_improvement_vs_mean_28_pct") > 0)).cast("int"))
        for m in ("mae", "rmse", "wape", "rmsse")
    )
    single = F.col("fold") != "combined"
    return comparison.where((F.col("horizon") == "days_1_30_daily") & (F.col("segment_type") == "overall")).groupBy("model_name").agg(
        F.min(F.when(single, gain)).alias("improvement_min_pct"),
        F.max(F.when(single, gain)).alias("improvement_max_pct"),
        (F.bool_and(F.when(single, gain > 0)) | F.bool_and(F.when(single, gain < 0))).alias("direction_consistent"),
        wins.alias("metric_wins_of_four"),
    )


def split_drift(validation: DataFrame, test: DataFrame) -> DataFrame:
    """Percent change of each combined metric from validation to the locked window."""
    names = ["mae", "rmse", "wape", "rmsse"]
    before = metric_slice(validation, "days_1_30_daily").select("model_name", *[F.col(n).alias(f"validation_{n}") for n in names])
    after = metric_slice(test, "days_1_30_daily").select("model_name", *[F.col(n).alias(f"test_{n}") for n in names])
    joined = after.join(before, "model_name")
    return joined.select("*", *[
        (-improvement_percent(F.col(f"validation_{n}"), F.col(f"test_{n}"))).alias(f"{n}_drift_pct") for n in names
    ])


def append_once(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Union that refuses a (split, model) already evaluated."""
    repeated = new.join(stored.select(*keys).distinct().withColumn("_seen", F.lit(True)), keys, "left")
    fail = F.raise_error(F.lit("this evaluation is already recorded")).cast("boolean")
    guarded = repeated.where(F.when(F.col("_seen"), fail).otherwise(True)).drop("_seen")
    return stored.unionByName(guarded)
