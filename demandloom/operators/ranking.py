"""Model rankings over the metric cube (a few rows per model)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandloom.functions.columns import improvement_percent, ratio
from demandloom.operators.metrics import metric_slice, primary_folds
from demandloom.sources.parameters import (
    RANK_FOLD_WEIGHT,
    RANK_HORIZON_WEIGHTS,
    RANK_METRIC_WEIGHTS,
    RANK_STABILITY_WEIGHT,
)

RANKED = ["mae", "rmse", "wape", "rmsse", "absolute_bias"]


def rank_min(partition: list[str], value: str) -> Column:
    return F.rank().over(W.partitionBy(*partition).orderBy(value))


def rank_average(partition: list[str], value: str) -> Column:
    """Tied values share the mean of their positions."""
    ties = F.count(F.lit(1)).over(W.partitionBy(*partition, value))
    return rank_min(partition, value) + (ties - 1) / 2


def steady(value: str) -> Column:
    """Metric rounded before ranking: equal metrics tie whatever the order of their sums."""
    return F.round(value, 9)


def long_metrics(cube: DataFrame, keys: list[str], names: list[str] = RANKED) -> DataFrame:
    rows = cube.withColumn("absolute_bias", F.abs("bias"))
    return rows.withColumns({name: steady(name) for name in names}).unpivot(keys, names, "metric", "value")


def baseline_ranking(cube: DataFrame) -> DataFrame:
    """Mean of five competition ranks on the combined 30-day daily slice."""
    primary = metric_slice(cube, "days_1_30_daily")
    ranks = long_metrics(primary, ["model_name"]).withColumn("position", rank_min(["metric"], "value"))
    scored = ranks.groupBy("model_name").agg(
        F.avg("position").alias("mean_rank"),
        F.max(F.when(F.col("metric") == "mae", F.col("value"))).alias("mae"),
    )
    return scored.orderBy("mean_rank", "mae", "model_name")


def best_by_metric(cube: DataFrame) -> DataFrame:
    primary = metric_slice(cube, "days_1_30_daily")
    return long_metrics(primary, ["model_name"]).groupBy("metric").agg(
        F.min(F.struct("value", "model_name"))["model_name"].alias("model_name"), F.min("value").alias("value")
    )


def ranking_components(cube: DataFrame) -> DataFrame:
    """(model, component, rank, weight) rows of the weighted ranking."""
    combined = cube.where((F.col("fold") == "combined") & (F.col("segment_type") == "overall"))
    by_horizon = long_metrics(combined, ["model_name", "horizon"]).withColumn(
        "rank", rank_average(["horizon", "metric"], "value")
    )

    def weight(table: dict, key: str) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.col(key))

    main = by_horizon.select(
        "model_name", F.concat_ws(":", F.lit("combined"), "horizon", "metric").alias("component"), "rank",
        (weight(RANK_HORIZON_WEIGHTS, "horizon") * weight(RANK_METRIC_WEIGHTS, "metric")).alias("weight"),
    )
    folds = primary_folds(cube)
    per_fold = long_metrics(folds, ["model_name", "fold"], ["mae", "rmsse"]).withColumn(
        "rank", rank_average(["fold", "metric"], "value")
    ).select(
        "model_name", F.concat_ws(":", "fold", F.lit("days_1_30_daily"), "metric").alias("component"), "rank",
        F.lit(RANK_FOLD_WEIGHT).alias("weight"),
    )
    spread = folds.groupBy("model_name").agg(F.stddev_samp("mae").alias("value")).select(
        "model_name", steady("value").alias("value"), F.lit("mae_std").alias("metric")
    )
    stability = spread.withColumn("rank", rank_average(["metric"], "value")).select(
        "model_name", F.lit("fold_stability:mae_std").alias("component"), "rank", F.lit(RANK_STABILITY_WEIGHT).alias("weight")
    )
    return main.unionByName(per_fold).unionByName(stability)


def balanced_ranking(cube: DataFrame) -> DataFrame:
    """Weighted mean rank over horizons, folds and stability; the best model has rank 1."""
    scores = ranking_components(cube).groupBy("model_name").agg(
        F.sum(F.col("rank") * F.col("weight")).alias("weighted_rank_sum"),
        F.sum("weight").alias("total_weight"),
        F.count(F.lit(1)).alias("comparison_components"),
    ).withColumn("balanced_rank_score", ratio(F.col("weighted_rank_sum"), F.col("total_weight")))
    primary = metric_slice(cube, "days_1_30_daily").select(
        "model_name", *[F.col(m).alias(f"days_1_30_{m}") for m in ("mae", "rmse", "wape", "rmsse", "bias")]
    )
    fold_stats = primary_folds(cube).groupBy("model_name").agg(
        F.avg("mae").alias("fold_mae_mean"), F.stddev_samp("mae").alias("fold_mae_std")
    )
    joined = scores.join(primary, "model_name").join(fold_stats, "model_name").withColumns({
        "_all": F.lit(1), "_score": steady("balanced_rank_score")
    })
    return joined.withColumn("selection_rank", rank_min(["_all"], "_score")).drop("_all", "_score")


def zero_gap(cube: DataFrame) -> DataFrame:
    """How far the best non-zero baseline is below the zero baseline's MAE."""
    primary = metric_slice(cube, "days_1_30_daily").withColumn("mae", steady("mae"))
    is_zero = F.col("model_name") == "zero"
    best = F.min(F.when(~is_zero, F.struct("mae", "model_name")))
    return primary.agg(F.max(F.when(is_zero, F.col("mae"))).alias("zero_mae"), best.alias("_best")).select(
        "zero_mae", F.col("_best.model_name").alias("best_model"), F.col("_best.mae").alias("best_mae"),
        improvement_percent(F.col("zero_mae"), F.col("_best.mae")).alias("improvement_pct"),
    )


def model_by_class(cube: DataFrame, model: str = "croston_sba") -> DataFrame:
    """One model's MAE rank inside each intermittency class, with that class's best model."""
    rows = metric_slice(cube, "days_1_30_daily", segment_type="intermittency_class").withColumn("mae", steady("mae"))
    ranked = rows.withColumn("mae_rank", rank_min(["segment_value"], "mae"))
    best = F.min(F.struct("mae", "model_name")).over(W.partitionBy("segment_value"))
    return ranked.withColumn("_best", best).where(F.col("model_name") == model).select(
        F.col("segment_value").alias("intermittency_class"), "mae", "wape", "rmsse", "mae_rank",
        F.col("_best.model_name").alias("best_model"), F.col("_best.mae").alias("best_mae"),
    )


def fold_wins(cube: DataFrame, candidate: str, benchmark: str, negligible_pct: float = 0.5) -> DataFrame:
    """Folds the candidate wins on MAE, and whether the combined change is negligible."""
    mae = {m: F.max(F.when(F.col("model_name") == m, F.col("mae"))) for m in (candidate, benchmark)}
    scope = cube.where((F.col("horizon") == "days_1_30_daily") & (F.col("segment_type") == "overall"))
    per_fold = scope.groupBy("fold").agg(mae[candidate].alias("candidate_mae"), mae[benchmark].alias("benchmark_mae"))
    gain = improvement_percent(F.col("benchmark_mae"), F.col("candidate_mae"))
    combined = F.col("fold") == "combined"
    return per_fold.agg(
        F.count_if(~combined & (F.col("candidate_mae") < F.col("benchmark_mae"))).alias("fold_wins"),
        F.count_if(~combined).alias("folds"),
        F.max(F.when(combined, gain)).alias("combined_improvement_pct"),
        F.max(F.when(combined, F.abs(gain) < negligible_pct)).alias("is_negligible"),
    )
