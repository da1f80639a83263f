"""What all learned forecasters share: predictors, training-only encodings and scalings, states, actuals, diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandloom.functions.columns import none_token
from demandloom.operators.folds import KNOWN_IN_ADVANCE, fold_rows
from demandloom.sources.parameters import SERIES

# Predictors of the learned models.
CATEGORICAL = ["item_id", "store_id", "dept_id", "event_name_1", "event_type_1", "event_name_2", "event_type_2"]
KNOWN_NUMERIC = [
    "year", "day_of_month", "is_weekend", "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos",
    "is_event", "snap_active", "product_age_days",
]
RECURSIVE = [
    "sales_lag_1", "sales_lag_7", "sales_lag_14", "sales_lag_28",
    "sales_roll_mean_7", "sales_roll_mean_14", "sales_roll_mean_28", "sales_roll_std_7", "sales_roll_std_28",
]


def category_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows per categorical column and category, nulls as a category of their own."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), none_token(F.col(c)).alias("category")) for c in CATEGORICAL])
    return rows.select(*keys, F.inline(pairs)).groupBy(*keys, "column_name", "category").agg(F.count(F.lit(1)).alias("n_rows"))


def category_table(training: DataFrame, *keys: str) -> DataFrame:
    """Training-only categories per column with a stable alphabetical code."""
    order = W.partitionBy(*keys, "column_name").orderBy("category")
    return category_counts(training, *keys).withColumn("code", F.row_number().over(order) - 1)


def scaling_table(training: DataFrame, *keys: str) -> DataFrame:
    """Training mean, population deviation and median of every numeric predictor."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in KNOWN_NUMERIC + RECURSIVE
    ])
    rows = training.select(*keys, F.inline(pairs))
    return rows.groupBy(*keys, "feature").agg(
        F.count("value").alias("n_rows"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation")
    )


def origin_states(origin_rows: DataFrame) -> DataFrame:
    """Last 28 known values per fold and series."""
    return origin_rows.select("fold", *SERIES, F.slice("known", -28, 28).alias("state"))


def fold_context(features: DataFrame, *, locked: bool = False) -> DataFrame:
    """What is known in advance about the target days of each fold."""
    return fold_rows(features.select(*KNOWN_IN_ADVANCE), locked=locked)


def with_actuals(forecasts: DataFrame, features: DataFrame, origin_rows: DataFrame) -> DataFrame:
    """Forecasts (fold, model_name, series, target_date, ...) next to what was sold, in the columns the metrics need."""
    known = origin_rows.drop("known", "start_date", "end_date")
    actuals = features.select(*SERIES, F.col("date").alias("target_date"), F.col("sales").alias("actual"))
    return forecasts.join(known, ["fold", *SERIES]).join(actuals, [*SERIES, "target_date"]).withColumnRenamed("origin", "forecast_origin")


def raw_negatives(forecasts: DataFrame, *keys: str) -> DataFrame:
    negative = F.col("raw_forecast") < 0
    return forecasts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(negative).alias("negative_rows"),
        (F.lit(100.0) * F.count_if(negative) / F.count(F.lit(1))).alias("negative_pct"),
        F.min(F.when(negative, F.col("raw_forecast"))).alias("most_negative"),
    )


def unseen_categories(scored: DataFrame, categories: DataFrame, *keys: str) -> DataFrame:
    """Categories of rows to score that the training rows never had, per column."""
    there = category_table(scored, *keys).select(*keys, "column_name", "category")
    unseen = there.join(categories.select(*keys, "column_name", "category"), [*keys, "column_name", "category"], "left_anti")
    counts = unseen.groupBy(*keys, "column_name").agg(F.count(F.lit(1)).alias("unseen_categories"))
    all_columns = categories.groupBy(*keys, "column_name").agg(F.count(F.lit(1)).alias("training_categories"), F.sum("n_rows").alias("encoder_rows"))
    return all_columns.join(counts, [*keys, "column_name"], "left").withColumn("unseen_categories", F.coalesce("unseen_categories", F.lit(0)))
