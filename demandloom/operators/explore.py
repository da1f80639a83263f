"""Exploratory tables: launches, demand, time, events, benefit days, prices, intermittency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandloom.functions.columns import change_percent, count_if, percent, ratio, week_ending_sunday, zero_share_bin
from demandloom.functions.quantiles import quantiles
from demandloom.sources.parameters import SERIES


def launch_summary(flagged: DataFrame) -> DataFrame:
    """Per series: history start, first price, first sale, launch and pre-launch length."""
    rows = flagged.groupBy(*SERIES).agg(
        F.min("dept_id").alias("dept_id"),
        F.min("demand_band").alias("demand_band"),
        F.min("date").alias("history_start"),
        F.min("first_known_price_date").alias("first_known_price_date"),
        F.min("first_positive_sale_date").alias("first_positive_sale_date"),
        F.min("launch_date").alias("launch_date"),
        count_if(F.col("prelaunch_flag")).alias("prelaunch_rows"),
        F.count(F.lit(1)).alias("total_rows"),
    )
    return rows.withColumns({
        "prelaunch_days": F.datediff("launch_date", "history_start"),
        "price_to_first_sale_lag_days": F.datediff("first_positive_sale_date", "first_known_price_date"),
    })


def distribution(df: DataFrame, value: str, probabilities: dict[str, float], *, small_domain: bool = False) -> DataFrame:
    """min, mean, max and exact quantiles of one column as one row."""
    cuts = quantiles(df, value, probabilities, small_domain=small_domain)
    ends = df.agg(F.min(value).alias("minimum"), F.avg(value).alias("mean"), F.max(value).alias("maximum"))
    return ends.select(F.lit(value).alias("measure"), "*", *[cuts.select(n).scalar().alias(n) for n in probabilities])


def corrected_skewness(value: Column) -> Column:
    """Bias-corrected skewness; the built-in one is the population value."""
    n = F.count(value).cast("double")
    return F.skewness(value) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))


def describe(df: DataFrame, value: str, probabilities: dict[str, float]) -> DataFrame:
    """Description of daily units (few distinct values)."""
    cuts = quantiles(df, value, probabilities, small_domain=True)
    top = cuts.select("p999").scalar()
    v = F.col(value)
    rows = df.agg(
        F.count(F.lit(1)).alias("observations"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("standard_deviation"),
        F.min(v).alias("minimum"), F.max(v).alias("maximum"), corrected_skewness(v).alias("skewness"),
        percent(count_if(v == 0), F.count(F.lit(1))).alias("zero_pct"), count_if(v > top).alias("rows_above_p999"),
    )
    return rows.select("*", *[cuts.select(n).scalar().alias(n) for n in probabilities])


def series_demand(active: DataFrame) -> DataFrame:
    """Intermittency and variability per series, with the mean gap between positive days.

    The gap is (last - first positive day) / (positive days - 1): consecutive differences
    telescope, so no window over the positive rows is needed.
    """
    sales = F.col("sales")
    sold = F.when(sales > 0, F.col("date"))
    rows = active.groupBy(*SERIES).agg(
        F.min("dept_id").alias("dept_id"), F.min("demand_band").alias("demand_band"),
        F.count(F.lit(1)).alias("active_days"), F.sum(sales).alias("total_sales"), F.avg(sales).alias("mean_sales"),
        F.median(sales).alias("median_sales"), F.stddev_samp(sales).alias("std_sales"),
        count_if(sales == 0).alias("zero_days"), count_if(sales > 0).alias("positive_days"),
        F.datediff(F.max(sold), F.min(sold)).alias("_span"),
    )
    return rows.withColumns({
        "active_zero_pct": percent(F.col("zero_days"), F.col("active_days")),
        "coefficient_of_variation": ratio(F.col("std_sales"), F.col("mean_sales")),
        "average_demand_interval": ratio(F.col("active_days"), F.col("positive_days")),
        "mean_positive_gap_days": ratio(F.col("_span"), F.col("positive_days") - 1),
    }).withColumn("intermittency_class", zero_share_bin(F.col("active_zero_pct"))).drop("_span")


def group_demand(flagged: DataFrame, series: DataFrame, column: str) -> DataFrame:
    """All-history and active demand of a dimension, shares, and medians of its series metrics."""
    sales, active = F.col("sales"), F.col("active_flag")
    on_active = F.when(active, sales)
    rows = flagged.groupBy(column).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(sales).alias("total_sales"), F.avg(sales).alias("mean_sales"),
        F.stddev_samp(sales).alias("standard_deviation"), percent(count_if(sales == 0), F.count(F.lit(1))).alias("zero_pct"),
        count_if(active).alias("active_rows"), F.avg(on_active).alias("active_mean_sales"),
        percent(count_if(active & (sales == 0)), count_if(active)).alias("active_zero_pct"),
        F.count_distinct("item_id").alias("products"),
    )
    medians = quantiles(flagged, "sales", {"median_sales": 0.5}, [column], small_domain=True)
    interval = quantiles(series, "average_demand_interval", {"median_series_adi": 0.5}, [column])
    total = flagged.agg(F.sum("sales")).scalar()
    return (
        rows.withColumn("sales_share_pct", percent(F.col("total_sales"), total))
        .join(medians, column, "left").join(interval, column, "left")
    )


def comparison(df: DataFrame, *keys: str) -> DataFrame:
    """n, units, mean, median and zero share of sales per group."""
    rows = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observations"), F.sum("sales").alias("total_sales"), F.avg("sales").alias("mean_sales"),
        percent(count_if(F.col("sales") == 0), F.count(F.lit(1))).alias("zero_pct"),
    )
    return rows.join(quantiles(df, "sales", {"median_sales": 0.5}, list(keys), small_domain=True), list(keys))


def daily_totals(panel: DataFrame) -> DataFrame:
    """Units per day and store, and per day over all stores (store is null)."""
    return panel.groupingSets([["date", "store_id"], ["date"]], "date", "store_id").agg(F.sum("sales").alias("sales"))


def weekly_totals(panel: DataFrame) -> DataFrame:
    """Weeks ending on Sunday; the panel is gap-free, so empty weeks are present with 0."""
    return panel.groupBy("store_id", week_ending_sunday(F.col("date")).alias("week_end")).agg(F.sum("sales").alias("weekly_sales"))


def normalised_weeks(weekly: DataFrame) -> DataFrame:
    """Weekly units over the store median and their centred 13-week mean (bounded by the calendar)."""
    store = W.partitionBy("store_id")
    share = ratio(F.col("weekly_sales"), F.median("weekly_sales").over(store))
    centred = store.orderBy("week_end").rowsBetween(-6, 6)
    return weekly.withColumn("normalized_weekly_sales", share).withColumn(
        "normalized_13_week_mean", F.avg("normalized_weekly_sales").over(centred)
    )


def monthly_totals(panel: DataFrame, *keys: str) -> DataFrame:
    return panel.groupBy(*keys, F.trunc("date", "MM").alias("month_start")).agg(F.sum("sales").alias("monthly_sales"))


def monthly_trend(monthly: DataFrame) -> DataFrame:
    """Least-squares line over the month index and the 12-month centred mean (6 back, 5 ahead).

    One row per calendar month: the single ordered partition is bounded by the calendar.
    """
    first = monthly.agg(F.min("month_start")).scalar()
    indexed = monthly.withColumn("_i", F.months_between("month_start", first))
    line = indexed.agg(F.regr_slope("monthly_sales", "_i").alias("slope"), F.regr_intercept("monthly_sales", "_i").alias("intercept"))
    frame = W.partitionBy("_all").orderBy("month_start").rowsBetween(-6, 5)
    return indexed.withColumn("_all", F.lit(1)).select(
        "month_start", "monthly_sales",
        (line.select("intercept").scalar() + line.select("slope").scalar() * F.col("_i")).alias("linear_trend"),
        F.when(F.count("monthly_sales").over(frame) >= 6, F.avg("monthly_sales").over(frame)).alias("twelve_month_mean"),
        line.select("slope").scalar().alias("slope"),
    )


def event_types(active: DataFrame, calendar: DataFrame) -> DataFrame:
    """Occurrences, mean and median daily units per event type over both event slots."""
    daily = active.groupBy("date").agg(F.sum("sales").alias("daily_sales"))
    days = calendar.select("date", F.explode(F.array("event_type_1", "event_type_2")).alias("event_type")).where("event_type IS NOT NULL")
    joined = daily.join(F.broadcast(days), "date")
    return joined.groupBy("event_type").agg(
        F.count_distinct("date").alias("event_occurrences"), F.avg("daily_sales").alias("mean_daily_sales"),
        F.median("daily_sales").alias("median_daily_sales"),
    )


def weekly_price_moves(active: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """Priced weeks per series with the change from the previous priced week and its direction."""
    weekly = active.where(F.col("sell_price").isNotNull()).groupBy(*SERIES, "dept_id", "week_start").agg(
        F.min("sell_price").alias("sell_price")
    )
    before = F.lag("sell_price").over(W.partitionBy(*SERIES).orderBy("week_start"))
    moved = weekly.withColumn("previous_price", before).withColumn("price_change", F.col("sell_price") - F.col("previous_price"))
    direction = (
        F.when(F.col("previous_price").isNull(), "first observation")
        .when(F.col("price_change") < -tolerance, "decrease")
        .when(F.col("price_change") > tolerance, "increase").otherwise("unchanged")
    )
    return moved.withColumns({
        "price_change_pct": F.lit(100.0) * ratio(F.col("price_change"), F.col("previous_price")), "change_direction": direction,
    })


def price_series(moves: DataFrame) -> DataFrame:
    return moves.groupBy(*SERIES).agg(
        F.min("dept_id").alias("dept_id"), F.count(F.lit(1)).alias("priced_weeks"),
        F.count_distinct("sell_price").alias("distinct_prices"),
        count_if(F.col("change_direction").isin("increase", "decrease")).alias("price_changes"),
        F.avg(F.abs("price_change_pct")).alias("mean_absolute_change_pct"),
    )


def price_with_demand(moves: DataFrame, active: DataFrame) -> DataFrame:
    units = active.groupBy(*SERIES, "week_start").agg(F.sum("sales").alias("weekly_sales"))
    return moves.join(units, [*SERIES, "week_start"], "left")


def price_demand_correlation(joined: DataFrame, weeks: int = 20, prices: int = 2) -> DataFrame:
    rows = joined.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("_weeks"), F.count_distinct("sell_price").alias("_prices"),
        F.corr("sell_price", F.col("weekly_sales").cast("double")).alias("correlation"),
    )
    kept = (F.col("_weeks") >= weeks) & (F.col("_prices") >= prices) & F.col("correlation").isNotNull() & ~F.isnan("correlation")
    return rows.where(kept).select(*SERIES, "correlation")


def outliers(active: DataFrame) -> DataFrame:
    """High quantiles of active sales, rows above p99.9 and their share on event days."""
    probabilities = {"p99": 0.99, "p999": 0.999, "p9999": 0.9999}
    cuts = quantiles(active, "sales", probabilities, small_domain=True)
    extreme = F.col("sales") > cuts.select("p999").scalar()
    event = F.col("event_name_1").isNotNull() | F.col("event_name_2").isNotNull()
    rows = active.agg(
        F.max("sales").alias("maximum"), count_if(extreme).alias("rows_above_p999"),
        percent(count_if(extreme), F.count(F.lit(1))).alias("rows_above_p999_pct"),
        count_if(extreme & event).alias("extreme_rows_on_event_days"),
    )
    return rows.select("*", *[cuts.select(n).scalar().alias(n) for n in probabilities])


def product_launches(series: DataFrame) -> DataFrame:
    rows = series.groupBy("item_id").agg(
        F.min("dept_id").alias("dept_id"), F.min("demand_band").alias("demand_band"),
        F.min("first_known_price_date").alias("earliest_price"), F.max("first_known_price_date").alias("latest_price"),
        F.min("first_positive_sale_date").alias("earliest_sale"), F.max("first_positive_sale_date").alias("latest_sale"),
        F.max("prelaunch_days").alias("maximum_prelaunch_days"),
    )
    return rows.withColumn("launch_year", F.year("earliest_price"))


def uplift(pairs: DataFrame, key: str, flag: str, values: Sequence = (0, 1)) -> DataFrame:
    """Percent difference of the flagged mean from the unflagged mean per key."""
    wide = pairs.groupBy(key).pivot(flag, list(values)).agg(F.max("mean_sales"))
    off, on = (F.col(str(v)) for v in values)
    return wide.select(key, change_percent(on, off).alias("difference_pct"))
