"""Availability, calendar, history-window and price features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandloom.catalog.registry import query
from demandloom.functions.columns import change_percent, count_if, percent
from demandloom.operators import features as ft
from demandloom.operators.joins import checked_join
from demandloom.sources.parameters import SERIES

KEYS = ["store_id", "item_id", "date"]


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({name: F.round(F.col(name).cast("double"), digits) for name in columns})


def sql_round(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({name}::DOUBLE, {digits}) AS {name}" for name in columns)


@query("prj_04_availability_boundary", """
SELECT store_id, item_id, min(first_price) AS first_known_price_date, min(first_sale) AS first_positive_sale_date,
  min(launch_date) AS launch_date FROM flagged GROUP BY 1, 2""")
def availability_boundary(d):
    return ft.flag_availability(d.panel).groupBy(*SERIES).agg(
        F.min("first_known_price_date").alias("first_known_price_date"),
        F.min("first_positive_sale_date").alias("first_positive_sale_date"),
        F.min("launch_date").alias("launch_date"),
    )


@query("prj_05_active_period_summary", """
SELECT count(*) FILTER (active_flag) AS active_rows, count(*) FILTER (prelaunch_flag) AS prelaunch_rows_excluded,
  round(100.0 * count(*) FILTER (prelaunch_flag) / count(*), 6) AS prelaunch_pct,
  count(*) FILTER (active_flag AND sales = 0) AS active_zero_rows_retained,
  count(*) FILTER (active_flag AND sell_price IS NULL) AS active_missing_price_rows,
  max(CASE WHEN active_flag THEN launch_date END) AS availability_date_max FROM flagged""")
def active_period_summary(d):
    active = F.col("active_flag")
    return ft.flag_availability(d.panel).agg(
        count_if(active).alias("active_rows"),
        count_if(~active).alias("prelaunch_rows_excluded"),
        F.round(percent(count_if(~active), F.count(F.lit(1))), 6).alias("prelaunch_pct"),
        count_if(active & (F.col("sales") == 0)).alias("active_zero_rows_retained"),
        count_if(active & F.col("sell_price").isNull()).alias("active_missing_price_rows"),
        F.max(F.when(active, F.col("launch_date"))).alias("availability_date_max"),
    )


@query("prj_06_launch_flags", "SELECT store_id, item_id, date, sales, prelaunch_flag, active_flag FROM flagged")
def launch_flags(d):
    return ft.flag_availability(d.panel).select(*KEYS, "sales", "prelaunch_flag", "active_flag")


@query("prj_07_product_age", "SELECT store_id, item_id, date, product_age_days, product_age_weeks FROM active")
def product_age(d):
    return d.active.select(*KEYS, "product_age_days", "product_age_weeks")


@query("prj_08_feature_readiness", """
SELECT store_id, item_id, count(*) AS n_rows, count(*) FILTER (is_feature_ready) AS ready_rows,
  min(CASE WHEN is_feature_ready THEN date END) AS first_ready_date FROM features GROUP BY 1, 2""")
def feature_readiness(d):
    return d.features.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("n_rows"),
        count_if(F.col("is_feature_ready")).alias("ready_rows"),
        F.min(F.when(F.col("is_feature_ready"), F.col("date"))).alias("first_ready_date"),
    )


@query("scl_01_date_parts", """
SELECT store_id, item_id, date, CAST(day_of_week AS INTEGER) AS day_of_week, CAST(day_of_month AS INTEGER) AS day_of_month,
  CAST(quarter AS INTEGER) AS quarter, CAST(week_of_year AS INTEGER) AS week_of_year, month, year, weekday,
  is_weekend, is_event, snap_active FROM features""")
def date_parts(d):
    return ft.calendar_features(d.active).select(
        *KEYS, "day_of_week", "day_of_month", "quarter", "week_of_year", "month", "year", "weekday",
        "is_weekend", "is_event", "snap_active",
    )


@query("scl_02_calendar_consistency", """
SELECT bool_and(weekday = dayname(date)) AS weekday_matches, bool_and(month = month(date)) AS month_matches,
  bool_and(year = year(date)) AS year_matches, count(*) AS days FROM calendar""")
def calendar_consistency(d):
    return d.calendar.agg(
        F.bool_and(F.col("weekday") == F.date_format("date", "EEEE")).alias("weekday_matches"),
        F.bool_and(F.col("month") == F.month("date")).alias("month_matches"),
        F.bool_and(F.col("year") == F.year("date")).alias("year_matches"),
        F.count(F.lit(1)).alias("days"),
    )


@query("scl_03_weekend_flag", """
SELECT store_id, is_weekend, count(*) AS n_rows, CAST(sum(sales) AS BIGINT) AS units FROM features GROUP BY 1, 2""")
def weekend_flag(d):
    return ft.calendar_features(d.active).groupBy("store_id", "is_weekend").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("sales").alias("units")
    )


CYCLES = ["day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos"]


@query("scl_04_cyclic_encodings", """
SELECT date, round(min(day_of_week_sin), 6) AS day_of_week_sin,
  round(min(day_of_week_cos), 6) AS day_of_week_cos, round(min(month_sin), 6) AS month_sin, round(min(month_cos), 6) AS month_cos
FROM features GROUP BY 1""")
def cyclic_encodings(d):
    return ft.calendar_features(d.active).groupBy("date").agg(*[F.round(F.min(c), 6).alias(c) for c in CYCLES])


@query("scl_05_event_flag", """
SELECT date, event_name_1, event_name_2, event_name_1 IS NOT NULL OR event_name_2 IS NOT NULL AS is_event FROM calendar""")
def event_flag(d):
    return d.calendar.select("date", "event_name_1", "event_name_2", ft.has_event().alias("is_event"))


@query("scl_06_store_benefit_days", """
SELECT store_id, state_id, count(*) AS n_rows, count(*) FILTER (snap_active = 1) AS flagged_rows FROM features GROUP BY 1, 2""")
def store_benefit_days(d):
    return d.active.withColumn("snap_active", ft.store_snap()).groupBy("store_id", "state_id").agg(
        F.count(F.lit(1)).alias("n_rows"), count_if(F.col("snap_active") == 1).alias("flagged_rows")
    )


@query("win_01_sales_lags", """
SELECT store_id, item_id, date, sales_lag_1, sales_lag_7, sales_lag_14, sales_lag_28 FROM features""")
def sales_lags(d):
    return ft.sales_lags(d.active).select(*KEYS, *[f"sales_lag_{n}" for n in ft.LAGS])


MEANS = [f"sales_roll_mean_{n}" for n in ft.MEAN_WINDOWS]
STDS = [f"sales_roll_std_{n}" for n in ft.SPREAD_WINDOWS]
ZEROS = [f"zero_rate_{n}" for n in ft.SPREAD_WINDOWS]


@query("win_02_rolling_means", f"SELECT store_id, item_id, date, {sql_round(MEANS)} FROM features")
def rolling_means(d):
    return rounded(ft.rolling_means(d.active).select(*KEYS, *MEANS), MEANS)


@query("win_03_rolling_stds", f"SELECT store_id, item_id, date, {sql_round(STDS)} FROM features")
def rolling_stds(d):
    return rounded(ft.rolling_stds(d.active).select(*KEYS, *STDS), STDS)


@query("win_04_zero_rates", f"SELECT store_id, item_id, date, {sql_round(ZEROS)} FROM features")
def zero_rates(d):
    return rounded(ft.zero_rates(d.active).select(*KEYS, *ZEROS), ZEROS)


@query("win_05_days_since_positive", """
SELECT store_id, item_id, date, CAST(days_since_last_positive_sale AS INTEGER) AS days_since_last_positive_sale FROM features""")
def days_since_positive(d):
    return ft.days_since_positive(d.active).select(*KEYS, "days_since_last_positive_sale")


@query("win_06_weekly_price_table", """
SELECT store_id, item_id, week_start, first_date, weekly_price, distinct_prices FROM weekly_features""")
def weekly_price_table(d):
    return ft.weekly_price_table(d.active)


@query("win_07_weekly_price_changes", """
SELECT store_id, item_id, week_start, prev_price AS previous_week_price, round(price_change, 6) AS price_change_previous_week,
  round(price_pct_change, 6) AS price_pct_change_previous_week FROM weekly_features""")
def weekly_price_changes(d):
    weekly = ft.weekly_price_features(ft.weekly_price_table(d.active))
    names = ["price_change_previous_week", "price_pct_change_previous_week"]
    return rounded(weekly.select(*SERIES, "week_start", "previous_week_price", *names), names)


@query("win_08_price_vs_4week_median", """
SELECT store_id, item_id, week_start, round(price_vs_median, 6) AS price_vs_4week_median_lagged FROM weekly_features""")
def price_vs_median(d):
    weekly = ft.weekly_price_features(ft.weekly_price_table(d.active))
    return rounded(weekly.select(*SERIES, "week_start", "price_vs_4week_median_lagged"), ["price_vs_4week_median_lagged"])


@query("win_09_extreme_price_changes", """
SELECT store_id, item_id, week_start, prev_price AS previous_week_price, weekly_price, round(weekly_price - prev_price, 6) AS change_absolute,
  round(100 * (weekly_price / prev_price - 1), 6) AS change_pct
FROM weekly_features WHERE weekly_price <> prev_price
ORDER BY abs(round(100 * (weekly_price / prev_price - 1), 6)) DESC, store_id, item_id, week_start LIMIT 10""")
def extreme_price_changes(d):
    weekly = ft.weekly_price_features(ft.weekly_price_table(d.active))
    price, before = F.col("weekly_price"), F.col("previous_week_price")
    changed = weekly.where(price != before).select(
        *SERIES, "week_start", "previous_week_price", "weekly_price",
        F.round(price - before, 6).alias("change_absolute"),
        F.round(change_percent(price, before), 6).alias("change_pct"),
    )
    return changed.orderBy(F.abs("change_pct").desc(), *SERIES, "week_start").limit(10)


@query("win_11_series_first_date", """
SELECT store_id, item_id, date, min(date) OVER (PARTITION BY store_id, item_id) AS series_first_date,
  min(CASE WHEN sales > 0 THEN date END) OVER (PARTITION BY store_id, item_id) AS series_first_sale FROM panel""")
def series_first_date(d):
    whole = W.partitionBy(*SERIES)
    return d.panel.select(
        *KEYS,
        F.min("date").over(whole).alias("series_first_date"),
        F.min(F.when(F.col("sales") > 0, F.col("date"))).over(whole).alias("series_first_sale"),
    )


@query("jn_05_weekly_features_to_daily", """
SELECT a.store_id, a.item_id, a.date, w.prev_price AS previous_week_price, round(w.price_change, 6) AS price_change_previous_week
FROM active a LEFT JOIN weekly_features w USING (store_id, item_id, week_start)""")
def weekly_features_to_daily(d):
    weekly = ft.weekly_price_features(ft.weekly_price_table(d.active)).select(
        *SERIES, "week_start", "previous_week_price", "price_change_previous_week"
    )
    joined = checked_join(d.active.select(*KEYS, "week_start"), weekly, [*SERIES, "week_start"], "left", "many_to_one")
    return rounded(joined.drop("week_start"), ["price_change_previous_week"])


NUMERIC = [*CYCLES, *MEANS, *STDS, *ZEROS, "previous_week_price", "price_change_previous_week",
           "price_pct_change_previous_week", "price_vs_4week_median_lagged"]


@query("prj_12_feature_table_in_manifest_order", f"""
SELECT date, d, week_start, item_id, dept_id, cat_id, store_id, state_id, availability_date, is_active, product_age_days, product_age_weeks,
  CAST(day_of_week AS INTEGER) AS day_of_week, CAST(day_of_month AS INTEGER) AS day_of_month, month, CAST(quarter AS INTEGER) AS quarter,
  year, CAST(week_of_year AS INTEGER) AS week_of_year, is_weekend, is_event, event_name_1, event_type_1, event_name_2, event_type_2, snap_active,
  sales_lag_1, sales_lag_7, sales_lag_14, sales_lag_28, CAST(days_since_last_positive_sale AS INTEGER) AS days_since_last_positive_sale,
  {sql_round(NUMERIC)}, sell_price AS known_future_sell_price, demand_band, is_feature_ready, sales
FROM features""")
def feature_table(d):
    return rounded(d.features, NUMERIC)


SOURCE_NAMES = {"known_future_sell_price": "sell_price"}


@query("prj_13_constant_columns", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{name}' AS column_name, count(DISTINCT coalesce(CAST({SOURCE_NAMES.get(name, name)} AS VARCHAR), '?')) = 1 AS is_constant FROM features"
    for name in ft.FEATURE_COLUMNS) + ") WHERE is_constant")
def constant_columns(d):
    table = d.features
    flags = table.agg(*[
        (F.min(F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))) == F.max(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")))).alias(c)
        for c in table.columns
    ])
    return flags.unpivot([], table.columns, "column_name", "is_constant").where("is_constant")


@query("agg_43_feature_missingness", " UNION ALL ".join(
    f"SELECT '{name}' AS feature, count(*) - count({name}) AS missing_rows, round(100.0 * (count(*) - count({name})) / count(*), 6) AS missing_pct FROM features"
    for name in ft.REQUIRED_FEATURES))
def feature_missingness(d):
    counts = d.features.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in ft.REQUIRED_FEATURES])
    long = counts.unpivot("_rows", ft.REQUIRED_FEATURES, "feature", "present")
    missing = F.col("_rows") - F.col("present")
    return long.select("feature", missing.alias("missing_rows"), F.round(percent(missing, F.col("_rows")), 6).alias("missing_pct"))


@query("agg_44_first_ready_age_range", """
SELECT min(age) AS first_ready_age_min, max(age) AS first_ready_age_max
FROM (SELECT store_id, item_id, min(product_age_days) AS age FROM features WHERE is_feature_ready GROUP BY 1, 2)""")
def first_ready_age_range(d):
    per_series = d.features.where("is_feature_ready").groupBy(*SERIES).agg(F.min("product_age_days").alias("age"))
    return per_series.agg(F.min("age").alias("first_ready_age_min"), F.max("age").alias("first_ready_age_max"))
