"""Leakage-safe features on the gap-free daily panel.

Every window here is partitioned by series, the partitioning the panel already has, so the
whole feature table costs sorts but no further exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandloom.functions.columns import all_of, change_percent, cyclic, has_event, ratio, store_snap, tertile_band
from demandloom.functions.quantiles import quantiles
from demandloom.sources.parameters import SERIES


def by_date() -> WindowSpec:
    return W.partitionBy(*SERIES).orderBy("date")


def whole_series() -> WindowSpec:
    return W.partitionBy(*SERIES)


LAGS = (1, 7, 14, 28)
MEAN_WINDOWS = (7, 14, 28)
SPREAD_WINDOWS = (7, 28)
HISTORY_FEATURES = [
    *[f"sales_lag_{n}" for n in LAGS],
    *[f"sales_roll_mean_{n}" for n in MEAN_WINDOWS],
    *[f"sales_roll_std_{n}" for n in SPREAD_WINDOWS],
    *[f"zero_rate_{n}" for n in SPREAD_WINDOWS],
    "days_since_last_positive_sale",
]
PRICE_FEATURES = [
    "previous_week_price",
    "price_change_previous_week",
    "price_pct_change_previous_week",
    "price_vs_4week_median_lagged",
]
REQUIRED_FEATURES = HISTORY_FEATURES + PRICE_FEATURES
CALENDAR_FEATURES = [
    "day_of_week", "day_of_month", "month", "quarter", "year", "week_of_year", "is_weekend",
    "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos",
]
EVENT_FEATURES = ["is_event", "event_name_1", "event_type_1", "event_name_2", "event_type_2"]

# Column -> (category, timing class, default predictor).
FEATURE_SPEC: dict[str, tuple[str, str, bool]] = {
    "date": ("calendar", "same_day_known_calendar", False),
    "d": ("calendar", "same_day_known_calendar", False),
    "week_start": ("calendar", "same_day_known_calendar", False),
    "item_id": ("identity", "static_identity", True),
    "dept_id": ("identity", "static_identity", True),
    "cat_id": ("identity", "static_identity", False),
    "store_id": ("identity", "static_identity", True),
    "state_id": ("identity", "static_identity", True),
    "availability_date": ("product_age", "availability_proxy", False),
    "is_active": ("product_age", "availability_proxy", False),
    "product_age_days": ("product_age", "availability_proxy", True),
    "product_age_weeks": ("product_age", "availability_proxy", True),
    **{name: ("calendar", "same_day_known_calendar", True) for name in CALENDAR_FEATURES},
    **{name: ("event", "same_day_known_calendar", True) for name in EVENT_FEATURES},
    "snap_active": ("SNAP", "same_day_known_calendar", True),
    **{name: ("sales_history", "past_target_history", True) for name in HISTORY_FEATURES},
    **{name: ("price_history", "past_price_history", True) for name in PRICE_FEATURES},
    "known_future_sell_price": ("optional_known_future", "optional_known_future", False),
    "demand_band": ("analysis_only", "analysis_only", False),
    "is_feature_ready": ("control", "control", False),
    "sales": ("target", "target", False),
}
FEATURE_COLUMNS = list(FEATURE_SPEC)
DEFAULT_PREDICTORS = [name for name, spec in FEATURE_SPEC.items() if spec[2]]
ALLOWED_TIMINGS = [
    "static_identity", "same_day_known_calendar", "availability_proxy", "past_target_history", "past_price_history",
]


def item_mean_demand(facts: DataFrame, days: int) -> DataFrame:
    """Mean daily units per item over its stores and the whole calendar, from sparse facts."""
    per_series = facts.groupBy(*SERIES).agg(F.sum("sales").alias("units"))
    return per_series.groupBy("item_id").agg(
        ratio(F.sum("units"), F.count(F.lit(1)) * days).alias("mean_daily_demand")
    )


def assign_bands(items: DataFrame, metric: str = "mean_daily_demand") -> DataFrame:
    """Tertile bands of the whole population; equal thresholds are an error."""
    cuts = quantiles(items, metric, {"low": 1 / 3, "high": 2 / 3})
    low, high = cuts.select("low").scalar(), cuts.select("high").scalar()
    distinct = F.when(low >= high, F.raise_error(F.lit("demand tertiles are not distinct")).cast("string"))
    return items.withColumn("demand_band", F.coalesce(distinct, tertile_band(F.col(metric), low, high)))


def flag_availability(panel: DataFrame) -> DataFrame:
    """First known price, first sale and the launch boundary on every row."""
    first_price = F.min(F.when(F.col("sell_price").isNotNull(), F.col("date"))).over(whole_series())
    first_sale = F.min(F.when(F.col("sales") > 0, F.col("date"))).over(whole_series())
    flagged = panel.withColumns({"first_known_price_date": first_price, "first_positive_sale_date": first_sale})
    missing = F.raise_error(F.lit("a series has neither a known price nor a positive sale")).cast("date")
    return flagged.withColumn(
        "launch_date", F.coalesce("first_known_price_date", "first_positive_sale_date", missing)
    ).withColumns({
        "prelaunch_flag": F.col("date") < F.col("launch_date"),
        "active_flag": F.col("date") >= F.col("launch_date"),
    })


def active_period(panel: DataFrame) -> DataFrame:
    """Rows from availability on (zero sales kept) with product age."""
    flagged = flag_availability(panel).where("active_flag")
    age = F.datediff("date", "launch_date")
    return flagged.withColumn("availability_date", F.col("launch_date")).withColumns({
        "is_active": F.col("active_flag"),
        "product_age_days": age.cast("int"),
        "product_age_weeks": F.floor(age / 7).cast("int"),
    }).drop("first_known_price_date", "first_positive_sale_date", "launch_date", "prelaunch_flag", "active_flag")


def calendar_features(df: DataFrame) -> DataFrame:
    weekday = F.weekday("date")
    dow_sin, dow_cos = cyclic(weekday, 7)
    month_sin, month_cos = cyclic(F.col("month") - 1, 12)
    return df.withColumns({
        "day_of_week": weekday,
        "day_of_month": F.dayofmonth("date"),
        "quarter": F.quarter("date"),
        "week_of_year": F.weekofyear("date"),
        "is_weekend": weekday >= 5,
        "day_of_week_sin": dow_sin,
        "day_of_week_cos": dow_cos,
        "month_sin": month_sin,
        "month_cos": month_cos,
        "is_event": has_event(),
        "snap_active": store_snap(),
    })


def _totals(df: DataFrame) -> DataFrame:
    """Running integer totals per series: units, squared units, zero days, rows, last sale."""
    so_far = by_date().rowsBetween(W.unboundedPreceding, W.currentRow)
    sales = F.col("sales").cast("bigint")
    exact = sales.cast("decimal(19,0)")  # squares of large daily units would overflow a bigint total
    return df.withColumns({
        "_units": F.sum(sales).over(so_far),
        "_squares": F.sum((exact * exact).cast("decimal(28,0)")).over(so_far),
        "_zeros": F.sum(F.when(sales == 0, 1).otherwise(0)).over(so_far),
        "_rows": F.row_number().over(by_date()),
        "_last_sale": F.max(F.when(sales > 0, F.col("date"))).over(so_far),
    })


TOTALS = ["_units", "_squares", "_zeros", "_rows", "_last_sale"]


def _past(total: str, n: int) -> Column:
    """Total over t-n..t-1 as a difference of two running totals, null until n rows exist.

    One subtraction per row instead of re-aggregating a sliding frame; the totals are
    integers, so nothing is lost to cancellation.
    """
    before = F.coalesce(F.lag(total, n + 1).over(by_date()), F.lit(0))
    return F.when(F.col("_rows") > n, F.lag(total, 1).over(by_date()) - before)


def lag_columns() -> dict[str, Column]:
    return {f"sales_lag_{n}": F.lag("sales", n).over(by_date()) for n in LAGS}


def mean_columns() -> dict[str, Column]:
    return {f"sales_roll_mean_{n}": _past("_units", n) / n for n in MEAN_WINDOWS}


def std_columns() -> dict[str, Column]:
    def deviation(n: int) -> Column:
        units, squares = _past("_units", n).cast("decimal(19,0)"), _past("_squares", n).cast("decimal(35,0)")
        scatter = (squares * n).cast("decimal(38,0)") - (units * units).cast("decimal(38,0)")
        return F.sqrt(scatter.cast("double") / (n * (n - 1)))

    return {f"sales_roll_std_{n}": deviation(n) for n in SPREAD_WINDOWS}


def zero_columns() -> dict[str, Column]:
    return {f"zero_rate_{n}": _past("_zeros", n) / n for n in SPREAD_WINDOWS}


def recency_columns() -> dict[str, Column]:
    return {"days_since_last_positive_sale": F.datediff("date", F.lag("_last_sale", 1).over(by_date()))}


def sales_lags(df: DataFrame) -> DataFrame:
    return df.withColumns(lag_columns())


def rolling_means(df: DataFrame) -> DataFrame:
    return _totals(df).withColumns(mean_columns()).drop(*TOTALS)


def rolling_stds(df: DataFrame) -> DataFrame:
    return _totals(df).withColumns(std_columns()).drop(*TOTALS)


def zero_rates(df: DataFrame) -> DataFrame:
    return _totals(df).withColumns(zero_columns()).drop(*TOTALS)


def days_since_positive(df: DataFrame) -> DataFrame:
    return _totals(df).withColumns(recency_columns()).drop(*TOTALS)


def demand_history(df: DataFrame) -> DataFrame:
    """All twelve history features from one pair of window passes."""
    return _totals(df).withColumns(
        {**lag_columns(), **mean_columns(), **std_columns(), **zero_columns(), **recency_columns()}
    ).drop(*TOTALS)


def weekly_price_table(active: DataFrame) -> DataFrame:
    """One row per series-week: first day, price and the number of distinct prices."""
    return active.groupBy(*SERIES, "week_start").agg(
        F.min("date").alias("first_date"),
        F.min("sell_price").alias("weekly_price"),
        F.count_distinct("sell_price").alias("distinct_prices"),
    )


def weekly_price_features(weekly: DataFrame) -> DataFrame:
    """Completed-prior-week price features at weekly grain."""
    weeks = W.partitionBy(*SERIES).orderBy("week_start")
    past4 = weeks.rowsBetween(-4, -1)
    price = F.col("weekly_price")
    middle = (F.sum(price).over(past4) - F.min(price).over(past4) - F.max(price).over(past4)) / 2
    return (
        weekly.withColumn("previous_week_price", F.lag(price, 1).over(weeks))
        .withColumn("_two_back", F.lag(price, 2).over(weeks))
        .withColumn("_median4", F.when(F.count(price).over(past4) == 4, middle))
        .withColumn("price_change_previous_week", F.col("previous_week_price") - F.col("_two_back"))
        .withColumn("price_pct_change_previous_week", change_percent(F.col("previous_week_price"), F.col("_two_back")))
        .withColumn("price_vs_4week_median_lagged", ratio(F.col("previous_week_price"), F.col("_median4")) - 1)
        .drop("_two_back", "_median4")
    )


def lagged_price_features(active: DataFrame) -> DataFrame:
    """The same weekly features straight on daily rows, without leaving the series partitioning.

    The active panel has no missing weeks, so the k-th previous week is the RANGE frame
    exactly k weeks back and no join with a weekly table is needed.
    """
    indexed = active.withColumn("_week", (F.datediff("week_start", F.lit("1970-01-05").cast("date")) / 7).cast("int"))
    by_week = W.partitionBy(*SERIES).orderBy("_week")
    back = [F.max("sell_price").over(by_week.rangeBetween(-k, -k)) for k in (1, 2, 3, 4)]
    lagged = indexed.withColumns({f"_p{k}": column for k, column in enumerate(back, start=1)})
    p1, p2, p3, p4 = (F.col(f"_p{k}") for k in (1, 2, 3, 4))
    middle = (p1 + p2 + p3 + p4 - F.least(p1, p2, p3, p4) - F.greatest(p1, p2, p3, p4)) / 2
    complete = all_of(p.isNotNull() for p in (p1, p2, p3, p4))
    return lagged.withColumns({
        "previous_week_price": p1,
        "price_change_previous_week": p1 - p2,
        "price_pct_change_previous_week": change_percent(p1, p2),
        "price_vs_4week_median_lagged": F.when(complete, ratio(p1, middle) - 1),
    }).drop("_week", "_p1", "_p2", "_p3", "_p4")


def readiness() -> Column:
    return all_of(F.col(name).isNotNull() for name in REQUIRED_FEATURES)


def feature_table(panel: DataFrame, bands: DataFrame) -> DataFrame:
    """Active panel with all features in manifest order.

    ``bands`` has one row per series, so this join keeps the panel's series partitioning:
    only the small side moves.
    """
    built = lagged_price_features(demand_history(calendar_features(active_period(panel))))
    banded = built.join(bands.select(*SERIES, "demand_band"), SERIES, "left")
    return (
        banded.withColumnRenamed("sell_price", "known_future_sell_price")
        .withColumn("is_feature_ready", readiness())
        .select(*FEATURE_COLUMNS)
    )


def feature_manifest(df: DataFrame) -> DataFrame:
    """The feature specification as a table (one row per column)."""
    rows = [(i, name, *spec) for i, (name, spec) in enumerate(FEATURE_SPEC.items(), start=1)]
    return df.sparkSession.createDataFrame(
        rows, "position int, feature string, category string, source_timing string, default_model_feature boolean"
    )
