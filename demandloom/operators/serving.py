"""Parameterised reporting queries over the panel, forecast and recommendation tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.functions.columns import clip, count_if, period_start, ratio
from demandloom.sources.parameters import SERIES

FILTERABLE = ("store_id", "state_id", "item_id", "dept_id", "demand_band")
BREAKDOWNS = ("store_id", "dept_id", "weekday")


def conditions(filters: Mapping | None, allowed: Sequence[str] = FILTERABLE, *, strict: bool = True) -> Column:
    """AND of whitelisted predicates: None, "" and "All" are skipped, lists mean IN."""
    clauses = []
    for name, value in (filters or {}).items():
        if value is None or value in ("", "All") or (isinstance(value, (list, tuple, set)) and not value):
            continue
        if name not in allowed:
            if strict:
                raise ValueError(f"filter on unknown column {name!r}")
            continue
        clauses.append(F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return reduce(lambda a, b: a & b, clauses, F.lit(True))


def date_range(df: DataFrame, start=None, end=None, column: str = "date") -> DataFrame:
    """Inclusive date range; open ends are allowed."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(column) <= F.lit(end).cast("date"))
    return df


def filter_options(panel: DataFrame, columns: Sequence[str] = ("store_id", "dept_id", "item_id")) -> DataFrame:
    """Distinct values of each filter column as (option, value) rows, from one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("option"), F.col(c).alias("value")) for c in columns]))
    return panel.select(pairs.alias("p")).select("p.option", "p.value").distinct().orderBy("option", "value")


def sales_trend(panel: DataFrame, filters=None, start=None, end=None, frequency: str = "weekly") -> DataFrame:
    scoped = date_range(panel.where(conditions(filters)), start, end)
    period = period_start(F.col("date"), frequency).alias("period")
    return scoped.groupBy(period).agg(F.sum("sales").alias("sales")).orderBy("period")


def sales_breakdown(panel: DataFrame, group_by: str, filters=None, start=None, end=None) -> DataFrame:
    if group_by not in BREAKDOWNS:
        raise ValueError(f"breakdown by {group_by!r} is not supported")
    scoped = date_range(panel.where(conditions(filters)), start, end)
    return scoped.groupBy(group_by).agg(F.sum("sales").alias("sales")).orderBy(F.desc("sales"), group_by)


def demand_profile(panel: DataFrame, filters=None, start=None, end=None) -> DataFrame:
    zero = count_if(F.col("sales") == 0)
    return date_range(panel.where(conditions(filters)), start, end).agg(
        F.count(F.lit(1)).alias("observations"),
        zero.alias("zero_observations"),
        F.coalesce(ratio(zero, F.count(F.lit(1))), F.lit(0.0)).alias("zero_rate"),
        F.coalesce(F.avg("sales"), F.lit(0.0)).alias("mean_sales"),
        F.coalesce(F.max("sales"), F.lit(0)).alias("max_sales"),
    )


def recent_history(panel: DataFrame, store_id: str, item_id: str, days: int = 90) -> DataFrame:
    """Newest N days of one series, returned oldest first."""
    one = panel.where((F.col("store_id") == store_id) & (F.col("item_id") == item_id))
    return one.orderBy(F.desc("date")).limit(days).orderBy("date")


def forecast_lookup(forecast: DataFrame, store_id=None, item_id=None, horizon_days: int = 30) -> DataFrame:
    if not 1 <= horizon_days <= 30:
        raise ValueError("horizon_days must be between 1 and 30")
    scoped = forecast.where(conditions({"store_id": store_id, "item_id": item_id}))
    return scoped.where(F.col("horizon_day") <= horizon_days).orderBy(*SERIES, "horizon_day")


def by_urgency(recommendations: DataFrame) -> DataFrame:
    return recommendations.orderBy(F.desc("priority_score"), *SERIES)


def recommendation_list(recommendations: DataFrame, filters=None) -> DataFrame:
    return by_urgency(recommendations.where(conditions(filters)))


def decision_list(recommendations: DataFrame, action: str = "Needs reorder", store_id="All", dept_id="All") -> DataFrame:
    scoped = recommendations.where(conditions({"store_id": store_id, "dept_id": dept_id}))
    if action == "Needs reorder":
        scoped = scoped.where(F.col("recommended_order_qty") > 0)
    elif action == "No reorder":
        scoped = scoped.where(F.col("recommended_order_qty") <= 0)
    elif action != "All":
        raise ValueError(f"unknown action {action!r}")
    return by_urgency(scoped)


def order_action() -> Column:
    return F.when(F.col("recommended_order_qty") > 0, "REORDER").otherwise("NO ORDER")


# Business labels of the exported recommendation table.
LABELS = {
    "store_id": "Store",
    "item_id": "Item",
    "dept_id": "Department",
    "stock_status": "Stock status",
    "priority_label": "Priority",
    "inventory_position": "Inventory position",
    "reorder_point": "Reorder point",
    "recommended_order_qty": "Recommended order",
    "cost_optimized_order_qty": "Cost-aware order",
}


def labelled(df: DataFrame, labels: Mapping[str, str] = LABELS) -> DataFrame:
    """Business column names, only for the columns that exist."""
    return df.select(*[F.col(name).alias(label) for name, label in labels.items() if name in df.columns])


def shortage_reduction(before: Column, after: Column) -> Column:
    return F.when(before > 0, clip(ratio(before - after, before), 0.0)).otherwise(0.0)


def item_selector(recommendations: DataFrame, store_id: str, dept_id: str, *, by_need: bool = False) -> DataFrame:
    """Items of one store and department, by urgency or by name."""
    items = (
        recommendations.where(conditions({"store_id": store_id, "dept_id": dept_id}))
        .groupBy("item_id").agg(F.max("priority_score").alias("priority_score"))
    )
    return items.orderBy(F.desc("priority_score"), "item_id") if by_need else items.orderBy("item_id")


def overview(panel: DataFrame, forecast: DataFrame, recommendations: DataFrame, last, filters=None) -> DataFrame:
    """One row of headline figures; each table contributes one one-row aggregate. ``last`` is the newest day of the
    panel. The panel is read once and collapses to its series before anything distinct is counted."""
    recent = F.col("date") > F.date_sub(F.lit(last), 30)
    per_series = panel.where(conditions(filters)).groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("n"), F.sum("sales").alias("units"), F.sum(F.when(recent, F.col("sales"))).alias("recent"))
    sold = per_series.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("observations"),
        F.count_distinct("item_id").alias("products"),
        F.count_distinct("store_id").alias("stores"),
        F.count(F.lit(1)).alias("series"),
        F.sum("units").alias("units"),
        F.sum("recent").alias("trailing_30_day_units"),
    )
    scoped = forecast.where(conditions(filters)).agg(
        F.sum(F.when(F.col("horizon_day") <= 7, F.col("forecast"))).alias("forecast_7d"),
        F.sum("forecast").alias("forecast_30d"),
    )
    orders = recommendations.where(conditions(filters)).agg(
        count_if(F.col("recommended_order_qty") > 0).alias("reorder_count"),
        count_if(F.col("stock_status").isin("CRITICAL", "STOCKOUT")).alias("critical_count"),
        F.sum("expected_shortage_without_order").alias("shortage_before"),
        F.sum("expected_shortage_with_recommendation").alias("shortage_after"),
        F.sum("estimated_cost_savings").alias("savings"),
    )
    return sold.select(
        "*",
        *[scoped.select(c).scalar().alias(c) for c in scoped.columns],
        *[orders.select(c).scalar().alias(c) for c in orders.columns],
    )
