"""Retail domain views derived from the star-schema tables.

A series is one (store, item) pair. After the daily pre-aggregation a series holds at most
one row per calendar day, so every per-series window and array below is bounded by the
length of the calendar, however skewed the line items are.
"""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandloom.sources.parameters import (
    CATEGORY,
    DEPARTMENTS,
    EVENTS_1,
    EVENTS_2,
    FOLDS,
    LEAD_TIME_CHOICES,
    LOCKED,
    POLICY,
    SERIES,
    SERVICE_LEVEL_CHOICES,
    SNAP_DAYS,
    STATES,
)

#: Rows that a task sorts or sums at once.
TASK_ROWS = 500_000


def lookup(mapping: dict, key: Column, default=None) -> Column:
    """Fixed mapping as a ``when`` chain, so no join is needed for a handful of values."""
    items = iter(mapping.items())
    first_key, first_value = next(items)
    column = F.when(key == first_key, F.lit(first_value))
    for name, value in items:
        column = column.when(key == name, F.lit(value))
    return column.otherwise(F.lit(default)) if default is not None else column


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Hash-partition by keys so that a partition has about ``TASK_ROWS`` of the ``rows``.

    Aggregates and sorts behind it hold a partition's rows in memory, so their number, not the size of a
    scan split or the session's partition count, bounds the memory of a task.
    """
    return df.repartition(max(1, -(-rows // TASK_ROWS)), *keys)


def daily_line_sales(lineitem: DataFrame, rows: int) -> DataFrame:
    """Line items collapsed to (part, supplier, day) before any join sees them.

    Hardly two line items share the three keys, so combining them in the scan would hold its whole split; they are
    dealt first, a hot part by its supplier-days.
    Units are decimals (fractions of a unit survive) and cents integers, so sums are exact and order-free.
    """
    lines = lineitem.select(
        "l_partkey",
        "l_suppkey",
        F.to_date("l_shipdate").alias("date"),
        F.col("l_quantity").cast("decimal(18,4)").alias("units"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
    )
    keys = ["l_partkey", "l_suppkey", "date"]
    return dealt(lines, rows, *keys).groupBy(*keys).agg(F.sum("units").alias("sales"), F.sum("cents").alias("cents"))


def supplier_stores(supplier: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """Supplier -> store; nation and region sizes are checked by Spark's broadcast threshold."""
    geography = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    return supplier.join(geography, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.col("r_name").alias("store_id")
    )


def store_item_sales(
    lineitem: DataFrame,
    part: DataFrame,
    supplier: DataFrame,
    nation: DataFrame,
    region: DataFrame,
    *,
    item: str = "p_type",
) -> DataFrame:
    """Sparse daily facts (store, item, [department,] date, sales, cents)."""
    stores = supplier_stores(supplier, nation, region)
    rows = lineitem.count()
    facts = daily_line_sales(lineitem, rows).join(stores, F.col("l_suppkey") == F.col("s_suppkey"))
    if item == "p_partkey":
        parts = part.select(F.col("p_partkey").alias("item_id"), F.col("p_type").alias("dept_id"))
        facts = dealt(facts, rows, "l_partkey")  # the sort of the join and the sums behind it
        joined = facts.join(parts, F.col("l_partkey") == F.col("item_id"))
        keys = ["store_id", "item_id", "dept_id", "date"]
    else:
        parts = part.select("p_partkey", F.col(item).alias("item_id"))
        joined = facts.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        keys = ["store_id", "item_id", "date"]
    units = F.round(F.sum("sales")).cast("bigint")  # whole units a day
    return joined.groupBy(*keys).agg(units.alias("sales"), F.sum("cents").alias("cents"))


class Bounds(NamedTuple):
    lo: dt.date
    hi: dt.date

    @property
    def days(self) -> int:
        return (self.hi - self.lo).days + 1


def date_bounds(lineitem: DataFrame) -> Bounds:
    """First and last day of the calendar: one row of a one-column min/max scan.

    As literals they reach scans and partition filters, which a subquery would not.
    """
    row = lineitem.agg(F.to_date(F.min("l_shipdate")).alias("lo"), F.to_date(F.max("l_shipdate")).alias("hi")).first()
    return Bounds(row.lo, row.hi)


def calendar(spark: SparkSession, bounds: Bounds) -> DataFrame:
    """One row per day. Its size is the number of days, never the number of facts."""
    lo, hi = F.lit(bounds.lo), F.lit(bounds.hi)
    days = spark.range(1).select(F.explode(F.sequence(lo, hi)).alias("date"))
    month_day = F.date_format("date", "MM-dd")

    def slot(events: dict, position: int) -> Column:
        return lookup({f"{m:02d}-{d:02d}": value[position] for (m, d), value in events.items()}, month_day)

    day = F.dayofmonth("date")
    return days.select(
        "date",
        F.concat(F.lit("d_"), (F.datediff("date", lo) + 1).cast("string")).alias("d"),
        F.date_trunc("week", "date").cast("date").alias("week_start"),
        F.date_format("date", "EEEE").alias("weekday"),
        F.month("date").alias("month"),
        F.year("date").alias("year"),
        slot(EVENTS_1, 0).alias("event_name_1"),
        slot(EVENTS_1, 1).alias("event_type_1"),
        slot(EVENTS_2, 0).alias("event_name_2"),
        slot(EVENTS_2, 1).alias("event_type_2"),
        *[day.between(first, last).cast("int").alias(name) for name, (first, last) in SNAP_DAYS.items()],
    )


def unit_price(cents: Column, units: Column) -> Column:
    """Price in whole cents by integer rounding (half up), null where nothing was sold."""
    numerator = (cents * 2 + units).cast("bigint")
    denominator = F.nullif(units * 2, F.lit(0)).cast("bigint")
    rounded = F.floor(numerator / denominator)
    return rounded / 100.0


def weekly_prices(facts: DataFrame) -> DataFrame:
    """(store, item, Monday week) -> unit price of that week; weeks without sales have no row."""
    return (
        facts.groupBy(*SERIES, F.date_trunc("week", "date").cast("date").alias("week_start"))
        .agg(F.sum("sales").alias("units"), F.sum("cents").alias("cents"))
        .where(F.col("units") > 0)
        .select(*SERIES, "week_start", unit_price(F.col("cents"), F.col("units")).alias("sell_price"))
    )


def by_series(df: DataFrame) -> DataFrame:
    """Hash-partition by series with a fixed partition count.

    The rows multiply after this exchange (zero runs, windows), so the adaptive planner,
    which only sees the small sparse input, must not merge its partitions.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *SERIES)


def dense_daily(facts: DataFrame, bounds: Bounds) -> DataFrame:
    """Fill the gaps of every series with zero-sales rows.

    Each sold day emits itself and the zero run up to the next sold day, so no join with
    a date spine is needed and the rows stay hash-partitioned by series for later windows.
    """
    series = W.partitionBy(*SERIES).orderBy("date")
    facts = by_series(facts)
    lo, hi = F.lit(bounds.lo), F.lit(bounds.hi)
    runs = (
        facts.withColumn("next_date", F.lead("date").over(series))
        .withColumn("is_first", F.row_number().over(series) == 1)
        .withColumn("run_start", F.when(F.col("is_first"), F.least(lo, F.col("date"))).otherwise(F.col("date")))
        .withColumn("run_end", F.coalesce(F.date_sub("next_date", 1), F.greatest(hi, F.col("date"))))
    )
    day = F.explode(F.sequence("run_start", "run_end")).alias("day")
    sold = F.col("day") == F.col("date")
    return runs.select(*SERIES, "date", "sales", "cents", day).select(
        *SERIES,
        F.col("day").alias("date"),
        F.when(sold, F.col("sales")).otherwise(F.lit(0)).cast("bigint").alias("sales"),
        F.when(sold, F.col("cents")).otherwise(F.lit(0)).cast("bigint").alias("cents"),
    )


def hierarchy(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        lookup(DEPARTMENTS, F.col("item_id")).alias("dept_id"),
        F.lit(CATEGORY).alias("cat_id"),
        lookup(STATES, F.col("store_id")).alias("state_id"),
    )


def daily_panel(facts: DataFrame, bounds: Bounds) -> DataFrame:
    """Gap-free store-item-day panel with calendar, price and hierarchy columns."""
    days = F.broadcast(calendar(facts.sparkSession, bounds))
    week = W.partitionBy(*SERIES, "week_start")
    priced = (
        dense_daily(facts, bounds)
        .join(days, "date")
        .withColumn("sell_price", unit_price(F.sum("cents").over(week), F.sum("sales").over(week)))
        .drop("cents")
    )
    return hierarchy(priced)


def folds(df: DataFrame, *, locked: bool = False) -> DataFrame:
    """Fold manifest as a table (three or four rows)."""
    rows = [*FOLDS, LOCKED] if locked else FOLDS
    values = ", ".join(f"('{n}', DATE'{s}', DATE'{e}', {str(n == 'locked').lower()})" for n, s, e in rows)
    return df.sparkSession.sql(
        f"SELECT * FROM VALUES {values} AS folds(fold, start_date, end_date, is_locked)"
    )


def hash_int(*parts: Column) -> Column:
    """First 32 bits of the md5 of the joined parts, as a non-negative integer."""
    key = F.concat_ws("/", *[part.cast("string") for part in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def inventory_state(series: DataFrame) -> DataFrame:
    """One stock row per series, drawn from a hash of its key, so reruns agree."""
    def draw(salt: str) -> Column:
        return hash_int(F.col("store_id"), F.col("item_id"), F.lit(salt))

    def pick(choices: list, salt: str) -> Column:
        return F.element_at(F.array(*[F.lit(c) for c in choices]), (draw(salt) % len(choices) + 1).cast("int"))

    return series.select(
        *SERIES,
        (draw("a") % 400).cast("double").alias("on_hand"),
        (draw("b") % 60).cast("double").alias("on_order"),
        (draw("c") % 3).cast("double").alias("backorders"),
        pick(LEAD_TIME_CHOICES, "d").cast("int").alias("lead_time_days"),
        pick(SERVICE_LEVEL_CHOICES, "e").alias("service_level"),
        F.lit(POLICY["holding_cost_per_unit_per_day"]).alias("holding_cost_per_unit_per_day"),
        F.lit(POLICY["stockout_cost_per_unit"]).alias("stockout_cost_per_unit"),
        F.lit(POLICY["fixed_order_cost"]).alias("fixed_order_cost"),
        F.lit("hashed_fixture").alias("inventory_source"),
    )
