"""Data-quality checks as rows (check_name, passed, observed, expected)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.functions.columns import percent
from demandloom.operators.profile import duplicate_rows, grid_coverage
from demandloom.sources.parameters import SERIES


def checks(df: DataFrame, rules: dict[str, tuple[Column, Column | int | float]]) -> DataFrame:
    """Named (observed aggregate, expected value) pairs from one pass over ``df``."""
    observed = df.agg(*[F.coalesce(pair[0].cast("double"), F.lit(-1.0)).alias(name) for name, pair in rules.items()])
    expected = {
        name: pair[1] if isinstance(pair[1], Column) else F.lit(float(pair[1])) for name, pair in rules.items()
    }
    rows = F.array(*[
        F.struct(F.lit(name).alias("check_name"), F.col(name).alias("observed"), expected[name].cast("double").alias("expected"))
        for name in rules
    ])
    return observed.select(F.inline(rows)).select(
        "check_name", F.col("observed").eqNullSafe(F.col("expected")).alias("passed"), "observed", "expected"
    )


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


#: Days one bitmap holds; the span of the panel is checked against it.
BITMAP_DAYS = 32_768


def per_series(panel: DataFrame, first_day, days: int, conditions: dict[str, Column], kept: dict[str, Column]) -> DataFrame:
    """One row per series: its rows, its days as a bitmap, how many rows meet each condition, and ``kept``.

    The panel is read once. Distinct days and repeated keys come from the bitmaps, distinct stores and items from the
    rows of the series, so nothing is expanded row by row for a distinct count.
    """
    if days > BITMAP_DAYS:
        raise ValueError(f"the panel spans {days} days; a bitmap holds {BITMAP_DAYS}")
    ordinal = F.datediff("date", F.lit(first_day)) + 1
    return panel.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("n_rows"), F.bitmap_construct_agg(F.bitmap_bit_position(ordinal)).alias("days_seen"),
        *[F.count_if(c).alias(name) for name, c in conditions.items()], *[c.alias(name) for name, c in kept.items()],
    )


def key_rules(stores: int, items: int, days: int) -> dict[str, tuple[Column, int]]:
    """Sizes and uniqueness of the panel, as aggregates over ``per_series``."""
    return {
        "stores": (F.count_distinct("store_id"), stores),
        "items": (F.count_distinct("item_id"), items),
        "series": (F.count(F.lit(1)), stores * items),
        "days": (F.bitmap_count(F.bitmap_or_agg("days_seen")), days),
        "row_count": (F.sum("n_rows"), stores * items * days),
        "duplicate_keys": (F.sum(F.col("n_rows") - F.bitmap_count("days_seen")), 0),
    }


PANEL_FAULTS = {
    "negative_sales": lambda: F.col("sales") < 0,
    "unmatched_calendar_rows": lambda: F.col("d").isNull(),
    "non_positive_prices": lambda: F.col("sell_price") <= 0,
    "missing_hierarchy": lambda: F.col("dept_id").isNull() | F.col("state_id").isNull(),
}


def panel_checks(panel: DataFrame, first_day, stores: int, items: int, days: int, faults: dict[str, Column] | None = None,
                 rules: dict[str, tuple[Column, int]] | None = None, kept: dict[str, Column] | None = None) -> DataFrame:
    """Integrity of the gap-free panel in one scan; ``faults`` are further conditions no row may meet, ``rules`` further
    aggregates over the series rows, which hold the aggregates ``kept``."""
    conditions = {name: rule() for name, rule in PANEL_FAULTS.items()} | (faults or {})
    rows = per_series(panel, first_day, days, conditions, kept or {})
    return checks(rows, {**key_rules(stores, items, days), **{n: (F.sum(n), 0) for n in conditions}, **(rules or {})})


def violations(df: DataFrame, table: str, rules: dict[str, Column]) -> DataFrame:
    """Rows breaking each CHECK-style rule of one table."""
    counted = df.agg(*[F.count_if(~rule).alias(name) for name, rule in rules.items()])
    return counted.unpivot([], list(rules), "constraint_name", "violations").select(F.lit(table).alias("table_name"), "constraint_name", "violations")


def observations(panel: DataFrame, prices: DataFrame, weeks: int) -> DataFrame:
    """Profile values with a rule-based label."""
    def label(value: Column, when_positive: str) -> Column:
        return F.when(value > 0, when_positive).otherwise("expected")

    negative, duplicated = F.col("negative"), F.col("duplicated")
    sales = panel.agg(
        percent(F.count_if(F.col("sales") == 0), F.count(F.lit(1))).alias("zero_pct"), F.count_if(F.col("sales") < 0).alias("negative")
    ).select(F.inline(F.array(
        F.struct(F.lit("zero-heavy demand").alias("observation"), F.lit("expected").alias("classification"), F.col("zero_pct").alias("value")),
        F.struct(
            F.lit("negative sales").alias("observation"), label(negative, "potential issue").alias("classification"),
            negative.cast("double").alias("value"),
        ),
    )))
    keys = prices.agg(duplicate_rows(prices, [*SERIES, "week_start"]).alias("duplicated")).select(
        F.lit("duplicate price keys").alias("observation"), label(duplicated, "potential issue").alias("classification"), duplicated.cast("double").alias("value")
    )
    grid = grid_coverage(prices, [], weeks).select(
        F.lit("sparse price grid").alias("observation"), F.lit("expected").alias("classification"), F.col("coverage_pct").alias("value")
    )
    changed = prices.groupBy("item_id").agg(F.min("sell_price").alias("lo"), F.max("sell_price").alias("hi"))
    moves = changed.agg(F.count_if(F.col("lo") < F.col("hi")).cast("double").alias("value")).select(
        F.lit("items with price changes").alias("observation"), label(F.col("value"), "investigate").alias("classification"), "value"
    )
    return union(sales, keys, grid, moves)
