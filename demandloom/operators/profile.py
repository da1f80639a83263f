"""Source profiles, price coverage, item eligibility and quota sampling on sparse daily facts.

Zero days are arithmetic (calendar days minus sold days), so the item-level grid of
items x stores x days is never materialised.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandloom.functions.columns import all_of, percent, ratio
from demandloom.operators.joins import checked_join
from demandloom.sources.parameters import SERIES
from demandloom.sources.retail import Bounds

# Screens used on the item-level facts of the test tables.
ELIGIBILITY = {
    "zero_prevalence": 0.9976,
    "remaining_history_days": 2350,
    "price_coverage": 0.005,
    "stores": 5,
}
QUOTAS = {"low": 4, "medium": 3, "high": 2}


def series_profile(facts: DataFrame, bounds: Bounds, *static: str) -> DataFrame:
    """Per series: units, zero and positive days, first and last positive day number (-1 if none)."""
    sold = F.col("sales") > 0
    number = F.datediff("date", F.lit(bounds.lo)) + 1
    positive = F.count_distinct(F.when(sold, F.col("date")))
    return facts.groupBy(*SERIES).agg(
        *[F.min(c).alias(c) for c in static],
        F.sum("sales").alias("total_units"),
        (F.lit(bounds.days) - positive).alias("zero_days"),
        positive.alias("positive_days"),
        F.coalesce(F.min(F.when(sold, number)), F.lit(-1)).alias("first_positive_day"),
        F.coalesce(F.max(F.when(sold, number)), F.lit(-1)).alias("last_positive_day"),
    )


def item_metrics(series: DataFrame, bounds: Bounds) -> DataFrame:
    """Item demand over its stores: presence, first sale, zero prevalence, mean demand, history left."""
    known = F.when(F.col("first_positive_day") >= 0, F.col("first_positive_day"))
    grid = F.count_distinct("store_id") * bounds.days
    return series.groupBy("item_id").agg(
        F.min("dept_id").alias("dept_id"),
        F.count_distinct("store_id").alias("store_count"),
        F.coalesce(F.min(known), F.lit(-1)).alias("first_positive_day"),
        F.sum("total_units").alias("total_units"),
        ratio(F.sum("zero_days"), grid).alias("zero_prevalence"),
        ratio(F.sum("total_units"), grid).alias("mean_daily_demand"),
    ).withColumn(
        "remaining_history_days",
        F.when(F.col("first_positive_day") >= 1, F.lit(bounds.days) - F.col("first_positive_day")).otherwise(-1),
    )


def store_summary(series: DataFrame, bounds: Bounds) -> DataFrame:
    return series.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("item_rows"),
        F.count_distinct("item_id").alias("unique_items"),
        F.sum("total_units").alias("total_units"),
        percent(F.sum("zero_days"), F.count(F.lit(1)) * bounds.days).alias("zero_prevalence_pct"),
    )


def value_profile(df: DataFrame, value: str) -> DataFrame:
    v = F.col(value)
    return df.agg(
        F.count(F.lit(1)).alias("n_values"),
        F.count_if(v.isNull()).alias("missing_values"),
        F.count_if(v < 0).alias("negative_values"),
        F.count_if(v == 0).alias("zero_values"),
        percent(F.count_if(v == 0), F.count(F.lit(1))).alias("zero_pct"),
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.orderBy(F.desc("n_rows"), "value")


def distinct_by_level(df: DataFrame, levels: Sequence[str], counted: str) -> DataFrame:
    """Distinct ``counted`` values per value of every level, in one grouping-sets pass."""
    kind, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in levels:
        kind = F.when(F.grouping(name) == 0, name).otherwise(kind)
        value = F.when(F.grouping(name) == 0, F.col(name)).otherwise(value)
    return df.groupingSets([[name] for name in levels], *levels).agg(
        kind.alias("level"), value.alias("value"), F.count_distinct(counted).alias("distinct_values")
    ).drop(*levels)


def functional_dependency(df: DataFrame, determinant: str, dependent: str) -> DataFrame:
    """Does each ``determinant`` value map to one ``dependent`` value (null counts as a value)?"""
    groups = df.groupBy(determinant).agg(F.min(dependent).alias("lo"), F.max(dependent).alias("hi"))
    return groups.agg(
        F.bool_and(F.col("lo").eqNullSafe(F.col("hi"))).alias("holds"), F.count(F.lit(1)).alias("groups")
    ).select(F.lit(f"{determinant} -> {dependent}").alias("dependency"), "holds", "groups")


def missing_by_column(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column_name", "missing_values")


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> Column:
    """Rows beyond the first of their key, as an aggregate."""
    return F.count(F.lit(1)) - F.count_distinct(F.struct(*keys))


def grid_coverage(prices: DataFrame, by: Sequence[str], weeks: int) -> DataFrame:
    """Price records over the series x weeks grid; series are counted once before the groups."""
    per_series = prices.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("week_start").alias("weeks"),
        *[F.min(c).alias(c) for c in by if c not in SERIES],
    )
    return per_series.groupBy(*by).agg(
        F.sum("records").alias("price_records"),
        F.count(F.lit(1)).alias("series"),
        percent(F.sum("records"), F.count(F.lit(1)) * weeks).alias("coverage_pct"),
    )


def calendar_weeks(bounds: Bounds) -> int:
    first = bounds.lo - timedelta(days=bounds.lo.weekday())
    return (bounds.hi - first).days // 7 + 1


def active_price_coverage(prices: DataFrame, series: DataFrame, bounds: Bounds) -> DataFrame:
    """Priced weeks over calendar weeks from the first sale on; 0 when a series never sold.

    Weeks after the first sale are counted by date arithmetic, so the calendar is never
    range-joined with the series.
    """
    start = F.date_trunc("week", F.date_add(F.lit(bounds.lo), F.col("first_positive_day") - 1)).cast("date")
    last = F.date_trunc("week", F.lit(bounds.hi)).cast("date")
    active_weeks = F.when(F.col("first_positive_day") >= 1, F.floor(F.datediff(last, start) / 7) + 1).otherwise(0)
    launched = series.select(*SERIES, "first_positive_day", start.alias("first_week"), active_weeks.alias("active_weeks"))
    joined = launched.join(prices.select(*SERIES, "week_start"), SERIES, "left")
    covered = joined.groupBy(*SERIES, "first_positive_day", "active_weeks").agg(
        F.count_distinct(F.when(F.col("week_start") >= F.col("first_week"), F.col("week_start"))).alias("priced_weeks")
    )
    return covered.withColumn("price_coverage", F.coalesce(ratio(F.col("priced_weeks"), F.col("active_weeks")), F.lit(0.0)))


RULES = ["passes_required_stores", "passes_sparsity", "passes_history", "passes_price_coverage"]


def eligibility(items: DataFrame, coverage: DataFrame, rules: Mapping = ELIGIBILITY) -> DataFrame:
    """Four independent screens and their conjunction; items without prices get 0 coverage."""
    per_item = coverage.groupBy("item_id").agg(
        F.count_distinct("store_id").alias("stores_with_coverage"), F.min("price_coverage").alias("minimum_coverage")
    )
    joined = checked_join(items, per_item, ["item_id"], "left", "many_to_one")
    joined = joined.withColumns({
        "stores_with_coverage": F.coalesce("stores_with_coverage", F.lit(0)),
        "minimum_coverage": F.coalesce("minimum_coverage", F.lit(0.0)),
    })
    return joined.withColumns({
        "passes_required_stores": F.col("store_count") == rules["stores"],
        "passes_sparsity": F.col("zero_prevalence") < rules["zero_prevalence"],
        "passes_history": F.col("remaining_history_days") >= rules["remaining_history_days"],
        "passes_price_coverage": (F.col("stores_with_coverage") == rules["stores"])
        & (F.col("minimum_coverage") >= rules["price_coverage"]),
    }).withColumn("eligible", all_of(F.col(r) for r in RULES))


def failure_counts(eligible: DataFrame) -> DataFrame:
    """Failures per rule (overlaps kept) and items failing more than one."""
    failed = sum((~F.col(r)).cast("int") for r in RULES)
    counts = eligible.agg(
        *[F.count_if(~F.col(r)).alias(r.replace("passes_", "")) for r in RULES],
        F.count_if(failed > 1).alias("more_than_one_rule"),
    )
    return counts.unpivot([], counts.columns, "rule", "failures")


def quota_availability(banded: DataFrame, quotas: Mapping[str, int] = QUOTAS, *, strict: bool = False) -> DataFrame:
    """Eligible items per department and band against the quota; a shortage is an error when strict."""
    available = banded.groupBy("dept_id", "demand_band").agg(F.count(F.lit(1)).alias("available"))
    bands = F.array(*[F.struct(F.lit(b).alias("demand_band"), F.lit(q).alias("required")) for b, q in quotas.items()])
    cells = banded.select("dept_id").distinct().select("dept_id", F.inline(bands))
    result = cells.join(available, ["dept_id", "demand_band"], "left").withColumn(
        "available", F.coalesce("available", F.lit(0).cast("bigint"))
    )
    if strict:
        fail = F.raise_error(F.lit("selection quotas cannot be satisfied")).cast("bigint")
        result = result.withColumn("available", F.when(F.col("available") >= F.col("required"), F.col("available")).otherwise(fail))
    return result.withColumn("satisfied", F.col("available") >= F.col("required"))


def quota_sample(banded: DataFrame, quotas: Mapping[str, int] = QUOTAS, seed: int = 42) -> DataFrame:
    """Exactly the quota per department x band, in hash order of (seed, item): order-independent.

    The largest quota is a literal limit on the numbering, so Spark's window group limit
    drops all but that many rows of a cell in every input partition, before the exchange.
    """
    draw = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("item_id").cast("string")))
    quota = F.element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col("demand_band"))
    order = W.partitionBy("dept_id", "demand_band").orderBy("_draw", "item_id")
    numbered = banded.withColumn("_draw", draw).withColumn("_n", F.row_number().over(order))
    return numbered.where(F.col("_n") <= max(quotas.values())).where(F.col("_n") <= quota).drop("_draw", "_n")


def product_screen(series: DataFrame, prices: DataFrame, stores: Sequence[str], bounds: Bounds, *, early: int, zero_pct: float, weeks_pct: float) -> DataFrame:
    """Items present, early, dense and priced in every store of a candidate list."""
    scoped = series.where(F.col("store_id").isin(list(stores)))
    row_zero = percent(F.col("zero_days"), F.lit(bounds.days))
    items = scoped.groupBy("item_id").agg(
        F.count_distinct("store_id").alias("stores_present"),
        F.count_if(F.col("first_positive_day").between(1, early)).alias("stores_early"),
        F.count_if(row_zero < zero_pct).alias("stores_dense"),
    )
    weeks = prices.where(F.col("store_id").isin(list(stores))).groupBy("item_id", "store_id").agg(
        F.count_distinct("week_start").alias("weeks")
    ).groupBy("item_id").agg(F.count(F.lit(1)).alias("stores_priced"), F.min("weeks").alias("minimum_weeks"))
    joined = items.join(weeks, "item_id", "left").withColumns({
        "stores_priced": F.coalesce("stores_priced", F.lit(0)), "minimum_weeks": F.coalesce("minimum_weeks", F.lit(0)),
    })
    n = len(stores)
    flags = {
        "in_all_stores": F.col("stores_present") == n,
        "priced_in_all_stores": F.col("stores_priced") == n,
        "early_in_all_stores": F.col("stores_early") == n,
        "dense_in_all_stores": F.col("stores_dense") == n,
        "covered_in_all_stores": (F.col("stores_priced") == n) & (percent(F.col("minimum_weeks"), F.lit(calendar_weeks(bounds))) >= weeks_pct),
    }
    everything = flags["in_all_stores"] & flags["covered_in_all_stores"] & flags["early_in_all_stores"] & flags["dense_in_all_stores"]
    return joined.agg(*[F.count_if(c).alias(name) for name, c in flags.items()], F.count_if(everything).alias("meets_all_screens"))


def store_strategies(summary: DataFrame) -> DataFrame:
    """Three candidate store lists: best per state, best three of the best large state, best three overall.

    ``summary`` has one row per store (state_id, coverage_pct, zero_prevalence_pct), so the
    orderings below run over a handful of rows.
    """
    order = [F.desc("coverage_pct"), F.asc("zero_prevalence_pct"), F.asc("store_id")]
    best = summary.withColumn("_n", F.row_number().over(W.partitionBy("state_id").orderBy(*order))).where("_n = 1")
    states = summary.groupBy("state_id").agg(F.count(F.lit(1)).alias("stores"), F.avg("coverage_pct").alias("mean_coverage"))
    chosen = states.where("stores >= 3").orderBy(F.desc("mean_coverage"), "state_id").limit(1).select("state_id")
    same = summary.join(chosen, "state_id", "left_semi").orderBy(*order).limit(3)
    top = summary.orderBy(*order).limit(3)
    parts = {"best per state": best, "same state": same, "highest coverage": top}
    stacked = None
    for name, part in parts.items():
        rows = part.select(F.lit(name).alias("strategy"), "store_id", "state_id", "coverage_pct", "zero_prevalence_pct")
        stacked = rows if stacked is None else stacked.unionByName(rows)
    return stacked


def gap_classes(panel: DataFrame) -> DataFrame:
    """Missing-price rows by where they fall around the known prices and the first sale."""
    whole = W.partitionBy(*SERIES)
    priced = F.when(F.col("sell_price").isNotNull(), F.col("date"))
    sold = F.when(F.col("sales") > 0, F.col("date"))
    placed = panel.select(
        "date", "sales", "sell_price",
        F.min(priced).over(whole).alias("first_known"), F.max(priced).over(whole).alias("last_known"),
        F.min(sold).over(whole).alias("first_sale"),
    ).where(F.col("sell_price").isNull())
    date = F.col("date")
    return placed.agg(
        F.count(F.lit(1)).alias("missing_rows"),
        F.count_if(date < F.col("first_known")).alias("before_first_known"),
        F.count_if((date > F.col("first_known")) & (date < F.col("last_known"))).alias("between_known"),
        F.count_if(date > F.col("last_known")).alias("after_last_known"),
        F.count_if(date < F.col("first_sale")).alias("before_first_sale"),
        F.count_if(date >= F.col("first_sale")).alias("after_first_sale"),
        F.count_if(F.col("sales") > 0).alias("with_positive_sale"),
    )
