"""Sources, joins, profiles, quotas, sinks and serving on small inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from demandloom.functions.columns import intermittency_class, ratio, tertile_band, week_ending_sunday, zero_share_bin
from demandloom.functions.quantiles import quantiles
from demandloom.operators import features as ft
from demandloom.operators import profile as pf
from demandloom.operators import reshape, serving
from demandloom.operators.joins import checked_join, key_mismatches
from demandloom.sources import retail, sinks, tables
from demandloom.sources.retail import Bounds, store_item_sales
from demandloom.sources.sinks import fingerprint


def test_day_columns_are_numeric_order():
    assert tables.day_columns(["id", "d_10", "d_invalid", "item_id", "d_2", "d_1"]) == ["d_1", "d_2", "d_10"]


def test_wide_rows_profile(spark):
    wide = spark.createDataFrame([("a", 0, 2, 0), ("b", -1, 0, 4)], "id string, d_1 int, d_2 int, d_3 int")
    long = reshape.wide_to_long(wide)
    row = pf.value_profile(long, "sales").first()
    assert (row.n_values, row.zero_values, row.negative_values, row.min_value, row.max_value) == (6, 3, 1, -1, 4)
    assert {r.id: r.s for r in long.groupBy("id").agg(F.sum("sales").alias("s")).collect()} == {"a": 2, "b": 3}


def test_series_profile_days(spark):
    lo = dt.date(2020, 1, 1)
    facts = spark.createDataFrame([("A", "x", lo + dt.timedelta(days=1), 2), ("A", "x", lo + dt.timedelta(days=4), 1)], "store_id string, item_id string, date date, sales bigint")
    row = pf.series_profile(facts, Bounds(lo, lo + dt.timedelta(days=9))).first()
    assert (row.total_units, row.zero_days, row.first_positive_day, row.last_positive_day) == (3, 8, 2, 5)


def test_tertiles(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 10)], "item_id int, mean_daily_demand double")
    cuts = quantiles(df, "mean_daily_demand", {"a": 1 / 3, "b": 2 / 3}).first()
    assert (cuts.a, cuts.b) == pytest.approx((3.6667, 6.3333), abs=1e-4)
    counts = {r.demand_band: r["count"] for r in ft.assign_bands(df).groupBy("demand_band").count().collect()}
    assert counts == {"low": 3, "medium": 3, "high": 3}


@pytest.mark.parametrize("values", [
    [float((i * 7919) % 1013) ** 1.5 if i % 5 else 0.0 for i in range(3000)],
    [1e15, *map(float, range(2000))],  # one outlier far from all others
    [2.0 ** (i % 900) for i in range(3000)],  # spread over many magnitudes
])
def test_quantiles_match_the_builtin(spark, values):
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)] + [(2, None)], "g int, v double")
    probabilities = {"p0": 0.0, "p33": 1 / 3, "p50": 0.5, "p999": 0.999, "p100": 1.0}
    want = {r.g: r for r in df.groupBy("g").agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in probabilities.items()]).collect()}
    whole = df.agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in probabilities.items()]).first()
    for row in quantiles(df, "v", probabilities, ["g"]).collect():
        for name in probabilities:
            assert row[name] == pytest.approx(want[row.g][name], rel=1e-12)
    assert quantiles(df, "v", probabilities).first().asDict() == pytest.approx(whole.asDict(), rel=1e-12)


def banded(spark):
    rows = [(f"{d}{b}{i}", d, b) for d in "pq" for b in ("low", "high") for i in range(5)]
    return spark.createDataFrame(rows, "item_id string, dept_id string, demand_band string")


def test_quota_sample_is_exact_and_order_free(spark):
    quotas = {"low": 2, "high": 1}
    first = pf.quota_sample(banded(spark), quotas)
    second = pf.quota_sample(banded(spark).orderBy(F.rand(3)).repartition(7), quotas)
    counts = {(r.dept_id, r.demand_band): r["count"] for r in first.groupBy("dept_id", "demand_band").count().collect()}
    assert counts == {("p", "low"): 2, ("p", "high"): 1, ("q", "low"): 2, ("q", "high"): 1}
    assert {r.item_id for r in first.collect()} == {r.item_id for r in second.collect()}


def test_quota_shortage_is_an_error(spark):
    with pytest.raises(Exception, match="cannot be satisfied"):
        pf.quota_availability(banded(spark), {"low": 9}, strict=True).collect()


def test_eligibility_rules_are_independent(spark):
    items = spark.createDataFrame([("good", 3, 0.5, 900), ("sparse", 3, 0.95, 900), ("late", 3, 0.4, 729)], "item_id string, store_count int, zero_prevalence double, remaining_history_days int")
    coverage = spark.createDataFrame([(i, s, c) for i, c in (("good", 0.9), ("sparse", 0.9), ("late", 0.2)) for s in "ABC"], "item_id string, store_id string, price_coverage double")
    rules = {"stores": 3, "zero_prevalence": 0.95, "remaining_history_days": 730, "price_coverage": 0.8}
    got = {r.item_id: r for r in pf.eligibility(items, coverage, rules).collect()}
    assert got["good"].eligible and not got["sparse"].passes_sparsity and got["sparse"].passes_history
    assert not got["late"].passes_history and not got["late"].passes_price_coverage


def test_checked_join_rejects_duplicate_keys(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    right = spark.createDataFrame([("a", 9)], "k string, w int")
    assert checked_join(left, right, ["k"]).count() == 2
    with pytest.raises(Exception, match="duplicate join key"):
        checked_join(left, right.union(right), ["k"]).collect()


def test_key_mismatches(spark):
    a, b = (spark.createDataFrame([(k,) for k in keys], "k string") for keys in ("abc", "bcde"))
    assert tuple(key_mismatches(a, b, ["k"]).first()) == (1, 2, 2)


def test_fifty_percent_boundary_differs(spark):
    row = spark.range(1).select(zero_share_bin(F.lit(50.0)).alias("a"), intermittency_class(F.lit(50.0)).alias("b"), ratio(F.lit(1), F.lit(0)).alias("c")).first()
    assert row.a.startswith("regular") and row.b == "intermittent" and row.c is None


def test_band_edges_and_sunday_weeks(spark):
    row = spark.range(1).select(
        tertile_band(F.lit(2.0), F.lit(2.0), F.lit(3.0)).alias("band"), week_ending_sunday(F.lit(dt.date(2020, 1, 5))).alias("sunday")
    ).first()
    assert row.band == "low" and row.sunday == dt.date(2020, 1, 5)


def test_source_contract_states(spark, folder):
    rows = {r.source: r for r in tables.inspect_sources(spark, folder, {"nation.parquet": ["n_name"], "region.parquet": ["no_such"], "none.csv": ["a"]}, count_rows=True).collect()}
    assert rows["nation.parquet"].status == "valid" and rows["nation.parquet"].row_count == 25
    assert rows["region.parquet"].missing_columns == "no_such" and rows["none.csv"].status == "missing"


def test_partial_table_is_an_error(spark):
    path = sinks.scratch_path(spark, "partial")
    assert sinks.load_once(spark.range(5), path) == "created"
    assert sinks.load_once(spark.range(5), path) == "skipped"
    with pytest.raises(ValueError, match="5 of 6"):
        sinks.load_once(spark.range(6), path)
    assert sinks.load_once(spark.range(6), path, refresh=True) == "refreshed"


def test_filters_are_whitelisted(spark):
    df = spark.createDataFrame([("A", "x"), ("B", "y")], "store_id string, item_id string")
    assert df.where(serving.conditions({"store_id": ["A"], "item_id": "All"})).count() == 1
    assert df.where(serving.conditions({"nope": 1}, strict=False)).count() == 2
    with pytest.raises(ValueError, match="unknown column"):
        serving.conditions({"nope": 1})


def test_shortage_reduction_is_safe_at_zero(spark):
    row = spark.range(1).select(serving.shortage_reduction(F.lit(0.0), F.lit(1.0)).alias("a"), serving.shortage_reduction(F.lit(4.0), F.lit(1.0)).alias("b")).first()
    assert row.a == 0.0 and row.b == 0.75


def test_large_daily_units_do_not_overflow(spark):
    """2,500 days at about 2e8 units: squares add up to 1e20, beyond a 64-bit total."""
    rows = [("A", "x", dt.date(2020, 1, 1) + dt.timedelta(days=i), 200_000_000 + i % 2) for i in range(2500)]
    df = spark.createDataFrame(rows, "store_id string, item_id string, date date, sales bigint")
    last = ft.rolling_stds(df).orderBy(F.desc("date")).first()
    assert last.sales_roll_std_28 == pytest.approx((28 * 0.25 / 27) ** 0.5)


def test_fingerprint_of_many_rows_does_not_overflow(spark):
    df = spark.range(10).select(F.lit("same").alias("k"))
    once = int(fingerprint(df.limit(1), ["k"], "t").first().content_hash)
    assert int(fingerprint(df, ["k"], "t").first().content_hash) == 10 * once


def test_fractions_of_units_are_kept_until_the_day_is_summed(spark):
    lines = spark.createDataFrame([(1, 1, dt.datetime(2020, 1, 1), 2.5, 1.0)] * 2, "l_partkey int, l_suppkey int, l_shipdate timestamp, l_quantity double, l_extendedprice double")
    part = spark.createDataFrame([(1, "T")], "p_partkey int, p_type string")
    supplier, nation = spark.createDataFrame([(1, 1)], "s_suppkey int, s_nationkey int"), spark.createDataFrame([(1, 1)], "n_nationkey int, n_regionkey int")
    region = spark.createDataFrame([(1, "ASIA")], "r_regionkey int, r_name string")
    assert store_item_sales(lines, part, supplier, nation, region).first().sales == 5


def _lines(spark, days: int):
    rows = [(p, 1, float(1 + p % 3), 10.0, f"1995-01-{1 + day:02d} 00:00:00") for p in (7, 8) for day in range(days) for _ in range(2)]
    return spark.createDataFrame([*rows, (None, 1, 1.0, 10.0, None)], "l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate string").withColumn(
        "l_shipdate", F.col("l_shipdate").cast("timestamp"))


def test_sales_are_summed_in_partitions_of_bounded_rows(spark, monkeypatch):
    """the rows a task sums do not grow with the table, and a hot part is dealt by its supplier-days."""
    lines = _lines(spark, 28)
    whole = {tuple(r) for r in retail.daily_line_sales(lines, 113).collect()}
    monkeypatch.setattr(retail, "TASK_ROWS", 10)
    daily = retail.daily_line_sales(lines, 113)
    assert {tuple(r) for r in daily.collect()} == whole and len(whole) == 57
    sizes = [r["count"] for r in daily.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 6 and max(sizes) <= 20
    assert retail.dealt(lines, 113, "l_partkey").rdd.getNumPartitions() == 12
