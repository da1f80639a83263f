"""Partitioned loads, pruned extracts and one-scan checks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from demandloom.operators import quality as dq
from demandloom.sources import sinks


def by_year(spark, counts):
    rows = [(y, i) for y, n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows, "year int, value int")


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_changed_year_rewrites_one_year(spark, tmp_path):
    path = tmp_path / "table"
    first = {r.partition: r.action for r in sinks.load_partitions(by_year(spark, {2000: 3, 2001: 2}), str(path), "year").collect()}
    assert first == {"2000": "created", "2001": "created"}
    before = files(path)
    assert {r.action for r in sinks.load_partitions(by_year(spark, {2000: 3, 2001: 2}), str(path), "year").collect()} == {"skipped"}
    assert files(path) == before
    grown = by_year(spark, {2000: 3, 2001: 5, 2002: 1})
    with pytest.raises(ValueError, match="2001"):
        sinks.load_partitions(grown, str(path), "year")
    assert files(path) == before
    actions = {r.partition: r.action for r in sinks.load_partitions(grown, str(path), "year", refresh=[2001]).collect()}
    assert actions == {"2000": "skipped", "2001": "refreshed", "2002": "created"}
    after = files(path)
    assert {p: t for p, t in after.items() if "year=2000" in p} == {p: t for p, t in before.items() if "year=2000" in p}
    assert {(r.year, r.value) for r in spark.read.parquet(str(path)).collect()} == {(r.year, r.value) for r in grown.collect()}


def test_recent_window_reads_the_newest_partitions(spark, tmp_path):
    days = spark.range(800).select(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("date")).withColumn("year", F.year("date"))
    days.write.partitionBy("year").parquet(str(tmp_path / "days"))
    stored = spark.read.parquet(str(tmp_path / "days"))
    newest = dt.date(2000, 1, 1) + dt.timedelta(days=799)
    recent = sinks.recent_window(stored, 30, newest)
    assert recent.count() == 30 and {p.rsplit("/", 2)[1] for p in recent.inputFiles()} <= {"year=2002", "year=2000", "year=2001"}
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "year" in plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
    assert sorted(r.date for r in recent.collect()) == sorted(r.date for r in sinks.recent_window(stored, 30).collect())


def test_panel_checks_find_each_fault(spark):
    base = dt.date(2000, 1, 1)
    rows = [(s, i, base + dt.timedelta(days=n), 1, 1, 2.0, "d", "x") for s in "AB" for i in "xyz" for n in range(5)]
    schema = "store_id string, item_id string, date date, sales int, d int, sell_price double, dept_id string, state_id string"

    def broken(extra):
        checked = dq.panel_checks(spark.createDataFrame(rows + extra, schema), base, 2, 3, 5)
        return {r.check_name for r in checked.collect() if not r.passed}

    assert broken([]) == set()
    assert broken([rows[0]]) == {"row_count", "duplicate_keys"}
    assert broken([("A", "x", base + dt.timedelta(days=9), -1, None, 0.0, None, "x")]) == {
        "days", "row_count", "negative_sales", "unmatched_calendar_rows", "non_positive_prices", "missing_hierarchy"}
    with pytest.raises(ValueError, match="bitmap"):
        dq.per_series(spark.createDataFrame(rows, schema), base, 40_000, {}, {})
