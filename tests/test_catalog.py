"""Catalogue queries next to their SQL twins on the smallest tables.

By default one query per family runs; DEMANDLOOM_ALL=1 runs every one.
"""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check_queries import compare, connect  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

SAMPLE = [
    "src_01_wide_sales_scan", "src_10_source_contracts", "prj_02_whitelisted_filter", "prj_12_feature_table_in_manifest_order", "rsh_01_wide_to_long",
    "jn_02_daily_sales_with_price", "agg_16_eligibility_rules", "agg_20_demand_description", "agg_37_price_demand_correlation", "win_08_price_vs_4week_median",
    "srt_06_representative_series", "set_05_duplicate_keys", "scl_09_demand_tertiles", "ml_01_stratified_quota_sample", "fc_06_fold_predictions",
    "met_04_metric_cube", "met_07_weighted_balanced_ranking", "inv_16_batch_recommendations", "dq_01_panel_integrity", "qry_03_weekly_sales_trend", "snk_02_idempotent_load",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("DEMANDLOOM_ALL") else SAMPLE


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, folder, name):
    got = entry.queries()[name](spark, folder).toPandas()
    want = connect(folder).execute(entry.oracle_sql()[name]).df()
    assert compare(got, want).startswith("ok")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 5


def test_result_does_not_depend_on_partitioning(spark, folder):
    name = "met_04_metric_cube"
    first = sorted(map(str, entry.queries()[name](spark, folder).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "31")
    try:
        assert sorted(map(str, entry.queries()[name](spark, folder).collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
