"""Headline timings on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

Stage builds (scan -> daily sales, features, predictions, recommendations) are timed on
their own; the report queries that follow read those stage tables, as in production.
"""

from __future__ import annotations

import json
import os
import time

from demandloom.catalog import QUERIES
from demandloom.catalog.domain import Retail
from demandloom.session import build_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

REPORTS = [
    "fc_06_fold_predictions",
    "met_04_metric_cube",
    "met_07_weighted_balanced_ranking",
    "inv_16_batch_recommendations",
    "agg_16_eligibility_rules",
    "ml_01_stratified_quota_sample",
    "agg_23_group_demand_comparison",
    "agg_37_price_demand_correlation",
    "agg_48_overview_kpis",
    "qry_03_weekly_sales_trend",
]


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session(
        "demandloom-bench", f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS,
        spark__driver__memory=os.environ.get("BENCH_DRIVER_MEMORY", "16g"), spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    drain(spark.range(1000).selectExpr("id % 7 AS k", "id").groupBy("k").sum("id"))  # JVM warm-up
    timings: dict[str, float] = {}

    def timed(name: str, action) -> None:
        started = time.perf_counter()
        action()
        timings[name] = round(time.perf_counter() - started, 3)

    domain = Retail(spark, FOLDER)
    timed("build_daily_sales", lambda: (domain.bounds, domain.facts))
    timed("build_item_daily_sales", lambda: domain.item_facts)
    timed("build_features", lambda: domain.features)
    timed("build_predictions", lambda: domain.predictions)
    timed("build_forecast", lambda: domain.deployed)
    timed("build_recommendations", lambda: domain.recommendations)
    for name in REPORTS:
        timed(name, lambda name=name: drain(QUERIES[name](spark, FOLDER)))
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(FOLDER.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
