"""Serving queries, exports and contract checks of the stored tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from demandloom.catalog.q_features import rounded, sql_round
from demandloom.catalog.prelude import OVERRIDES
from demandloom.catalog.registry import query
from demandloom.operators import features as ft
from demandloom.operators import folds as fo
from demandloom.operators import inventory as iv
from demandloom.operators import quality as dq
from demandloom.operators import serving
from demandloom.sources import parameters as P
from demandloom.sources import sinks
from demandloom.sources.parameters import SERIES


@query("qry_01_filter_options", " UNION ALL ".join(f"SELECT '{c}' AS option, {c} AS value FROM panel GROUP BY {c}" for c in ("store_id", "dept_id", "item_id")))
def filter_options(d):
    return serving.filter_options(d.panel)


KPI = ["forecast_7d", "forecast_30d", "shortage_before", "shortage_after", "savings"]


def overview_sql(where: str = "true") -> str:
    return f"""SELECT p.*, f.*, r.* FROM
  (SELECT count(*) AS observations, count(DISTINCT item_id) AS products, count(DISTINCT store_id) AS stores, count(DISTINCT store_id || '/' || item_id) AS series, CAST(sum(sales) AS BIGINT) AS units,
    CAST(sum(CASE WHEN date > (SELECT max(date) - 30 FROM panel WHERE {where}) THEN sales END) AS BIGINT) AS trailing_30_day_units FROM panel WHERE {where}) p,
  (SELECT round(sum(CASE WHEN horizon_day <= 7 THEN forecast END), 4) AS forecast_7d, round(sum(forecast), 4) AS forecast_30d FROM deployed WHERE {where}) f,
  (SELECT count(*) FILTER (recommended_order_qty > 0) AS reorder_count, count(*) FILTER (stock_status IN ('CRITICAL', 'STOCKOUT')) AS critical_count, round(sum(expected_shortage_without_order), 4) AS shortage_before,
    round(sum(expected_shortage_with_recommendation), 4) AS shortage_after, round(sum(estimated_cost_savings), 4) AS savings FROM recommendations WHERE {where}) r"""


@query("agg_48_overview_kpis", overview_sql())
def overview_kpis(d):
    return rounded(serving.overview(d.panel, d.deployed, d.recommendations, d.bounds.hi), KPI, 4)


@query("qry_02_filtered_overview", overview_sql("store_id IN ('ASIA', 'EUROPE')"))
def filtered_overview(d):
    return rounded(serving.overview(d.panel, d.deployed, d.recommendations, d.bounds.hi, {"store_id": ["ASIA", "EUROPE"]}), KPI, 4)


@query("qry_03_weekly_sales_trend", """
SELECT CAST(date_trunc('week', date) AS DATE) AS period, CAST(sum(sales) AS BIGINT) AS sales FROM panel WHERE dept_id = 'SIZED' AND date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' GROUP BY 1""")
def weekly_sales_trend(d):
    return serving.sales_trend(d.panel, {"dept_id": "SIZED"}, "2000-01-01", "2000-12-31", "weekly")


@query("qry_03_monthly_sales_trend", "SELECT CAST(date_trunc('month', date) AS DATE) AS period, CAST(sum(sales) AS BIGINT) AS sales FROM panel GROUP BY 1")
def monthly_sales_trend(d):
    return serving.sales_trend(d.panel, frequency="monthly")


@query("qry_03_daily_event_trend", "SELECT CAST(ts AS DATE) AS period, round(sum(value), 2) AS sales FROM events WHERE event_type = 'purchase' GROUP BY 1")
def daily_event_trend(d):
    events = d.table("events", "ts", "event_type", "value").where(serving.conditions({"event_type": "purchase"}, ("event_type",)))
    daily = events.select(F.to_date("ts").alias("date"), F.col("value").alias("sales"))
    return rounded(serving.sales_trend(daily, frequency="daily"), ["sales"], 2)


@query("qry_04_breakdown_by_store", "SELECT store_id, CAST(sum(sales) AS BIGINT) AS sales FROM panel GROUP BY 1")
def breakdown_by_store(d):
    return serving.sales_breakdown(d.panel, "store_id")


@query("qry_04_breakdown_by_weekday", "SELECT weekday, CAST(sum(sales) AS BIGINT) AS sales FROM panel WHERE store_id = 'ASIA' GROUP BY 1")
def breakdown_by_weekday(d):
    return serving.sales_breakdown(d.panel, "weekday", {"store_id": "ASIA"})


@query("qry_05_demand_profile", """
SELECT count(*) AS observations, count(*) FILTER (sales = 0) AS zero_observations, round(count(*) FILTER (sales = 0) / count(*), 6) AS zero_rate, round(avg(sales), 6) AS mean_sales, max(sales) AS max_sales FROM panel WHERE item_id = 'PROMO'""")
def demand_profile(d):
    return rounded(serving.demand_profile(d.panel, {"item_id": "PROMO"}), ["zero_rate", "mean_sales"])


@query("qry_06_recent_history", "SELECT date, sales, sell_price FROM panel WHERE store_id = 'EUROPE' AND item_id = 'SMALL' ORDER BY date DESC LIMIT 45")
def recent_history(d):
    return serving.recent_history(d.panel, "EUROPE", "SMALL", 45).select("date", "sales", "sell_price")


@query("qry_07_forecast_lookup", "SELECT store_id, item_id, target_date, horizon_day, round(forecast, 6) AS forecast FROM deployed WHERE store_id = 'ASIA' AND horizon_day <= 7")
def forecast_lookup(d):
    return rounded(serving.forecast_lookup(d.deployed, "ASIA", horizon_days=7).select(*SERIES, "target_date", "horizon_day", "forecast"), ["forecast"])


LIST = "store_id, item_id, stock_status, priority_label, recommended_order_qty, round(priority_score, 6) AS priority_score"


@query("qry_08_recommendation_list", f"SELECT {LIST} FROM recommendations WHERE dept_id = 'STYLED'")
def recommendation_list(d):
    rows = serving.recommendation_list(d.recommendations, {"dept_id": "STYLED"})
    return rounded(rows.select(*SERIES, "stock_status", "priority_label", "recommended_order_qty", "priority_score"), ["priority_score"])


@query("srt_05_urgency_order", f"SELECT {LIST} FROM recommendations ORDER BY priority_score DESC, store_id, item_id LIMIT 20")
def urgency_order(d):
    rows = serving.by_urgency(d.recommendations).limit(20)
    return rounded(rows.select(*SERIES, "stock_status", "priority_label", "recommended_order_qty", "priority_score"), ["priority_score"])


@query("qry_09_inventory_state_lookup", "SELECT * FROM inv_state WHERE store_id = 'AMERICA' AND item_id = 'LARGE'")
def inventory_state_lookup(d):
    return d.state.where((F.col("store_id") == "AMERICA") & (F.col("item_id") == "LARGE")).drop("inventory_source")


@query("qry_10_decision_explorer", """
SELECT store_id, item_id, recommended_order_qty, cost_optimized_order_qty FROM recommendations WHERE recommended_order_qty > 0 AND dept_id = 'SIZED' ORDER BY recommended_order_qty DESC, store_id, item_id LIMIT 10""")
def decision_explorer(d):
    rows = serving.decision_list(d.recommendations, "Needs reorder", dept_id="SIZED")
    return rows.orderBy(F.desc("recommended_order_qty"), *SERIES).limit(10).select(*SERIES, "recommended_order_qty", "cost_optimized_order_qty")


@query("prj_14_order_action", "SELECT store_id, item_id, CASE WHEN recommended_order_qty > 0 THEN 'REORDER' ELSE 'NO ORDER' END AS order_action FROM recommendations")
def order_action(d):
    return d.recommendations.select(*SERIES, serving.order_action().alias("order_action"))


@query("prj_15_decision_list", "SELECT store_id, item_id, recommended_order_qty, round(priority_score, 6) AS priority_score FROM recommendations WHERE recommended_order_qty > 0 AND store_id = 'AFRICA'")
def decision_list(d):
    rows = serving.decision_list(d.recommendations, "Needs reorder", store_id="AFRICA")
    return rounded(rows.select(*SERIES, "recommended_order_qty", "priority_score"), ["priority_score"])


@query("prj_16_business_labels", """
SELECT store_id AS "Store", item_id AS "Item", dept_id AS "Department", stock_status AS "Stock status", priority_label AS "Priority", round(inventory_position, 4) AS "Inventory position",
  round(reorder_point, 4) AS "Reorder point", recommended_order_qty AS "Recommended order", cost_optimized_order_qty AS "Cost-aware order" FROM recommendations""")
def business_labels(d):
    return serving.labelled(rounded(d.recommendations, ["inventory_position", "reorder_point"], 4))


@query("qry_11_forecast_explorer", """
SELECT store_id, item_id, round(sum(CASE WHEN horizon_day = 1 THEN forecast END), 6) AS forecast_1d, round(sum(CASE WHEN horizon_day <= 7 THEN forecast END), 6) AS forecast_7d, round(sum(forecast), 6) AS forecast_30d, round(avg(forecast), 6) AS mean_per_day FROM deployed GROUP BY 1, 2""")
def forecast_explorer(d):
    from demandloom.operators.forecast import horizon_totals

    rows = horizon_totals(d.deployed).withColumn("mean_per_day", F.col("forecast_30d") / P.HORIZON)
    return rounded(rows, ["forecast_1d", "forecast_7d", "forecast_30d", "mean_per_day"])


@query("qry_12_linked_item_selector", "SELECT item_id, round(priority_score, 6) AS priority_score FROM recommendations WHERE store_id = 'ASIA' AND dept_id = 'SIZED'")
def linked_item_selector(d):
    return rounded(serving.item_selector(d.recommendations, "ASIA", "SIZED", by_need=True), ["priority_score"])


@query("snk_05_model_metadata", """
SELECT 'recursive_mean_28' AS model_name, max(forecast_origin) AS forecast_origin, max(horizon_day) AS max_horizon_days, 'default_policy' AS policy_name FROM deployed""")
def model_metadata(d):
    return sinks.model_metadata(d.deployed, "recursive_mean_28", "default_policy")


@query("snk_06_result_export", """
SELECT store_id AS "Store", item_id AS "Item", stock_status AS "Stock status", recommended_order_qty AS "Recommended order" FROM recommendations WHERE store_id = 'EUROPE'""")
def result_export(d):
    labels = {c: serving.LABELS[c] for c in ("store_id", "item_id", "stock_status", "recommended_order_qty")}
    table = serving.labelled(serving.recommendation_list(d.recommendations, {"store_id": "EUROPE"}), labels)
    return sinks.write_table(table, sinks.scratch_path(d.spark, "export"), fmt="csv")


@query("scl_08_safe_ratio", """
SELECT store_id, item_id, round(sum(CASE WHEN month = 12 THEN sales END) / nullif(sum(CASE WHEN event_name_2 IS NOT NULL THEN sales END), 0), 6) AS december_to_event_ratio FROM panel GROUP BY 1, 2""")
def safe_ratio(d):
    from demandloom.functions.columns import ratio

    december = F.sum(F.when(F.col("month") == 12, F.col("sales")))
    event = F.sum(F.when(F.col("event_name_2").isNotNull(), F.col("sales")))
    return rounded(d.panel.groupBy(*SERIES).agg(ratio(december, event).alias("december_to_event_ratio")), ["december_to_event_ratio"])


@query("scl_14_label_formats", """
SELECT item_id || ' · ' || store_id AS label, CASE WHEN days_of_supply IS NULL THEN 'NO EXPECTED DEMAND' ELSE format('{:.1f} days', days_of_supply) END AS supply FROM recommendations""")
def label_formats(d):
    return d.recommendations.select(F.concat_ws(" · ", "item_id", "store_id").alias("label"), F.col("days_of_supply_label").alias("supply"))


@query("scl_16_scenario_explanations", """
WITH b AS (SELECT w.*, r.inventory_position AS s_position, r.lead_time_days AS s_lead, r.service_level AS s_service, r.recommended_order_qty AS s_order, 7 AS s_review,
    r.holding_cost_per_unit_per_day AS s_holding, r.stockout_cost_per_unit AS s_stockout, r.fixed_order_cost AS s_fixed
  FROM wi_result w JOIN recommendations r USING (store_id, item_id)),
s AS (SELECT *, concat_ws(' ',
  CASE WHEN inventory_position <> s_position THEN format('Inventory position {} from {:.1f} to {:.1f} units.', CASE WHEN inventory_position > s_position THEN 'increased' ELSE 'decreased' END, s_position, inventory_position) END,
  CASE WHEN lead_time_days <> s_lead THEN format('The {}-day lead time creates {} demand exposure than the saved {}-day assumption.', lead_time_days, CASE WHEN lead_time_days > s_lead THEN 'more' ELSE 'less' END, s_lead) END,
  CASE WHEN service_level <> s_service THEN format('Changing the service target from {:.1f}% to {:.1f}% {} the uncertainty buffer.', 100 * s_service, 100 * service_level, CASE WHEN service_level > s_service THEN 'raises' ELSE 'reduces' END) END,
  CASE WHEN review_period_days <> s_review THEN format('The review period changed from {} to {} days, changing the target stock horizon.', s_review, review_period_days) END,
  CASE WHEN holding_cost_per_unit_per_day <> s_holding OR stockout_cost_per_unit <> s_stockout OR fixed_order_cost <> s_fixed
    THEN 'The cost assumptions changed the cost-optimized alternative; they do not change the service-level order rule.' END) AS changes FROM b)
SELECT what_if, store_id, item_id, concat_ws(' ', CASE WHEN changes = '' THEN 'The operational assumptions match the saved recommendation, so the decision is unchanged.' ELSE changes END,
  format('The recommended order is {:,} units, compared with {:,} units in the saved decision.', recommended_order_qty, s_order)) AS explanation FROM s""")
def scenario_explanations(d):
    """The sentences of every override set, joined."""
    both = iv.compare_scenarios(d.recommendations, iv.what_if(d.decision_inputs, OVERRIDES))
    return both.select("what_if", *SERIES, F.concat_ws(" ", iv.scenario_sentences()).alias("explanation"))


def rules_sql(table: str, rules: dict) -> str:
    arms = [f"SELECT '{n}' AS check_name, ({o})::DOUBLE AS observed, ({e})::DOUBLE AS expected FROM {table}" for n, (o, e) in rules.items()]
    return "SELECT check_name, observed = expected AS passed, observed, expected FROM (" + " UNION ALL ".join(arms) + ")"


PANEL_SQL = {
    "stores": ("count(DISTINCT store_id)", 5), "items": ("count(DISTINCT item_id)", 6), "series": ("count(DISTINCT store_id || item_id)", 30),
    "days": ("count(DISTINCT date)", "(SELECT date_diff('day', lo, hi) + 1 FROM bounds)"), "row_count": ("count(*)", "(SELECT 30 * (date_diff('day', lo, hi) + 1) FROM bounds)"),
    "duplicate_keys": ("count(*) - count(DISTINCT store_id || item_id || date::VARCHAR)", 0), "negative_sales": ("count(*) FILTER (sales < 0)", 0),
    "unmatched_calendar_rows": ("count(*) FILTER (d IS NULL)", 0), "non_positive_prices": ("count(*) FILTER (sell_price <= 0)", 0),
    "missing_hierarchy": ("count(*) FILTER (dept_id IS NULL OR state_id IS NULL)", 0),
}


@query("dq_01_panel_integrity", rules_sql("panel", PANEL_SQL))
def panel_integrity(d):
    return dq.panel_checks(d.panel, d.bounds.lo, 5, 6, d.bounds.days)


@query("dq_02_input_revalidation", rules_sql("flagged", {**PANEL_SQL, "bands": ("count(DISTINCT demand_band)", 3), "rows_without_launch": ("count(*) FILTER (launch_date IS NULL)", 0)}))
def input_revalidation(d):
    return dq.panel_checks(
        d.flagged, d.bounds.lo, 5, 6, d.bounds.days, {"rows_without_launch": F.col("launch_date").isNull()},
        {"bands": (F.count_distinct("band"), 3)}, {"band": F.min("demand_band")})


FEATURE_SQL = {
    "inactive_rows": ("count(*) FILTER (NOT is_active)", 0), "stores": ("count(DISTINCT store_id)", 5), "series": ("count(DISTINCT store_id || item_id)", 30),
    "duplicate_keys": ("count(*) - count(DISTINCT store_id || item_id || date::VARCHAR)", 0), "negative_age": ("count(*) FILTER (product_age_days < 0)", 0),
    "first_rows_with_lag": ("count(*) FILTER (product_age_days = 0 AND sales_lag_1 IS NOT NULL)", 0), "incomplete_ready_rows": ("count(*) FILTER (is_feature_ready AND sales_roll_mean_28 IS NULL)", 0),
}


@query("dq_03_feature_table_checks", rules_sql("(SELECT *, lag(sales) OVER (PARTITION BY store_id, item_id ORDER BY date) AS lag_again FROM features)", {**FEATURE_SQL, "lag_mismatches": ("count(*) FILTER (sales_lag_1 IS DISTINCT FROM lag_again)", 0)}))
def feature_table_checks(d):
    previous = F.lag("sales").over(ft.by_date())
    rows = d.features.withColumn("_previous", previous)
    incomplete = F.col("is_feature_ready") & ~ft.readiness()
    return dq.checks(rows, {
        "inactive_rows": (F.count_if(~F.col("is_active")), 0), "stores": (F.count_distinct("store_id"), 5), "series": (F.count_distinct(*SERIES), 30),
        "duplicate_keys": (F.count(F.lit(1)) - F.count_distinct("date", *SERIES), 0), "negative_age": (F.count_if(F.col("product_age_days") < 0), 0),
        "first_rows_with_lag": (F.count_if((F.col("product_age_days") == 0) & F.col("sales_lag_1").isNotNull()), 0),
        "incomplete_ready_rows": (F.count_if(incomplete), 0),
        "lag_mismatches": (F.count_if(~F.col("sales_lag_1").eqNullSafe(F.col("_previous"))), 0),
    })


@query("dq_04_boundary_checks", "SELECT 'flagged' AS table_name, 'no_prelaunch_sale' AS constraint_name, count(*) FILTER (prelaunch_flag AND sales > 0) AS violations FROM flagged UNION ALL SELECT 'flagged', 'no_prelaunch_price', count(*) FILTER (prelaunch_flag AND sell_price IS NOT NULL) FROM flagged")
def boundary_checks(d):
    early = F.col("prelaunch_flag")
    return dq.violations(ft.flag_availability(d.panel), "flagged", {
        "no_prelaunch_sale": ~(early & (F.col("sales") > 0)), "no_prelaunch_price": ~(early & F.col("sell_price").isNotNull()),
    })


SPEC = ", ".join(f"('{n}', '{t}', {str(m).lower()})" for n, (_, t, m) in ft.FEATURE_SPEC.items())
FILLED = " UNION ALL ".join(f"SELECT '{n}' AS feature, count({'sell_price' if n == 'known_future_sell_price' else n}) AS filled_rows FROM features" for n in ft.FEATURE_COLUMNS)


@query("dq_05_manifest_leakage_audit", f"""
SELECT v.feature, source_timing, default_model_feature, NOT default_model_feature OR source_timing IN ({', '.join(f"'{t}'" for t in ft.ALLOWED_TIMINGS)}) AS allowed, filled_rows
FROM (VALUES {SPEC}) AS v(feature, source_timing, default_model_feature) JOIN ({FILLED}) f ON f.feature = v.feature""")
def manifest_leakage_audit(d):
    filled = d.features.agg(*[F.count(c).alias(c) for c in ft.FEATURE_COLUMNS]).unpivot([], ft.FEATURE_COLUMNS, "feature", "filled_rows")
    audited = ft.feature_manifest(d.features).join(filled, "feature")
    allowed = ~F.col("default_model_feature") | F.col("source_timing").isin(ft.ALLOWED_TIMINGS)
    return audited.select("feature", "source_timing", "default_model_feature", allowed.alias("allowed"), "filled_rows")


@query("dq_06_fold_plan_checks", """
SELECT fold, date_diff('day', start_date, end_date) + 1 AS days, coalesce(start_date = lag(end_date) OVER (ORDER BY start_date) + 1, true) AS contiguous,
  coalesce(n > lag(n) OVER (ORDER BY start_date), true) AS expanding, n AS training_rows FROM (SELECT fold, start_date, end_date, count(*) AS n FROM fold_table_all JOIN features ON date < start_date AND is_feature_ready GROUP BY 1, 2, 3)""")
def fold_plan_checks(d):
    from pyspark.sql import Window as W

    counts = d.features.where("is_feature_ready").select(F.explode(F.filter(fo.fold_array(locked=True), lambda f: F.col("date") < f["start_date"])).alias("f"))
    rows = counts.groupBy("f.fold", "f.start_date", "f.end_date").agg(F.count(F.lit(1)).alias("training_rows")).withColumn("_plan", F.lit("folds"))
    order = W.partitionBy("_plan").orderBy("start_date")
    return rows.select(
        "fold", (F.datediff("end_date", "start_date") + 1).cast("bigint").alias("days"),
        F.coalesce(F.col("start_date") == F.date_add(F.lag("end_date").over(order), 1), F.lit(True)).alias("contiguous"),
        F.coalesce(F.col("training_rows") > F.lag("training_rows").over(order), F.lit(True)).alias("expanding"), "training_rows",
    )


@query("agg_42_fold_statistics", """
SELECT fold, count(*) FILTER (is_feature_ready AND date < start_date) AS training_rows, count(*) FILTER (is_feature_ready AND date BETWEEN start_date AND end_date) AS validation_rows,
  count(DISTINCT CASE WHEN date BETWEEN start_date AND end_date THEN item_id END) AS items, count(DISTINCT CASE WHEN date BETWEEN start_date AND end_date THEN store_id END) AS stores,
  max(CASE WHEN is_feature_ready AND date < start_date THEN date END) AS last_training_date FROM features JOIN fold_table ON date <= end_date GROUP BY 1""")
def fold_statistics(d):
    rows = d.features.select("*", F.inline(F.filter(fo.fold_array(), lambda f: F.col("date") <= f["end_date"])))
    ready, before = F.col("is_feature_ready"), F.col("date") < F.col("start_date")
    return rows.groupBy("fold").agg(
        F.count_if(ready & before).alias("training_rows"), F.count_if(ready & ~before).alias("validation_rows"),
        F.count_distinct(F.when(~before, F.col("item_id"))).alias("items"), F.count_distinct(F.when(~before, F.col("store_id"))).alias("stores"),
        F.max(F.when(ready & before, F.col("date"))).alias("last_training_date"),
    )


CONFIG = [*ft.HISTORY_FEATURES[:9], "day_of_week_sin", "is_event", "demand_band", "no_such_feature"]


@query("dq_08_experiment_config_checks", f"""
SELECT c.feature, v.feature IS NOT NULL AS exists_in_manifest, coalesce(source_timing NOT IN ('analysis_only', 'target', 'control', 'optional_known_future'), false) AS is_permitted, coalesce(filled_rows, 0) AS filled_rows
FROM (SELECT unnest([{', '.join(f"'{c}'" for c in CONFIG)}]) AS feature) c LEFT JOIN (VALUES {SPEC}) AS v(feature, source_timing, default_model_feature) ON v.feature = c.feature LEFT JOIN ({FILLED}) f ON f.feature = c.feature""")
def experiment_config_checks(d):
    wanted = d.spark.createDataFrame([(c,) for c in CONFIG], "feature string")
    filled = d.features.agg(*[F.count(c).alias(c) for c in ft.FEATURE_COLUMNS]).unpivot([], ft.FEATURE_COLUMNS, "feature", "filled_rows")
    joined = wanted.join(ft.feature_manifest(d.features), "feature", "left").join(filled, "feature", "left")
    permitted = F.col("source_timing").isin(ft.ALLOWED_TIMINGS)
    return joined.select("feature", F.col("source_timing").isNotNull().alias("exists_in_manifest"), F.coalesce(permitted, F.lit(False)).alias("is_permitted"),
                         F.coalesce("filled_rows", F.lit(0)).alias("filled_rows"))


@query("dq_10_artifact_contract", rules_sql("deployed", {"duplicate_keys": ("count(*) - count(DISTINCT store_id || item_id || target_date::VARCHAR)", 0), "horizon_out_of_range": ("count(*) FILTER (horizon_day NOT BETWEEN 1 AND 30)", 0),
    "negative_forecasts": ("count(*) FILTER (forecast < 0)", 0), "origins": ("count(DISTINCT forecast_origin)", 1)}))
def artifact_contract(d):
    return dq.checks(d.deployed, {
        "duplicate_keys": (F.count(F.lit(1)) - F.count_distinct(*SERIES, "target_date"), 0), "horizon_out_of_range": (F.count_if(~F.col("horizon_day").between(1, 30)), 0),
        "negative_forecasts": (F.count_if(F.col("forecast") < 0), 0), "origins": (F.count_distinct("forecast_origin"), 1),
    })


@query("dq_11_loaded_table_validation", rules_sql("deployed", {"forecast_rows": ("count(*)", 900), "forecast_days": ("count(DISTINCT target_date)", 30), "max_horizon": ("max(horizon_day)", 30), "stores": ("count(DISTINCT store_id)", 5), "items": ("count(DISTINCT item_id)", 6)}))
def loaded_table_validation(d):
    stored = sinks.write_table(d.deployed, sinks.scratch_path(d.spark, "forecasts"))
    return dq.checks(stored, {"forecast_rows": (F.count(F.lit(1)), 900), "forecast_days": (F.count_distinct("target_date"), 30), "max_horizon": (F.max("horizon_day"), 30),
                              "stores": (F.count_distinct("store_id"), 5), "items": (F.count_distinct("item_id"), 6)})


@query("dq_12_extract_contract", rules_sql("panel WHERE date >= (SELECT hi - 119 FROM bounds)", {"row_count": ("count(*)", 3600), "days": ("count(DISTINCT date)", 120), "span_days": ("date_diff('day', min(date), max(date)) + 1", 120), "series": ("count(DISTINCT store_id || item_id)", 30)}))
def extract_contract(d):
    """Read from the panel stored by year: older years are not listed."""
    recent = sinks.recent_window(d.stored_panel, 120, d.bounds.hi)
    first = d.bounds.hi - timedelta(days=119)
    rules = dq.key_rules(5, 6, 120)
    span = (F.datediff(F.max("last"), F.min("first")) + 1, 120)
    rows = dq.per_series(recent, first, 120, {}, {"first": F.min("date"), "last": F.max("date")})
    return dq.checks(rows, {"row_count": rules["row_count"], "days": rules["days"], "span_days": span, "series": rules["series"]})


@query("dq_13_table_constraints", """
SELECT 'history' AS table_name, 'sales_non_negative' AS constraint_name, count(*) FILTER (sales < 0) AS violations FROM panel
UNION ALL SELECT 'forecasts', 'horizon_in_range', count(*) FILTER (horizon_day NOT BETWEEN 1 AND 30) FROM deployed UNION ALL SELECT 'forecasts', 'forecast_non_negative', count(*) FILTER (forecast < 0) FROM deployed
UNION ALL SELECT 'recommendations', 'quantities_non_negative', count(*) FILTER (recommended_order_qty < 0 OR cost_optimized_order_qty < 0) FROM recommendations UNION ALL SELECT 'recommendations', 'risk_in_range', count(*) FILTER (stockout_risk NOT BETWEEN 0 AND 1) FROM recommendations""")
def table_constraints(d):
    return dq.union(
        dq.violations(d.panel, "history", {"sales_non_negative": F.col("sales") >= 0}),
        dq.violations(d.deployed, "forecasts", {"horizon_in_range": F.col("horizon_day").between(1, 30), "forecast_non_negative": F.col("forecast") >= 0}),
        dq.violations(d.recommendations, "recommendations", {"quantities_non_negative": (F.col("recommended_order_qty") >= 0) & (F.col("cost_optimized_order_qty") >= 0), "risk_in_range": F.col("stockout_risk").between(0, 1)}),
    )
