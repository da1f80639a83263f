"""Residual calibration, replenishment decisions and their summaries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandloom.catalog.q_features import rounded, sql_round
from demandloom.catalog.prelude import OVERRIDES
from demandloom.catalog.registry import query
from demandloom.functions.columns import clip
from demandloom.operators import inventory as iv
from demandloom.operators import reshape, serving
from demandloom.operators.joins import key_mismatches
from demandloom.sources import parameters as P
from demandloom.sources.parameters import SERIES

RES = ["residual_mean", "residual_std", "residual_rmse"]


@query("inv_01_residual_summary", """
SELECT model_name, store_id, dept_id, round(avg(actual - forecast), 6) AS residual_mean, round(stddev_samp(actual - forecast), 6) AS residual_std,
  round(sqrt(avg(pow(actual - forecast, 2))), 6) AS residual_rmse, count(*) AS calibration_count FROM predictions GROUP BY 1, 2, 3""")
def residual_summary(d):
    return rounded(iv.residual_summary(d.predictions, "model_name", "store_id", "dept_id"), RES)


CAL = ["residual_mean", "sigma_daily", "residual_rmse"]


@query("inv_02_hierarchical_calibration", f"""
SELECT store_id, item_id, dept_id, demand_band, intermittency_class, calibration_level, calibration_count, {sql_round(CAL)} FROM calibration""")
def hierarchical_calibration(d):
    return rounded(iv.calibrate(d.predictions), CAL)


@query("jn_11_residual_fallback_levels", """
SELECT store_id, item_id, NULL AS dept_id, 'item_store' AS level, round(stddev_samp(actual - forecast), 6) AS residual_std, count(*) AS calibration_count FROM predictions WHERE model_name = 'mean_28' GROUP BY 1, 2
UNION ALL SELECT store_id, NULL, dept_id, 'department_store', round(stddev_samp(actual - forecast), 6), count(*) FROM predictions WHERE model_name = 'mean_28' GROUP BY store_id, dept_id
UNION ALL SELECT NULL, NULL, NULL, 'global', round(stddev_samp(actual - forecast), 6), count(*) FROM predictions WHERE model_name = 'mean_28'""")
def residual_fallback_levels(d):
    levels = iv.residual_levels(d.predictions.where(F.col("model_name") == "mean_28"))
    return rounded(levels.select("store_id", "item_id", "dept_id", "level", "residual_std", "calibration_count"), ["residual_std"])


@query("jn_12_key_set_equality", """
SELECT (SELECT count(*) FROM (SELECT DISTINCT store_id, item_id FROM deployed EXCEPT SELECT store_id, item_id FROM inv_state)) AS only_left,
  (SELECT count(*) FROM (SELECT store_id, item_id FROM inv_state EXCEPT SELECT store_id, item_id FROM deployed)) AS only_right,
  (SELECT count(*) FROM (SELECT store_id, item_id FROM inv_state INTERSECT SELECT store_id, item_id FROM deployed)) AS in_both""")
def key_set_equality(d):
    return key_mismatches(d.deployed, d.state, SERIES)


@query("jn_19_series_metadata", """
SELECT store_id, item_id, min(dept_id) AS dept_id, min(demand_band) AS demand_band, arg_max(intermittency_class, target_date) AS intermittency_class
FROM predictions WHERE model_name = 'mean_28' GROUP BY 1, 2""")
def series_metadata(d):
    return iv.latest_class(d.predictions.where(F.col("model_name") == "mean_28"))


@query("win_19_latest_row_per_series", """
SELECT store_id, item_id, target_date, intermittency_class, round(forecast, 6) AS forecast FROM (
  SELECT *, row_number() OVER (PARTITION BY store_id, item_id ORDER BY target_date DESC) AS rn FROM predictions WHERE model_name = 'mean_28') WHERE rn = 1""")
def latest_row_per_series(d):
    newest = W.partitionBy(*SERIES).orderBy(F.desc("target_date"))
    rows = d.predictions.where(F.col("model_name") == "mean_28").withColumn("rn", F.row_number().over(newest)).where("rn = 1")
    return rounded(rows.select(*SERIES, "target_date", "intermittency_class", "forecast"), ["forecast"])


@query("src_09_policy_parameters", """
SELECT store_id, item_id, coalesce(lead_time_days, 7) AS lead_time_days, coalesce(service_level, 0.95) AS service_level, 7 AS review_period_days,
  holding_cost_per_unit_per_day, stockout_cost_per_unit, fixed_order_cost FROM inv_state""")
def policy_parameters(d):
    return iv.with_policy(d.state).select(
        *SERIES, "lead_time_days", "service_level", "review_period_days", "holding_cost_per_unit_per_day", "stockout_cost_per_unit", "fixed_order_cost"
    )


@query("src_09_policy_violations", " UNION ALL ".join(f"SELECT '{n}' AS parameter, count(*) FILTER ({rule}) AS violations FROM inv_state" for n, rule in {
    "service_level": "NOT (service_level > 0.5 AND service_level < 1)", "lead_time_days": "NOT lead_time_days BETWEEN 1 AND 30", "review_period_days": "false",
    "holding_cost_per_unit_per_day": "holding_cost_per_unit_per_day < 0", "stockout_cost_per_unit": "stockout_cost_per_unit < 0", "fixed_order_cost": "fixed_order_cost < 0"}.items()))
def policy_violations(d):
    return iv.policy_violations(iv.with_policy(d.state))


@query("inv_03_inventory_position", "SELECT store_id, item_id, on_hand + on_order - backorders AS inventory_position FROM inv_state")
def inventory_position(d):
    return d.state.select(*SERIES, iv.inventory_position(F.col("on_hand"), F.col("on_order"), F.col("backorders")).alias("inventory_position"))


def stage(name: str, columns: list[str], text: list[str] = []):
    """One registered slice of the service decision."""
    @query(name, f"SELECT store_id, item_id, {', '.join([*text, sql_round(columns)])} FROM inv_service")
    def slice_of_decision(d):
        return rounded(iv.service_decision(d.decision_inputs).select(*SERIES, *text, *columns), columns)


stage("inv_04_lead_and_planning_demand", ["lead_time_demand", "planning_horizon_demand", "mean_daily_forecast"], ["planning_horizon_days"])
stage("inv_05_safety_stock", ["safety_stock", "sigma_daily", "service_level"])
stage("inv_06_reorder_point_and_target", ["reorder_point", "target_stock_level"])
stage("inv_07_order_quantity", ["recommended_order_qty_raw"], ["recommended_order_qty"])
stage("inv_09_stockout_probability", ["stockout_risk", "inventory_position"])
stage("inv_10_stock_status", ["days_of_supply"], ["stock_status"])
stage("inv_11_priority", ["priority_score"], ["priority_label"])


@query("inv_08_days_of_supply", """
SELECT store_id, item_id, round(days_of_supply, 6) AS days_of_supply,
  CASE WHEN days_of_supply IS NULL THEN 'NO EXPECTED DEMAND' ELSE format('{:.1f} days', days_of_supply) END AS days_of_supply_label FROM inv_service""")
def days_of_supply(d):
    return rounded(iv.service_decision(d.decision_inputs).select(*SERIES, "days_of_supply", "days_of_supply_label"), ["days_of_supply"])


@query("inv_12_demand_scenarios", "SELECT store_id, item_id, CAST(scenario AS INTEGER) AS scenario, round(demand, 6) AS demand FROM inv_scenarios")
def demand_scenarios(d):
    return rounded(iv.demand_scenarios(iv.service_decision(d.decision_inputs), SERIES).drop("decision"), ["demand"])


COST = ["expected_excess", "expected_shortage", "holding_cost", "shortage_cost", "expected_cost"]


def cost_table(d):
    return iv.candidate_costs(iv.with_candidates(iv.demand_scenarios(iv.service_decision(d.decision_inputs), SERIES), SERIES), SERIES)


@query("inv_13_expected_cost_of_candidates", """
SELECT store_id, item_id, quantity, round(excess, 6) AS expected_excess, round(shortage, 6) AS expected_shortage, round(holding_cost, 6) AS holding_cost,
  round(shortage_cost, 6) AS shortage_cost, round(expected_cost, 6) AS expected_cost FROM inv_costs""")
def expected_cost_of_candidates(d):
    return rounded(cost_table(d).select(*SERIES, "quantity", *COST), COST)


@query("inv_14_candidate_grid", "SELECT store_id, item_id, quantity FROM inv_grid")
def candidate_grid(d):
    prepared = iv.with_candidates(iv.demand_scenarios(iv.service_decision(d.decision_inputs), SERIES), SERIES)
    return prepared.select(*SERIES, F.explode("quantities").alias("quantity"))


CHEAP = ["estimated_cost_without_order", "estimated_cost_with_recommendation", "estimated_cost_with_service_order", "estimated_cost_savings",
         "expected_shortage_without_order", "expected_excess_without_order", "expected_shortage_with_recommendation", "expected_excess_with_recommendation"]


@query("inv_15_cheapest_order", f"""
SELECT store_id, item_id, cost_optimized_order_qty, candidate_count, candidate_max, {sql_round(CHEAP)} FROM recommendations""")
def cheapest_order(d):
    return rounded(iv.cheapest_orders(cost_table(d), SERIES).select(*SERIES, "cost_optimized_order_qty", "candidate_count", "candidate_max", *CHEAP), CHEAP)


BATCH = ["on_hand", "on_order", "backorders", "service_level", "inventory_position", "forecast_1d", "forecast_7d", "forecast_30d", "lead_time_demand",
         "sigma_daily", "residual_mean", "residual_rmse", "safety_stock", "reorder_point", "target_stock_level", "days_of_supply", "stockout_risk",
         "recommended_order_qty_raw", "priority_score", *CHEAP]
BATCH_TEXT = ["dept_id", "demand_band", "intermittency_class", "calibration_level", "calibration_count", "lead_time_days", "planning_horizon_days",
              "recommended_order_qty", "cost_optimized_order_qty", "stock_status", "priority_label"]


@query("inv_16_batch_recommendations", f"SELECT store_id, item_id, {', '.join(BATCH_TEXT)}, {sql_round(BATCH)} FROM recommendations")
def batch_recommendations(d):
    return rounded(iv.recommend(d.decision_inputs).select(*SERIES, *BATCH_TEXT, *BATCH), BATCH)


WHAT_IF = ["inventory_position", "lead_time_demand", "planning_horizon_demand", "safety_stock", "stockout_risk", "estimated_cost_with_recommendation", "estimated_cost_without_order"]
WHAT_IF_TEXT = ["recommended_order_qty", "cost_optimized_order_qty", "planning_horizon_days", "stock_status", "priority_label"]


@query("inv_17_what_if_overrides", f"SELECT what_if, store_id, item_id, {', '.join(WHAT_IF_TEXT)}, {sql_round(WHAT_IF)} FROM wi_result")
def what_if_overrides(d):
    """Every kind of override: stock, lead time, service, review period and costs; "saved" changes nothing."""
    return rounded(iv.what_if(d.decision_inputs, OVERRIDES).select("what_if", *SERIES, *WHAT_IF_TEXT, *WHAT_IF), WHAT_IF)


@query("inv_18_saved_vs_scenario", f"""
SELECT w.what_if, store_id, item_id, w.recommended_order_qty, r.recommended_order_qty AS saved_recommended_order_qty, w.recommended_order_qty - r.recommended_order_qty AS order_delta,
  w.cost_optimized_order_qty, r.cost_optimized_order_qty AS saved_cost_optimized_order_qty,
  round(w.estimated_cost_with_recommendation - r.estimated_cost_with_recommendation, 6) + 0.0 AS cost_delta
FROM wi_result w JOIN recommendations r USING (store_id, item_id)""")
def saved_vs_scenario(d):
    both = iv.compare_scenarios(d.recommendations, iv.what_if(d.decision_inputs, OVERRIDES))
    return rounded(both.select(
        "what_if", *SERIES, "recommended_order_qty", "saved_recommended_order_qty", "order_delta",
        "cost_optimized_order_qty", "saved_cost_optimized_order_qty", "cost_delta"), ["cost_delta"])


SUMS = ["expected_shortage_without_order", "expected_shortage_with_recommendation", "estimated_cost_without_order", "estimated_cost_with_recommendation", "estimated_cost_savings"]
SUM_SQL = """count(*) AS series, count(*) FILTER (recommended_order_qty > 0) AS requiring_reorder, CAST(sum(recommended_order_qty) AS BIGINT) AS recommended_units,
  CAST(sum(cost_optimized_order_qty) AS BIGINT) AS cost_optimized_units, """ + ", ".join(f"round(sum({c}), 4) AS {c}" for c in SUMS)


@query("agg_45_recommendation_totals", f"SELECT {SUM_SQL} FROM recommendations")
def recommendation_totals(d):
    return rounded(d.recommendations.agg(*iv.result_columns()), SUMS, 4)


@query("agg_46_group_results", " UNION ALL ".join(
    f"SELECT '{c}' AS group_type, {c} AS group_value, {SUM_SQL} FROM recommendations GROUP BY {c}" for c in ("store_id", "dept_id", "priority_label")))
def group_results(d):
    return rounded(iv.group_results(d.recommendations, ["store_id", "dept_id", "priority_label"]), SUMS, 4)


@query("agg_47_state_input_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS attribute, CAST({c} AS VARCHAR) AS value, count(*) AS series FROM inv_state GROUP BY 2" for c in ("lead_time_days", "service_level")))
def state_input_counts(d):
    return iv.category_counts(d.state, ["lead_time_days", "service_level"])


def _ordered(order, column):
    values = ", ".join(f"({i}, '{v}')" for i, v in enumerate(order, start=1))
    return f"""SELECT position, v.{column}, CAST(coalesce(n, 0) AS BIGINT) AS series FROM (VALUES {values}) AS v(position, {column})
LEFT JOIN (SELECT {column}, count(*) AS n FROM recommendations GROUP BY 1) c ON c.{column} = v.{column}"""


@query("rsh_06_status_counts_in_order", _ordered(P.STATUS_ORDER, "stock_status"))
def status_counts(d):
    counts = d.recommendations.groupBy("stock_status").agg(F.count(F.lit(1)).alias("series"))
    return reshape.reindexed(counts, "stock_status", P.STATUS_ORDER, ["series"]).withColumn("position", F.col("position").cast("int"))


@query("rsh_06_priority_counts_in_order", _ordered(P.PRIORITY_ORDER, "priority_label"))
def priority_counts(d):
    counts = d.recommendations.groupBy("priority_label").agg(F.count(F.lit(1)).alias("series"))
    return reshape.reindexed(counts, "priority_label", P.PRIORITY_ORDER, ["series"]).withColumn("position", F.col("position").cast("int"))


@query("agg_49_actions_by_store", """
SELECT store_id, CASE WHEN recommended_order_qty > 0 THEN 'REORDER' ELSE 'NO ORDER' END AS order_action, count(*) AS series,
  CAST(sum(recommended_order_qty) AS BIGINT) AS units FROM recommendations GROUP BY 1, 2""")
def actions_by_store(d):
    return d.recommendations.groupBy("store_id", serving.order_action().alias("order_action")).agg(
        F.count(F.lit(1)).alias("series"), F.sum("recommended_order_qty").alias("units")
    )


@query("agg_50_shortage_reduction", """
SELECT round(CASE WHEN sum(expected_shortage_without_order) > 0 THEN greatest(0, (sum(expected_shortage_without_order) - sum(expected_shortage_with_recommendation)) / sum(expected_shortage_without_order)) ELSE 0 END, 6) AS shortage_reduction
FROM recommendations""")
def shortage_reduction(d):
    share = serving.shortage_reduction(F.sum("expected_shortage_without_order"), F.sum("expected_shortage_with_recommendation"))
    return rounded(d.recommendations.agg(share.alias("shortage_reduction")), ["shortage_reduction"])


@query("agg_51_histograms", """
SELECT 'stockout_risk_pct' AS measure, CAST(least(floor(stockout_risk * 100 / 5) + 1, 20) AS BIGINT) AS bin, count(*) AS series FROM recommendations GROUP BY 2
UNION ALL SELECT 'days_of_supply', CAST(least(floor(least(days_of_supply, 60) / 3) + 1, 20) AS BIGINT), count(*) FROM recommendations WHERE days_of_supply IS NOT NULL GROUP BY 2
UNION ALL SELECT 'recommended_order_qty', CAST(least(floor(recommended_order_qty * 20.0 / (SELECT max(recommended_order_qty) FROM recommendations)) + 1, 20) AS BIGINT), count(*) FROM recommendations GROUP BY 2""")
def histograms(d):
    rows = d.recommendations
    top = rows.agg(F.max("recommended_order_qty")).scalar()
    parts = {
        "stockout_risk_pct": iv.histogram(rows, F.col("stockout_risk") * 100, 0.0, 100.0, 20),
        "days_of_supply": iv.histogram(rows, F.least(F.col("days_of_supply"), F.lit(60.0)), 0.0, 60.0, 20),
        "recommended_order_qty": iv.histogram(rows, F.col("recommended_order_qty") * 20.0 / top, 0.0, 20.0, 20),
    }
    tagged = [part.select(F.lit(name).alias("measure"), F.col("bin").cast("bigint").alias("bin"), "series") for name, part in parts.items()]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


@query("scl_12_clip_and_ceil", """
SELECT store_id, item_id, round(greatest(target_stock_level - inventory_position, 0), 6) AS clipped, CAST(ceil(greatest(target_stock_level - inventory_position, 0)) AS BIGINT) AS units,
  round(least(greatest(stockout_risk, 0), 1), 6) AS bounded_risk FROM inv_service""")
def clip_and_ceil(d):
    gap = clip(F.col("target_stock_level") - F.col("inventory_position"), 0.0)
    rows = iv.service_decision(d.decision_inputs).select(
        *SERIES, gap.alias("clipped"), F.ceil(gap).alias("units"), clip(F.col("stockout_risk"), 0.0, 1.0).alias("bounded_risk")
    )
    return rounded(rows, ["clipped", "bounded_risk"])


CHECKS = {
    "inventory_position_formula": "abs(inventory_position - (on_hand + on_order - backorders)) < 1e-9",
    "reorder_point_formula": "abs(reorder_point - (lead_time_demand + safety_stock)) < 1e-9",
    "reorder_raw_formula": "abs(recommended_order_qty_raw - greatest(target_stock_level - inventory_position, 0)) < 1e-9",
    "rounded_orders_cover_raw": "recommended_order_qty >= recommended_order_qty_raw - 1e-9",
    "stockout_risk_bounded": "stockout_risk BETWEEN 0 AND 1",
    "nonnegative_orders": "recommended_order_qty >= 0 AND cost_optimized_order_qty >= 0",
    "optimizer_never_worse_than_no_order": "estimated_cost_with_recommendation <= estimated_cost_without_order + 1e-9",
    "optimizer_never_worse_than_service": "estimated_cost_with_recommendation <= estimated_cost_with_service_order + 1e-9",
    "target_covers_reorder_point": "target_stock_level >= reorder_point - 1e-9",
    "priority_none_without_order": "(priority_label = 'NONE') = (recommended_order_qty_raw <= 0)",
}


@query("dq_09_recommendation_checks", " UNION ALL ".join(
    f"SELECT '{name}' AS check_name, coalesce(bool_and({rule}), false) AS passed, count(*) AS rows_checked FROM recommendations" for name, rule in CHECKS.items())
    + " UNION ALL SELECT 'unique_series', count(*) = count(DISTINCT store_id || '/' || item_id), count(*) FROM recommendations")
def recommendation_checks(d):
    row = d.recommendations.agg(
        *[F.coalesce(F.bool_and(F.expr(rule)), F.lit(False)).alias(name) for name, rule in CHECKS.items()],
        (F.count(F.lit(1)) == F.count_distinct(*SERIES)).alias("unique_series"),
        F.count(F.lit(1)).alias("rows_checked"),
    )
    return row.unpivot("rows_checked", [*CHECKS, "unique_series"], "check_name", "passed").select("check_name", "passed", "rows_checked")
