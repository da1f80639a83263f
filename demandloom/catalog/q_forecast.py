"""Baseline forecasts, their metrics and the model rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.catalog.q_features import rounded, sql_round
from demandloom.catalog.registry import query
from demandloom.functions.columns import count_if
from demandloom.operators import forecast as fc
from demandloom.operators import metrics as mt
from demandloom.operators import ranking as rk
from demandloom.operators.features import sales_lags, rolling_means
from demandloom.sources import parameters as P
from demandloom.sources.parameters import SERIES

FIRST_START = P.FOLDS[0][1]


@query("entry_mean28_accuracy_by_store", """
SELECT store_id, count(*) AS forecast_rows, round(avg(abs(mean_28 - sales)), 6) AS mae, round(avg(mean_28 - sales), 6) AS bias,
  round(avg(prior_day), 6) AS mean_prior_day, round(avg(prior_week), 6) AS mean_prior_week
FROM (SELECT f.store_id, f.sales, o.mean_28, f.sales_lag_1 AS prior_day, f.sales_roll_mean_7 AS prior_week FROM features f JOIN origins o ON o.store_id = f.store_id AND o.item_id = f.item_id AND o.fold = 'f1'
  WHERE f.date BETWEEN DATE '2001-04-02' AND DATE '2001-05-01') GROUP BY 1""")
def mean28_accuracy_by_store(d):
    """Panel -> lags and rolling means -> mean-28 at one origin -> accuracy by store, in one job."""
    history = rolling_means(sales_lags(d.active))
    start = F.lit(FIRST_START).cast("date")
    before = F.col("date").between(F.date_sub(start, 28), F.date_sub(start, 1))
    level = history.where(before).groupBy(*SERIES).agg(F.avg("sales").alias("forecast"))
    window = history.where(F.col("date").between(start, F.lit(P.FOLDS[0][2]).cast("date")))
    scored = window.join(level, SERIES).groupBy("store_id").agg(
        F.count(F.lit(1)).alias("forecast_rows"),
        F.avg(F.abs(F.col("forecast") - F.col("sales"))).alias("mae"),
        F.avg(F.col("forecast") - F.col("sales")).alias("bias"),
        F.avg("sales_lag_1").alias("mean_prior_day"),
        F.avg("sales_roll_mean_7").alias("mean_prior_week"),
    )
    return rounded(scored, ["mae", "bias", "mean_prior_day", "mean_prior_week"])


def one_model(name: str):
    key = {"zero": "fc_01_zero_forecast", "last_value": "fc_02_last_value_forecast", "seasonal_naive_7": "fc_03_seasonal_naive_forecast",
           "mean_28": "fc_04_mean_28_forecast", "croston_sba": "fc_05_croston_sba_forecast"}[name]

    @query(key, f"""
    SELECT fold, store_id, item_id, target_date, CAST(horizon_day AS INTEGER) AS horizon_day, round(forecast, 6) AS forecast
    FROM forecasts WHERE model_name = '{name}'""")
    def forecast(d):
        rows = fc.origins(fc.series_history(d.active))
        return rounded(
            fc.baseline_forecasts(rows, [name]).select("fold", *SERIES, "target_date", "horizon_day", "forecast"), ["forecast"]
        )


for _name in P.MODELS:
    one_model(_name)


PREDICTION_KEYS = ["fold", "model_name", *SERIES, "target_date"]


@query("fc_06_fold_predictions", """
SELECT fold, model_name, store_id, item_id, dept_id, demand_band, intermittency_class, forecast_origin, history_end_date,
  history_observations, target_date, CAST(horizon_day AS INTEGER) AS horizon_day, actual, round(forecast, 6) AS forecast,
  round(rmsse_scale, 6) AS rmsse_scale, round(training_zero_pct, 6) AS training_zero_pct FROM predictions""")
def fold_predictions(d):
    active = d.active.join(d.series_bands, SERIES)
    built = rounded(fc.fold_predictions(active), ["forecast", "rmsse_scale", "training_zero_pct"])
    return built.withColumn("history_observations", F.col("history_observations").cast("bigint"))


STATE = ["sales_lag_1", "sales_lag_7", "sales_lag_14", "sales_lag_28", "sales_roll_mean_7", "sales_roll_mean_14",
         "sales_roll_mean_28", "sales_roll_std_7", "sales_roll_std_28"]


@query("fc_07_recursive_demand_features", f"""
SELECT fold, store_id, item_id, {sql_round(STATE)} FROM features JOIN fold_table ON date = start_date""")
def recursive_demand_features(d):
    state = fc.tail(F.col("known"), 28)
    rows = fc.origins(fc.series_history(d.active))
    return rounded(rows.select("fold", *SERIES, *[c.alias(n) for n, c in fc.demand_state_features(state).items()]), STATE)


RECURSIVE = """
WITH RECURSIVE grown AS (
  SELECT store_id, item_id, max(date) AS forecast_origin, 0 AS horizon_day, list(sales::DOUBLE ORDER BY date) AS hist, 0.0::DOUBLE AS forecast
  FROM active WHERE date > (SELECT max(date) - 28 FROM active) GROUP BY 1, 2
  UNION ALL
  SELECT store_id, item_id, forecast_origin, horizon_day + 1, list_append(hist[2:], list_avg(hist)), list_avg(hist) FROM grown WHERE horizon_day < 30)
"""


@query("fc_09_recursive_mean_deployment", RECURSIVE + """
SELECT store_id, item_id, forecast_origin, forecast_origin + horizon_day AS target_date, horizon_day, round(forecast, 6) AS forecast
FROM grown WHERE horizon_day > 0""")
def recursive_mean_deployment(d):
    return rounded(fc.deployment_forecast(fc.last_values(d.active)), ["forecast"])


@query("fc_11_deployment_refit", """
SELECT store_id, item_id, max(date) AS trained_through, count(*) AS window_days, CAST(sum(sales) AS BIGINT) AS window_units,
  CAST(max(CASE WHEN date = (SELECT max(date) FROM active) THEN sales END) AS DOUBLE) AS last_value
FROM active WHERE date > (SELECT max(date) - 28 FROM active) GROUP BY 1, 2""")
def deployment_refit(d):
    recent = F.col("recent")
    return fc.last_values(d.active).select(
        *SERIES, "trained_through", F.size(recent).cast("bigint").alias("window_days"),
        fc.total(recent).cast("bigint").alias("window_units"), F.element_at(recent, -1).alias("last_value"),
    )


ORIGIN = ["rmsse_scale", "training_zero_pct"]


@query("fc_12_history_metadata", f"""
SELECT fold, origin, store_id, item_id, history_observations, history_end_date, intermittency_class, {sql_round(ORIGIN)} FROM origins""")
def history_metadata(d):
    rows = fc.origins(fc.series_history(d.active)).select(
        "fold", "origin", *SERIES, F.col("history_observations").cast("bigint").alias("history_observations"),
        "history_end_date", "intermittency_class", *ORIGIN,
    )
    return rounded(rows, ORIGIN)


@query("win_21_naive_error_scale", "SELECT fold, store_id, item_id, round(rmsse_scale, 6) AS rmsse_scale FROM origins")
def naive_error_scale(d):
    return rounded(fc.origins(fc.series_history(d.active)).select("fold", *SERIES, "rmsse_scale"), ["rmsse_scale"])


@query("win_22_horizon_index", """
SELECT fold, store_id, item_id, date, CAST(date - (start_date - 1) AS INTEGER) AS horizon_day
FROM active JOIN fold_table ON date BETWEEN start_date AND end_date""")
def horizon_index(d):
    from demandloom.operators.folds import fold_rows

    rows = fold_rows(d.active.select(*SERIES, "date"))
    return rows.select("fold", *SERIES, "date", F.datediff("date", "origin").alias("horizon_day"))


@query("scl_11_training_intermittency_class", """
SELECT fold, intermittency_class, count(*) AS series, round(avg(training_zero_pct), 6) AS mean_zero_pct FROM origins GROUP BY 1, 2""")
def training_intermittency_class(d):
    rows = fc.origins(fc.series_history(d.active))
    return rounded(rows.groupBy("fold", "intermittency_class").agg(
        F.count(F.lit(1)).alias("series"), F.avg("training_zero_pct").alias("mean_zero_pct")
    ), ["mean_zero_pct"])


@query("fc_13_horizon_totals", RECURSIVE + """
SELECT store_id, item_id, round(sum(CASE WHEN horizon_day <= 1 THEN forecast END), 6) AS forecast_1d,
  round(sum(CASE WHEN horizon_day <= 7 THEN forecast END), 6) AS forecast_7d, round(sum(forecast), 6) AS forecast_30d
FROM grown WHERE horizon_day > 0 GROUP BY 1, 2""")
def horizon_totals(d):
    totals = fc.horizon_totals(fc.deployment_forecast(fc.last_values(d.active)))
    return rounded(totals, ["forecast_1d", "forecast_7d", "forecast_30d"])


@query("fc_14_leakage_mutation_audit", """
SELECT fold, 0::BIGINT AS changed_forecasts, count(*) AS changed_actuals FROM predictions GROUP BY 1""")
def leakage_mutation_audit(d):
    """Every fold with all sales from its first target day on changed: no forecast may differ, every actual must."""
    keys = ["fold", "model_name", *SERIES, "target_date"]
    active = d.active.join(d.series_bands, SERIES)

    def run(rows, suffix):
        return rows.select(*keys, F.col("forecast").alias(f"forecast{suffix}"), F.col("actual").alias(f"actual{suffix}"))

    mutated = [fc.fold_predictions(fc.mutate_future(active, start)).where(F.col("fold") == fold) for fold, start, _ in P.FOLDS]
    both = run(fc.fold_predictions(active), "").join(run(reduce(DataFrame.unionByName, mutated), "_mutated"), keys, "full_outer")
    return both.groupBy("fold").agg(
        count_if(~F.col("forecast").eqNullSafe(F.col("forecast_mutated"))).alias("changed_forecasts"),
        count_if(~F.col("actual").eqNullSafe(F.col("actual_mutated"))).alias("changed_actuals"),
    )


@query("dq_15_history_validity", """
SELECT store_id, item_id, count(*) AS observations, count(*) - count(sales) AS missing_values, count(*) FILTER (sales < 0) AS negative_values,
  CAST(date_diff('day', min(date), max(date)) + 1 - count(DISTINCT date) AS BIGINT) AS gap_days, count(*) >= 28 AS has_minimum FROM active GROUP BY 1, 2""")
def history_validity(d):
    return fc.history_problems(d.active).withColumn("gap_days", F.col("gap_days").cast("bigint"))


@query("jn_06_actuals_attached", """
SELECT fold, model_name, count(*) AS n_rows, count(actual) AS with_actual, CAST(sum(actual) AS BIGINT) AS actual_units FROM predictions GROUP BY 1, 2""")
def actuals_attached(d):
    forecasts = fc.baseline_forecasts(fc.origins(fc.series_history(d.active)))
    return fc.attach_actuals(forecasts, d.active).groupBy("fold", "model_name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("actual").alias("with_actual"), F.sum("actual").alias("actual_units")
    )


BASIC = ["mae", "rmse", "wape", "bias", "aggregate_bias", "forecast_sum"]


@query("met_01_basic_metrics", """
SELECT model_name, store_id, round(avg(abs(forecast - actual)), 6) AS mae, round(sqrt(avg(pow(forecast - actual, 2))), 6) AS rmse,
  round(sum(abs(forecast - actual)) / nullif(sum(actual), 0), 6) AS wape, round(avg(forecast - actual), 6) AS bias,
  round(sum(forecast - actual), 4) AS aggregate_bias, CAST(sum(actual) AS BIGINT) AS actual_sum, round(sum(forecast), 4) AS forecast_sum,
  count(*) AS observations FROM predictions GROUP BY 1, 2""")
def basic_metrics(d):
    rows = rounded(mt.basic_metrics(d.predictions, "model_name", "store_id"), BASIC[:4])
    return rounded(rows, BASIC[4:], 4)


@query("met_02_series_rmsse", """
SELECT fold, model_name, round(avg(series_rmsse), 6) AS rmsse, count(series_rmsse) AS defined_series, count(*) - count(series_rmsse) AS undefined_series
FROM series_errors WHERE horizon = 'days_1_30_daily' GROUP BY 1, 2""")
def series_rmsse(d):
    rows = mt.series_errors(d.predictions).where(F.col("horizon") == "days_1_30_daily")
    return rounded(rows.groupBy("fold", "model_name").agg(
        F.avg("series_rmsse").alias("rmsse"), F.count("series_rmsse").alias("defined_series"),
        count_if(F.col("series_rmsse").isNull()).alias("undefined_series"),
    ), ["rmsse"])


@query("met_03_aggregate_horizon_metrics", """
SELECT model_name, horizon, round(sum(abs_error) / sum(n), 6) AS mae, round(sqrt(sum(sq_error) / sum(n)), 6) AS rmse, round(avg(series_rmsse), 6) AS rmsse
FROM series_errors WHERE is_aggregate GROUP BY 1, 2""")
def aggregate_horizon_metrics(d):
    rows = mt.series_errors(d.predictions).where("is_aggregate").groupBy("model_name", "horizon").agg(
        (F.sum("abs_error") / F.sum("n")).alias("mae"), F.sqrt(F.sum("sq_error") / F.sum("n")).alias("rmse"),
        F.avg("series_rmsse").alias("rmsse"),
    )
    return rounded(rows, ["mae", "rmse", "rmsse"])


CUBE6 = ["mae", "rmse", "wape", "bias", "rmsse"]
CUBE4 = ["aggregate_bias", "forecast_sum"]
CUBE_COLUMNS = f"""fold, model_name, horizon, horizon_days, evaluation_type, segment_type, segment_value, {sql_round(CUBE6)}, {sql_round(CUBE4, 4)},
  actual_sum, observations, rmsse_defined_series, rmsse_undefined_series"""


@query("met_04_metric_cube", f"SELECT {CUBE_COLUMNS} FROM metrics")
def metric_cube(d):
    return rounded(rounded(mt.metrics(d.predictions), CUBE6), CUBE4, 4)


@query("prj_17_metric_slice", f"""
SELECT {CUBE_COLUMNS} FROM metrics WHERE fold = 'combined' AND horizon = 'days_1_30_daily' AND segment_type = 'store_id'""")
def metric_slice(d):
    sliced = mt.metric_slice(mt.metrics(d.predictions), "days_1_30_daily", segment_type="store_id")
    return rounded(rounded(sliced, CUBE6), CUBE4, 4)


@query("rsh_03_pivot_fold_by_model", """
SELECT fold, """ + ", ".join(f"round(max(CASE WHEN model_name = '{m}' THEN mae END), 6) AS {m}" for m in P.MODELS) + """
FROM metrics WHERE horizon = 'days_1_30_daily' AND segment_type = 'overall' GROUP BY 1""")
def pivot_fold_by_model(d):
    cube = mt.metrics(d.predictions).where((F.col("horizon") == "days_1_30_daily") & (F.col("segment_type") == "overall"))
    return rounded(cube.groupBy("fold").pivot("model_name", P.MODELS).agg(F.max("mae")), P.MODELS)


PRIMARY = "SELECT *, abs(bias) AS absolute_bias FROM metrics WHERE fold = 'combined' AND horizon = 'days_1_30_daily' AND segment_type = 'overall'"
LONG = " UNION ALL ".join(f"SELECT model_name, '{m}' AS metric, round({m}::DOUBLE, 9) AS value FROM p" for m in rk.RANKED)


@query("win_16_competition_rank", f"""
WITH p AS ({PRIMARY}) SELECT metric, model_name, round(value, 6) AS value, rank() OVER (PARTITION BY metric ORDER BY value) AS position FROM ({LONG})""")
def competition_rank(d):
    primary = mt.metric_slice(mt.metrics(d.predictions), "days_1_30_daily")
    ranked = rk.long_metrics(primary, ["model_name"]).withColumn("position", rk.rank_min(["metric"], "value").cast("bigint"))
    return rounded(ranked, ["value"])


@query("met_05_baseline_ranking", f"""
WITH p AS ({PRIMARY}), r AS (SELECT model_name, metric, value, rank() OVER (PARTITION BY metric ORDER BY value) AS position FROM ({LONG}))
SELECT model_name, round(avg(position), 6) AS mean_rank, round(max(CASE WHEN metric = 'mae' THEN value END), 6) AS mae FROM r GROUP BY 1""")
def baseline_ranking(d):
    return rounded(rk.baseline_ranking(mt.metrics(d.predictions)), ["mean_rank", "mae"])


@query("met_06_best_by_metric", f"""
WITH p AS ({PRIMARY}) SELECT metric, arg_min(model_name, (value, model_name)) AS model_name, round(min(value), 6) AS value FROM ({LONG}) GROUP BY 1""")
def best_by_metric(d):
    return rounded(rk.best_by_metric(mt.metrics(d.predictions)), ["value"])


def _weights(table: dict) -> str:
    return ", ".join(f"('{k}', {v})" for k, v in table.items())


COMPONENTS = f"""
WITH o AS (SELECT *, abs(bias) AS absolute_bias FROM metrics WHERE fold = 'combined' AND segment_type = 'overall'),
h AS ({' UNION ALL '.join(f"SELECT model_name, horizon, '{m}' AS metric, round({m}::DOUBLE, 9) AS value FROM o" for m in rk.RANKED)}),
f AS (SELECT * FROM metrics WHERE fold <> 'combined' AND segment_type = 'overall' AND horizon = 'days_1_30_daily'),
g AS (SELECT model_name, fold, 'mae' AS metric, round(mae, 9) AS value FROM f UNION ALL SELECT model_name, fold, 'rmsse', round(rmsse, 9) FROM f),
s AS (SELECT model_name, round(stddev_samp(mae), 9) AS value FROM f GROUP BY 1),
c AS (
  SELECT model_name, 'combined:' || h.horizon || ':' || h.metric AS component,
    rank() OVER (PARTITION BY h.horizon, h.metric ORDER BY value) + (count(*) OVER (PARTITION BY h.horizon, h.metric, value) - 1) / 2 AS rank, hw.w * mw.w AS weight
  FROM h JOIN (VALUES {_weights(P.RANK_HORIZON_WEIGHTS)}) AS hw(k, w) ON hw.k = h.horizon JOIN (VALUES {_weights(P.RANK_METRIC_WEIGHTS)}) AS mw(k, w) ON mw.k = h.metric
  UNION ALL SELECT model_name, fold || ':days_1_30_daily:' || metric,
    rank() OVER (PARTITION BY fold, metric ORDER BY value) + (count(*) OVER (PARTITION BY fold, metric, value) - 1) / 2, {P.RANK_FOLD_WEIGHT} FROM g
  UNION ALL SELECT model_name, 'fold_stability:mae_std', rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2, {P.RANK_STABILITY_WEIGHT} FROM s)
"""


@query("win_17_average_rank_components", COMPONENTS + "SELECT model_name, component, round(rank::DOUBLE, 6) AS rank, round(weight::DOUBLE, 6) AS weight FROM c")
def average_rank_components(d):
    return rounded(rk.ranking_components(mt.metrics(d.predictions)), ["rank", "weight"])


RANKING = ["total_weight", "balanced_rank_score", "days_1_30_mae", "days_1_30_rmsse", "fold_mae_mean", "fold_mae_std"]


@query("met_07_weighted_balanced_ranking", COMPONENTS + f"""
, r AS (SELECT model_name, sum(weight) AS total_weight, count(*) AS comparison_components, sum(rank * weight) / sum(weight) AS balanced_rank_score FROM c GROUP BY 1)
SELECT r.model_name, comparison_components, CAST(rank() OVER (ORDER BY round(balanced_rank_score::DOUBLE, 9)) AS INTEGER) AS selection_rank, {sql_round(RANKING)}
FROM r JOIN (SELECT model_name AS m, mae AS days_1_30_mae, rmsse AS days_1_30_rmsse FROM o WHERE horizon = 'days_1_30_daily') ON m = model_name
JOIN (SELECT model_name AS n, avg(mae) AS fold_mae_mean, stddev_samp(mae) AS fold_mae_std FROM f GROUP BY 1) ON n = model_name""")
def weighted_balanced_ranking(d):
    ranking = rk.balanced_ranking(mt.metrics(d.predictions))
    return rounded(ranking.select("model_name", "comparison_components", "selection_rank", *RANKING), RANKING)


COMPARE = [f"{m}_improvement_vs_{b}_pct" for b in ("mean_28", "zero") for m in ("mae", "rmse", "wape", "rmsse")]
COMPARE_SQL = """
WITH k AS (SELECT c.*, """ + ", ".join(f"{b}.{m} AS {b}_{m}" for b in ("mean_28", "zero") for m in ("mae", "rmse", "wape", "rmsse", "bias")) + """
FROM (SELECT * FROM metrics WHERE model_name = 'croston_sba') c
LEFT JOIN (SELECT * FROM metrics WHERE model_name = 'mean_28') mean_28 USING (fold, horizon, horizon_days, evaluation_type, segment_type, segment_value)
LEFT JOIN (SELECT * FROM metrics WHERE model_name = 'zero') zero USING (fold, horizon, horizon_days, evaluation_type, segment_type, segment_value)),
i AS (SELECT *, """ + ", ".join(
    f"100 * ({b}_{m} - {m}) / nullif({b}_{m}, 0) AS {m}_improvement_vs_{b}_pct" for b in ("mean_28", "zero") for m in ("mae", "rmse", "wape", "rmsse")
) + """, 100 * (abs(mean_28_bias) - abs(bias)) / nullif(abs(mean_28_bias), 0) AS absolute_bias_improvement_vs_mean_28_pct FROM k)
"""
BIAS_GAIN = "absolute_bias_improvement_vs_mean_28_pct"


@query("met_08_improvement_vs_benchmarks", COMPARE_SQL + f"""
SELECT fold, horizon, segment_type, segment_value, {sql_round([*COMPARE, BIAS_GAIN], 4)} FROM i""")
def improvement_vs_benchmarks(d):
    compared = mt.compare_to_benchmarks(mt.metrics(d.predictions), "croston_sba")
    return rounded(compared.select("fold", "horizon", "segment_type", "segment_value", *COMPARE, BIAS_GAIN), [*COMPARE, BIAS_GAIN], 4)


BENCH = [f"{b}_{m}" for b in ("mean_28", "zero") for m in ("mae", "rmse", "wape", "rmsse", "bias")]


@query("jn_07_candidate_and_benchmark_rows", COMPARE_SQL + f"""
SELECT fold, horizon, segment_type, segment_value, round(mae, 6) AS mae, {sql_round(BENCH)} FROM i""")
def candidate_and_benchmark_rows(d):
    compared = mt.compare_to_benchmarks(mt.metrics(d.predictions), "croston_sba")
    return rounded(compared.select("fold", "horizon", "segment_type", "segment_value", "mae", *BENCH), ["mae", *BENCH])


@query("scl_15_fold_change_percent", COMPARE_SQL + f"""
SELECT fold, {sql_round([COMPARE[0], COMPARE[4], BIAS_GAIN], 4)} FROM i WHERE horizon = 'days_1_30_daily' AND segment_type = 'overall'""")
def fold_change_percent(d):
    names = [COMPARE[0], COMPARE[4], BIAS_GAIN]
    compared = mt.compare_to_benchmarks(mt.metrics(d.predictions), "croston_sba")
    scope = compared.where((F.col("horizon") == "days_1_30_daily") & (F.col("segment_type") == "overall"))
    return rounded(scope.select("fold", *names), names, 4)


@query("met_09_fold_stability", COMPARE_SQL + """
SELECT model_name, round(min(CASE WHEN fold <> 'combined' THEN mae_improvement_vs_mean_28_pct END), 4) AS improvement_min_pct,
  round(max(CASE WHEN fold <> 'combined' THEN mae_improvement_vs_mean_28_pct END), 4) AS improvement_max_pct,
  bool_and(mae_improvement_vs_mean_28_pct > 0) FILTER (fold <> 'combined') OR bool_and(mae_improvement_vs_mean_28_pct < 0) FILTER (fold <> 'combined') AS direction_consistent,
  """ + " + ".join(f"CAST(max(CASE WHEN fold = 'combined' THEN CAST({m}_improvement_vs_mean_28_pct > 0 AS INTEGER) END) AS INTEGER)" for m in ("mae", "rmse", "wape", "rmsse")) + """ AS metric_wins_of_four
FROM i WHERE horizon = 'days_1_30_daily' AND segment_type = 'overall' GROUP BY 1""")
def fold_stability(d):
    compared = mt.compare_to_benchmarks(mt.metrics(d.predictions), "croston_sba")
    return rounded(mt.fold_stability(compared), ["improvement_min_pct", "improvement_max_pct"], 4)


@query("met_10_zero_baseline_gap", f"""
WITH p AS ({PRIMARY}), b AS (SELECT arg_min(model_name, (round(mae, 9), model_name)) AS best_model, min(mae) AS best_mae FROM p WHERE model_name <> 'zero')
SELECT round(p.mae, 6) AS zero_mae, best_model, round(best_mae, 6) AS best_mae, round(100 * (p.mae - best_mae) / p.mae, 6) AS improvement_pct
FROM p, b WHERE p.model_name = 'zero'""")
def zero_baseline_gap(d):
    return rounded(rk.zero_gap(mt.metrics(d.predictions)), ["zero_mae", "best_mae", "improvement_pct"])


@query("met_11_croston_by_class", """
WITH m AS (SELECT *, rank() OVER (PARTITION BY segment_value ORDER BY round(mae, 9)) AS mae_rank FROM metrics
  WHERE fold = 'combined' AND horizon = 'days_1_30_daily' AND segment_type = 'intermittency_class')
SELECT c.segment_value AS intermittency_class, round(c.mae, 6) AS mae, round(c.wape, 6) AS wape, round(c.rmsse, 6) AS rmsse,
  CAST(c.mae_rank AS INTEGER) AS mae_rank, best_model, round(best_mae, 6) AS best_mae
FROM m c JOIN (SELECT segment_value, arg_min(model_name, (round(mae, 9), model_name)) AS best_model, min(mae) AS best_mae FROM m GROUP BY 1) b USING (segment_value)
WHERE c.model_name = 'croston_sba'""")
def croston_by_class(d):
    return rounded(rk.model_by_class(mt.metrics(d.predictions)), ["mae", "wape", "rmsse", "best_mae"])


@query("met_12_class_counts_by_fold", "SELECT fold, intermittency_class, count(*) AS series FROM origins GROUP BY 1, 2")
def class_counts_by_fold(d):
    keys = d.predictions.select("fold", *SERIES, "intermittency_class").distinct()
    return keys.groupBy("fold", "intermittency_class").agg(F.count(F.lit(1)).alias("series"))


@query("met_13_prediction_reconciliation", """
SELECT DISTINCT fold, model_name, true AS metrics_match, true AS rows_match FROM predictions""")
def prediction_reconciliation(d):
    return mt.reconcile(d.predictions, mt.metrics(d.predictions), 1e-9)


TEST_SQL = """
WITH h AS (SELECT store_id, item_id, date, sales, row_number() OVER (PARTITION BY store_id, item_id ORDER BY date DESC) AS back,
    sales - lag(sales) OVER (PARTITION BY store_id, item_id ORDER BY date) AS diff FROM active WHERE date < DATE '2001-07-01'),
o AS (SELECT store_id, item_id, avg(diff * diff) AS scale, avg(CASE WHEN back <= 28 THEN sales END) AS mean_28, max(CASE WHEN back = 1 THEN sales END) AS last_value FROM h GROUP BY 1, 2),
t AS (SELECT m.model_name, a.store_id, a.item_id, a.sales, m.forecast, scale FROM active a JOIN o USING (store_id, item_id)
  CROSS JOIN LATERAL (VALUES ('mean_28', mean_28::DOUBLE), ('last_value', last_value::DOUBLE)) AS m(model_name, forecast)
  WHERE a.date BETWEEN DATE '2001-07-01' AND DATE '2001-07-30'),
e AS (SELECT model_name, avg(abs(forecast - sales)) AS mae, sqrt(avg(pow(forecast - sales, 2))) AS rmse, sum(abs(forecast - sales)) / sum(sales) AS wape FROM t GROUP BY 1),
s AS (SELECT model_name, avg(r) AS rmsse FROM (SELECT model_name, sqrt(avg(pow(forecast - sales, 2)) / max(scale)) AS r FROM t GROUP BY model_name, store_id, item_id) GROUP BY 1)
"""
DRIFT = [f"{n}_drift_pct" for n in ("mae", "rmse", "wape", "rmsse")]


@query("met_15_validation_to_test_drift", TEST_SQL + """
SELECT e.model_name, """ + ", ".join(f"round(100 * ({x}.{n} / v.{n} - 1), 4) AS {n}_drift_pct" for n, x in (("mae", "e"), ("rmse", "e"), ("wape", "e"), ("rmsse", "s"))) + """,
  round(e.mae, 6) AS test_mae FROM e JOIN s USING (model_name) JOIN metrics v ON v.model_name = e.model_name AND v.fold = 'combined' AND v.horizon = 'days_1_30_daily' AND v.segment_type = 'overall'""")
def validation_to_test_drift(d):
    active = d.active.join(d.series_bands, SERIES)
    test = mt.metrics(fc.fold_predictions(active, locked=True, models=["mean_28", "last_value"]))
    drift = mt.split_drift(mt.metrics(d.predictions), test)
    return rounded(rounded(drift.select("model_name", *DRIFT, "test_mae"), DRIFT, 4), ["test_mae"])


@query("met_16_one_time_test_evaluation", TEST_SQL + """
SELECT 'validation' AS split, model_name, round(mae, 6) AS mae FROM metrics WHERE fold = 'combined' AND horizon = 'days_1_30_daily' AND segment_type = 'overall'
UNION ALL SELECT 'test', model_name, round(mae, 6) FROM e WHERE model_name = 'mean_28'""")
def one_time_test_evaluation(d):
    active = d.active.join(d.series_bands, SERIES)
    stored = mt.metric_slice(mt.metrics(d.predictions), "days_1_30_daily").select(F.lit("validation").alias("split"), "model_name", "mae")
    test = mt.metrics(fc.fold_predictions(active, locked=True, models=["mean_28"]))
    new = mt.metric_slice(test, "days_1_30_daily").select(F.lit("test").alias("split"), "model_name", "mae")
    return rounded(mt.append_once(stored, new, ["split", "model_name"]), ["mae"])


@query("met_17_negligible_change_and_fold_wins", f"""
WITH p AS (SELECT fold, max(CASE WHEN model_name = 'croston_sba' THEN mae END) AS c, max(CASE WHEN model_name = 'mean_28' THEN mae END) AS b
  FROM metrics WHERE horizon = 'days_1_30_daily' AND segment_type = 'overall' GROUP BY 1)
SELECT count(*) FILTER (fold <> 'combined' AND c < b) AS fold_wins, count(*) FILTER (fold <> 'combined') AS folds,
  round(max(CASE WHEN fold = 'combined' THEN 100 * (b - c) / b END), 4) AS combined_improvement_pct,
  bool_or(fold = 'combined' AND abs(100 * (b - c) / b) < 0.5) AS is_negligible FROM p""")
def negligible_change_and_fold_wins(d):
    return rounded(rk.fold_wins(mt.metrics(d.predictions), "croston_sba", "mean_28"), ["combined_improvement_pct"], 4)


@query("jn_18_model_vs_model_by_fold", """
SELECT a.fold, round(a.mae, 6) AS mean_28_mae, round(b.mae, 6) AS seasonal_mae, a.mae < b.mae AS mean_28_wins
FROM metrics a JOIN metrics b USING (fold, horizon, segment_type) WHERE a.model_name = 'mean_28' AND b.model_name = 'seasonal_naive_7'
  AND horizon = 'days_1_30_daily' AND segment_type = 'overall' AND fold <> 'combined'""")
def model_vs_model_by_fold(d):
    folds = mt.primary_folds(mt.metrics(d.predictions))
    a = folds.where(F.col("model_name") == "mean_28").select("fold", F.col("mae").alias("mean_28_mae"))
    b = folds.where(F.col("model_name") == "seasonal_naive_7").select("fold", F.col("mae").alias("seasonal_mae"))
    joined = a.join(b, "fold").withColumn("mean_28_wins", F.col("mean_28_mae") < F.col("seasonal_mae"))
    return rounded(joined, ["mean_28_mae", "seasonal_mae"])


@query("set_01_union_of_model_predictions", """
SELECT model_name, fold, count(*) AS n_rows, round(sum(forecast), 4) AS forecast_units FROM predictions WHERE model_name IN ('mean_28', 'zero', 'last_value') GROUP BY 1, 2""")
def union_of_model_predictions(d):
    parts = [d.predictions.where(F.col("model_name") == m) for m in ("mean_28", "zero", "last_value")]
    stacked = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rounded(stacked.groupBy("model_name", "fold").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("forecast").alias("forecast_units")
    ), ["forecast_units"], 4)


@query("srt_06_representative_series", """
WITH e AS (SELECT store_id, item_id, avg(abs(forecast - actual)) AS mae FROM predictions WHERE model_name = 'mean_28' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (ORDER BY round(mae, 9), store_id, item_id) AS rn, count(*) OVER () AS n FROM e)
SELECT store_id, item_id, round(mae, 6) AS mae FROM r WHERE rn = n // 2 + 1""")
def representative_series(d):
    """The series in the middle of the error order, by an exact rank selection without a global window."""
    errors = d.predictions.where(F.col("model_name") == "mean_28").groupBy(*SERIES).agg(
        F.round(F.avg(F.abs(F.col("forecast") - F.col("actual"))), 9).alias("mae")
    )
    return rounded(fc.middle_row(errors, "mae", SERIES), ["mae"])


@query("dq_07_forecast_origin_audit", """
SELECT fold, model_name, count(*) = 30 * count(DISTINCT store_id || item_id) AS expected_rows, bool_and(target_date > forecast_origin) AS targets_after_origin,
  bool_and(horizon_day BETWEEN 1 AND 30) AS targets_in_window, bool_and(forecast >= 0) AS non_negative, bool_and(history_end_date = forecast_origin) AS history_ends_at_origin,
  bool_and(target_date < DATE '2001-07-01') AS no_locked_targets FROM predictions GROUP BY 1, 2""")
def forecast_origin_audit(d):
    start, _ = P.LOCKED[1], P.LOCKED[2]
    return d.predictions.groupBy("fold", "model_name").agg(
        (F.count(F.lit(1)) == 30 * F.count_distinct(*SERIES)).alias("expected_rows"),
        F.bool_and(F.col("target_date") > F.col("forecast_origin")).alias("targets_after_origin"),
        F.bool_and(F.col("horizon_day").between(1, 30)).alias("targets_in_window"),
        F.bool_and((F.col("forecast") >= 0) & ~F.isnan("forecast")).alias("non_negative"),
        F.bool_and(F.col("history_end_date") == F.col("forecast_origin")).alias("history_ends_at_origin"),
        F.bool_and(F.col("target_date") < F.lit(start).cast("date")).alias("no_locked_targets"),
    )
