"""Exploratory tables over the flagged panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandloom.catalog.q_features import rounded, sql_round
from demandloom.catalog.registry import query
from demandloom.functions.columns import count_if, percent
from demandloom.operators import explore as ex
from demandloom.operators import features as ft
from demandloom.operators import reshape
from demandloom.operators.forecast import last_values, deployment_forecast
from demandloom.sources.parameters import SERIES


def active_flagged(d):
    return d.flagged.where("active_flag")


L = """l AS (SELECT store_id, item_id, min(dept_id) AS dept_id, min(demand_band) AS demand_band, min(date) AS history_start, min(first_price) AS first_known_price_date, min(first_sale) AS first_positive_sale_date,
  min(launch_date) AS launch_date, count(*) FILTER (prelaunch_flag) AS prelaunch_rows, count(*) AS total_rows, date_diff('day', min(date), min(launch_date)) AS prelaunch_days,
  date_diff('day', min(first_price), min(first_sale)) AS price_to_first_sale_lag_days FROM flagged GROUP BY 1, 2)"""


@query("agg_18_prelaunch_series_summary", f"WITH {L} SELECT * FROM l")
def prelaunch_series_summary(d):
    rows = ex.launch_summary(d.flagged)
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("prelaunch_days", "price_to_first_sale_lag_days")})


P4 = {"median": 0.5, "p75": 0.75, "p90": 0.9}


@query("agg_19_prelaunch_distribution", f"WITH {L} " + " UNION ALL ".join(
    f"SELECT '{c}' AS measure, min({c}) AS minimum, round(avg({c}), 6) AS mean, max({c}) AS maximum, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS median, round(quantile_cont({c}::DOUBLE, 0.75), 6) AS p75, round(quantile_cont({c}::DOUBLE, 0.9), 6) AS p90 FROM l"
    for c in ("prelaunch_days", "price_to_first_sale_lag_days")))
def prelaunch_distribution(d):
    rows = ex.launch_summary(d.flagged)
    both = [ex.distribution(rows, c, P4, small_domain=True) for c in ("prelaunch_days", "price_to_first_sale_lag_days")]
    return rounded(both[0].unionByName(both[1]), ["mean", *P4]).withColumns({c: F.col(c).cast("bigint") for c in ("minimum", "maximum")})


P8 = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999, "p9999": 0.9999}


@query("agg_20_demand_description", """
SELECT count(*) AS observations, round(avg(sales), 6) AS mean, round(stddev_samp(sales), 6) AS standard_deviation, min(sales) AS minimum, max(sales) AS maximum, round(skewness(sales), 6) AS skewness,
  round(100.0 * count(*) FILTER (sales = 0) / count(*), 6) AS zero_pct, count(*) FILTER (sales > (SELECT quantile_cont(sales::DOUBLE, 0.999) FROM flagged WHERE active_flag)) AS rows_above_p999, """ + ", ".join(
    f"round(quantile_cont(sales::DOUBLE, {p}), 6) AS {n}" for n, p in P8.items()) + " FROM flagged WHERE active_flag")
def demand_description(d):
    return rounded(ex.describe(d.active, "sales", P8), ["mean", "standard_deviation", "skewness", "zero_pct", *P8])


M = """m AS (SELECT store_id, item_id, min(dept_id) AS dept_id, min(demand_band) AS demand_band, count(*) AS active_days, CAST(sum(sales) AS BIGINT) AS total_sales, avg(sales) AS mean_sales, quantile_cont(sales::DOUBLE, 0.5) AS median_sales,
  stddev_samp(sales) AS std_sales, count(*) FILTER (sales = 0) AS zero_days, count(*) FILTER (sales > 0) AS positive_days, 100.0 * count(*) FILTER (sales = 0) / count(*) AS active_zero_pct,
  stddev_samp(sales) / nullif(avg(sales), 0) AS coefficient_of_variation, count(*) / nullif(count(*) FILTER (sales > 0), 0) AS average_demand_interval FROM flagged WHERE active_flag GROUP BY 1, 2),
g AS (SELECT store_id, item_id, avg(gap) AS mean_positive_gap_days FROM (SELECT store_id, item_id, date_diff('day', lag(date) OVER (PARTITION BY store_id, item_id ORDER BY date), date) AS gap FROM flagged WHERE active_flag AND sales > 0) GROUP BY 1, 2),
r AS (SELECT m.*, mean_positive_gap_days, CASE WHEN active_zero_pct <= 50 THEN 'regular (<50% zero)' WHEN active_zero_pct <= 80 THEN 'intermittent (50-80% zero)' ELSE 'highly intermittent (>80% zero)' END AS intermittency_class
  FROM m LEFT JOIN g USING (store_id, item_id))"""
R = ["mean_sales", "median_sales", "std_sales", "active_zero_pct", "coefficient_of_variation", "average_demand_interval", "mean_positive_gap_days"]


@query("agg_21_series_intermittency_metrics", f"""
WITH {M} SELECT store_id, item_id, dept_id, demand_band, active_days, total_sales, zero_days, positive_days, intermittency_class, {sql_round(R)} FROM r""")
def series_intermittency_metrics(d):
    return rounded(ex.series_demand(active_flagged(d)), R)


@query("agg_22_mean_positive_gap", f"WITH {M} SELECT store_id, item_id, round(mean_positive_gap_days, 6) AS mean_positive_gap_days FROM g")
def mean_positive_gap(d):
    return rounded(ex.series_demand(active_flagged(d)).select(*SERIES, "mean_positive_gap_days"), ["mean_positive_gap_days"])


@query("scl_10_zero_share_bins", f"WITH {M} SELECT intermittency_class, count(*) AS series, round(min(active_zero_pct), 6) AS lowest, round(max(active_zero_pct), 6) AS highest FROM r GROUP BY 1")
def zero_share_bins(d):
    rows = ex.series_demand(active_flagged(d)).groupBy("intermittency_class").agg(
        F.count(F.lit(1)).alias("series"), F.min("active_zero_pct").alias("lowest"), F.max("active_zero_pct").alias("highest"))
    return rounded(rows, ["lowest", "highest"])


G = ["mean_sales", "standard_deviation", "zero_pct", "active_mean_sales", "active_zero_pct", "sales_share_pct", "median_sales", "median_series_adi"]


@query("agg_23_group_demand_comparison", f"WITH {M} " + " UNION ALL ".join(f"""
SELECT '{c}' AS dimension, f.{c} AS value, count(*) AS n_rows, CAST(sum(sales) AS BIGINT) AS total_sales, round(avg(sales), 6) AS mean_sales, round(stddev_samp(sales), 6) AS standard_deviation, round(100.0 * count(*) FILTER (sales = 0) / count(*), 6) AS zero_pct,
  count(*) FILTER (active_flag) AS active_rows, round(avg(sales) FILTER (active_flag), 6) AS active_mean_sales, round(100.0 * count(*) FILTER (active_flag AND sales = 0) / count(*) FILTER (active_flag), 6) AS active_zero_pct,
  count(DISTINCT item_id) AS products, round(100.0 * sum(sales) / (SELECT sum(sales) FROM flagged), 6) AS sales_share_pct, round(quantile_cont(sales::DOUBLE, 0.5), 6) AS median_sales, round(min(k.a), 6) AS median_series_adi
FROM flagged f JOIN (SELECT {c} AS v, quantile_cont(average_demand_interval, 0.5) AS a FROM r GROUP BY 1) k ON k.v = f.{c} GROUP BY f.{c}""" for c in ("demand_band", "dept_id", "store_id")))
def group_demand_comparison(d):
    flagged = d.flagged
    series = ex.series_demand(active_flagged(d))
    parts = [ex.group_demand(flagged, series, c).select(F.lit(c).alias("dimension"), F.col(c).alias("value"), "n_rows", "total_sales", "active_rows", "products", *G)
             for c in ("demand_band", "dept_id", "store_id")]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), G)


@query("agg_24_store_department_mix", """
SELECT store_id, dept_id, units, round(100.0 * units / sum(units) OVER (PARTITION BY store_id), 6) AS share_pct FROM (SELECT store_id, dept_id, CAST(sum(sales) AS BIGINT) AS units FROM panel GROUP BY 1, 2)""")
def store_department_mix(d):
    from pyspark.sql import Window as W

    units = d.panel.groupBy("store_id", "dept_id").agg(F.sum("sales").alias("units"))
    return rounded(units.withColumn("share_pct", percent(F.col("units"), F.sum("units").over(W.partitionBy("store_id")))), ["share_pct"])


@query("agg_25_daily_totals", """
SELECT date, store_id, CAST(sum(sales) AS BIGINT) AS sales FROM panel GROUP BY GROUPING SETS ((date, store_id), (date))""")
def daily_totals(d):
    return ex.daily_totals(d.panel)


WEEK = "date + CAST((7 - isodow(date)) AS INTEGER)"


@query("agg_26_weekly_totals", f"SELECT store_id, {WEEK} AS week_end, CAST(sum(sales) AS BIGINT) AS weekly_sales FROM panel GROUP BY 1, 2")
def weekly_totals(d):
    return ex.weekly_totals(d.panel)


NORM = f"""w AS (SELECT store_id, {WEEK} AS week_end, sum(sales)::DOUBLE AS weekly_sales FROM panel GROUP BY 1, 2),
n AS (SELECT w.store_id, week_end, weekly_sales, weekly_sales / med AS normalized_weekly_sales FROM w JOIN (SELECT store_id, quantile_cont(weekly_sales, 0.5) AS med FROM w GROUP BY 1) k ON k.store_id = w.store_id)"""


@query("win_12_normalised_by_store_median", f"WITH {NORM} SELECT store_id, week_end, round(normalized_weekly_sales, 6) AS normalized_weekly_sales FROM n")
def normalised_by_store_median(d):
    return rounded(ex.normalised_weeks(ex.weekly_totals(d.panel)).select("store_id", "week_end", "normalized_weekly_sales"), ["normalized_weekly_sales"])


@query("win_13_centred_13_week_mean", f"""
WITH {NORM} SELECT store_id, week_end, round(avg(normalized_weekly_sales) OVER (PARTITION BY store_id ORDER BY week_end ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING), 6) AS normalized_13_week_mean FROM n""")
def centred_13_week_mean(d):
    return rounded(ex.normalised_weeks(ex.weekly_totals(d.panel)).select("store_id", "week_end", "normalized_13_week_mean"), ["normalized_13_week_mean"])


@query("agg_27_monthly_totals", "SELECT store_id, CAST(date_trunc('month', date) AS DATE) AS month_start, CAST(sum(sales) AS BIGINT) AS monthly_sales FROM panel GROUP BY 1, 2")
def monthly_totals(d):
    return ex.monthly_totals(d.panel, "store_id")


MT = """t AS (SELECT month_start, monthly_sales, row_number() OVER (ORDER BY month_start) - 1 AS i FROM (SELECT CAST(date_trunc('month', date) AS DATE) AS month_start, sum(sales)::DOUBLE AS monthly_sales FROM panel GROUP BY 1)),
f AS (SELECT regr_slope(monthly_sales, i) AS slope, regr_intercept(monthly_sales, i) AS intercept FROM t)"""


@query("ml_02_linear_monthly_trend", f"WITH {MT} SELECT month_start, round(intercept + slope * i, 4) AS linear_trend, round(slope, 4) AS slope FROM t, f")
def linear_monthly_trend(d):
    return rounded(ex.monthly_trend(ex.monthly_totals(d.panel)).select("month_start", "linear_trend", "slope"), ["linear_trend", "slope"], 4)


@query("win_14_centred_12_month_mean", f"""
WITH {MT} SELECT month_start, round(CASE WHEN count(*) OVER x >= 6 THEN avg(monthly_sales) OVER x END, 4) AS twelve_month_mean FROM t WINDOW x AS (ORDER BY month_start ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)""")
def centred_12_month_mean(d):
    return rounded(ex.monthly_trend(ex.monthly_totals(d.panel)).select("month_start", "twelve_month_mean"), ["twelve_month_mean"], 4)


@query("agg_28_yearly_totals", """
SELECT year, CAST(sum(sales) AS BIGINT) AS total_sales, round(avg(sales), 6) AS mean_observation, count(DISTINCT date) AS observed_days, round(sum(sales) / count(DISTINCT date), 6) AS average_daily_total FROM panel GROUP BY 1""")
def yearly_totals(d):
    rows = d.panel.groupBy("year").agg(F.sum("sales").alias("total_sales"), F.avg("sales").alias("mean_observation"), F.count_distinct("date").alias("observed_days"),
                                       (F.sum("sales") / F.count_distinct("date")).alias("average_daily_total"))
    return rounded(rows, ["mean_observation", "average_daily_total"])


CMP = ["mean_sales", "median_sales", "zero_pct"]
CMP_SQL = "count(*) AS observations, CAST(sum(sales) AS BIGINT) AS total_sales, round(avg(sales), 6) AS mean_sales, round(quantile_cont(sales::DOUBLE, 0.5), 6) AS median_sales, round(100.0 * count(*) FILTER (sales = 0) / count(*), 6) AS zero_pct"


@query("agg_29_weekday_profile", f"SELECT weekday, {CMP_SQL} FROM flagged WHERE active_flag GROUP BY 1")
def weekday_profile(d):
    return rounded(ex.comparison(d.active, "weekday"), CMP)


@query("agg_29_store_weekday_means", "SELECT store_id, weekday, round(avg(sales), 6) AS mean_sales FROM flagged WHERE active_flag GROUP BY 1, 2 ORDER BY 1, 2")
def store_weekday_means(d):
    rows = d.active.groupBy("store_id", "weekday").agg(F.avg("sales").alias("mean_sales"), F.min(F.weekday("date")).alias("_w")).orderBy("store_id", "_w")
    return rounded(rows.drop("_w"), ["mean_sales"])


@query("agg_30_month_seasonality", """
SELECT store_id, month, round(avg(s), 6) AS average_daily_sales FROM (SELECT date, store_id, month(date) AS month, sum(sales) AS s FROM panel GROUP BY GROUPING SETS ((date, store_id), (date))) GROUP BY 1, 2""")
def month_seasonality(d):
    return rounded(ex.daily_totals(d.panel).groupBy("store_id", F.month("date").cast("bigint").alias("month")).agg(F.avg("sales").alias("average_daily_sales")), ["average_daily_sales"])


@query("agg_31_event_comparison", f"SELECT event_name_1 IS NOT NULL OR event_name_2 IS NOT NULL AS event_day, {CMP_SQL} FROM flagged WHERE active_flag GROUP BY 1")
def event_comparison(d):
    return rounded(ex.comparison(d.active.withColumn("event_day", ft.has_event()), "event_day"), CMP)


@query("agg_31_event_mean_difference", """
SELECT round(100 * (avg(sales) FILTER (event_name_1 IS NOT NULL) / avg(sales) FILTER (event_name_1 IS NULL) - 1), 6) AS difference_pct FROM flagged WHERE active_flag""")
def event_mean_difference(d):
    pairs = ex.comparison(d.active.withColumn("event_day", ft.has_event().cast("int")).withColumn("scope", F.lit("all")), "scope", "event_day")
    return rounded(ex.uplift(pairs, "scope", "event_day").drop("scope"), ["difference_pct"])


ET = """t AS (SELECT c.date, event_type, sum(sales) AS s FROM (SELECT date, event_type_1 AS event_type FROM calendar WHERE event_type_1 IS NOT NULL UNION ALL SELECT date, event_type_2 FROM calendar WHERE event_type_2 IS NOT NULL) c
  JOIN flagged f ON f.date = c.date AND active_flag GROUP BY 1, 2)"""


@query("agg_32_event_type_summary", f"WITH {ET} SELECT event_type, count(DISTINCT date) AS event_occurrences, round(avg(s), 6) AS mean_daily_sales, round(quantile_cont(s::DOUBLE, 0.5), 6) AS median_daily_sales FROM t GROUP BY 1")
def event_type_summary(d):
    return rounded(ex.event_types(d.active, d.calendar), ["mean_daily_sales", "median_daily_sales"])


@query("jn_09_daily_totals_with_events", """
SELECT date, CAST(sum(sales) AS BIGINT) AS daily_sales, min(event_name_1) AS event_name_1, min(event_type_2) AS event_type_2 FROM flagged WHERE active_flag GROUP BY 1""")
def daily_totals_with_events(d):
    daily = d.active.groupBy("date").agg(F.sum("sales").alias("daily_sales"))
    return daily.join(F.broadcast(d.calendar.select("date", "event_name_1", "event_type_2")), "date", "left")


SNAP = "CASE state_id WHEN 'EMEA' THEN snap_emea WHEN 'AMER' THEN snap_amer WHEN 'APAC' THEN snap_apac END"


@query("agg_33_benefit_day_comparison", f"SELECT store_id, {SNAP} AS snap_active, {CMP_SQL} FROM flagged WHERE active_flag GROUP BY 1, 2")
def benefit_day_comparison(d):
    return rounded(ex.comparison(d.active.withColumn("snap_active", ft.store_snap()), "store_id", "snap_active"), CMP)


@query("agg_33_benefit_day_uplift", f"""
SELECT store_id, round(100 * (avg(sales) FILTER ({SNAP} = 1) / avg(sales) FILTER ({SNAP} = 0) - 1), 6) AS difference_pct FROM flagged WHERE active_flag GROUP BY 1""")
def benefit_day_uplift(d):
    pairs = ex.comparison(d.active.withColumn("snap_active", ft.store_snap()), "store_id", "snap_active")
    return rounded(ex.uplift(pairs, "store_id", "snap_active"), ["difference_pct"])


K = """k AS (SELECT store_id, item_id, dept_id, week_start, min(sell_price) AS sell_price FROM flagged WHERE active_flag AND sell_price IS NOT NULL GROUP BY 1, 2, 3, 4),
v AS (SELECT *, sell_price - previous_price AS price_change, 100 * (sell_price - previous_price) / previous_price AS price_change_pct,
  CASE WHEN previous_price IS NULL THEN 'first observation' WHEN sell_price - previous_price < -1e-7 THEN 'decrease' WHEN sell_price - previous_price > 1e-7 THEN 'increase' ELSE 'unchanged' END AS change_direction
  FROM (SELECT *, lag(sell_price) OVER (PARTITION BY store_id, item_id ORDER BY week_start) AS previous_price FROM k)),
u AS (SELECT v.*, weekly_sales FROM v LEFT JOIN (SELECT store_id, item_id, week_start, sum(sales) AS weekly_sales FROM flagged WHERE active_flag GROUP BY 1, 2, 3) USING (store_id, item_id, week_start))"""


@query("win_10_price_change_direction", f"""
WITH {K} SELECT store_id, item_id, week_start, sell_price, previous_price, round(price_change, 6) AS price_change, round(price_change_pct, 6) AS price_change_pct, change_direction FROM v""")
def price_change_direction(d):
    return rounded(ex.weekly_price_moves(d.active).drop("dept_id"), ["price_change", "price_change_pct"])


PR = {"p01": 0.01, "p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}


@query("agg_34_weekly_price_statistics", f"WITH {K} SELECT 'sell_price' AS measure, min(sell_price) AS minimum, round(avg(sell_price), 6) AS mean, max(sell_price) AS maximum, " + ", ".join(
    f"round(quantile_cont(sell_price, {p}), 6) AS {n}" for n, p in PR.items()) + " FROM k")
def weekly_price_statistics(d):
    return rounded(ex.distribution(ex.weekly_price_moves(d.active), "sell_price", PR), ["mean", *PR])


@query("agg_34_price_by_department", f"WITH {K} SELECT dept_id, count(*) AS observations, round(avg(sell_price), 6) AS mean, round(quantile_cont(sell_price, 0.5), 6) AS median, min(sell_price) AS minimum, max(sell_price) AS maximum FROM k GROUP BY 1")
def price_by_department(d):
    moves = ex.weekly_price_moves(d.active)
    from demandloom.functions.quantiles import quantiles

    rows = moves.groupBy("dept_id").agg(F.count(F.lit(1)).alias("observations"), F.avg("sell_price").alias("mean"), F.min("sell_price").alias("minimum"), F.max("sell_price").alias("maximum"))
    return rounded(rows.join(quantiles(moves, "sell_price", {"median": 0.5}, ["dept_id"]), "dept_id"), ["mean", "median"])


@query("agg_35_price_change_series_stats", f"""
WITH {K} SELECT store_id, item_id, min(dept_id) AS dept_id, count(*) AS priced_weeks, count(DISTINCT sell_price) AS distinct_prices, count(*) FILTER (change_direction IN ('increase', 'decrease')) AS price_changes,
  round(avg(abs(price_change_pct)), 6) AS mean_absolute_change_pct FROM v GROUP BY 1, 2""")
def price_change_series_stats(d):
    return rounded(ex.price_series(ex.weekly_price_moves(d.active)), ["mean_absolute_change_pct"])


@query("agg_36_demand_by_price_direction", f"""
WITH {K} SELECT change_direction, count(*) AS weeks, round(avg(weekly_sales), 6) AS mean_weekly_sales, round(quantile_cont(weekly_sales::DOUBLE, 0.5), 6) AS median_weekly_sales, round(avg(price_change_pct), 6) AS mean_price_change_pct
FROM u WHERE change_direction <> 'first observation' GROUP BY 1""")
def demand_by_price_direction(d):
    from demandloom.functions.quantiles import quantiles

    joined = ex.price_with_demand(ex.weekly_price_moves(d.active), d.active).where("change_direction <> 'first observation'")
    rows = joined.groupBy("change_direction").agg(F.count(F.lit(1)).alias("weeks"), F.avg("weekly_sales").alias("mean_weekly_sales"), F.avg("price_change_pct").alias("mean_price_change_pct"))
    medians = quantiles(joined, "weekly_sales", {"median_weekly_sales": 0.5}, ["change_direction"])
    return rounded(rows.join(medians, "change_direction"), ["mean_weekly_sales", "median_weekly_sales", "mean_price_change_pct"])


@query("jn_10_weekly_price_with_units", f"WITH {K} SELECT store_id, item_id, week_start, sell_price, CAST(weekly_sales AS BIGINT) AS weekly_sales FROM u")
def weekly_price_with_units(d):
    return ex.price_with_demand(ex.weekly_price_moves(d.active), d.active).select(*SERIES, "week_start", "sell_price", "weekly_sales")


CORR = f"""{K}, c AS (SELECT store_id, item_id, corr(sell_price, weekly_sales::DOUBLE) AS correlation FROM u GROUP BY 1, 2 HAVING count(*) >= 20 AND count(DISTINCT sell_price) >= 2)"""


@query("agg_37_price_demand_correlation", f"WITH {CORR} SELECT store_id, item_id, round(correlation, 6) AS correlation FROM c")
def price_demand_correlation(d):
    joined = ex.price_with_demand(ex.weekly_price_moves(d.active), d.active)
    return rounded(ex.price_demand_correlation(joined), ["correlation"])


@query("agg_37_correlation_distribution", f"""
WITH {CORR} SELECT 'correlation' AS measure, round(min(correlation), 6) AS minimum, round(avg(correlation), 6) AS mean, round(max(correlation), 6) AS maximum,
  round(quantile_cont(correlation, 0.25), 6) AS p25, round(quantile_cont(correlation, 0.5), 6) AS median, round(quantile_cont(correlation, 0.75), 6) AS p75 FROM c""")
def correlation_distribution(d):
    joined = ex.price_with_demand(ex.weekly_price_moves(d.active), d.active)
    probabilities = {"p25": 0.25, "median": 0.5, "p75": 0.75}
    return rounded(ex.distribution(ex.price_demand_correlation(joined), "correlation", probabilities), ["minimum", "mean", "maximum", *probabilities])


@query("agg_38_intermittency_class_counts", f"WITH {M} SELECT intermittency_class, count(*) AS series FROM r GROUP BY 1")
def intermittency_class_counts(d):
    return ex.series_demand(active_flagged(d)).groupBy("intermittency_class").agg(F.count(F.lit(1)).alias("series"))


@query("srt_02_most_intermittent_series", f"""
WITH {M} SELECT store_id, item_id, active_days, round(active_zero_pct, 6) AS active_zero_pct FROM r ORDER BY round(active_zero_pct, 6) DESC, store_id, item_id LIMIT 10""")
def most_intermittent_series(d):
    rows = rounded(ex.series_demand(active_flagged(d)).select(*SERIES, "active_days", "active_zero_pct"), ["active_zero_pct"])
    return rows.orderBy(F.desc("active_zero_pct"), *SERIES).limit(10)


@query("agg_39_outlier_summary", """
WITH a AS (SELECT * FROM flagged WHERE active_flag), q AS (SELECT quantile_cont(sales::DOUBLE, 0.99) AS p99, quantile_cont(sales::DOUBLE, 0.999) AS p999, quantile_cont(sales::DOUBLE, 0.9999) AS p9999 FROM a)
SELECT max(sales) AS maximum, count(*) FILTER (sales > p999) AS rows_above_p999, round(100.0 * count(*) FILTER (sales > p999) / count(*), 6) AS rows_above_p999_pct,
  count(*) FILTER (sales > p999 AND (event_name_1 IS NOT NULL OR event_name_2 IS NOT NULL)) AS extreme_rows_on_event_days, round(min(p99), 6) AS p99, round(min(p999), 6) AS p999, round(min(p9999), 6) AS p9999 FROM a, q""")
def outlier_summary(d):
    return rounded(ex.outliers(d.active), ["rows_above_p999_pct", "p99", "p999", "p9999"])


@query("agg_40_product_launches", f"""
WITH {L} SELECT item_id, min(dept_id) AS dept_id, min(demand_band) AS demand_band, min(first_known_price_date) AS earliest_price, max(first_known_price_date) AS latest_price, min(first_positive_sale_date) AS earliest_sale,
  max(first_positive_sale_date) AS latest_sale, max(prelaunch_days) AS maximum_prelaunch_days, year(min(first_known_price_date)) AS launch_year FROM l GROUP BY 1""")
def product_launches(d):
    rows = ex.product_launches(ex.launch_summary(d.flagged))
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("maximum_prelaunch_days", "launch_year")})


@query("rsh_05_actual_and_forecast_timeline", """
SELECT store_id, item_id, date, 'actual' AS measure, sales::DOUBLE AS units FROM active
UNION ALL SELECT store_id, item_id, target_date, 'forecast', round(forecast, 6) FROM deployed""")
def actual_and_forecast_timeline(d):
    return rounded(reshape.timeline(d.active, d.deployed, SERIES), ["units"])
