"""Source profiles, price coverage, eligibility, bands and quota sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandloom.catalog.q_features import rounded, sql_round
from demandloom.catalog.registry import query
from demandloom.functions.columns import count_if, percent
from demandloom.functions.quantiles import quantiles
from demandloom.operators import features as ft
from demandloom.operators import profile as pf
from demandloom.sources import parameters as P
from demandloom.sources import retail
from demandloom.sources.parameters import SERIES
from demandloom.sources.tables import relevant_prices

E = pf.ELIGIBILITY


def item_series(d):
    return pf.series_profile(d.item_facts, d.bounds, "dept_id")


def item_prices(d):
    """Weekly item prices; items keep their department. Hardly two sales share a week, so they are dealt before the sums."""
    priced = retail.dealt(d.item_facts, d.item_days, *SERIES).groupBy(*SERIES, "dept_id", F.date_trunc("week", "date").cast("date").alias("week_start"))
    return priced.agg(F.sum("sales").alias("u"), F.sum("cents").alias("c")).where("u > 0").select(
        *SERIES, "dept_id", "week_start", retail.unit_price(F.col("c"), F.col("u")).alias("sell_price")
    )


def items(d):
    return pf.item_metrics(item_series(d), d.bounds)


def judged(d):
    return pf.eligibility(items(d), pf.active_price_coverage(item_prices(d), item_series(d), d.bounds))


def banded(d):
    return ft.assign_bands(judged(d).where("eligible"))


S = """s AS (SELECT store_id, item_id, min(dept_id) AS dept_id, CAST(sum(sales) AS BIGINT) AS total_units, n_days - count(DISTINCT CASE WHEN sales > 0 THEN date END) AS zero_days,
  count(DISTINCT CASE WHEN sales > 0 THEN date END) AS positive_days, coalesce(min(CASE WHEN sales > 0 THEN date_diff('day', lo, date) + 1 END), -1) AS first_positive_day,
  coalesce(max(CASE WHEN sales > 0 THEN date_diff('day', lo, date) + 1 END), -1) AS last_positive_day, min(n_days) AS n_days, min(hi) AS hi, min(lo) AS lo
  FROM item_facts, (SELECT lo, hi, date_diff('day', lo, hi) + 1 AS n_days FROM bounds) GROUP BY store_id, item_id, n_days)"""
IP = """ip AS (SELECT store_id, item_id, dept_id, CAST(date_trunc('week', date) AS DATE) AS week_start, ((2 * sum(cents) + sum(sales)) // (2 * sum(sales))) / 100.0::DOUBLE AS sell_price
  FROM item_facts GROUP BY 1, 2, 3, 4 HAVING sum(sales) > 0)"""
I = """i AS (SELECT item_id, min(dept_id) AS dept_id, count(DISTINCT store_id) AS store_count, coalesce(min(CASE WHEN first_positive_day >= 0 THEN first_positive_day END), -1) AS first_positive_day,
  CAST(sum(total_units) AS BIGINT) AS total_units, sum(zero_days) / (count(DISTINCT store_id) * min(n_days)) AS zero_prevalence,
  sum(total_units) / (count(DISTINCT store_id) * min(n_days)) AS mean_daily_demand, min(n_days) - coalesce(min(CASE WHEN first_positive_day >= 0 THEN first_positive_day END), -1) AS remaining_history_days FROM s GROUP BY 1)"""
C = """c AS (SELECT s.store_id, s.item_id, first_positive_day, date_diff('day', date_trunc('week', lo + CAST(first_positive_day - 1 AS INTEGER)), date_trunc('week', hi)) // 7 + 1 AS active_weeks,
  (SELECT count(DISTINCT week_start) FROM ip WHERE ip.store_id = s.store_id AND ip.item_id = s.item_id) AS priced_weeks FROM s)"""
J = f"""j AS (SELECT *, passes_required_stores AND passes_sparsity AND passes_history AND passes_price_coverage AS eligible FROM (
  SELECT i.*, coalesce(stores_with_coverage, 0) AS stores_with_coverage, coalesce(minimum_coverage, 0) AS minimum_coverage, store_count = {E['stores']} AS passes_required_stores,
  zero_prevalence < {E['zero_prevalence']} AS passes_sparsity, remaining_history_days >= {E['remaining_history_days']} AS passes_history,
  coalesce(stores_with_coverage, 0) = {E['stores']} AND coalesce(minimum_coverage, 0) >= {E['price_coverage']} AS passes_price_coverage
  FROM i LEFT JOIN (SELECT item_id, count(DISTINCT store_id) AS stores_with_coverage, min(priced_weeks / active_weeks) AS minimum_coverage FROM c GROUP BY 1) k USING (item_id)))"""
B = """b AS (SELECT j.*, CASE WHEN mean_daily_demand <= q1 THEN 'low' WHEN mean_daily_demand <= q2 THEN 'medium' ELSE 'high' END AS demand_band
  FROM j, (SELECT quantile_cont(mean_daily_demand, 1.0/3) AS q1, quantile_cont(mean_daily_demand, 2.0/3) AS q2 FROM j WHERE eligible) WHERE eligible)"""


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


@query("agg_01_series_row_metrics", ctes(S) + "SELECT store_id, item_id, total_units, zero_days, positive_days, first_positive_day, last_positive_day FROM s")
def series_row_metrics(d):
    rows = item_series(d).drop("dept_id")
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("zero_days", "first_positive_day", "last_positive_day")})


@query("agg_02_global_value_profile", """
SELECT count(*) AS n_values, count(*) - count(sales) AS missing_values, count(*) FILTER (sales < 0) AS negative_values, count(*) FILTER (sales = 0) AS zero_values,
  round(100.0 * count(*) FILTER (sales = 0) / count(*), 6) AS zero_pct, min(sales) AS min_value, max(sales) AS max_value FROM panel""")
def global_value_profile(d):
    return rounded(pf.value_profile(d.panel, "sales"), ["zero_pct"])


@query("agg_03_item_demand_metrics", ctes(S, I) + """
SELECT item_id, dept_id, store_count, first_positive_day, total_units, round(zero_prevalence, 9) AS zero_prevalence, round(mean_daily_demand, 9) AS mean_daily_demand, remaining_history_days FROM i""")
def item_demand_metrics(d):
    rows = rounded(items(d), ["zero_prevalence", "mean_daily_demand"], 9)
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("first_positive_day", "remaining_history_days")})


@query("agg_04_store_summary", ctes(S) + """
SELECT store_id, count(*) AS item_rows, count(DISTINCT item_id) AS unique_items, CAST(sum(total_units) AS BIGINT) AS total_units,
  round(100.0 * sum(zero_days) / (count(*) * min(n_days)), 6) AS zero_prevalence_pct FROM s GROUP BY 1""")
def store_summary(d):
    return rounded(pf.store_summary(item_series(d), d.bounds), ["zero_prevalence_pct"])


@query("agg_05_distinct_items_by_level", " UNION ALL ".join(
    f"SELECT '{c}' AS level, {c} AS value, count(DISTINCT item_id) AS distinct_values FROM item_facts GROUP BY {c}" for c in ("store_id", "dept_id")))
def distinct_items_by_level(d):
    return pf.distinct_by_level(d.item_facts, ["store_id", "dept_id"], "item_id")


@query("agg_06_value_counts", """
SELECT o_orderpriority AS value, count(*) AS n_rows FROM orders GROUP BY 1""")
def value_counts(d):
    return pf.value_counts(d.table("orders", "o_orderpriority"), "o_orderpriority")


@query("agg_07_functional_dependencies", """
SELECT 'item_id -> dept_id' AS dependency, bool_and(n = 1) AS holds, count(*) AS groups FROM (SELECT item_id, count(DISTINCT dept_id) AS n FROM item_facts GROUP BY 1)
UNION ALL SELECT 'store_id -> state_id', bool_and(n = 1), count(*) FROM (SELECT store_id, count(DISTINCT state_id) AS n FROM panel GROUP BY 1)
UNION ALL SELECT 'dept_id -> cat_id', bool_and(n = 1), count(*) FROM (SELECT dept_id, count(DISTINCT cat_id) AS n FROM panel GROUP BY 1)
UNION ALL SELECT 'state_id -> store_id', bool_and(n = 1), count(*) FROM (SELECT state_id, count(DISTINCT store_id) AS n FROM panel GROUP BY 1)""")
def functional_dependencies(d):
    wide = retail.hierarchy(d.series)
    rows = [pf.functional_dependency(d.item_facts, "item_id", "dept_id")]
    rows += [pf.functional_dependency(wide, a, b) for a, b in (("store_id", "state_id"), ("dept_id", "cat_id"), ("state_id", "store_id"))]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


@query("agg_08_calendar_profile", """
SELECT count(*) AS days, count(DISTINCT d) AS unique_d, count(DISTINCT week_start) AS unique_weeks, count(*) FILTER (event_name_1 IS NOT NULL OR event_name_2 IS NOT NULL) AS event_days,
  count(*) FILTER (event_name_1 IS NOT NULL AND event_name_2 IS NOT NULL) AS two_event_days, """ + ", ".join(
    f"round(100.0 * sum({c}) / count(*), 4) AS {c}_pct" for c in P.SNAP_COLUMNS.values()) + " FROM calendar")
def calendar_profile(d):
    one, two = F.col("event_name_1").isNotNull(), F.col("event_name_2").isNotNull()
    flags = list(P.SNAP_COLUMNS.values())
    rows = d.calendar.agg(
        F.count(F.lit(1)).alias("days"), F.count_distinct("d").alias("unique_d"), F.count_distinct("week_start").alias("unique_weeks"),
        count_if(one | two).alias("event_days"), count_if(one & two).alias("two_event_days"),
        *[percent(F.sum(c), F.count(F.lit(1))).alias(f"{c}_pct") for c in flags],
    )
    return rounded(rows, [f"{c}_pct" for c in flags], 4)


CALENDAR_NULLS = ["event_name_1", "event_type_1", "event_name_2", "event_type_2", "weekday"]


@query("agg_08_calendar_missing_values", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_values FROM calendar" for c in CALENDAR_NULLS))
def calendar_missing_values(d):
    return pf.missing_by_column(d.calendar, CALENDAR_NULLS)


@query("agg_09_price_profile", ctes(IP) + """
SELECT count(*) AS records, min(sell_price) AS min_price, max(sell_price) AS max_price, round(avg(sell_price), 6) AS mean_price, round(quantile_cont(sell_price, 0.5), 6) AS median_price,
  count(*) - count(sell_price) AS missing_values, count(*) FILTER (sell_price < 0) AS negative_prices, count(*) FILTER (sell_price = 0) AS zero_prices,
  count(*) - count(DISTINCT (store_id, item_id, week_start)) AS duplicate_keys FROM ip""")
def price_profile(d):
    prices = item_prices(d)
    median = quantiles(prices, "sell_price", {"m": 0.5}).select("m").scalar()
    price = F.col("sell_price")
    rows = prices.agg(
        F.count(F.lit(1)).alias("records"), F.min(price).alias("min_price"), F.max(price).alias("max_price"), F.avg(price).alias("mean_price"),
        count_if(price.isNull()).alias("missing_values"), count_if(price < 0).alias("negative_prices"), count_if(price == 0).alias("zero_prices"),
        pf.duplicate_rows(prices, [*SERIES, "week_start"]).alias("duplicate_keys"),
    ).withColumn("median_price", median)
    return rounded(rows, ["mean_price", "median_price"])


W = "(SELECT count(DISTINCT week_start) FROM calendar)"


@query("agg_10_price_grid_coverage", ctes(IP) + " UNION ALL ".join(
    f"SELECT '{k}' AS level, {v} AS value, count(*) AS price_records, count(DISTINCT (store_id, item_id)) AS series, round(100.0 * count(*) / (count(DISTINCT (store_id, item_id)) * {W}), 6) AS coverage_pct FROM ip{g}"
    for k, v, g in (("overall", "'all'", ""), ("store_id", "store_id", " GROUP BY store_id"), ("dept_id", "dept_id", " GROUP BY dept_id"))))
def price_grid_coverage(d):
    weeks, prices = pf.calendar_weeks(d.bounds), item_prices(d)
    parts = [pf.grid_coverage(prices, by, weeks).select(F.lit(by[0] if by else "overall").alias("level"), (F.col(by[0]) if by else F.lit("all")).alias("value"),
             "price_records", "series", "coverage_pct") for by in ([], ["store_id"], ["dept_id"])]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["coverage_pct"])


@query("agg_10_median_weeks_per_item", ctes(IP) + """
SELECT store_id, quantile_cont(n, 0.5) AS median_weeks FROM (SELECT store_id, item_id, count(DISTINCT week_start)::DOUBLE AS n FROM ip GROUP BY 1, 2) GROUP BY 1""")
def median_weeks_per_item(d):
    weeks = item_prices(d).groupBy(*SERIES).agg(F.count_distinct("week_start").alias("n"))
    return quantiles(weeks, "n", {"median_weeks": 0.5}, ["store_id"], small_domain=True)


@query("agg_11_distinct_prices_per_item", ctes(IP) + """
SELECT min(n) AS min_prices, quantile_cont(n::DOUBLE, 0.5) AS median_prices, round(avg(n), 6) AS mean_prices, max(n) AS max_prices, count(*) FILTER (n > 1) AS items_with_changes
FROM (SELECT item_id, count(DISTINCT sell_price) AS n FROM ip GROUP BY 1)""")
def distinct_prices_per_item(d):
    per_item = item_prices(d).groupBy("item_id").agg(F.count_distinct("sell_price").alias("n"))
    median = quantiles(per_item, "n", {"m": 0.5}, small_domain=True).select("m").scalar()
    rows = per_item.agg(F.min("n").alias("min_prices"), F.avg("n").alias("mean_prices"), F.max("n").alias("max_prices"),
                        count_if(F.col("n") > 1).alias("items_with_changes")).withColumn("median_prices", median)
    return rounded(rows, ["mean_prices"])


SCREEN = ["ASIA", "EUROPE", "AFRICA"]


def screen_sql(stores: str) -> str:
    return f"""SELECT count(*) FILTER (p = 3) AS in_all_stores, count(*) FILTER (coalesce(sp, 0) = 3) AS priced_in_all_stores, count(*) FILTER (e = 3) AS early_in_all_stores,
  count(*) FILTER (z = 3) AS dense_in_all_stores, count(*) FILTER (coalesce(sp, 0) = 3 AND 100.0 * coalesce(w, 0) / {W} >= 1) AS covered_in_all_stores,
  count(*) FILTER (p = 3 AND e = 3 AND z = 3 AND coalesce(sp, 0) = 3 AND 100.0 * coalesce(w, 0) / {W} >= 1) AS meets_all_screens
FROM (SELECT item_id, count(DISTINCT store_id) AS p, count(*) FILTER (first_positive_day BETWEEN 1 AND 730) AS e, count(*) FILTER (100.0 * zero_days / n_days < 99.85) AS z FROM s WHERE store_id IN ({stores}) GROUP BY 1) x
LEFT JOIN (SELECT item_id, count(*) AS sp, min(n) AS w FROM (SELECT item_id, store_id, count(DISTINCT week_start) AS n FROM ip WHERE store_id IN ({stores}) GROUP BY 1, 2) GROUP BY 1) y USING (item_id)"""


@query("agg_12_candidate_product_screen", ctes(S, IP) + screen_sql("'ASIA', 'EUROPE', 'AFRICA'"))
def candidate_product_screen(d):
    return pf.product_screen(item_series(d), item_prices(d), SCREEN, d.bounds, early=730, zero_pct=99.85, weeks_pct=1.0)


@query("agg_13_missing_price_gap_classes", """
SELECT count(*) AS missing_rows, count(*) FILTER (date < fk) AS before_first_known, count(*) FILTER (date > fk AND date < lk) AS between_known, count(*) FILTER (date > lk) AS after_last_known,
  count(*) FILTER (date < fs) AS before_first_sale, count(*) FILTER (date >= fs) AS after_first_sale, count(*) FILTER (sales > 0) AS with_positive_sale
FROM (SELECT *, min(CASE WHEN sell_price IS NOT NULL THEN date END) OVER w AS fk, max(CASE WHEN sell_price IS NOT NULL THEN date END) OVER w AS lk, min(CASE WHEN sales > 0 THEN date END) OVER w AS fs
  FROM panel WINDOW w AS (PARTITION BY store_id, item_id)) WHERE sell_price IS NULL""")
def missing_price_gap_classes(d):
    return pf.gap_classes(d.panel)


@query("agg_14_missing_price_by_product", """
SELECT store_id, item_id, count(*) AS n_rows, count(*) - count(sell_price) AS missing_rows, round(100.0 * (count(*) - count(sell_price)) / count(*), 6) AS missing_pct
FROM panel GROUP BY 1, 2 ORDER BY missing_rows DESC, store_id, item_id LIMIT 15""")
def missing_price_by_product(d):
    missing = count_if(F.col("sell_price").isNull())
    rows = d.panel.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n_rows"), missing.alias("missing_rows"), percent(missing, F.count(F.lit(1))).alias("missing_pct"))
    return rounded(rows, ["missing_pct"]).orderBy(F.desc("missing_rows"), *SERIES).limit(15)


COVERAGE_SQL = "SELECT store_id, item_id, first_positive_day, active_weeks, priced_weeks, round(priced_weeks / active_weeks, 9) AS price_coverage FROM c"


def coverage(d):
    rows = pf.active_price_coverage(item_prices(d), item_series(d), d.bounds)
    return rounded(rows, ["price_coverage"], 9).withColumns({c: F.col(c).cast("bigint") for c in ("first_positive_day", "active_weeks")})


@query("agg_15_active_price_coverage", ctes(S, IP, C) + COVERAGE_SQL)
def active_price_coverage(d):
    return coverage(d)


@query("jn_15_weeks_after_launch", ctes(S, IP, C) + "SELECT store_id, active_weeks, count(*) AS series, CAST(sum(priced_weeks) AS BIGINT) AS priced_weeks FROM c GROUP BY 1, 2")
def weeks_after_launch(d):
    return coverage(d).groupBy("store_id", "active_weeks").agg(F.count(F.lit(1)).alias("series"), F.sum("priced_weeks").alias("priced_weeks"))


@query("agg_16_eligibility_rules", ctes(S, IP, I, C, J) + "SELECT item_id, dept_id, passes_required_stores, passes_sparsity, passes_history, passes_price_coverage, eligible FROM j")
def eligibility_rules(d):
    return judged(d).select("item_id", "dept_id", *pf.RULES, "eligible")


@query("jn_04_item_metrics_with_coverage", ctes(S, IP, I, C, J) + "SELECT item_id, store_count, stores_with_coverage, round(minimum_coverage::DOUBLE, 9) AS minimum_coverage FROM j")
def item_metrics_with_coverage(d):
    return rounded(judged(d).select("item_id", "store_count", "stores_with_coverage", "minimum_coverage"), ["minimum_coverage"], 9)


@query("agg_17_rule_failure_counts", ctes(S, IP, I, C, J) + " UNION ALL ".join(
    f"SELECT '{r.replace('passes_', '')}' AS rule, count(*) FILTER (NOT {r}) AS failures FROM j" for r in pf.RULES) +
    " UNION ALL SELECT 'more_than_one_rule', count(*) FILTER (" + " + ".join(f"CAST(NOT {r} AS INTEGER)" for r in pf.RULES) + " > 1) FROM j")
def rule_failure_counts(d):
    return pf.failure_counts(judged(d))


@query("scl_09_demand_tertiles", ctes(S, IP, I, C, J, B) + "SELECT item_id, dept_id, round(mean_daily_demand, 9) AS mean_daily_demand, demand_band FROM b")
def demand_tertiles(d):
    return rounded(banded(d).select("item_id", "dept_id", "mean_daily_demand", "demand_band"), ["mean_daily_demand"], 9)


QUOTA_VALUES = ", ".join(f"('{b}', {q})" for b, q in pf.QUOTAS.items())


@query("agg_41_quota_availability", ctes(S, IP, I, C, J, B) + f"""
SELECT x.dept_id, v.demand_band, v.required, coalesce(n, 0) AS available, coalesce(n, 0) >= v.required AS satisfied FROM (SELECT DISTINCT dept_id FROM b) x CROSS JOIN (VALUES {QUOTA_VALUES}) AS v(demand_band, required)
LEFT JOIN (SELECT dept_id, demand_band, count(*) AS n FROM b GROUP BY 1, 2) y ON y.dept_id = x.dept_id AND y.demand_band = v.demand_band""")
def quota_availability(d):
    return pf.quota_availability(banded(d))


SAMPLE = f"""SELECT item_id, dept_id, demand_band FROM (SELECT b.*, v.required, row_number() OVER (PARTITION BY dept_id, b.demand_band ORDER BY md5('42/' || item_id), item_id) AS rn
FROM b JOIN (VALUES {QUOTA_VALUES}) AS v(demand_band, required) ON v.demand_band = b.demand_band) WHERE rn <= required"""


@query("ml_01_stratified_quota_sample", ctes(S, IP, I, C, J, B) + SAMPLE)
def stratified_quota_sample(d):
    return pf.quota_sample(banded(d)).select("item_id", "dept_id", "demand_band")


@query("snk_08_selection_manifest", ctes(S, IP, I, C, J, B) + f"""
SELECT b.item_id, b.dept_id, b.demand_band, round(b.mean_daily_demand, 9) AS mean_daily_demand, b.remaining_history_days, q1 AS low_upper, q2 AS medium_upper FROM b JOIN ({SAMPLE}) USING (item_id),
(SELECT round(quantile_cont(mean_daily_demand, 1.0/3), 9) AS q1, round(quantile_cont(mean_daily_demand, 2.0/3), 9) AS q2 FROM j WHERE eligible)""")
def selection_manifest(d):
    cuts = quantiles(judged(d).where("eligible"), "mean_daily_demand", {"lo": 1 / 3, "hi": 2 / 3})
    rows = pf.quota_sample(banded(d)).select("item_id", "dept_id", "demand_band", "mean_daily_demand", F.col("remaining_history_days").cast("bigint").alias("remaining_history_days"),
                                             cuts.select("lo").scalar().alias("low_upper"), cuts.select("hi").scalar().alias("medium_upper"))
    return rounded(rows, ["mean_daily_demand", "low_upper", "medium_upper"], 9)


STORES = f"""t AS (SELECT store_id, CASE store_id WHEN 'AMERICA' THEN 'AMER' WHEN 'ASIA' THEN 'APAC' ELSE 'EMEA' END AS state_id, zero_prevalence_pct, coverage_pct FROM
  (SELECT store_id, round(100.0 * sum(zero_days) / (count(*) * min(n_days)), 6) AS zero_prevalence_pct FROM s GROUP BY 1)
  JOIN (SELECT store_id, round(100.0 * count(*) / (count(DISTINCT item_id) * {W}), 6) AS coverage_pct FROM ip GROUP BY 1) USING (store_id))"""


def store_table(d):
    coverage_pct = rounded(pf.grid_coverage(item_prices(d), ["store_id"], pf.calendar_weeks(d.bounds)), ["coverage_pct"])
    summary = rounded(pf.store_summary(item_series(d), d.bounds), ["zero_prevalence_pct"])
    joined = coverage_pct.join(summary.select("store_id", "zero_prevalence_pct"), "store_id", "left")
    return joined.select("store_id", retail.lookup(P.STATES, F.col("store_id")).alias("state_id"), "zero_prevalence_pct", "coverage_pct")


@query("jn_08_store_coverage_with_sales", ctes(S, IP, STORES) + "SELECT * FROM t")
def store_coverage_with_sales(d):
    return store_table(d)


@query("win_18_best_store_per_state", ctes(S, IP, STORES) + """
SELECT store_id, state_id, coverage_pct, zero_prevalence_pct FROM (SELECT *, row_number() OVER (PARTITION BY state_id ORDER BY coverage_pct DESC, zero_prevalence_pct, store_id) AS rn FROM t) WHERE rn = 1""")
def best_store_per_state(d):
    return pf.store_strategies(store_table(d)).where("strategy = 'best per state'").drop("strategy")


@query("agg_52_store_strategy_evidence", ctes(S, IP, STORES) + """
SELECT 'best per state' AS strategy, store_id, state_id, coverage_pct, zero_prevalence_pct FROM (SELECT *, row_number() OVER (PARTITION BY state_id ORDER BY coverage_pct DESC, zero_prevalence_pct, store_id) AS rn FROM t) WHERE rn = 1
UNION ALL SELECT * FROM (SELECT 'same state', store_id, state_id, coverage_pct, zero_prevalence_pct FROM t WHERE state_id = 'EMEA' ORDER BY coverage_pct DESC, zero_prevalence_pct, store_id LIMIT 3)
UNION ALL SELECT * FROM (SELECT 'highest coverage', store_id, state_id, coverage_pct, zero_prevalence_pct FROM t ORDER BY coverage_pct DESC, zero_prevalence_pct, store_id LIMIT 3)""")
def store_strategy_evidence(d):
    return pf.store_strategies(store_table(d))


@query("src_03_relevant_prices_by_item", ctes(IP) + "SELECT item_id, count(*) AS price_rows FROM ip WHERE dept_id = 'PROMO' GROUP BY 1")
def relevant_prices_by_item(d):
    promo = d.item_facts.where(F.col("dept_id") == "PROMO")
    return relevant_prices(item_prices(d).drop("dept_id"), promo).groupBy("item_id").agg(F.count(F.lit(1)).alias("price_rows"))


@query("dq_14_quality_observations", ctes(IP) + f"""
SELECT 'zero-heavy demand' AS observation, 'expected' AS classification, round(100.0 * count(*) FILTER (sales = 0) / count(*), 6) AS value FROM panel
UNION ALL SELECT 'negative sales', CASE WHEN count(*) FILTER (sales < 0) > 0 THEN 'potential issue' ELSE 'expected' END, count(*) FILTER (sales < 0) FROM panel
UNION ALL SELECT 'sparse price grid', 'expected', round(100.0 * count(*) / (count(DISTINCT (store_id, item_id)) * {W}), 6) FROM ip
UNION ALL SELECT 'items with price changes', 'investigate', count(*) FROM (SELECT item_id FROM ip GROUP BY 1 HAVING count(DISTINCT sell_price) > 1)
UNION ALL SELECT 'duplicate price keys', CASE WHEN count(*) > count(DISTINCT (store_id, item_id, week_start)) THEN 'potential issue' ELSE 'expected' END, count(*) - count(DISTINCT (store_id, item_id, week_start)) FROM ip""")
def quality_observations(d):
    from demandloom.operators.quality import observations

    return rounded(observations(d.panel, item_prices(d), pf.calendar_weeks(d.bounds)), ["value"])
