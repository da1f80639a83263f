"""Scans, filters, reshapes, joins, sorts and set operations on the panel."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandloom.catalog.registry import query
from demandloom.functions.columns import count_if, none_token, percent, period_start
from demandloom.operators import features as ft
from demandloom.operators import folds as fo
from demandloom.operators import reshape, serving
from demandloom.operators.joins import checked_join, duplicate_keys, key_mismatches
from demandloom.sources import parameters as P
from demandloom.sources import retail, sinks, tables
from demandloom.sources.parameters import SERIES

KEYS = ["store_id", "item_id", "date"]
IDS = ["id", "store_id", "item_id", "dept_id", "cat_id", "state_id"]


def wide_sales(d):
    """The whole panel in wide form, one column per day; staged, for a pivot of all days is costly to plan twice."""
    days = [f"d_{n}" for n in range(1, d.bounds.days + 1)]
    named = d.panel.withColumn("id", F.concat_ws("_", "item_id", "store_id"))
    return d.stage("wide-sales", lambda: reshape.long_to_wide(named, IDS, days))


WIDE_LONG = "SELECT item_id || '_' || store_id AS id, * FROM panel"


@query("src_01_wide_sales_scan", f"""
SELECT id, store_id, item_id, CAST(sum(sales) AS BIGINT) AS units, count(*) AS day_columns
FROM ({WIDE_LONG}) WHERE cat_id = 'GOODS' AND store_id IN ('AFRICA', 'ASIA') GROUP BY 1, 2, 3""")
def wide_sales_scan(d):
    wide = wide_sales(d)
    path = sinks.scratch_path(d.spark, "wide-sales-csv")
    sinks.write_table(wide, path, fmt="csv")
    days = tables.day_columns(wide.columns)
    scan = tables.read_wide_csv(d.spark, path, IDS, days, category="GOODS", stores=["AFRICA", "ASIA"])
    return reshape.wide_to_long(scan).groupBy("id", "store_id", "item_id").agg(
        F.sum("sales").alias("units"), F.count("sales").alias("day_columns")
    )


@query("src_02_calendar_scan", "SELECT * FROM calendar")
def calendar_scan(d):
    path = sinks.scratch_path(d.spark, "calendar")
    sinks.write_table(d.calendar, path, fmt="csv")
    return tables.read_calendar_csv(d.spark, path)


@query("src_03_relevant_price_scan", """
SELECT * FROM weekly_price WHERE store_id IN ('ASIA', 'EUROPE')
  AND item_id IN (SELECT item_id FROM facts WHERE store_id IN ('ASIA', 'EUROPE'))""")
def relevant_price_scan(d):
    path = sinks.scratch_path(d.spark, "prices")
    sinks.write_table(d.prices, path, fmt="csv")
    sold = d.facts.where(F.col("store_id").isin("ASIA", "EUROPE"))
    return tables.relevant_prices(tables.read_price_csv(d.spark, path), sold)


@query("src_04_identifier_scan", """
SELECT DISTINCT item_id || '_' || store_id AS id, store_id, item_id, dept_id, cat_id, state_id FROM panel""")
def identifier_scan(d):
    return retail.hierarchy(d.series).withColumn("id", F.concat_ws("_", "item_id", "store_id"))


@query("src_05_day_columns", f"""
SELECT row_number() OVER (ORDER BY CAST(substr(d, 3) AS INTEGER)) AS position, d, units
FROM (SELECT d, CAST(sum(sales) AS BIGINT) AS units FROM ({WIDE_LONG}) GROUP BY 1)""")
def day_column_discovery(d):
    wide = wide_sales(d)
    ordered = tables.day_columns(sorted(wide.columns))
    position = F.array_position(F.lit(ordered), F.col("d"))
    units = reshape.wide_to_long(wide).groupBy("d").agg(F.sum("sales").alias("units"))
    return units.select(position.cast("bigint").alias("position"), "d", "units")


@query("src_06_cutoff_scan", """
SELECT store_id, count(*) AS n_rows, max(date) AS last_date, CAST(sum(sales) AS BIGINT) AS units
FROM panel WHERE date <= DATE '2001-04-01' GROUP BY 1""")
def cutoff_scan(d):
    facts = tables.through_date(d.panel, P.FOLDS[0][1]).where(F.col("date") < F.lit(P.FOLDS[0][1]).cast("date"))
    return facts.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("date").alias("last_date"), F.sum("sales").alias("units")
    )


@query("src_07_typed_panel_scan", """
SELECT year, state_id, count(*) AS n_rows, CAST(sum(sales) AS BIGINT) AS units, count(sell_price) AS priced_rows
FROM panel GROUP BY 1, 2""")
def typed_panel_scan(d):
    path = sinks.scratch_path(d.spark, "panel")
    stored = sinks.write_table(d.panel, path, partition_by=["year"])
    return stored.groupBy("year", "state_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("sales").alias("units"), F.count("sell_price").alias("priced_rows")
    )


@query("src_08_modeling_scan", """
SELECT store_id, item_id, date, dept_id, demand_band, sales, is_feature_ready FROM features""")
def modeling_scan(d):
    return d.features.select(*KEYS, "dept_id", "demand_band", "sales", "is_feature_ready")


@query("src_10_source_contracts", """
SELECT 'lineitem.parquet' AS source, 'valid' AS status, 11 AS column_count, '' AS missing_columns, count(*) AS row_count FROM lineitem
UNION ALL SELECT 'part.parquet', 'invalid', 6, 'p_container', count(*) FROM part
UNION ALL SELECT 'supplier.parquet', 'valid', 4, '', count(*) FROM supplier
UNION ALL SELECT 'prices.csv', 'missing', 0, 'store_id,item_id', NULL""")
def source_contracts(d):
    return tables.inspect_sources(d.spark, d.folder, {
        "lineitem.parquet": ["l_partkey", "l_suppkey", "l_shipdate", "l_quantity"],
        "part.parquet": ["p_partkey", "p_type", "p_container"],
        "supplier.parquet": ["s_suppkey", "s_nationkey"],
        "prices.csv": ["store_id", "item_id"],
    }, count_rows=True)


@query("prj_01_dimension_filter", """
SELECT store_id, item_id, count(*) AS n_rows, CAST(sum(sales) AS BIGINT) AS units
FROM panel WHERE dept_id = 'SIZED' AND store_id IN ('AFRICA', 'EUROPE') GROUP BY 1, 2""")
def dimension_filter(d):
    kept = d.panel.where((F.col("dept_id") == "SIZED") & F.col("store_id").isin("AFRICA", "EUROPE"))
    return kept.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("sales").alias("units"))


@query("prj_02_whitelisted_filter", """
SELECT store_id, dept_id, count(*) AS n_rows, CAST(sum(sales) AS BIGINT) AS units
FROM panel WHERE store_id IN ('ASIA', 'AMERICA') AND dept_id = 'STYLED' GROUP BY 1, 2""")
def whitelisted_filter(d):
    wanted = serving.conditions({"store_id": ["ASIA", "AMERICA"], "dept_id": "STYLED", "item_id": "All", "state_id": None})
    return d.panel.where(wanted).groupBy("store_id", "dept_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("sales").alias("units")
    )


@query("prj_02_customer_segment_filter", """
SELECT c_mktsegment, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer
WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey = 3 GROUP BY 1""")
def customer_segment_filter(d):
    wanted = serving.conditions(
        {"c_mktsegment": ["BUILDING", "MACHINERY"], "c_nationkey": 3, "c_name": ""}, ("c_mktsegment", "c_nationkey", "c_name")
    )
    return d.table("customer", "c_mktsegment", "c_nationkey", "c_acctbal").where(wanted).groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance")
    )


@query("prj_03_date_range_filter", """
SELECT o_orderpriority, count(*) AS orders, min(CAST(o_orderdate AS DATE)) AS first_date, max(CAST(o_orderdate AS DATE)) AS last_date
FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-03-01' AND DATE '1999-02-28' GROUP BY 1""")
def date_range_filter(d):
    orders = d.table("orders", "o_orderpriority", "o_orderdate").withColumn("date", F.to_date("o_orderdate"))
    return serving.date_range(orders, "1998-03-01", "1999-02-28").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("orders"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


@query("prj_09_training_rows", """
SELECT fold, count(*) AS training_rows, max(date) AS last_training_date, CAST(sum(sales) AS BIGINT) AS units
FROM features JOIN fold_table ON date < start_date WHERE is_feature_ready GROUP BY 1""")
def training_rows(d):
    return fo.training_rows(d.features).groupBy("fold").agg(
        F.count(F.lit(1)).alias("training_rows"), F.max("date").alias("last_training_date"), F.sum("sales").alias("units")
    )


@query("prj_10_window_lock", """
SELECT f.fold, f.start_date, f.end_date, f.start_date <= DATE '2001-07-30' AND f.end_date >= DATE '2001-07-01' AS is_blocked,
  count(*) AS panel_rows FROM fold_table_all f JOIN panel ON date BETWEEN f.start_date AND f.end_date GROUP BY 1, 2, 3""")
def window_lock(d):
    scoped = fo.fold_rows(d.panel.select("date"), locked=True)
    counts = scoped.groupBy("fold", "start_date", "end_date").agg(F.count(F.lit(1)).alias("panel_rows"))
    return counts.withColumn("is_blocked", fo.overlaps_locked(F.col("start_date"), F.col("end_date")))


@query("prj_11_restricted_future_context", """
SELECT fold, store_id, item_id, dept_id, state_id, date, CAST(day_of_week AS INTEGER) AS day_of_week, month, is_event, snap_active,
  product_age_days FROM features JOIN fold_table ON date BETWEEN start_date AND end_date""")
def restricted_future_context(d):
    context = fo.future_context(d.active)
    return context.select("fold", *KEYS, "dept_id", "state_id", "day_of_week", "month", "is_event", "snap_active", "product_age_days")


@query("rsh_01_wide_to_long", f"SELECT id, store_id, item_id, dept_id, cat_id, state_id, d, sales FROM ({WIDE_LONG})")
def wide_to_long(d):
    return reshape.wide_to_long(wide_sales(d))


@query("rsh_02_day_number_and_date", f"""
SELECT DISTINCT d, CAST(substr(d, 3) AS INTEGER) AS day_number, date FROM ({WIDE_LONG})""")
def day_number_and_date(d):
    days = reshape.wide_to_long(wide_sales(d)).select("d").distinct()
    return days.withColumn("day_number", reshape.day_number()).join(F.broadcast(d.calendar.select("d", "date")), "d", "left")


@query("rsh_03_pivot_store_by_benefit_day", """
SELECT store_id, round(avg(CASE WHEN snap_active = 0 THEN sales END), 6) AS off_days, round(avg(CASE WHEN snap_active = 1 THEN sales END), 6) AS on_days
FROM features GROUP BY 1""")
def pivot_store_by_benefit_day(d):
    flagged = d.active.withColumn("snap_active", ft.store_snap())
    wide = reshape.pivot_mean(flagged, ["store_id"], "snap_active", [0, 1], "sales")
    return wide.select("store_id", F.round("0", 6).alias("off_days"), F.round("1", 6).alias("on_days"))


@query("rsh_04_stack_event_slots", """
SELECT date, event_type_1 AS event_type FROM calendar WHERE event_type_1 IS NOT NULL
UNION ALL SELECT date, event_type_2 FROM calendar WHERE event_type_2 IS NOT NULL""")
def stack_event_slots(d):
    return reshape.stack_slots(d.calendar, ["date"], ["event_type_1", "event_type_2"], "event_type")


@query("rsh_06_ordered_reindex", """
SELECT position, v.weekday, CAST(coalesce(units, 0) AS BIGINT) AS units FROM (VALUES """ + ", ".join(
    f"({i}, '{w}')" for i, w in enumerate(P.WEEKDAYS, start=1)) + """) AS v(position, weekday)
LEFT JOIN (SELECT weekday, sum(sales) AS units FROM panel GROUP BY 1) u ON u.weekday = v.weekday""")
def ordered_reindex(d):
    by_weekday = d.panel.groupBy("weekday").agg(F.sum("sales").alias("units"))
    return reshape.reindexed(by_weekday, "weekday", P.WEEKDAYS, ["units"]).withColumn("position", F.col("position").cast("int"))


@query("jn_01_long_sales_with_calendar", f"""
SELECT id, d, sales, date, week_start, weekday, event_name_1, snap_emea FROM ({WIDE_LONG})""")
def long_sales_with_calendar(d):
    long = reshape.wide_to_long(wide_sales(d))
    days = F.broadcast(d.calendar.select("d", "date", "week_start", "weekday", "event_name_1", "snap_emea"))
    return long.join(days, "d", "left").select("id", "d", "sales", "date", "week_start", "weekday", "event_name_1", "snap_emea")


@query("jn_02_daily_sales_with_price", """
SELECT p.store_id, p.item_id, p.date, p.sales, w.sell_price FROM panel p LEFT JOIN weekly_price w USING (store_id, item_id, week_start)""")
def daily_sales_with_price(d):
    daily = d.panel.select(*KEYS, "week_start", "sales")
    return checked_join(daily, d.prices, [*SERIES, "week_start"], "left", "many_to_one").drop("week_start")


@query("jn_02_price_match_report", """
SELECT count(*) AS n_rows, count(sell_price) AS matched, count(*) - count(sell_price) AS missing FROM panel""")
def price_match_report(d):
    daily = d.panel.select(*KEYS, "week_start", "sales")
    joined = checked_join(daily, d.prices, [*SERIES, "week_start"], "left", "many_to_one")
    return joined.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("sell_price").alias("matched"),
        count_if(F.col("sell_price").isNull()).alias("missing"),
    )


@query("jn_03_item_band_lookup", """
SELECT store_id, item_id, date, dept_id, demand_band FROM panel JOIN item_bands USING (item_id)""")
def item_band_lookup(d):
    return checked_join(d.panel.select(*KEYS, "dept_id"), d.bands.select("item_id", "demand_band"), ["item_id"])


@query("jn_13_priced_series_semi_join", """
SELECT store_id, item_id, week_start, sell_price FROM weekly_price
WHERE item_id IN (SELECT item_id FROM item_bands WHERE demand_band = 'high')""")
def priced_series_semi_join(d):
    high = d.bands.where(F.col("demand_band") == "high").select("item_id")
    return d.prices.join(high, "item_id", "left_semi").select(*SERIES, "week_start", "sell_price")


@query("jn_14_key_coverage_both_ways", """
SELECT 'series' AS key_set, (SELECT count(*) FROM (SELECT store_id, item_id FROM facts EXCEPT SELECT store_id, item_id FROM weekly_price)) AS only_left,
  (SELECT count(*) FROM (SELECT store_id, item_id FROM weekly_price EXCEPT SELECT store_id, item_id FROM facts)) AS only_right,
  (SELECT count(*) FROM (SELECT store_id, item_id FROM weekly_price INTERSECT SELECT store_id, item_id FROM facts)) AS in_both
UNION ALL SELECT 'weeks', (SELECT count(*) FROM (SELECT week_start FROM calendar EXCEPT SELECT week_start FROM weekly_price)),
  (SELECT count(*) FROM (SELECT week_start FROM weekly_price EXCEPT SELECT week_start FROM calendar)),
  (SELECT count(*) FROM (SELECT week_start FROM weekly_price INTERSECT SELECT week_start FROM calendar))""")
def key_coverage(d):
    by_series = key_mismatches(d.facts, d.prices, SERIES).select(F.lit("series").alias("key_set"), "*")
    by_week = key_mismatches(d.calendar, d.prices, ["week_start"]).select(F.lit("weeks").alias("key_set"), "*")
    return by_series.unionByName(by_week)


@query("jn_14_unmatched_parts_anti_join", """
SELECT p_type, count(*) AS parts FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem) GROUP BY 1""")
def unmatched_parts(d):
    sold = d.table("lineitem", "l_partkey").distinct()  # a hot part becomes one row before the exchange
    unsold = d.table("part", "p_partkey", "p_type").join(sold, F.col("p_partkey") == F.col("l_partkey"), "left_anti")
    return unsold.groupBy("p_type").agg(F.count(F.lit(1)).alias("parts"))


@query("jn_16_known_price_span", """
SELECT store_id, item_id, min(CASE WHEN sell_price IS NOT NULL THEN date END) AS first_priced, max(CASE WHEN sell_price IS NOT NULL THEN date END) AS last_priced,
  count(*) FILTER (sell_price IS NULL) AS missing_rows FROM panel GROUP BY 1, 2""")
def known_price_span(d):
    priced = F.when(F.col("sell_price").isNotNull(), F.col("date"))
    return d.panel.groupBy(*SERIES).agg(
        F.min(priced).alias("first_priced"), F.max(priced).alias("last_priced"),
        count_if(F.col("sell_price").isNull()).alias("missing_rows"),
    )


@query("jn_17_fold_history_join", """
SELECT fold, store_id, count(*) AS history_rows, max(date) AS history_end FROM active JOIN fold_table ON date < start_date GROUP BY 1, 2""")
def fold_history_join(d):
    return fo.history_rows(d.active).groupBy("fold", "store_id").agg(
        F.count(F.lit(1)).alias("history_rows"), F.max("date").alias("history_end")
    )


@query("scl_07_period_truncation", """
SELECT CAST(date_trunc('month', date) AS DATE) AS month_start, CAST(date_trunc('week', date) AS DATE) AS monday, count(*) AS n_rows,
  CAST(sum(sales) AS BIGINT) AS units FROM panel GROUP BY 1, 2""")
def period_truncation(d):
    date = F.col("date")
    return d.panel.groupBy(period_start(date, "monthly").alias("month_start"), period_start(date, "weekly").alias("monday")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("sales").alias("units")
    )


@query("scl_13_missing_category_token", """
SELECT coalesce(event_name_1, '__NONE__') AS event_name_1, coalesce(event_type_2, '__NONE__') AS event_type_2, count(*) AS n_rows
FROM features GROUP BY 1, 2""")
def missing_category_token(d):
    return d.active.groupBy(
        none_token(F.col("event_name_1")).alias("event_name_1"), none_token(F.col("event_type_2")).alias("event_type_2")
    ).agg(F.count(F.lit(1)).alias("n_rows"))


@query("srt_01_canonical_order", """
SELECT date, store_id, item_id, sales FROM panel ORDER BY date, store_id, item_id""")
def canonical_order(d):
    return d.panel.select("date", *SERIES, "sales").orderBy("date", *SERIES)


@query("srt_02_largest_days", """
SELECT store_id, item_id, date, sales FROM panel ORDER BY sales DESC, store_id, item_id, date LIMIT 15""")
def largest_days(d):
    return d.panel.select(*KEYS, "sales").orderBy(F.desc("sales"), *KEYS).limit(15)


@query("srt_03_highest_zero_items", """
SELECT item_id, dept_id, zero_pct, units FROM (
  SELECT item_id, min(dept_id) AS dept_id, round(100.0 * (1 - count(*) / (count(DISTINCT store_id) * (SELECT date_diff('day', lo, hi) + 1 FROM bounds))), 6) AS zero_pct,
    CAST(sum(sales) AS BIGINT) AS units FROM item_facts WHERE sales > 0 GROUP BY 1)
ORDER BY zero_pct DESC, item_id LIMIT 10""")
def highest_zero_items(d):
    items = d.item_facts.where("sales > 0").groupBy("item_id").agg(
        F.min("dept_id").alias("dept_id"),
        F.round(100.0 * (1 - F.count(F.lit(1)) / (F.count_distinct("store_id") * d.bounds.days)), 6).alias("zero_pct"),
        F.sum("sales").alias("units"),
    )
    return items.orderBy(F.desc("zero_pct"), "item_id").limit(10)


@query("srt_04_recency_limit", """
SELECT date, sales FROM (SELECT date, sales FROM panel WHERE store_id = 'ASIA' AND item_id = 'PROMO' ORDER BY date DESC LIMIT 90) ORDER BY date""")
def recency_limit(d):
    return serving.recent_history(d.panel, "ASIA", "PROMO", 90).select("date", "sales")


@query("set_02_distinct_keys", "SELECT DISTINCT store_id, item_id, dept_id FROM item_facts")
def distinct_keys(d):
    return d.item_facts.select(*SERIES, "dept_id").distinct()


@query("set_03_week_intersection", """
SELECT store_id, week_start FROM weekly_price INTERSECT SELECT store_id, week_start FROM (SELECT store_id, item_id, CAST(date_trunc('week', date) AS DATE) AS week_start FROM item_facts)""")
def week_intersection(d):
    """Weeks of a store that have a price and, at item level, a sale."""
    sold = d.item_facts.select("store_id", F.date_trunc("week", "date").cast("date").alias("week_start"))
    return d.prices.select("store_id", "week_start").intersect(sold)


@query("set_03_series_difference", """
SELECT store_id, item_id FROM item_facts WHERE date < DATE '1998-01-01' EXCEPT SELECT store_id, item_id FROM item_facts WHERE date >= DATE '1998-01-01'""")
def series_difference(d):
    """Both sides shrink to their distinct series, so the join behind the difference sorts each once."""
    sold = retail.dealt(d.item_facts.select(*SERIES, "date"), d.item_days, *SERIES)
    early = sold.where(F.col("date") < "1998-01-01").select(*SERIES).distinct()
    return early.subtract(sold.where(F.col("date") >= "1998-01-01").select(*SERIES).distinct())


@query("set_04_item_set_equality", """
SELECT (SELECT count(DISTINCT p_partkey) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)) AS only_left,
  (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)) AS only_right,
  (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part)) AS in_both""")
def item_set_equality(d):
    parts = d.table("part", "p_partkey").select(F.col("p_partkey").alias("item_id"))
    return key_mismatches(parts, d.table("lineitem", "l_partkey").select(F.col("l_partkey").alias("item_id")), ["item_id"])


@query("set_05_duplicate_keys", """
SELECT l_orderkey, l_linenumber, count(*) AS key_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_line_keys(d):
    return duplicate_keys(d.table("lineitem", "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query("set_06_first_row_per_key", """
SELECT store_id, item_id, week_start, date, sales FROM (
  SELECT *, row_number() OVER (PARTITION BY store_id, item_id, week_start ORDER BY date) AS rn FROM panel) WHERE rn = 1""")
def first_row_per_key(d):
    return d.panel.groupBy(*SERIES, "week_start").agg(F.min(F.struct("date", "sales")).alias("first")).select(
        *SERIES, "week_start", "first.date", "first.sales"
    )


@query("win_15_share_of_total", """
SELECT store_id, dept_id, CAST(sum(sales) AS BIGINT) AS units, round(100.0 * sum(sales) / (SELECT sum(sales) FROM panel), 6) AS share_pct
FROM panel GROUP BY 1, 2""")
def share_of_total(d):
    units = d.panel.groupBy("store_id", "dept_id").agg(F.sum("sales").alias("units"))
    total = d.facts.agg(F.sum("sales")).scalar()
    return units.withColumn("share_pct", F.round(percent(F.col("units"), total), 6))


@query("win_20_last_28_per_series", """
SELECT store_id, item_id, date, sales, back FROM (SELECT *, row_number() OVER (PARTITION BY store_id, item_id ORDER BY date DESC) AS back FROM active) WHERE back <= 28""")
def last_28_per_series(d):
    newest = W.partitionBy(*SERIES).orderBy(F.desc("date"))
    return d.active.withColumn("back", F.row_number().over(newest)).where("back <= 28").select(*KEYS, "sales", "back")


@query("snk_01_partitioned_panel_write", """
SELECT year, month, count(*) AS n_rows, CAST(sum(sales) AS BIGINT) AS units FROM panel GROUP BY 1, 2""")
def partitioned_panel_write(d):
    stored = sinks.write_table(d.panel, sinks.scratch_path(d.spark, "panel-by-month"), partition_by=["year", "month"])
    return stored.groupBy("year", "month").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("sales").alias("units")
    )


@query("snk_02_idempotent_load", """
SELECT 1 AS load_number, 'created' AS action, count(*) AS n_rows FROM weekly_price
UNION ALL SELECT 2, 'skipped', count(*) FROM weekly_price UNION ALL SELECT 3, 'refreshed', count(*) FROM weekly_price""")
def idempotent_load(d):
    path = sinks.scratch_path(d.spark, "weekly-prices")
    actions = [sinks.load_once(d.prices, path), sinks.load_once(d.prices, path), sinks.load_once(d.prices, path, refresh=True)]
    rows = d.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.select(F.posexplode(F.array(*[F.lit(a) for a in actions])).alias("p", "action"), "n_rows").select(
        (F.col("p") + 1).alias("load_number"), "action", "n_rows"
    )


@query("snk_02_partitioned_load", """
WITH y AS (SELECT CAST(year(week_start) AS VARCHAR) AS partition, count(*) AS n_rows FROM weekly_price GROUP BY 1), l AS (SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS load_number)
SELECT load_number, partition, CASE WHEN load_number = 1 THEN 'created' WHEN load_number = 3 AND partition = '2000' THEN 'refreshed' ELSE 'skipped' END AS action, n_rows, 0::BIGINT AS differing_rows FROM y, l""")
def partitioned_load(d):
    """A first load, a repeated one and one that refreshes a single year; the stored rows stay those of the source."""
    path = sinks.scratch_path(d.spark, "weekly-prices-by-year")
    rows = d.prices.withColumn("year", F.year("week_start"))
    loads = [sinks.load_partitions(rows, path, "year", refresh=years) for years in ((), (), (2000,))]
    stored = d.spark.read.parquet(path).select(*rows.columns)
    differing = rows.exceptAll(stored).unionByName(stored.exceptAll(rows)).agg(F.count(F.lit(1)).alias("differing_rows"))
    told = [load.withColumn("load_number", F.lit(i)) for i, load in enumerate(loads, 1)]
    return told[0].unionByName(told[1]).unionByName(told[2]).join(F.broadcast(differing))


@query("snk_03_serving_history", """
SELECT p.store_id, p.item_id, p.date, p.sales, p.sell_price,
  CASE state_id WHEN 'EMEA' THEN snap_emea WHEN 'AMER' THEN snap_amer WHEN 'APAC' THEN snap_apac END = 1 AS snap_active FROM panel p""")
def serving_history(d):
    return sinks.serving_history(d.panel).select(*KEYS, "sales", "sell_price", "snap_active")


@query("snk_04_recent_window_extract", """
SELECT store_id, item_id, date, sales FROM panel WHERE date >= (SELECT max(date) - 119 FROM panel)""")
def recent_window_extract(d):
    """Read from the panel stored by year: older years are not listed."""
    return sinks.recent_window(d.stored_panel, 120, d.bounds.hi).select(*KEYS, "sales")


HASH = "CAST('0x' || substr(md5(store_id || '/' || item_id || '/' || CAST(date AS VARCHAR) || '/' || CAST(sales AS VARCHAR)), 1, 8) AS BIGINT)"


@query("snk_07_table_fingerprint", f"""
SELECT 'facts' AS table_name, count(*) AS n_rows, CAST(sum({HASH}) AS VARCHAR) AS content_hash FROM facts
UNION ALL SELECT 'panel', count(*), CAST(sum({HASH}) AS VARCHAR) FROM panel""")
def table_fingerprint(d):
    columns = [*KEYS, "sales"]
    return sinks.fingerprint(d.facts, columns, "facts").unionByName(sinks.fingerprint(d.panel, columns, "panel"))
