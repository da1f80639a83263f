"""The domain views as SQL, shared by the SQL twins of the queries."""

from __future__ import annotations

from statistics import NormalDist

from demandloom.functions.normal import CDF_DENOMINATOR, CDF_NUMERATOR
from demandloom.sources import parameters as P


def _case(mapping: dict, key: str) -> str:
    arms = " ".join(f"WHEN {key} = '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {arms} END"


def _slot(events: dict, position: int) -> str:
    arms = " ".join(
        f"WHEN month(date) = {m} AND day(date) = {d} THEN '{v[position]}'" for (m, d), v in events.items()
    )
    return f"CASE {arms} END"


_SNAPS = ", ".join(
    f"CAST(day(date) BETWEEN {lo} AND {hi} AS INTEGER) AS {name}" for name, (lo, hi) in P.SNAP_DAYS.items()
)
_DEPT = _case(P.DEPARTMENTS, "item_id")
_STATE = _case(P.STATES, "store_id")


def _fold_values(rows) -> str:
    return ", ".join(f"('{n}', DATE '{s}', DATE '{e}')" for n, s, e in rows)


def _hash(salt: str, keys: str = "store_id || '/' || item_id") -> str:
    return f"CAST('0x' || substr(md5({keys} || '/' || {salt}), 1, 8) AS BIGINT)"


def _pick(choices: list, salt: str) -> str:
    return f"list_extract([{', '.join(str(c) for c in choices)}], CAST({_hash(salt)} % {len(choices)} + 1 AS INTEGER))"


NORMAL_QUANTILES = {level: NormalDist().inv_cdf(level) for level in P.SERVICE_LEVEL_CHOICES}


def _case_num(mapping: dict, key: str) -> str:
    arms = " ".join(f"WHEN {key} = {k} THEN {v!r}::DOUBLE" for k, v in mapping.items())
    return f"CASE {arms} END"


def _horner(x: str, coefficients: list[float]) -> str:
    text = f"{coefficients[0]!r}::DOUBLE"
    for coefficient in coefficients[1:]:
        text = f"({text} * {x} + {coefficient!r}::DOUBLE)"
    return text


def _normal_cdf(x: str) -> str:
    near = f"exp(-{x} * {x} / 2) * {_horner(f'abs({x})', CDF_NUMERATOR)} / {_horner(f'abs({x})', CDF_DENOMINATOR)}"
    return f"CASE WHEN {x} > 0 THEN 1 - CASE WHEN abs({x}) > 7 THEN 0 ELSE {near} END ELSE CASE WHEN abs({x}) > 7 THEN 0 ELSE {near} END END"


_LINES = """FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
_W = "PARTITION BY store_id, item_id ORDER BY date"


def _frame(n: int) -> str:
    return f"({_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def _rolled(expr: str, n: int) -> str:
    return f"CASE WHEN count(*) OVER {_frame(n)} = {n} THEN {expr} OVER {_frame(n)} END"


VIEWS: dict[str, str] = {
    "facts": f"""
    SELECT r_name AS store_id, p_type AS item_id, CAST(l_shipdate AS DATE) AS date,
      CAST(sum(l_quantity) AS BIGINT) AS sales, CAST(sum(round(l_extendedprice * 100)) AS BIGINT) AS cents
    {_LINES} GROUP BY 1, 2, 3""",
    "item_facts": f"""
    SELECT r_name AS store_id, p_partkey AS item_id, p_type AS dept_id, CAST(l_shipdate AS DATE) AS date,
      CAST(sum(l_quantity) AS BIGINT) AS sales, CAST(sum(round(l_extendedprice * 100)) AS BIGINT) AS cents
    {_LINES} GROUP BY 1, 2, 3, 4""",
    "bounds": "SELECT CAST(min(l_shipdate) AS DATE) AS lo, CAST(max(l_shipdate) AS DATE) AS hi FROM lineitem",
    "calendar": f"""
    SELECT date, 'd_' || CAST(date_diff('day', lo, date) + 1 AS VARCHAR) AS d,
      CAST(date_trunc('week', date) AS DATE) AS week_start, dayname(date) AS weekday,
      CAST(month(date) AS INTEGER) AS month, CAST(year(date) AS INTEGER) AS year,
      {_slot(P.EVENTS_1, 0)} AS event_name_1, {_slot(P.EVENTS_1, 1)} AS event_type_1,
      {_slot(P.EVENTS_2, 0)} AS event_name_2, {_slot(P.EVENTS_2, 1)} AS event_type_2, {_SNAPS}
    FROM (SELECT lo, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM bounds)""",
    "series": "SELECT DISTINCT store_id, item_id FROM facts",
    "weekly_price": """
    SELECT store_id, item_id, CAST(date_trunc('week', date) AS DATE) AS week_start,
      ((2 * sum(cents) + sum(sales)) // (2 * sum(sales))) / 100.0::DOUBLE AS sell_price
    FROM facts GROUP BY 1, 2, 3 HAVING sum(sales) > 0""",
    "panel": f"""
    SELECT c.*, s.store_id, s.item_id, CAST(coalesce(f.sales, 0) AS BIGINT) AS sales, w.sell_price,
      {_DEPT.replace('item_id', 's.item_id')} AS dept_id, '{P.CATEGORY}' AS cat_id,
      {_STATE.replace('store_id', 's.store_id')} AS state_id
    FROM series s CROSS JOIN calendar c
    LEFT JOIN facts f ON f.store_id = s.store_id AND f.item_id = s.item_id AND f.date = c.date
    LEFT JOIN weekly_price w ON w.store_id = s.store_id AND w.item_id = s.item_id AND w.week_start = c.week_start""",
    "band_thresholds": """
    SELECT quantile_cont(m, 1.0/3) AS q1, quantile_cont(m, 2.0/3) AS q2
    FROM (SELECT item_id, avg(sales) AS m FROM panel GROUP BY 1)""",
    "item_bands": """
    SELECT item_id, CASE WHEN m <= q1 THEN 'low' WHEN m <= q2 THEN 'medium' ELSE 'high' END AS demand_band
    FROM (SELECT item_id, avg(sales) AS m FROM panel GROUP BY 1), band_thresholds""",
    "flagged": """
    SELECT p.*, coalesce(first_price, first_sale) AS launch_date, date < coalesce(first_price, first_sale) AS prelaunch_flag,
      date >= coalesce(first_price, first_sale) AS active_flag, demand_band
    FROM (SELECT *, min(CASE WHEN sell_price IS NOT NULL THEN date END) OVER (PARTITION BY store_id, item_id) AS first_price,
            min(CASE WHEN sales > 0 THEN date END) OVER (PARTITION BY store_id, item_id) AS first_sale FROM panel) p
    JOIN item_bands USING (item_id)""",
    "active": """
    SELECT * EXCLUDE (launch_date, prelaunch_flag, active_flag, first_price, first_sale), launch_date AS availability_date, true AS is_active,
      CAST(date_diff('day', launch_date, date) AS INTEGER) AS product_age_days,
      CAST(date_diff('day', launch_date, date) // 7 AS INTEGER) AS product_age_weeks
    FROM flagged WHERE active_flag""",
    "weekly_features": """
    SELECT *, prev_price - prev2_price AS price_change, 100 * (prev_price / prev2_price - 1) AS price_pct_change,
      CASE WHEN c4 = 4 THEN prev_price / ((s4 - lo4 - hi4) / 2) - 1 END AS price_vs_median
    FROM (SELECT *, lag(weekly_price, 1) OVER w AS prev_price, lag(weekly_price, 2) OVER w AS prev2_price,
        count(weekly_price) OVER f AS c4, sum(weekly_price) OVER f AS s4, min(weekly_price) OVER f AS lo4, max(weekly_price) OVER f AS hi4
      FROM (SELECT store_id, item_id, week_start, min(date) AS first_date, min(sell_price) AS weekly_price,
              count(DISTINCT sell_price) AS distinct_prices FROM active GROUP BY 1, 2, 3)
      WINDOW w AS (PARTITION BY store_id, item_id ORDER BY week_start),
        f AS (PARTITION BY store_id, item_id ORDER BY week_start ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))""",
    "features": f"""
    SELECT *, sales_lag_1 IS NOT NULL AND sales_lag_7 IS NOT NULL AND sales_lag_14 IS NOT NULL AND sales_lag_28 IS NOT NULL
      AND sales_roll_mean_28 IS NOT NULL AND sales_roll_std_28 IS NOT NULL AND zero_rate_28 IS NOT NULL
      AND days_since_last_positive_sale IS NOT NULL AND previous_week_price IS NOT NULL AND price_change_previous_week IS NOT NULL
      AND price_pct_change_previous_week IS NOT NULL AND price_vs_4week_median_lagged IS NOT NULL AS is_feature_ready
    FROM (SELECT a.*, isodow(a.date) - 1 AS day_of_week, day(a.date) AS day_of_month, quarter(a.date) AS quarter,
      weekofyear(a.date) AS week_of_year, isodow(a.date) >= 6 AS is_weekend,
      sin(2 * pi() * (isodow(a.date) - 1) / 7) AS day_of_week_sin, cos(2 * pi() * (isodow(a.date) - 1) / 7) AS day_of_week_cos,
      sin(2 * pi() * (month - 1) / 12) AS month_sin, cos(2 * pi() * (month - 1) / 12) AS month_cos,
      event_name_1 IS NOT NULL OR event_name_2 IS NOT NULL AS is_event,
      CASE state_id WHEN 'EMEA' THEN snap_emea WHEN 'AMER' THEN snap_amer WHEN 'APAC' THEN snap_apac END AS snap_active,
      lag(sales, 1) OVER s AS sales_lag_1, lag(sales, 7) OVER s AS sales_lag_7,
      lag(sales, 14) OVER s AS sales_lag_14, lag(sales, 28) OVER s AS sales_lag_28,
      {_rolled('avg(sales)', 7)} AS sales_roll_mean_7, {_rolled('avg(sales)', 14)} AS sales_roll_mean_14,
      {_rolled('avg(sales)', 28)} AS sales_roll_mean_28,
      {_rolled('stddev_samp(sales)', 7)} AS sales_roll_std_7, {_rolled('stddev_samp(sales)', 28)} AS sales_roll_std_28,
      {_rolled('avg(CASE WHEN sales = 0 THEN 1.0 ELSE 0.0 END)', 7)} AS zero_rate_7,
      {_rolled('avg(CASE WHEN sales = 0 THEN 1.0 ELSE 0.0 END)', 28)} AS zero_rate_28,
      date_diff('day', max(CASE WHEN sales > 0 THEN a.date END) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a.date)
        AS days_since_last_positive_sale,
      prev_price AS previous_week_price, price_change AS price_change_previous_week,
      price_pct_change AS price_pct_change_previous_week, price_vs_median AS price_vs_4week_median_lagged
    FROM active a LEFT JOIN (SELECT store_id AS ws, item_id AS wi, week_start AS ww, prev_price, price_change, price_pct_change, price_vs_median FROM weekly_features)
      ON store_id = ws AND item_id = wi AND week_start = ww
    WINDOW s AS ({_W}))""",
    "fold_table": f"SELECT * FROM (VALUES {_fold_values(P.FOLDS)}) AS v(fold, start_date, end_date)",
    "fold_table_all": f"SELECT * FROM (VALUES {_fold_values([*P.FOLDS, P.LOCKED])}) AS v(fold, start_date, end_date)",
    "fold_history": """
    SELECT fold, start_date - 1 AS origin, store_id, item_id, dept_id, demand_band, date, sales,
      row_number() OVER (PARTITION BY fold, store_id, item_id ORDER BY date) AS pos,
      row_number() OVER (PARTITION BY fold, store_id, item_id ORDER BY date DESC) AS back,
      sales - lag(sales) OVER (PARTITION BY fold, store_id, item_id ORDER BY date) AS diff
    FROM active JOIN fold_table ON date < start_date""",
    "origins": """
    SELECT fold, origin, store_id, item_id, min(dept_id) AS dept_id, min(demand_band) AS demand_band,
      count(*) AS history_observations, max(date) AS history_end_date,
      CASE WHEN avg(diff * diff) > 0 THEN avg(diff * diff) END AS rmsse_scale,
      100 * avg(CASE WHEN sales = 0 THEN 1.0 ELSE 0.0 END) AS training_zero_pct,
      CASE WHEN 100 * avg(CASE WHEN sales = 0 THEN 1.0 ELSE 0.0 END) < 50 THEN 'regular'
           WHEN 100 * avg(CASE WHEN sales = 0 THEN 1.0 ELSE 0.0 END) <= 80 THEN 'intermittent'
           ELSE 'highly_intermittent' END AS intermittency_class,
      max(CASE WHEN back = 1 THEN sales END) AS last_value,
      avg(CASE WHEN back <= 28 THEN sales END) AS mean_28
    FROM fold_history GROUP BY 1, 2, 3, 4""",
    # Croston-SBA in closed form: the k-th positive of n has weight a(1-a)^(n-k), the first (1-a)^(n-1);
    # intervals use the gap to the previous positive, the first its own position.
    "croston": f"""
    SELECT o.fold, o.store_id, o.item_id, coalesce({1 - P.CROSTON_ALPHA / 2} * size / gap, 0.0) AS level
    FROM origins o LEFT JOIN (
      SELECT fold, store_id, item_id,
        sum(sales * pow({1 - P.CROSTON_ALPHA}, n - k) * CASE WHEN k = 1 THEN 1 ELSE {P.CROSTON_ALPHA} END) AS size,
        sum(gap * pow({1 - P.CROSTON_ALPHA}, n - k) * CASE WHEN k = 1 THEN 1 ELSE {P.CROSTON_ALPHA} END) AS gap
      FROM (SELECT fold, store_id, item_id, sales, pos - coalesce(lag(pos) OVER p, 0) AS gap,
              row_number() OVER p AS k, count(*) OVER (PARTITION BY fold, store_id, item_id) AS n
            FROM fold_history WHERE sales > 0 WINDOW p AS (PARTITION BY fold, store_id, item_id ORDER BY pos))
      GROUP BY 1, 2, 3) c USING (fold, store_id, item_id)""",
    "forecasts": """
    SELECT o.*, h AS horizon_day, o.origin + CAST(h AS INTEGER) AS target_date, m.model_name, m.forecast
    FROM (SELECT o.*, level, unnest(generate_series(1, 30)) AS h FROM origins o JOIN croston USING (fold, store_id, item_id)) o
    JOIN (SELECT fold AS ff, store_id AS fs, item_id AS fi, back, sales FROM fold_history WHERE back <= 7) b
      ON ff = fold AND fs = store_id AND fi = item_id AND back = 7 - ((h - 1) % 7)
    CROSS JOIN LATERAL (VALUES ('zero', 0.0::DOUBLE), ('last_value', last_value::DOUBLE), ('seasonal_naive_7', b.sales::DOUBLE),
      ('mean_28', mean_28::DOUBLE), ('croston_sba', level::DOUBLE)) AS m(model_name, forecast)""",
    "predictions": """
    SELECT f.fold, f.model_name, f.store_id, f.item_id, f.dept_id, f.demand_band, f.intermittency_class, f.training_zero_pct,
      f.origin AS forecast_origin, f.history_end_date, f.history_observations, f.target_date, f.horizon_day, f.forecast, f.rmsse_scale,
      v.sales AS actual
    FROM forecasts f LEFT JOIN features v ON v.store_id = f.store_id AND v.item_id = f.item_id AND v.date = f.target_date""",
    "horizon_specs": "SELECT * FROM (VALUES "
    + ", ".join(f"('{n}', {d}, {str(a).lower()})" for n, d, a in P.HORIZON_SPECS)
    + ") AS v(horizon, horizon_days, is_aggregate)",
    "series_errors": """
    SELECT fold, model_name, horizon, horizon_days, is_aggregate, store_id, item_id, dept_id, demand_band, intermittency_class,
      CASE WHEN is_aggregate THEN 1 ELSE count(*) END AS n,
      sum(actual) AS actual_sum, sum(forecast) AS forecast_sum,
      CASE WHEN is_aggregate THEN abs(sum(forecast) - sum(actual)) ELSE sum(abs(forecast - actual)) END AS abs_error,
      CASE WHEN is_aggregate THEN pow(sum(forecast) - sum(actual), 2) ELSE sum(pow(forecast - actual, 2)) END AS sq_error,
      CASE WHEN is_aggregate THEN abs(sum(forecast) - sum(actual)) / sqrt(horizon_days * max(rmsse_scale))
           ELSE sqrt(avg(pow(forecast - actual, 2)) / max(rmsse_scale)) END AS series_rmsse
    FROM predictions JOIN horizon_specs ON horizon_day <= horizon_days
    GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9, 10""",
    "segment_errors": """
    SELECT e.*, g.segment_type, g.segment_value FROM series_errors e
    CROSS JOIN LATERAL (VALUES ('overall', 'all'), ('demand_band', demand_band), ('store_id', store_id), ('dept_id', dept_id),
      ('intermittency_class', intermittency_class)) AS g(segment_type, segment_value)""",
    "metrics": """
    SELECT CASE WHEN grouping(fold) = 1 THEN 'combined' ELSE fold END AS fold, model_name, horizon, horizon_days,
      CASE WHEN is_aggregate THEN 'aggregate' ELSE 'daily' END AS evaluation_type, segment_type, segment_value,
      sum(abs_error) / sum(n) AS mae, sqrt(sum(sq_error) / sum(n)) AS rmse, sum(abs_error) / nullif(sum(actual_sum), 0) AS wape,
      (sum(forecast_sum) - sum(actual_sum)) / sum(n) AS bias, sum(forecast_sum) - sum(actual_sum) AS aggregate_bias,
      CAST(sum(actual_sum) AS BIGINT) AS actual_sum, sum(forecast_sum) AS forecast_sum, CAST(sum(n) AS BIGINT) AS observations,
      avg(series_rmsse) AS rmsse, count(series_rmsse) AS rmsse_defined_series, count(*) - count(series_rmsse) AS rmsse_undefined_series
    FROM segment_errors
    GROUP BY GROUPING SETS ((fold, model_name, horizon, horizon_days, is_aggregate, segment_type, segment_value),
      (model_name, horizon, horizon_days, is_aggregate, segment_type, segment_value))""",
    "inv_state": f"""
    SELECT store_id, item_id, ({_hash("'a'")} % 400)::DOUBLE AS on_hand, ({_hash("'b'")} % 60)::DOUBLE AS on_order, ({_hash("'c'")} % 3)::DOUBLE AS backorders,
      {_pick(P.LEAD_TIME_CHOICES, "'d'")} AS lead_time_days, {_pick(P.SERVICE_LEVEL_CHOICES, "'e'")}::DOUBLE AS service_level,
      0.02::DOUBLE AS holding_cost_per_unit_per_day, 5.0::DOUBLE AS stockout_cost_per_unit, 25.0::DOUBLE AS fixed_order_cost
    FROM series""",
    "deploy_steps": f"""
    SELECT store_id, item_id, max(date) AS forecast_origin, 0 AS horizon_day, list(sales::DOUBLE ORDER BY date) AS hist, 0.0::DOUBLE AS forecast
    FROM active WHERE date > DATE '{P.LOCKED[2]}' - 28 AND date <= DATE '{P.LOCKED[2]}' GROUP BY 1, 2
    UNION ALL
    SELECT store_id, item_id, forecast_origin, horizon_day + 1, list_append(hist[2:], list_avg(hist)), list_avg(hist) FROM deploy_steps WHERE horizon_day < 30""",
    "deployed": """
    SELECT store_id, item_id, forecast_origin, forecast_origin + horizon_day AS target_date, horizon_day, forecast FROM deploy_steps WHERE horizon_day > 0""",
    "calibration": """
    SELECT s.store_id, s.item_id, s.dept_id, demand_band, intermittency_class,
      CASE WHEN s.n >= 60 AND s.sd > 0 THEN 'item_store' WHEN d.n > 1 AND d.sd > 0 THEN 'department_store' ELSE 'global' END AS calibration_level,
      CASE WHEN s.n >= 60 AND s.sd > 0 THEN s.n WHEN d.n > 1 AND d.sd > 0 THEN d.n ELSE g.n END AS calibration_count,
      CASE WHEN s.n >= 60 AND s.sd > 0 THEN s.m WHEN d.n > 1 AND d.sd > 0 THEN d.m ELSE g.m END AS residual_mean,
      CASE WHEN s.n >= 60 AND s.sd > 0 THEN s.sd WHEN d.n > 1 AND d.sd > 0 THEN d.sd ELSE g.sd END AS sigma_daily,
      CASE WHEN s.n >= 60 AND s.sd > 0 THEN s.r WHEN d.n > 1 AND d.sd > 0 THEN d.r ELSE g.r END AS residual_rmse
    FROM (SELECT store_id, item_id, min(dept_id) AS dept_id, min(demand_band) AS demand_band, arg_max(intermittency_class, target_date) AS intermittency_class,
        count(*) AS n, avg(actual - forecast) AS m, stddev_samp(actual - forecast) AS sd, sqrt(avg(pow(actual - forecast, 2))) AS r
      FROM predictions WHERE model_name = 'mean_28' GROUP BY 1, 2) s
    LEFT JOIN (SELECT store_id, dept_id, count(*) AS n, avg(actual - forecast) AS m, stddev_samp(actual - forecast) AS sd, sqrt(avg(pow(actual - forecast, 2))) AS r
      FROM predictions WHERE model_name = 'mean_28' GROUP BY 1, 2) d ON d.store_id = s.store_id AND d.dept_id = s.dept_id
    CROSS JOIN (SELECT count(*) AS n, avg(actual - forecast) AS m, stddev_samp(actual - forecast) AS sd, sqrt(avg(pow(actual - forecast, 2))) AS r
      FROM predictions WHERE model_name = 'mean_28') g""",
    "inv_base": f"""
    SELECT *, lead_time_demand + safety_stock AS reorder_point, planning_horizon_demand + safety_stock AS target_stock_level,
      sigma_daily * sqrt(lead_time_days) AS spread
    FROM (SELECT c.*, s.* EXCLUDE (store_id, item_id), on_hand + on_order - backorders AS inventory_position, lead_time_days + 7 AS planning_horizon_days,
        {_case_num(NORMAL_QUANTILES, 'service_level')} * sigma_daily * sqrt(lead_time_days) AS safety_stock, f.* EXCLUDE (fs, fi)
      FROM calibration c JOIN inv_state s ON s.store_id = c.store_id AND s.item_id = c.item_id
      JOIN (SELECT d.store_id AS fs, d.item_id AS fi, sum(CASE WHEN horizon_day <= 1 THEN forecast END) AS forecast_1d,
          sum(CASE WHEN horizon_day <= 7 THEN forecast END) AS forecast_7d, sum(forecast) AS forecast_30d, avg(forecast) AS mean_daily_forecast,
          sum(CASE WHEN horizon_day <= lead_time_days THEN forecast END) AS lead_time_demand,
          sum(CASE WHEN horizon_day <= lead_time_days + 7 THEN forecast END) AS planning_horizon_demand
        FROM deployed d JOIN inv_state i ON i.store_id = d.store_id AND i.item_id = d.item_id GROUP BY 1, 2) f ON fs = c.store_id AND fi = c.item_id)""",
    "inv_service": f"""
    SELECT *, CASE WHEN recommended_order_qty_raw <= 0 THEN 'NONE' WHEN priority_score >= 75 THEN 'URGENT' WHEN priority_score >= 50 THEN 'HIGH'
        WHEN priority_score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS priority_label
    FROM (SELECT *, CASE WHEN inventory_position <= 0 THEN 'STOCKOUT' WHEN stockout_risk >= 0.75 THEN 'CRITICAL' WHEN inventory_position <= reorder_point THEN 'REORDER NOW'
        WHEN days_of_supply < 10 THEN 'LOW' WHEN target_stock_level > 0 AND inventory_position > 1.5 * target_stock_level THEN 'OVERSTOCK' ELSE 'HEALTHY' END AS stock_status,
      CASE WHEN recommended_order_qty_raw <= 0 THEN 0.0::DOUBLE ELSE 100 * (0.5 * stockout_risk
        + 0.3 * greatest(reorder_point - inventory_position, 0) / greatest(reorder_point, 1)
        + 0.2 * greatest(target_stock_level - inventory_position, 0) / greatest(target_stock_level, 1)) END AS priority_score
    FROM (SELECT *, greatest(0.0, target_stock_level - inventory_position) AS recommended_order_qty_raw,
        CAST(ceil(greatest(0.0, target_stock_level - inventory_position)) AS BIGINT) AS recommended_order_qty,
        CASE WHEN mean_daily_forecast > 1e-9 THEN greatest(inventory_position, 0) / mean_daily_forecast END AS days_of_supply,
        CASE WHEN spread <= 1e-9 THEN CASE WHEN lead_time_demand > inventory_position THEN 1.0 ELSE 0.0 END
          ELSE 1 - ({_normal_cdf('((inventory_position - lead_time_demand) / spread)')}) END AS stockout_risk
      FROM inv_base))""",
    "inv_scenarios": """
    SELECT store_id, item_id, s AS scenario, sum(greatest(forecast + residual_mean + sigma_daily * sqrt(-2 * ln(u1)) * cos(2 * pi() * u2), 0)) AS demand
    FROM (SELECT b.store_id, b.item_id, s, forecast, residual_mean, sigma_daily,
        (CAST('0x' || substr(md5(b.store_id || '/' || b.item_id || '/' || s || '/' || horizon_day), 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE AS u1,
        (CAST('0x' || substr(md5(b.store_id || '/' || b.item_id || '/' || s || '/' || horizon_day), 9, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE AS u2
      FROM inv_base b JOIN deployed d ON d.store_id = b.store_id AND d.item_id = b.item_id AND horizon_day <= planning_horizon_days
      CROSS JOIN (SELECT unnest(generate_series(1, 300)) AS s))
    GROUP BY 1, 2, 3""",
    "inv_grid": """
    SELECT store_id, item_id, inventory_position, unnest(list_distinct(list_concat([0::BIGINT, recommended_order_qty],
      CASE WHEN upper_q + 1 <= 301 THEN generate_series(0::BIGINT, upper_q)
        ELSE list_transform(generate_series(0, 300), lambda i: CASE WHEN i = 300 THEN upper_q ELSE CAST(ceil(i * (upper_q / 300.0::DOUBLE)) AS BIGINT) END) END))) AS quantity
    FROM (SELECT v.store_id, v.item_id, inventory_position, recommended_order_qty,
        CAST(ceil(greatest(recommended_order_qty::DOUBLE, greatest(q - inventory_position, 0)) * 1.1::DOUBLE) AS BIGINT) AS upper_q
      FROM inv_service v JOIN (SELECT store_id, item_id, quantile_cont(demand, 0.995) AS q FROM inv_scenarios GROUP BY 1, 2) h
        ON h.store_id = v.store_id AND h.item_id = v.item_id)""",
    "inv_costs": """
    SELECT e.*, excess * holding_cost_per_unit_per_day * planning_horizon_days / 2 AS holding_cost, shortage * stockout_cost_per_unit AS shortage_cost,
      round(excess * holding_cost_per_unit_per_day * planning_horizon_days / 2 + shortage * stockout_cost_per_unit
        + CASE WHEN quantity > 0 THEN fixed_order_cost ELSE 0 END, 9) AS expected_cost, recommended_order_qty
    FROM (SELECT g.store_id, g.item_id, quantity, avg(greatest(inventory_position + quantity - demand, 0)) AS excess, avg(greatest(demand - inventory_position - quantity, 0)) AS shortage
      FROM inv_grid g JOIN inv_scenarios s ON s.store_id = g.store_id AND s.item_id = g.item_id GROUP BY 1, 2, 3) e
    JOIN inv_service v ON v.store_id = e.store_id AND v.item_id = e.item_id""",
    "recommendations": """
    SELECT v.*, c.* EXCLUDE (store_id, item_id), estimated_cost_without_order - estimated_cost_with_recommendation AS estimated_cost_savings
    FROM inv_service v JOIN (SELECT store_id, item_id, arg_min(quantity, (expected_cost, quantity)) AS cost_optimized_order_qty,
        min(expected_cost) AS estimated_cost_with_recommendation, max(CASE WHEN quantity = 0 THEN expected_cost END) AS estimated_cost_without_order,
        max(CASE WHEN quantity = recommended_order_qty THEN expected_cost END) AS estimated_cost_with_service_order,
        max(CASE WHEN quantity = 0 THEN shortage END) AS expected_shortage_without_order, max(CASE WHEN quantity = 0 THEN excess END) AS expected_excess_without_order,
        arg_min(shortage, (expected_cost, quantity)) AS expected_shortage_with_recommendation, arg_min(excess, (expected_cost, quantity)) AS expected_excess_with_recommendation,
        count(*) AS candidate_count, max(quantity) AS candidate_max
      FROM inv_costs GROUP BY 1, 2) c ON c.store_id = v.store_id AND c.item_id = v.item_id""",
}

# What-if: every override set applied to every saved state. The views of the decision are reused on keys that carry the
# name of the set before the store; random draws stay those of the plain key.
OVERRIDES = {
    "saved": {},
    "no stock": {"on_hand": 0.0, "on_order": 0.0},
    "longer lead time": {"lead_time_days": 14, "service_level": 0.99},
    "higher service": {"service_level": 0.99},
    "shorter review": {"review_period_days": 3},
    "other costs": {"holding_cost_per_unit_per_day": 0.05, "stockout_cost_per_unit": 9.0, "fixed_order_cost": 10.0},
    "more on order": {"on_order": 500.0, "backorders": 0.0},
}


def _what_if_views() -> dict[str, str]:
    inputs = ["on_hand", "on_order", "backorders", "lead_time_days", "service_level", "holding_cost_per_unit_per_day", "stockout_cost_per_unit", "fixed_order_cost"]

    def value(sets: dict, name: str, saved: str) -> str:
        arms = " ".join(f"WHEN '{k}' THEN {v[name]}" for k, v in sets.items() if name in v)
        cast = "BIGINT" if name.endswith("_days") else "DOUBLE"
        return f"CAST(CASE what_if {arms} ELSE {saved} END AS {cast}) AS {name}" if arms else f"CAST({saved} AS {cast}) AS {name}"

    sets = "(SELECT unnest([" + ", ".join(f"'{k}'" for k in OVERRIDES) + "]) AS what_if)"
    views = {
        "wi_state": f"SELECT what_if || '|' || store_id AS store_id, item_id, {', '.join(value(OVERRIDES, n, n) for n in inputs)}, {value(OVERRIDES, 'review_period_days', '7')} FROM inv_state, {sets}",
        "wi_deployed": f"SELECT d.* EXCLUDE (store_id), what_if || '|' || store_id AS store_id FROM deployed d, {sets}",
        "wi_calibration": f"SELECT c.* EXCLUDE (store_id), what_if || '|' || store_id AS store_id FROM calibration c, {sets}",
    }
    for name in ("base", "service", "scenarios", "grid", "costs"):
        text = VIEWS[f"inv_{name}"].replace("inv_", "wi_").replace("FROM calibration", "FROM wi_calibration").replace("deployed d", "wi_deployed d")
        text = text.replace("lead_time_days + 7", "lead_time_days + review_period_days").replace("md5(b.store_id", "md5(split_part(b.store_id, '|', 2)")
        views[f"wi_{name}"] = text
    views["wi_recommendations"] = VIEWS["recommendations"].replace("inv_", "wi_")
    views["wi_result"] = "SELECT split_part(store_id, '|', 1) AS what_if, split_part(store_id, '|', 2) AS store_id, * EXCLUDE (store_id) FROM wi_recommendations"
    return views


VIEWS |= _what_if_views()
