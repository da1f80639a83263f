"""Residual calibration and replenishment decisions, one row per series.

The daily forecast of a series is an array of at most ``HORIZON`` values; scenario and
candidate rows per series are bounded by policy parameters, so the only exchanges are the
ones that bring forecast, state and calibration of a series together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandloom.functions.columns import all_of, clip, ratio
from demandloom.functions.normal import normal_cdf, normal_inverse
from demandloom.operators.forecast import total
from demandloom.sources.parameters import HORIZON, POLICY, SERIES
from demandloom.sources.retail import by_series

NEAR_ZERO = 1e-9


# --- calibration -----------------------------------------------------------------------

def residual_aggregates() -> list[Column]:
    residual = F.col("actual") - F.col("forecast")
    return [
        F.avg(residual).alias("residual_mean"),
        F.stddev_samp(residual).alias("residual_std"),
        F.sqrt(F.avg(residual * residual)).alias("residual_rmse"),
        F.count(F.lit(1)).alias("calibration_count"),
    ]


def residual_summary(predictions: DataFrame, *keys: str) -> DataFrame:
    return predictions.groupBy(*keys).agg(*residual_aggregates())


def residual_levels(predictions: DataFrame) -> DataFrame:
    """Series, department-store and global residual statistics from one pass."""
    sets = [["store_id", "item_id"], ["store_id", "dept_id"], []]
    level = (
        F.when(F.grouping("item_id") == 0, "item_store").when(F.grouping("dept_id") == 0, "department_store").otherwise("global")
    )
    return predictions.groupingSets(sets, "store_id", "item_id", "dept_id").agg(*residual_aggregates(), level.alias("level"))


def latest_class(predictions: DataFrame) -> DataFrame:
    """Static attributes and the intermittency class of the newest prediction."""
    return predictions.groupBy(*SERIES).agg(
        F.min("dept_id").alias("dept_id"),
        F.min("demand_band").alias("demand_band"),
        F.max_by("intermittency_class", "target_date").alias("intermittency_class"),
    )


def calibrate(predictions: DataFrame, minimum: int = POLICY["minimum_series_observations"], model: str = "mean_28") -> DataFrame:
    """Residual statistics per series, falling back to department-store, then global."""
    chosen = predictions.where(F.col("model_name") == model)
    stats = ["residual_mean", "residual_std", "residual_rmse", "calibration_count"]
    series = residual_summary(chosen, *SERIES).join(latest_class(chosen), SERIES)
    levels = residual_levels(chosen)
    fallback = levels.where(F.col("level") == "department_store").select(
        "store_id", "dept_id", *[F.col(s).alias(f"_d_{s}") for s in stats]
    )
    whole = levels.where(F.col("level") == "global")
    joined = series.join(fallback, ["store_id", "dept_id"], "left")
    enough = (F.col("calibration_count") >= minimum) & (F.coalesce("residual_std", F.lit(0.0)) > 0)
    usable = (F.col("_d_calibration_count") > 1) & (F.coalesce("_d_residual_std", F.lit(0.0)) > 0)

    def pick(stat: str) -> Column:
        return F.when(enough, F.col(stat)).when(usable, F.col(f"_d_{stat}")).otherwise(whole.select(stat).scalar())

    return joined.select(
        *SERIES, "dept_id", "demand_band", "intermittency_class",
        F.when(enough, "item_store").when(usable, "department_store").otherwise("global").alias("calibration_level"),
        pick("calibration_count").alias("calibration_count"),
        pick("residual_mean").alias("residual_mean"),
        pick("residual_std").alias("sigma_daily"),
        pick("residual_rmse").alias("residual_rmse"),
    )


# --- formulas --------------------------------------------------------------------------

def inventory_position(on_hand: Column, on_order: Column, backorders: Column) -> Column:
    invalid = (on_hand < 0) | (on_order < 0) | (backorders < 0)
    fail = F.raise_error(F.lit("stock quantities must not be negative")).cast("double")
    return F.when(invalid, fail).otherwise(on_hand + on_order - backorders)


def safety_stock(service_level: Column, sigma: Column, lead_time: Column) -> Column:
    return normal_inverse(service_level) * sigma * F.sqrt(lead_time.cast("double"))


def order_quantity(target: Column, position: Column) -> tuple[Column, Column]:
    raw = F.greatest(F.lit(0.0), target - position)
    return raw, F.ceil(raw)


def days_of_supply(position: Column, mean_daily: Column) -> tuple[Column, Column]:
    days = F.when(mean_daily > NEAR_ZERO, F.greatest(position, F.lit(0.0)) / F.nullif(mean_daily, F.lit(0.0)))
    label = F.when(days.isNull(), "NO EXPECTED DEMAND").otherwise(F.format_string("%.1f days", days))
    return days, label


def stockout_probability(position: Column, lead_demand: Column, sigma: Column, lead_time: Column) -> Column:
    spread = sigma * F.sqrt(lead_time.cast("double"))
    certain = F.when(lead_demand > position, 1.0).otherwise(0.0)
    z = (position - lead_demand) / F.nullif(spread, F.lit(0.0))
    return F.when(spread <= NEAR_ZERO, certain).otherwise(clip(1 - normal_cdf(z), 0.0, 1.0))


def stock_status(policy: dict = POLICY) -> Column:
    """First matching status; LOW is tested before OVERSTOCK."""
    position, target = F.col("inventory_position"), F.col("target_stock_level")
    return (
        F.when(position <= 0, "STOCKOUT")
        .when(F.col("stockout_risk") >= policy["critical_risk_threshold"], "CRITICAL")
        .when(position <= F.col("reorder_point"), "REORDER NOW")
        .when(F.col("days_of_supply") < policy["low_stock_days"], "LOW")
        .when((target > 0) & (position > policy["overstock_multiplier"] * target), "OVERSTOCK")
        .otherwise("HEALTHY")
    )


def priority(policy: dict = POLICY) -> tuple[Column, Column]:
    """Score in 0..100 and its label; NONE whenever nothing is ordered."""
    position = F.col("inventory_position")

    def gap(level: str) -> Column:
        return clip(F.greatest(F.col(level) - position, F.lit(0.0)) / F.greatest(F.col(level), F.lit(1.0)), 0.0, 1.0)

    weighted = 100 * (
        policy["weight_risk"] * clip(F.col("stockout_risk"), 0.0, 1.0)
        + policy["weight_reorder_gap"] * gap("reorder_point")
        + policy["weight_target_gap"] * gap("target_stock_level")
    )
    ordered = F.col("recommended_order_qty_raw") > 0
    score = F.when(ordered, clip(weighted, 0.0, 100.0)).otherwise(0.0)
    label = (
        F.when(~ordered, "NONE").when(score >= policy["urgent"], "URGENT")
        .when(score >= policy["high"], "HIGH").when(score >= policy["medium"], "MEDIUM").otherwise("LOW")
    )
    return score, label


# --- decisions -------------------------------------------------------------------------

def daily_arrays(forecast: DataFrame, *static: str) -> DataFrame:
    """Forecast rows of a series as one ordered array (length = horizon)."""
    return forecast.groupBy(*SERIES).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("horizon_day", "forecast"))), lambda s: s["forecast"]).alias("daily"),
        *[F.min(c).alias(c) for c in static],
    )


def decision_inputs(forecast: DataFrame, state: DataFrame, calibration: DataFrame) -> DataFrame:
    """Forecast, stock state and calibration per series; the three key sets must be equal.

    The one-row-per-series sources are stacked and grouped by series: one exchange instead
    of two full outer joins, and a missing or repeated key fails the job.
    """
    parts = {"forecast": daily_arrays(forecast), "state": state, "calibration": calibration}
    stacked = None
    for name, part in parts.items():
        tagged = part.select("*", *[F.lit(int(name == other)).alias(f"_{other}") for other in parts])
        stacked = tagged if stacked is None else stacked.unionByName(tagged, allowMissingColumns=True)
    values = [c for c in stacked.columns if c not in SERIES and not c.startswith("_")]
    grouped = by_series(stacked).groupBy(*SERIES).agg(
        *[F.max(c).alias(c) for c in values], *[F.sum(f"_{name}").alias(f"_{name}") for name in parts]
    )
    complete = all_of(F.col(f"_{name}") == 1 for name in parts)
    fail = F.raise_error(F.lit("forecast, stock state and calibration keys do not match")).cast("boolean")
    return grouped.where(F.when(complete, True).otherwise(fail)).select(*SERIES, *values)


def with_policy(inputs: DataFrame, policy: dict = POLICY) -> DataFrame:
    """Series values where present, policy values elsewhere."""
    names = ["lead_time_days", "service_level", "review_period_days", "holding_cost_per_unit_per_day",
             "stockout_cost_per_unit", "fixed_order_cost"]
    filled = {
        n: F.coalesce(F.col(n), F.lit(policy[n])) if n in inputs.columns else F.lit(policy[n]) for n in names
    }
    return inputs.withColumns(filled)


def policy_violations(inputs: DataFrame) -> DataFrame:
    """Counts of out-of-range policy values."""
    rules = {
        "service_level": ~((F.col("service_level") > 0.5) & (F.col("service_level") < 1)),
        "lead_time_days": ~F.col("lead_time_days").between(1, 30),
        "review_period_days": F.col("review_period_days") < 0,
        "holding_cost_per_unit_per_day": F.col("holding_cost_per_unit_per_day") < 0,
        "stockout_cost_per_unit": F.col("stockout_cost_per_unit") < 0,
        "fixed_order_cost": F.col("fixed_order_cost") < 0,
    }
    counted = inputs.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    return counted.unpivot([], list(rules), "parameter", "violations")


def demand_windows(inputs: DataFrame) -> DataFrame:
    """Lead-time and planning-horizon demand; the horizon must cover the planning days."""
    planning = F.col("lead_time_days") + F.col("review_period_days")
    short = F.raise_error(F.lit("forecast horizon shorter than lead time plus review")).cast("int")
    covered = F.when(planning <= F.size("daily"), planning).otherwise(short).cast("int")

    def first_days(n: Column) -> Column:
        return total(F.slice("daily", F.lit(1), n))

    return inputs.withColumn("planning_horizon_days", covered).withColumns({
        "forecast_1d": first_days(F.lit(1)),
        "forecast_7d": first_days(F.lit(7)),
        "forecast_30d": first_days(F.lit(HORIZON)),
        "mean_daily_forecast": total(F.col("daily")) / F.size("daily"),
        "lead_time_demand": first_days(F.col("lead_time_days")),
        "planning_horizon_demand": first_days(F.col("planning_horizon_days")),
    })


def service_decision(inputs: DataFrame, policy: dict = POLICY) -> DataFrame:
    """Position, safety stock, reorder point, order, risk, status and priority."""
    base = demand_windows(with_policy(inputs, policy)).withColumns({
        "inventory_position": inventory_position(F.col("on_hand"), F.col("on_order"), F.col("backorders")),
        "safety_stock": safety_stock(F.col("service_level"), F.col("sigma_daily"), F.col("lead_time_days")),
    }).withColumns({
        "reorder_point": F.col("lead_time_demand") + F.col("safety_stock"),
        "target_stock_level": F.col("planning_horizon_demand") + F.col("safety_stock"),
    })
    raw, units = order_quantity(F.col("target_stock_level"), F.col("inventory_position"))
    days, label = days_of_supply(F.col("inventory_position"), F.col("mean_daily_forecast"))
    risk = stockout_probability(
        F.col("inventory_position"), F.col("lead_time_demand"), F.col("sigma_daily"), F.col("lead_time_days")
    )
    decided = base.withColumns({
        "recommended_order_qty_raw": raw,
        "recommended_order_qty": units,
        "days_of_supply": days,
        "days_of_supply_label": label,
        "stockout_risk": risk,
    })
    score, level = priority(policy)
    return decided.withColumns({"stock_status": stock_status(policy), "priority_score": score, "priority_label": level})


# --- cost-aware quantity ---------------------------------------------------------------

def scenario_noise(scenario: Column, day: Column) -> Column:
    """Standard normal draw from one md5 per (series, scenario, day): two uniforms, Box-Muller."""
    digest = F.md5(F.concat_ws("/", "store_id", "item_id", scenario.cast("string"), day.cast("string")))

    def uniform(start: int) -> Column:
        return (F.conv(F.substring(digest, start, 8), 16, 10).cast("double") + 0.5) / 4294967296.0

    return F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * F.pi() * uniform(9))


def demand_scenarios(decisions: DataFrame, keys: list[str], count: int = POLICY["scenario_count"]) -> DataFrame:
    """``count`` noisy planning-horizon totals per series; the same draws on every rerun."""
    kept = [c for c in decisions.columns if c not in (*keys, "daily")]
    numbered = decisions.select("*", F.explode(F.sequence(F.lit(1), F.lit(count))).alias("scenario"))
    days = F.sequence(F.lit(1), F.col("planning_horizon_days"))

    def add(acc: Column, day: Column) -> Column:
        noise = F.col("residual_mean") + F.col("sigma_daily") * scenario_noise(F.col("scenario"), day)
        return acc + F.greatest(F.element_at("daily", day) + noise, F.lit(0.0))

    decision = F.when(F.col("scenario") == 1, F.struct(*kept)).alias("decision")
    return numbered.select(*keys, "scenario", F.aggregate(days, F.lit(0.0), add).alias("demand"), decision)


def with_candidates(scenarios: DataFrame, keys: list[str], policy: dict = POLICY) -> DataFrame:
    """One row per key: the scenario totals, the decision columns and the candidate quantities.

    Quantities are a bounded grid 0..upper that always holds 0 and the service order.
    The aggregation reuses the key partitioning, and evaluates each scenario once.
    """
    points = policy["maximum_candidate_points"]
    drawn = scenarios.groupBy(*keys).agg(
        F.collect_list("demand").alias("demands"),
        F.percentile("demand", F.lit(policy["upper_quantile"])).alias("_high"),
        F.max("decision").alias("decision"),
    ).select(*keys, "demands", "_high", "decision.*")
    need = F.greatest(F.col("_high") - F.col("inventory_position"), F.lit(0.0))
    upper = F.ceil(F.greatest(F.col("recommended_order_qty").cast("double"), need) * policy["upper_buffer"])
    step = F.col("_upper") / F.lit(float(points - 1))
    spaced = F.transform(
        F.sequence(F.lit(0), F.lit(points - 1)),
        lambda i: F.when(i == points - 1, F.col("_upper")).otherwise(F.ceil(i * step)),
    )
    every = F.sequence(F.lit(0).cast("bigint"), F.least(F.col("_upper"), F.lit(points)))
    grid = F.when(F.col("_upper") + 1 <= points, every).otherwise(spaced)
    always = F.array(F.lit(0).cast("bigint"), F.col("recommended_order_qty"))
    return drawn.withColumn("_upper", upper).withColumn(
        "quantities", F.array_distinct(F.concat(grid, always))
    ).drop("_upper", "_high")


COST_TERMS = [
    "planning_horizon_days", "holding_cost_per_unit_per_day", "stockout_cost_per_unit", "fixed_order_cost",
    "recommended_order_qty",
]


def candidate_costs(prepared: DataFrame, keys: list[str], carry: list[str] = ()) -> DataFrame:
    """Expected surplus, shortage and cost of every candidate.

    Scenario demands and candidate supplies of a series are swept once in value order:
    running count and sum of the demands below a supply give both expectations, so the
    candidates x scenarios product is never built and the rows never leave their partition.
    ``carry`` columns travel on the zero-quantity row only.
    """
    nothing = F.lit(None).cast("bigint")
    supply = F.transform("quantities", lambda q: F.struct(
        q.alias("quantity"), (F.col("inventory_position") + q).alias("level"), F.lit(0).alias("_n"), F.lit(0.0).alias("_demand")
    ))
    demand = F.transform("demands", lambda x: F.struct(
        nothing.alias("quantity"), x.alias("level"), F.lit(1).alias("_n"), x.alias("_demand")
    ))
    rows = prepared.select(*keys, *COST_TERMS, *carry, F.inline_outer(F.concat(supply, demand)))
    if carry:
        kept = F.when(F.col("quantity") == 0, F.struct(*carry)).alias("_carried")
        rows = rows.select(*keys, *COST_TERMS, "quantity", "level", "_n", "_demand", kept)
    series = W.partitionBy(*keys)
    sweep = series.orderBy("level").rangeBetween(W.unboundedPreceding, W.currentRow)
    swept = rows.withColumns({
        "_below": F.sum("_n").over(sweep),
        "_below_sum": F.sum("_demand").over(sweep),
        "_all": F.sum("_n").over(series),
        "_all_sum": F.sum("_demand").over(series),
    }).where(F.col("quantity").isNotNull())
    level, below, below_sum = F.col("level"), F.col("_below"), F.col("_below_sum")
    priced = swept.withColumns({
        "expected_excess": (level * below - below_sum) / F.col("_all"),
        "expected_shortage": (F.col("_all_sum") - below_sum - level * (F.col("_all") - below)) / F.col("_all"),
    })
    holding = F.col("expected_excess") * F.col("holding_cost_per_unit_per_day") * F.col("planning_horizon_days") / 2
    shortage = F.col("expected_shortage") * F.col("stockout_cost_per_unit")
    fixed = F.when(F.col("quantity") > 0, F.col("fixed_order_cost")).otherwise(0.0)
    return priced.withColumns({
        "holding_cost": holding, "shortage_cost": shortage, "fixed_cost": fixed,
        "expected_cost": F.round(holding + shortage + fixed, 9),
    })


def cheapest_orders(costs: DataFrame, keys: list[str]) -> DataFrame:
    """Least cost, then least quantity; plus the costs of ordering nothing and the service order."""
    best = F.min(F.struct("expected_cost", "quantity", "expected_shortage", "expected_excess"))
    none = F.col("quantity") == 0
    service = F.col("quantity") == F.col("recommended_order_qty")
    carried = "_carried" in costs.columns
    picked = costs.groupBy(*keys).agg(
        best.alias("_best"),
        F.max(F.when(none, F.col("expected_cost"))).alias("estimated_cost_without_order"),
        F.max(F.when(service, F.col("expected_cost"))).alias("estimated_cost_with_service_order"),
        F.max(F.when(none, F.col("expected_shortage"))).alias("expected_shortage_without_order"),
        F.max(F.when(none, F.col("expected_excess"))).alias("expected_excess_without_order"),
        F.count(F.lit(1)).alias("candidate_count"),
        F.max("quantity").alias("candidate_max"),
        *([F.max("_carried").alias("_carried")] if carried else []),
    )
    return picked.select(
        *keys,
        *(["_carried.*"] if carried else []),
        F.col("_best.quantity").alias("cost_optimized_order_qty"),
        "estimated_cost_without_order",
        F.col("_best.expected_cost").alias("estimated_cost_with_recommendation"),
        "estimated_cost_with_service_order",
        (F.col("estimated_cost_without_order") - F.col("_best.expected_cost")).alias("estimated_cost_savings"),
        "expected_shortage_without_order", "expected_excess_without_order",
        F.col("_best.expected_shortage").alias("expected_shortage_with_recommendation"),
        F.col("_best.expected_excess").alias("expected_excess_with_recommendation"),
        "candidate_count", "candidate_max",
    )


def recommend(inputs: DataFrame, policy: dict = POLICY, keys: list[str] = SERIES) -> DataFrame:
    """Service-level and cost-aware decision for every row of ``inputs`` (one row per key)."""
    scenarios = demand_scenarios(service_decision(inputs, policy), keys, policy["scenario_count"])
    prepared = with_candidates(scenarios, keys, policy)
    kept = [c for c in prepared.columns if c not in (*keys, "demands", "quantities")]
    return cheapest_orders(candidate_costs(prepared, keys, kept), keys)


def what_if(inputs: DataFrame, overrides: dict[str, dict], policy: dict = POLICY) -> DataFrame:
    """Many override sets at once: each series is decided under every named set.

    An override replaces the saved value only where it is given; saved rows are untouched.
    """
    names = sorted({name for values in overrides.values() for name in values})
    filled = with_policy(inputs, policy)
    sets = F.array(*[
        F.struct(F.lit(label).alias("what_if"), *[F.lit(values.get(n)).cast("double").alias(f"_{n}") for n in names])
        for label, values in overrides.items()
    ])
    rows = filled.select("*", F.inline(sets))
    types = dict(filled.dtypes)
    revised = rows.withColumns({n: F.coalesce(F.col(f"_{n}").cast(types[n]), F.col(n)) for n in names})
    return recommend(revised.drop(*[f"_{n}" for n in names]), policy, ["what_if", *SERIES])


#: Inputs an override may replace, in the order they are explained.
OVERRIDABLE = ["on_hand", "on_order", "backorders", "lead_time_days", "service_level", "review_period_days",
               "holding_cost_per_unit_per_day", "stockout_cost_per_unit", "fixed_order_cost"]


def compare_scenarios(saved: DataFrame, revised: DataFrame) -> DataFrame:
    """Revised and saved decision and inputs of every series side by side, with the change of the order and its cost."""
    names = ["recommended_order_qty", "cost_optimized_order_qty", "stockout_risk", "estimated_cost_with_recommendation", "inventory_position", *OVERRIDABLE]
    before = saved.select(*SERIES, *[F.col(n).alias(f"saved_{n}") for n in names])
    joined = revised.select("what_if", *SERIES, *names).join(before, SERIES)
    return joined.withColumns({
        "order_delta": F.col("recommended_order_qty") - F.col("saved_recommended_order_qty"),
        "cost_delta": F.col("estimated_cost_with_recommendation") - F.col("saved_estimated_cost_with_recommendation"),
    })


# The sentences that explain a scenario.
SENTENCES = {
    "position": "Inventory position %s from %.1f to %.1f units.",
    "lead": "The %d-day lead time creates %s demand exposure than the saved %d-day assumption.",
    "service": "Changing the service target from %.1f%% to %.1f%% %s the uncertainty buffer.",
    "review": "The review period changed from %d to %d days, changing the target stock horizon.",
    "cost": "The cost assumptions changed the cost-optimized alternative; they do not change the service-level order rule.",
    "same": "The operational assumptions match the saved recommendation, so the decision is unchanged.",
    "order": "The recommended order is %s units, compared with %s units in the saved decision.",
}


def scenario_sentences() -> Column:
    """Array of sentences for a row of ``compare_scenarios``: what changed, or that nothing did, then the order."""
    def moved(name: str) -> Column:
        return F.col(name) != F.col(f"saved_{name}")

    def word(name: str, up: str, down: str) -> Column:
        return F.when(F.col(name) > F.col(f"saved_{name}"), up).otherwise(down)

    def told(key: str, *values) -> Column:
        return F.format_string(SENTENCES[key], *values)

    position, lead, service, review = "inventory_position", "lead_time_days", "service_level", "review_period_days"
    costs = moved("holding_cost_per_unit_per_day") | moved("stockout_cost_per_unit") | moved("fixed_order_cost")
    changes = F.array_compact(F.array(
        F.when(moved(position), told("position", word(position, "increased", "decreased"), F.col(f"saved_{position}"), F.col(position))),
        F.when(moved(lead), told("lead", F.col(lead).cast("int"), word(lead, "more", "less"), F.col(f"saved_{lead}").cast("int"))),
        F.when(moved(service), told("service", 100 * F.col(f"saved_{service}"), 100 * F.col(service), word(service, "raises", "reduces"))),
        F.when(moved(review), told("review", F.col(f"saved_{review}").cast("int"), F.col(review).cast("int"))),
        F.when(costs, F.lit(SENTENCES["cost"])),
    ))
    units = [F.format_number(n, 0) for n in ("recommended_order_qty", "saved_recommended_order_qty")]
    return F.concat(F.when(F.size(changes) > 0, changes).otherwise(F.array(F.lit(SENTENCES["same"]))), F.array(told("order", *units)))


# --- summaries -------------------------------------------------------------------------

def result_columns() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("series"),
        F.count_if(F.col("recommended_order_qty") > 0).alias("requiring_reorder"),
        F.sum("recommended_order_qty").alias("recommended_units"),
        F.sum("cost_optimized_order_qty").alias("cost_optimized_units"),
        *[F.sum(c).alias(c) for c in (
            "expected_shortage_without_order", "expected_shortage_with_recommendation",
            "estimated_cost_without_order", "estimated_cost_with_recommendation", "estimated_cost_savings",
        )],
    ]


def group_results(recommendations: DataFrame, columns: list[str]) -> DataFrame:
    """The same sums by each single column, in one grouping-sets pass."""
    kind = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for name in columns:
        kind = F.when(F.grouping(name) == 0, name).otherwise(kind)
        value = F.when(F.grouping(name) == 0, F.col(name)).otherwise(value)
    return recommendations.groupingSets([[c] for c in columns], *columns).agg(
        kind.alias("group_type"), value.alias("group_value"), *result_columns()
    ).drop(*columns)


def category_counts(recommendations: DataFrame, columns: list[str]) -> DataFrame:
    """Frequencies of several categorical columns from one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in columns])
    return recommendations.select(F.inline(pairs)).groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("series"))


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """Equal-width bin counts; the upper edge belongs to the last bin."""
    bucket = F.least(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins))
    return df.where(value.isNotNull()).groupBy(bucket.alias("bin")).agg(F.count(F.lit(1)).alias("series"))


def savings_share() -> Column:
    return ratio(F.sum("estimated_cost_savings"), F.sum("estimated_cost_without_order"))
