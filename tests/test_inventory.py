"""Normal functions, replenishment formulas and the cost sweep against brute force."""

from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandloom.functions.normal import normal_cdf, normal_inverse
from demandloom.operators import inventory as iv
from demandloom.sources.parameters import POLICY, SERIES


def test_normal_functions_match_the_standard_library(spark):
    xs = [-8.0, -5.5, -2.0, -0.3, 0.0, 0.7, 1.96, 4.0, 7.5]
    ps = [1e-9, 0.01, 0.05, 0.3, 0.5, 0.9, 0.95, 0.975, 0.99, 1 - 1e-9]
    cdf = [r.v for r in spark.createDataFrame([(x,) for x in xs], "x double").select(normal_cdf(F.col("x")).alias("v")).collect()]
    inv = [r.v for r in spark.createDataFrame([(p,) for p in ps], "p double").select(normal_inverse(F.col("p")).alias("v")).collect()]
    assert cdf == pytest.approx([NormalDist().cdf(x) for x in xs], abs=1e-14)
    assert inv == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-12)


def one(spark, **columns):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])
    return lambda *cols: row.select(*cols).first()


def test_inventory_position(spark):
    pick = one(spark, a=10.0, b=4.0, c=3.0)
    assert pick(iv.inventory_position(F.col("a"), F.col("b"), F.col("c")))[0] == 11.0
    with pytest.raises(Exception, match="must not be negative"):
        one(spark, a=-1.0, b=0.0, c=0.0)(iv.inventory_position(F.col("a"), F.col("b"), F.col("c")))


def test_safety_stock_rises_with_service_and_lead_time(spark):
    level = lambda s, days: one(spark, s=s, g=2.0, d=days)(iv.safety_stock(F.col("s"), F.col("g"), F.col("d")))[0]
    assert level(0.99, 5) > level(0.90, 5)
    assert level(0.95, 10) > level(0.95, 3)


def test_order_quantity_is_rounded_up(spark):
    raw, units = one(spark, t=30.2, p=20.0)(*iv.order_quantity(F.col("t"), F.col("p")))
    assert raw == pytest.approx(10.2) and units == 11


def test_no_demand(spark):
    days, label = one(spark, p=5.0, m=0.0)(*iv.days_of_supply(F.col("p"), F.col("m")))
    assert days is None and label == "NO EXPECTED DEMAND"
    risk = one(spark, p=5.0, d=0.0, s=0.0, n=3)(iv.stockout_probability(F.col("p"), F.col("d"), F.col("s"), F.col("n")))[0]
    assert risk == 0.0


def test_risk_falls_with_stock(spark):
    risk = lambda p: one(spark, p=p, d=20.0, s=3.0, n=7)(iv.stockout_probability(F.col("p"), F.col("d"), F.col("s"), F.col("n")))[0]
    assert 0 <= risk(30.0) < risk(5.0) <= 1


def inputs(spark, on_hand=12.0):
    return spark.createDataFrame(
        [("A", "x", [2.0] * 30, on_hand, 3.0, 1.0, 7, 0.95, 0.02, 5.0, 25.0, 0.1, 1.5)],
        "store_id string, item_id string, daily array<double>, on_hand double, on_order double, backorders double, lead_time_days int, "
        "service_level double, holding_cost_per_unit_per_day double, stockout_cost_per_unit double, fixed_order_cost double, residual_mean double, sigma_daily double",
    )


def test_cost_sweep_equals_brute_force(spark):
    decisions = iv.service_decision(inputs(spark))
    scenarios = iv.demand_scenarios(decisions, SERIES)
    prepared = iv.with_candidates(scenarios, SERIES)
    demand = np.array([r.demand for r in scenarios.collect()])
    decision = decisions.first()
    upper = int(np.ceil(max(decision.recommended_order_qty, np.quantile(demand, 0.995) - decision.inventory_position) * POLICY["upper_buffer"]))
    rows = {r.quantity: r for r in iv.candidate_costs(prepared, SERIES).collect()}
    assert sorted(rows) == list(range(upper + 1))
    for q, row in rows.items():
        available = decision.inventory_position + q
        surplus, shortage = np.maximum(available - demand, 0).mean(), np.maximum(demand - available, 0).mean()
        cost = surplus * 0.02 * 14 / 2 + shortage * 5.0 + (25.0 if q else 0.0)
        assert (row.expected_excess, row.expected_shortage) == pytest.approx((surplus, shortage), abs=1e-9)
        assert row.expected_cost == pytest.approx(cost, abs=1e-7)
    best = iv.recommend(inputs(spark)).first()
    assert best.cost_optimized_order_qty == min(rows, key=lambda q: (rows[q].expected_cost, q))
    assert best.estimated_cost_savings >= 0


def test_recommendation_is_deterministic(spark):
    assert iv.recommend(inputs(spark)).collect() == iv.recommend(inputs(spark).repartition(7)).collect()


def test_what_if_leaves_saved_rows_alone(spark):
    rows = {r.what_if: r for r in iv.what_if(inputs(spark), {"saved": {}, "empty": {"on_hand": 0.0}}).collect()}
    assert rows["saved"].on_hand == 12.0 and rows["empty"].on_hand == 0.0
    assert rows["empty"].recommended_order_qty > rows["saved"].recommended_order_qty


def test_mismatched_keys_fail_the_job(spark):
    forecast = spark.createDataFrame([("A", "x", d, 1.0) for d in range(1, 31)], "store_id string, item_id string, horizon_day int, forecast double")
    state = spark.createDataFrame([("A", "y", 1.0)], "store_id string, item_id string, on_hand double")
    calibration = spark.createDataFrame([("A", "x", 1.0)], "store_id string, item_id string, sigma_daily double")
    with pytest.raises(Exception, match="keys do not match"):
        iv.decision_inputs(forecast, state, calibration).collect()


def test_every_declared_override_against_brute_force(spark):
    from demandloom.catalog.q_inventory import OVERRIDES

    rows = {r.what_if: r for r in iv.what_if(inputs(spark), OVERRIDES).collect()}
    assert set(rows) == set(OVERRIDES)
    longer = rows["longer lead time"]
    safety = NormalDist().inv_cdf(0.99) * 1.5 * 14**0.5
    assert (longer.lead_time_days, longer.service_level, longer.inventory_position) == (14, 0.99, 14.0)
    assert (longer.lead_time_demand, longer.safety_stock) == pytest.approx((28.0, safety), rel=1e-9)
    assert rows["shorter review"].planning_horizon_days == rows["saved"].planning_horizon_days - 4
    assert rows["other costs"].recommended_order_qty == rows["saved"].recommended_order_qty
    assert rows["higher service"].safety_stock > rows["saved"].safety_stock
    assert (rows["more on order"].inventory_position, rows["no stock"].inventory_position) == (12.0 + 500.0, -rows["saved"].backorders)
    horizon = longer.planning_horizon_days
    assert horizon > rows["saved"].planning_horizon_days
    assert longer.recommended_order_qty == int(np.ceil(2.0 * horizon + safety - 14.0))


def test_sentences_name_what_changed(spark):
    from demandloom.catalog.q_inventory import OVERRIDES

    saved = iv.recommend(inputs(spark))
    both = iv.compare_scenarios(saved, iv.what_if(inputs(spark), OVERRIDES)).withColumn("told", iv.scenario_sentences())
    told = {r.what_if: r.told for r in both.collect()}
    order = "The recommended order is"
    assert told["saved"][0].startswith("The operational assumptions match") and len(told["saved"]) == 2
    assert [t.split()[0] for t in told["longer lead time"]] == ["The", "Changing", "The"] and "14-day lead time creates more" in told["longer lead time"][0]
    assert told["shorter review"][0].startswith("The review period changed from 7 to 3 days") and told["other costs"][0].startswith("The cost assumptions")
    assert "Inventory position decreased from" in told["no stock"][0] and all(t[-1].startswith(order) for t in told.values())
