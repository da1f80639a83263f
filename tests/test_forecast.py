"""Baselines, metrics, rankings and leakage."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from demandloom.operators import forecast as fc
from demandloom.operators import metrics as mt
from demandloom.operators import ranking as rk
from demandloom.operators.folds import overlaps_locked, require_unlocked


def array(spark, values):
    return spark.createDataFrame([([float(v) for v in values],)], "h array<double>")


def value(spark, values, build):
    return array(spark, values).select(build(F.col("h")).alias("v")).first().v


def test_croston(spark):
    assert value(spark, [0, 2, 0, 0, 4], fc.croston_sba) == pytest.approx(0.9952380952)
    assert value(spark, [0, 0, 0], fc.croston_sba) == 0.0


def test_naive_scale(spark):
    assert value(spark, [1, 3, 2], fc.naive_scale) == 2.5
    assert value(spark, [4, 4, 4], fc.naive_scale) is None


def test_baseline_values(spark):
    h = array(spark, range(1, 31))
    day = lambda n, name: h.select(fc.model_values(F.col("h"), F.lit(n))[name].alias("v")).first().v
    assert day(1, "mean_28") == 16.5
    assert day(30, "last_value") == 30.0
    assert [day(n, "seasonal_naive_7") for n in (1, 7, 8)] == [24.0, 30.0, 24.0]
    assert day(5, "zero") == 0.0


def test_recursive_mean_changes_on_day_two(spark):
    days = value(spark, range(1, 29), lambda h: fc.recursive_mean(h, 30))
    assert len(days) == 30
    assert days[0] == 14.5
    assert days[1] == pytest.approx(14.98214, abs=1e-5)


def test_locked_window_is_refused(spark):
    with pytest.raises(ValueError):
        require_unlocked("2001-07-01", "2001-07-30")
    require_unlocked("2001-06-01", "2001-06-30")
    df = spark.sql("SELECT DATE'2001-06-20' AS s, DATE'2001-07-01' AS e")
    assert df.select(overlaps_locked(F.col("s"), F.col("e"))).first()[0]


def active(spark, values, start=dt.date(2001, 1, 1)):
    rows = [("A", "x", start + dt.timedelta(days=i), int(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "store_id string, item_id string, date date, sales int")


def test_future_sales_never_reach_a_forecast(spark):
    base = active(spark, [i % 9 for i in range(190)])
    changed = fc.mutate_future(base, "2001-04-02", 999)

    def run(df):
        rows = fc.origins(fc.series_history(df)).where("fold = 'f1'")
        return {(r.model_name, r.horizon_day): r.forecast for r in fc.baseline_forecasts(rows).collect()}

    assert run(base) == run(changed)


def test_gap_in_history_is_an_error(spark):
    with pytest.raises(Exception, match="missing or repeated days"):
        fc.series_history(active(spark, range(10)).where("date <> DATE'2001-01-05'")).collect()


def test_short_history_is_an_error(spark):
    late = active(spark, range(60), dt.date(2001, 3, 20))
    with pytest.raises(Exception, match="history too short"):
        fc.origins(fc.series_history(late)).collect()


def predictions(spark, rows):
    return spark.createDataFrame(
        [("f1", m, "A", i, "d", "low", "regular", h, float(f), int(a), 2.0) for m, i, h, f, a in rows],
        "fold string, model_name string, store_id string, item_id string, dept_id string, demand_band string, "
        "intermittency_class string, horizon_day int, forecast double, actual int, rmsse_scale double",
    )


def test_wape_of_zero_actuals_is_null(spark):
    row = mt.basic_metrics(predictions(spark, [("m", "x", 1, 1, 0), ("m", "x", 2, 2, 0)]), "model_name").first()
    assert row.wape is None and row.mae == 1.5 and row.bias == 1.5


def test_aggregate_slice_compares_totals(spark):
    cube = mt.metrics(predictions(spark, [("m", "x", h, 1, h % 2) for h in range(1, 8)]))
    row = cube.where("fold = 'f1' AND horizon = 'days_1_7_aggregate' AND segment_type = 'overall'").first()
    assert row.mae == 3.0
    assert row.rmsse == pytest.approx(3 / math.sqrt(7 * 2.0))


def test_average_rank_shares_ties(spark):
    df = spark.createDataFrame([("m", "a", 1.0), ("m", "b", 2.0), ("m", "c", 2.0), ("m", "d", 3.0)], "metric string, name string, v double")
    ranks = {r.name: r.r for r in df.withColumn("r", rk.rank_average(["metric"], "v")).collect()}
    assert ranks == {"a": 1.0, "b": 2.5, "c": 2.5, "d": 4.0}


def test_second_evaluation_of_the_same_split_is_refused(spark):
    stored = spark.createDataFrame([("test", "m", 1.0)], "split string, model_name string, mae double")
    with pytest.raises(Exception, match="already recorded"):
        mt.append_once(stored, stored, ["split", "model_name"]).collect()
