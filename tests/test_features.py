"""Availability, calendar, history windows and price features on hand-made series."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from demandloom.operators import explore as ex
from demandloom.operators import features as ft
from demandloom.sources.retail import Bounds, dense_daily

DAY = dt.date(2020, 1, 6)


def series(spark, values, prices=None, store="A", item="x", start=DAY):
    prices = prices if prices is not None else [1.0] * len(values)
    rows = [(store, item, start + dt.timedelta(days=i), v, p) for i, (v, p) in enumerate(zip(values, prices))]
    df = spark.createDataFrame(rows, "store_id string, item_id string, date date, sales int, sell_price double")
    return df.withColumn("week_start", F.date_trunc("week", "date").cast("date"))


def column(df, name):
    return [r[name] for r in df.orderBy("store_id", "date").collect()]


def test_first_price_opens_the_series(spark):
    df = ft.flag_availability(series(spark, [0, 0, 0, 1], [None, 2.0, 2.0, 2.0]))
    rows = df.orderBy("date").collect()
    assert rows[0].launch_date == DAY + dt.timedelta(days=1)
    assert rows[0].first_positive_sale_date == DAY + dt.timedelta(days=3)
    assert [r.prelaunch_flag for r in rows] == [True, False, False, False]


def test_first_sale_is_the_fallback(spark):
    df = ft.flag_availability(series(spark, [0, 2, 0], [None, None, None]))
    assert {r.launch_date for r in df.collect()} == {DAY + dt.timedelta(days=1)}


def test_series_without_price_and_sale_is_an_error(spark):
    with pytest.raises(Exception, match="neither a known price"):
        ft.flag_availability(series(spark, [0, 0], [None, None])).collect()


def test_active_rows_keep_zeros_and_age(spark):
    df = ft.active_period(series(spark, [0, 0, 0, 1], [None, 2.0, 2.0, 2.0]))
    assert column(df, "product_age_days") == [0, 1, 2]
    assert column(df, "sales") == [0, 0, 1]


def test_lags_stay_inside_the_series(spark):
    both = series(spark, [10, 20, 30]).unionByName(series(spark, [100, 200, 300], store="B"))
    assert column(ft.sales_lags(both), "sales_lag_1") == [None, 10, 20, None, 100, 200]


def test_rolling_mean_excludes_the_target_day(spark):
    df = ft.demand_history(series(spark, [10, 20, 30, 40, 50, 60, 70, 800]))
    assert column(df, "sales_roll_mean_7") == [None] * 7 + [40.0]
    assert column(df, "sales_roll_std_7")[-1] == pytest.approx(21.602468994692867)


def test_zero_rate(spark):
    df = ft.zero_rates(series(spark, [0, 0, 1, 0, 5, 0, 0, 9]))
    assert column(df, "zero_rate_7")[-1] == pytest.approx(5 / 7)


def test_days_since_positive(spark):
    df = ft.days_since_positive(series(spark, [1, 0, 0, 5]))
    assert column(df, "days_since_last_positive_sale") == [None, 1, 2, 3]


def test_weekly_price_features_both_ways(spark):
    prices = [p for p in (1.0, 2.0, 3.0, 4.0, 100.0) for _ in range(7)]
    df = series(spark, [1] * 35, prices)
    weekly = ft.weekly_price_features(ft.weekly_price_table(df)).orderBy("week_start").collect()[-1]
    daily = ft.lagged_price_features(df).orderBy(F.desc("date")).first()
    for row in (weekly, daily):
        assert row.previous_week_price == 4.0
        assert row.price_change_previous_week == 1.0
        assert row.price_pct_change_previous_week == pytest.approx(100 / 3)
        assert row.price_vs_4week_median_lagged == pytest.approx(0.6)


def test_price_direction(spark):
    prices = [p for p in (2.0, 1.5, 2.25) for _ in range(7)]
    both = series(spark, [1] * 21, prices).unionByName(series(spark, [1] * 14, [3.0] * 14, store="B")).withColumn("dept_id", F.lit("d"))
    moves = ex.weekly_price_moves(both).orderBy("store_id", "week_start").collect()
    assert [m.change_direction for m in moves] == ["first observation", "decrease", "increase", "first observation", "unchanged"]


def test_intermittency_metrics(spark):
    df = series(spark, [0, 2, 0, 0, 3]).withColumn("dept_id", F.lit("d")).withColumn("demand_band", F.lit("low"))
    row = ex.series_demand(df).first()
    assert (row.active_days, row.positive_days, row.active_zero_pct) == (5, 2, 60.0)
    assert row.average_demand_interval == 2.5
    assert row.mean_positive_gap_days == 3.0


def test_unknown_state_is_an_error(spark):
    df = spark.createDataFrame([("NOWHERE", 1, 0, 0)], "state_id string, snap_emea int, snap_amer int, snap_apac int")
    with pytest.raises(Exception, match="no benefit-day flag"):
        df.select(ft.store_snap()).collect()


def test_dense_daily_fills_all_gaps(spark):
    facts = spark.createDataFrame(
        [("A", "x", DAY + dt.timedelta(days=2), 5, 500), ("A", "x", DAY + dt.timedelta(days=4), 7, 700)],
        "store_id string, item_id string, date date, sales bigint, cents bigint",
    )
    dense = dense_daily(facts, Bounds(DAY, DAY + dt.timedelta(days=6)))
    assert column(dense, "sales") == [0, 0, 5, 0, 7, 0, 0]


def test_skewness_is_bias_corrected(spark):
    values = [1.0, 2.0, 3.0, 4.0, 20.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert df.agg(ex.corrected_skewness(F.col("v"))).first()[0] == pytest.approx(pd.Series(values).skew())


def test_even_centred_window_looks_six_back_five_ahead(spark):
    rows = [(dt.date(2020 + m // 12, m % 12 + 1, 1), float(m)) for m in range(24)]
    monthly = spark.createDataFrame(rows, "month_start date, monthly_sales double")
    trend = ex.monthly_trend(monthly).orderBy("month_start").collect()
    assert trend[10].twelve_month_mean == pytest.approx(sum(range(4, 16)) / 12)
    assert trend[0].twelve_month_mean == pytest.approx(sum(range(0, 6)) / 6)
    assert trend[0].slope == pytest.approx(1.0)
