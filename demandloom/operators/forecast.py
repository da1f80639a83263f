"""Baseline forecasts from one history array per series.

A history array holds one value per calendar day of the active period, so its length is
bounded by the calendar. All folds and all models are columns of the same row; nothing is
re-shuffled per fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandloom.functions.columns import intermittency_class
from demandloom.functions.quantiles import quantiles
from demandloom.operators.folds import fold_array
from demandloom.operators.joins import checked_join, require
from demandloom.sources.parameters import CROSTON_ALPHA, FOLDS, HORIZON, LOCKED, SERIES


def series_history(active: DataFrame, *static: str) -> DataFrame:
    """(series) -> first day and the ordered sales array; gaps inside a series are an error."""
    grouped = active.groupBy(*SERIES).agg(
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.sort_array(F.collect_list(F.struct("date", "sales"))).alias("_days"),
        *[F.min(name).alias(name) for name in static],
    )
    whole = F.size("_days") == F.datediff("last_date", "first_date") + 1
    values = F.transform("_days", lambda day: day["sales"].cast("double"))
    gap = F.raise_error(F.lit("a series history has missing or repeated days"))
    return grouped.withColumn("history", F.when(whole, values).otherwise(gap.cast("array<double>"))).drop("_days")


def tail(values: Column, n: int) -> Column:
    return F.slice(values, -n, n)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def mean(values: Column, n: int) -> Column:
    return total(values) / n


def sample_std(values: Column, n: int) -> Column:
    centre = mean(values, n)
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + (x - centre) * (x - centre)) / (n - 1))


def naive_scale(history: Column) -> Column:
    """Mean squared first difference, null unless positive."""
    steps = F.size(history) - 1
    squared = F.zip_with(
        F.slice(history, F.lit(1), steps), F.slice(history, F.lit(2), steps), lambda a, b: (b - a) * (b - a)
    )
    scale = F.when(steps >= 1, total(squared) / F.nullif(steps, F.lit(0)))
    return F.when(scale > 0, scale)


def croston_sba(history: Column, alpha: float = CROSTON_ALPHA) -> Column:
    """Croston level with the SBA factor as one fold over the array; all zeros give 0."""
    state = F.struct(F.lit(0.0).alias("size"), F.lit(0.0).alias("gap"), F.lit(0.0).alias("since"))

    def step(acc: Column, x: Column) -> Column:
        waited = acc["since"] + 1
        first = acc["gap"] == 0
        size = F.when(first, x).otherwise(acc["size"] + alpha * (x - acc["size"]))
        gap = F.when(first, waited).otherwise(acc["gap"] + alpha * (waited - acc["gap"]))
        sold = x > 0
        return F.struct(
            F.when(sold, size).otherwise(acc["size"]).alias("size"),
            F.when(sold, gap).otherwise(acc["gap"]).alias("gap"),
            F.when(sold, F.lit(0.0)).otherwise(waited).alias("since"),
        )

    def level(acc: Column) -> Column:
        return F.when(acc["gap"] > 0, (1 - alpha / 2) * acc["size"] / F.nullif(acc["gap"], F.lit(0.0))).otherwise(0.0)

    return F.aggregate(history, state, step, level)


def origins(history: DataFrame, *, locked: bool = False, minimum: int = 28) -> DataFrame:
    """Per fold and series: history up to the origin and everything known from it."""
    per_fold = history.select("*", F.explode(fold_array(locked=locked)).alias("_f")).select("_f.*", *history.columns)
    known = F.datediff("start_date", "first_date")
    enough = F.when(known >= minimum, known).otherwise(
        F.raise_error(F.concat(F.lit("history too short before "), F.col("fold"))).cast("int")
    )
    cut = per_fold.withColumn("history_observations", enough).withColumn(
        "known", F.slice("history", F.lit(1), F.col("history_observations"))
    )
    zeros = F.size(F.filter("known", lambda x: x == 0))
    return cut.select(
        "fold", "start_date", "end_date", "origin", *SERIES,
        *[c for c in ("dept_id", "demand_band") if c in history.columns],
        "history_observations",
        F.date_add("first_date", F.col("history_observations") - 1).alias("history_end_date"),
        naive_scale(F.col("known")).alias("rmsse_scale"),
        (F.lit(100.0) * zeros / F.size("known")).alias("training_zero_pct"),
        "known",
    ).withColumn("intermittency_class", intermittency_class(F.col("training_zero_pct")))


def model_values(known: Column, day: Column) -> dict[str, Column]:
    """The five baselines for one horizon day."""
    week = tail(known, 7)
    return {
        "zero": F.lit(0.0),
        "last_value": F.element_at(known, -1),
        "seasonal_naive_7": F.element_at(week, (day - 1) % 7 + 1),
        "mean_28": mean(tail(known, 28), 28),
        "croston_sba": croston_sba(known),
    }


def baseline_forecasts(origin_rows: DataFrame, models: list[str] | None = None, horizon: int = HORIZON) -> DataFrame:
    """fold x series x horizon day x model, from the origin's history only."""
    values = model_values(F.col("known"), F.col("horizon_day"))
    wanted = models or list(values)
    # level models are evaluated once per origin, before the horizon multiplies the rows
    levels = {name: f"_{name}" for name in wanted if name != "seasonal_naive_7"}
    prepared = origin_rows.withColumns({alias: values[name] for name, alias in levels.items()}).withColumn(
        "_week", tail(F.col("known"), 7)
    ).drop("known")
    days = prepared.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("horizon_day"))
    seasonal = F.element_at("_week", (F.col("horizon_day") - 1) % 7 + 1)
    pairs = F.array(*[
        F.struct(F.lit(name).alias("model_name"), (F.col(levels[name]) if name in levels else seasonal).alias("forecast"))
        for name in wanted
    ])
    kept = [c for c in days.columns if not c.startswith("_")]
    return days.select(*kept, F.inline(pairs)).withColumn("target_date", F.date_add("origin", F.col("horizon_day")))


def attach_actuals(forecasts: DataFrame, observed: DataFrame) -> DataFrame:
    """Observed sales joined only after forecasting; a missing actual is an error."""
    actuals = observed.select(*SERIES, F.col("date").alias("target_date"), F.col("sales").alias("actual"))
    joined = checked_join(forecasts, actuals, [*SERIES, "target_date"], "left", "many_to_one")
    return joined.withColumn("actual", require("actual", "no actual for a forecast row")).select(
        "fold", "model_name", *SERIES, *[c for c in ("dept_id", "demand_band") if c in forecasts.columns],
        "intermittency_class", "training_zero_pct",
        F.col("origin").alias("forecast_origin"), "history_end_date", "history_observations",
        "target_date", "horizon_day", "forecast", "rmsse_scale", "actual",
    )


def fold_predictions(active: DataFrame, *, locked: bool = False, models: list[str] | None = None) -> DataFrame:
    """All baselines on all folds, with actuals of the folds' windows."""
    static = [c for c in ("dept_id", "demand_band") if c in active.columns]
    rows = origins(series_history(active, *static), locked=locked)
    if locked:
        rows = rows.where(F.col("fold") == "locked")
    first, last = F.lit(fold_limits(locked)[0]).cast("date"), F.lit(fold_limits(locked)[1]).cast("date")
    return attach_actuals(baseline_forecasts(rows, models), active.where(F.col("date").between(first, last)))


def fold_limits(locked: bool) -> tuple[str, str]:
    windows = [LOCKED] if locked else FOLDS
    return min(w[1] for w in windows), max(w[2] for w in windows)


def demand_state_features(state: Column) -> dict[str, Column]:
    """The nine demand features of the next day from an array of the last 28 values."""
    return {
        "sales_lag_1": F.element_at(state, -1),
        "sales_lag_7": F.element_at(state, -7),
        "sales_lag_14": F.element_at(state, -14),
        "sales_lag_28": F.element_at(state, -28),
        "sales_roll_mean_7": mean(tail(state, 7), 7),
        "sales_roll_mean_14": mean(tail(state, 14), 14),
        "sales_roll_mean_28": mean(tail(state, 28), 28),
        "sales_roll_std_7": sample_std(tail(state, 7), 7),
        "sales_roll_std_28": sample_std(tail(state, 28), 28),
    }


def last_values(active: DataFrame, n: int = 28, *static: str) -> DataFrame:
    """Deployment refit: the last ``n`` observed values per series, all ending on one cutoff."""
    cutoff = active.agg(F.max("date")).scalar()
    recent = active.where(F.col("date") > F.date_sub(cutoff, n))
    table = series_history(recent, *static)
    complete = (F.size("history") == n) & (F.col("last_date") == cutoff)
    fail = F.raise_error(F.lit("a series does not end on the cutoff with enough days")).cast("array<double>")
    return table.select(
        *SERIES, *static, F.col("last_date").alias("trained_through"),
        F.when(complete, F.col("history")).otherwise(fail).alias("recent"),
    )


def recursive_mean(recent: Column, horizon: int, n: int = 28) -> Column:
    """Each prediction joins the window of the next one; returns the horizon's values."""
    grown = F.aggregate(
        F.sequence(F.lit(1), F.lit(horizon)), recent, lambda acc, _: F.concat(acc, F.array(mean(tail(acc, n), n)))
    )
    return tail(grown, horizon)


def deployment_forecast(table: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Future dates with the recursive 28-day mean."""
    others = [c for c in table.columns if c not in ("recent", "trained_through")]
    stepped = table.select(*others, "trained_through", F.posexplode(recursive_mean(F.col("recent"), horizon)).alias("_p", "forecast"))
    return stepped.select(
        *others,
        F.col("trained_through").alias("forecast_origin"),
        F.date_add("trained_through", F.col("_p") + 1).alias("target_date"),
        (F.col("_p") + 1).alias("horizon_day"),
        "forecast",
    )


def horizon_totals(forecast: DataFrame, *keys: str) -> DataFrame:
    """1-, 7- and 30-day sums per series."""
    def upto(days: int) -> Column:
        return F.sum(F.when(F.col("horizon_day") <= days, F.col("forecast"))).alias(f"forecast_{days}d")

    return forecast.groupBy(*(keys or SERIES)).agg(upto(1), upto(7), upto(30))


def mutate_future(active: DataFrame, start: str, value: int = 9999) -> DataFrame:
    """Overwrite all sales from ``start`` on; forecasts made before must not change."""
    return active.withColumn(
        "sales", F.when(F.col("date") >= F.lit(start).cast("date"), F.lit(value)).otherwise(F.col("sales"))
    )


def history_problems(active: DataFrame, minimum: int = 28) -> DataFrame:
    """Per series: negative, missing or short histories and gaps, as counts."""
    return active.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("observations"),
        F.count_if(F.col("sales").isNull()).alias("missing_values"),
        F.count_if(F.col("sales") < 0).alias("negative_values"),
        (F.datediff(F.max("date"), F.min("date")) + 1 - F.count_distinct("date")).alias("gap_days"),
    ).withColumn("has_minimum", F.col("observations") >= minimum)


def middle_row(df: DataFrame, value: str, ties: list[str]) -> DataFrame:
    """The row at position n/2 + 1 of the order by (value, ties).

    The median value narrows the candidates to its neighbourhood first, so only rows tied
    with it are ordered.
    """
    middle = quantiles(df, value, {"middle": 0.5}).scalar()
    upper = df.where(F.col(value) >= middle).agg(F.min(value)).scalar()
    below = df.agg(F.count_if(F.col(value) < upper)).scalar()
    rows = df.agg(F.count(F.lit(1))).scalar()
    position = F.row_number().over(W.partitionBy(value).orderBy(*ties))
    return df.where(F.col(value) == upper).withColumn("_p", position + below).where(
        F.col("_p") == F.floor(rows / 2) + 1
    ).drop("_p")
