"""Scalar column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from demandloom.sources.parameters import SNAP_COLUMNS


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division with null, never an error, for a zero denominator."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    return F.lit(100.0) * ratio(part, whole)


def change_percent(new: Column, old: Column) -> Column:
    return F.lit(100.0) * (ratio(new, old) - 1)


def improvement_percent(benchmark: Column, candidate: Column) -> Column:
    return percent(benchmark - candidate, benchmark)


def count_if(condition: Column) -> Column:
    return F.count_if(condition)


def tertile_band(value: Column, low: Column, high: Column) -> Column:
    return F.when(value <= low, "low").when(value <= high, "medium").otherwise("high")


def zero_share_bin(zero_pct: Column) -> Column:
    """Exploratory bins, closed on the right: 50 is regular, 80 is intermittent."""
    return (
        F.when(zero_pct <= 50, "regular (<50% zero)")
        .when(zero_pct <= 80, "intermittent (50-80% zero)")
        .when(zero_pct > 80, "highly intermittent (>80% zero)")
    )


def intermittency_class(zero_pct: Column) -> Column:
    """Training-only class: 50 is already intermittent, unlike the exploratory bins."""
    return F.when(zero_pct < 50, "regular").when(zero_pct <= 80, "intermittent").otherwise("highly_intermittent")


def has_event() -> Column:
    return F.col("event_name_1").isNotNull() | F.col("event_name_2").isNotNull()


def store_snap(state: str = "state_id") -> Column:
    """The one benefit-day flag that applies to the row's state; an unknown state is an error."""
    flag = F.raise_error(F.concat(F.lit("no benefit-day flag for state "), F.coalesce(F.col(state), F.lit("null"))))
    for name, column in SNAP_COLUMNS.items():
        flag = F.when(F.col(state) == name, F.col(column)).otherwise(flag)
    return flag.cast("int")


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    angle = F.lit(2.0) * F.pi() * value / F.lit(period)
    return F.sin(angle), F.cos(angle)


def period_start(date: Column, frequency: str) -> Column:
    """Start of the day, Monday week or month."""
    if frequency == "daily":
        return date.cast("date")
    if frequency not in ("weekly", "monthly"):
        raise ValueError(f"unknown frequency {frequency!r}")
    return F.date_trunc({"weekly": "week", "monthly": "month"}[frequency], date).cast("date")


def week_ending_sunday(date: Column) -> Column:
    return F.next_day(F.date_sub(date, 1), "SUN")


def none_token(column: Column) -> Column:
    return F.coalesce(column, F.lit("__NONE__"))


def clip(column: Column, low: float, high: float | None = None) -> Column:
    clipped = F.greatest(column, F.lit(low))
    return clipped if high is None else F.least(clipped, F.lit(high))


def all_of(conditions: Iterable[Column]) -> Column:
    result = F.lit(True)
    for condition in conditions:
        result = result & condition
    return result
