"""Chronological folds: training selection, history selection, locks and future context.

The fold table is a handful of fixed date windows, so rows meet it as a literal array:
no join, no exchange, and a row is copied only for the folds it belongs to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.operators.features import calendar_features
from demandloom.sources.parameters import FOLDS, LOCKED


def fold_array(*, locked: bool = False) -> Column:
    rows = [*FOLDS, LOCKED] if locked else FOLDS
    return F.array(*[
        F.struct(
            F.lit(name).alias("fold"),
            F.lit(start).cast("date").alias("start_date"),
            F.lit(end).cast("date").alias("end_date"),
            F.date_sub(F.lit(start).cast("date"), 1).alias("origin"),
        )
        for name, start, end in rows
    ])


def _explode(df: DataFrame, keep, *, locked: bool = False) -> DataFrame:
    picked = F.explode(F.filter(fold_array(locked=locked), keep)).alias("_f")
    return df.select("*", picked).select("_f.*", *df.columns)


def history_rows(df: DataFrame) -> DataFrame:
    """Rows known at each fold's origin (date < start)."""
    return _explode(df, lambda f: F.col("date") < f["start_date"])


def fold_rows(df: DataFrame, *, locked: bool = False) -> DataFrame:
    """Rows inside each fold's window."""
    return _explode(df, lambda f: F.col("date").between(f["start_date"], f["end_date"]), locked=locked)


def training_rows(features: DataFrame) -> DataFrame:
    """Feature-ready rows strictly before each fold."""
    return history_rows(features.where("is_feature_ready"))


def overlaps_locked(start: Column, end: Column) -> Column:
    _, lock_start, lock_end = LOCKED
    return (start <= F.lit(lock_end).cast("date")) & (end >= F.lit(lock_start).cast("date"))


def require_unlocked(start: str, end: str) -> None:
    """Refuse an evaluation window that touches the locked one."""
    if start <= LOCKED[2] and end >= LOCKED[1]:
        raise ValueError(f"window {start}..{end} overlaps the locked window")


# What a forecaster may know about a target day in advance.
KNOWN_IN_ADVANCE = [
    "store_id", "item_id", "dept_id", "state_id", "date", "product_age_days", "product_age_weeks",
    "day_of_week", "day_of_month", "month", "quarter", "year", "week_of_year", "is_weekend",
    "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos",
    "is_event", "event_name_1", "event_type_1", "event_name_2", "event_type_2", "snap_active",
]


def future_context(active: DataFrame, *, locked: bool = False) -> DataFrame:
    """Identity and known-in-advance columns at the target dates of each fold."""
    recomputed = active.withColumn("product_age_days", F.datediff("date", "availability_date"))
    known = calendar_features(recomputed).select(*KNOWN_IN_ADVANCE)
    return fold_rows(known, locked=locked)
