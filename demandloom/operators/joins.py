"""Joins with a declared cardinality, and key-set checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("key_rows")).where("key_rows > 1")


def unique_side(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Collapse each key to one row and fail, inside the job, when a key had several.

    The check rides on the aggregation that the join needs anyway (one exchange on the
    key); no separate counting job and no driver round trip.
    """
    others = [name for name in df.columns if name not in keys]
    checked = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_key_rows"),
        F.max(F.struct(*others)).alias("_row") if others else F.lit(None).alias("_row"),
    )
    fail = F.raise_error(F.lit(f"duplicate join key on the {label} side"))
    return checked.where(F.when(F.col("_key_rows") > 1, fail.cast("boolean")).otherwise(True)).select(
        *keys, *([F.col(f"_row.{name}").alias(name) for name in others])
    )


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", cardinality: str = "many_to_one") -> DataFrame:
    """Equi-join that enforces ``many_to_one`` or ``one_to_one``; row counts cannot multiply."""
    if cardinality not in ("many_to_one", "one_to_one"):
        raise ValueError(f"unsupported cardinality {cardinality!r}")
    keys = list(on)
    right = unique_side(right, keys, "right")
    if cardinality == "one_to_one":
        left = unique_side(left, keys, "left")
    return left.join(right, keys, how)


def require(column: str, message: str):
    """Column that raises when a value is missing after a join."""
    return F.coalesce(F.col(column), F.raise_error(F.lit(message)))


def key_mismatches(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of keys only on the left, only on the right and on both sides."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(1))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(1))
    both = a.join(b, list(keys), "full_outer")
    return both.agg(
        F.count_if(F.col("_r").isNull()).alias("only_left"),
        F.count_if(F.col("_l").isNull()).alias("only_right"),
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("in_both"),
    )
