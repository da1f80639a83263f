"""Wide/long reshaping, pivots and ordered re-indexing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.sources.tables import day_columns


def day_number(d: str | Column = "d") -> Column:
    return F.regexp_replace(F.col(d) if isinstance(d, str) else d, "^d_", "").cast("int")


def wide_to_long(wide: DataFrame) -> DataFrame:
    """Id columns plus ``d_*`` columns -> (d, sales) rows; filter the wide side first."""
    days = day_columns(wide.columns)
    ids = [name for name in wide.columns if name not in days]
    return wide.unpivot(ids, days, "d", "sales")


def long_to_wide(panel: DataFrame, ids: Sequence[str], days: Sequence[str]) -> DataFrame:
    """One integer column per listed day; the explicit list avoids a distinct-values job."""
    return panel.where(F.col("d").isin(list(days))).groupBy(*ids).pivot("d", list(days)).agg(F.sum("sales"))


def pivot_mean(df: DataFrame, rows: Sequence[str], column: str, values: Sequence, measure: str) -> DataFrame:
    return df.groupBy(*rows).pivot(column, list(values)).agg(F.avg(measure))


def stack_slots(df: DataFrame, keep: Sequence[str], slots: Sequence[str], name: str) -> DataFrame:
    """Several slot columns into one, dropping empty slots."""
    return df.select(*keep, F.explode(F.array(*slots)).alias(name)).where(F.col(name).isNotNull())


def timeline(history: DataFrame, forecast: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tidy actual/forecast series for one chart: history has no forecast and vice versa."""
    actual = history.select(*keys, "date", F.col("sales").cast("double").alias("actual"))
    future = forecast.select(*keys, F.col("target_date").alias("date"), "forecast")
    both = actual.unionByName(future, allowMissingColumns=True)
    return both.unpivot([*keys, "date"], ["actual", "forecast"], "measure", "units").where(F.col("units").isNotNull())


def reindexed(counts: DataFrame, key: str, order: Sequence, measures: Sequence[str]) -> DataFrame:
    """Every listed category in its fixed order, absent ones with zero."""
    rows = [(i, value) for i, value in enumerate(order, start=1)]
    dimension = counts.sparkSession.createDataFrame(rows, ["position", key])
    return dimension.join(counts, key, "left").select("position", key, *[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in measures])
