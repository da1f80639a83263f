"""Typed scans of the input tables and their file contracts."""

from __future__ import annotations

import os
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table_path(folder: str, name: str) -> str:
    return os.path.join(folder, f"{name}.parquet")


_SCHEMAS: dict[str, T.StructType] = {}


def read_table(spark: SparkSession, folder: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet scan; the column list makes the pruning visible at the call.

    The schema is taken from the footer once per path, so later scans plan without a job.
    """
    path = table_path(folder, name)
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    df = spark.read.schema(_SCHEMAS[path]).parquet(path)
    return df.select(*columns) if columns else df


def wide_sales_schema(id_columns: Sequence[str], day_columns: Sequence[str]) -> T.StructType:
    fields = [T.StructField(name, T.StringType()) for name in id_columns]
    return T.StructType(fields + [T.StructField(name, T.LongType()) for name in day_columns])


def day_columns(columns: Iterable[str]) -> list[str]:
    """``d_<int>`` names in numeric order; other names are ignored."""
    numbered = [(int(name[2:]), name) for name in columns if name.startswith("d_") and name[2:].isdigit()]
    return [name for _, name in sorted(numbered)]


CALENDAR_SCHEMA = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("d", T.StringType()),
    T.StructField("week_start", T.DateType()),
    T.StructField("weekday", T.StringType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("event_name_1", T.StringType()),
    T.StructField("event_type_1", T.StringType()),
    T.StructField("event_name_2", T.StringType()),
    T.StructField("event_type_2", T.StringType()),
    T.StructField("snap_emea", T.IntegerType()),
    T.StructField("snap_amer", T.IntegerType()),
    T.StructField("snap_apac", T.IntegerType()),
])

PRICE_SCHEMA = T.StructType([
    T.StructField("store_id", T.StringType()),
    T.StructField("item_id", T.StringType()),
    T.StructField("week_start", T.DateType()),
    T.StructField("sell_price", T.DoubleType()),
])


def read_wide_csv(
    spark: SparkSession,
    path: str,
    id_columns: Sequence[str],
    days: Sequence[str],
    *,
    category: str | None = None,
    stores: Sequence[str] = (),
) -> DataFrame:
    """Typed wide-sales scan; hierarchy filters sit on the scan, before any reshape."""
    df = spark.read.schema(wide_sales_schema(id_columns, days)).option("header", True).csv(path)
    if category is not None:
        df = df.where(F.col("cat_id") == category)
    return df.where(F.col("store_id").isin(list(stores))) if stores else df


def read_calendar_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CALENDAR_SCHEMA).option("header", True).csv(path)


def read_price_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PRICE_SCHEMA).option("header", True).csv(path)


def relevant_prices(prices: DataFrame, sales_keys: DataFrame, keys: Sequence[str] = ("store_id", "item_id")) -> DataFrame:
    """Price facts whose keys occur in sales."""
    return prices.join(sales_keys.select(*keys).distinct(), list(keys), "left_semi")


def through_date(df: DataFrame, cutoff, column: str = "date") -> DataFrame:
    """Rows up to a cutoff; the predicate reaches the scan (and partitions, when partitioned by date)."""
    return df.where(F.col(column) <= F.lit(cutoff).cast("date"))


def inspect_source(
    spark: SparkSession,
    folder: str,
    filename: str,
    key_columns: Sequence[str],
    *,
    count_rows: bool = False,
) -> DataFrame:
    """One contract row for one source: status, missing key columns, optional row count."""
    path = os.path.join(folder, filename)
    reader = spark.read.option("header", True).csv if filename.endswith(".csv") else spark.read.parquet
    try:
        df = reader(path)
        columns = df.columns
    except AnalysisException:
        df, columns = None, []
    missing = [name for name in key_columns if name not in columns]
    status = "missing" if df is None else "invalid" if missing or not columns else "valid"
    counted = df.agg(F.count(F.lit(1)).alias("row_count")) if df is not None and count_rows else spark.range(1).select(
        F.lit(None).cast("bigint").alias("row_count")
    )
    return counted.select(
        F.lit(filename).alias("source"),
        F.lit(status).alias("status"),
        F.lit(len(columns)).alias("column_count"),
        F.lit(",".join(missing)).alias("missing_columns"),
        "row_count",
    )


def inspect_sources(spark: SparkSession, folder: str, contracts: dict[str, Sequence[str]], **options) -> DataFrame:
    rows = [inspect_source(spark, folder, name, keys, **options) for name, keys in contracts.items()]
    return reduce(DataFrame.unionByName, rows)
