"""Table writes: partitioned panels, idempotent loads, exports, fingerprints."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence
from datetime import timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.functions.columns import store_snap
from demandloom.session import checkpoint_dir
from demandloom.sources.parameters import SNAP_COLUMNS
from demandloom.sources.retail import hash_int


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path inside the shared checkpoint folder, readable by every executor."""
    return os.path.join(checkpoint_dir(spark), "tables", f"{name}-{uuid.uuid4().hex[:12]}")


def write_table(df: DataFrame, path: str, *, partition_by: Sequence[str] = (), fmt: str = "parquet") -> DataFrame:
    """Write and return the stored table. Rows are clustered by the partition columns first,
    so each task writes few files."""
    if partition_by:
        df = df.repartition(*partition_by, *[c for c in ("store_id",) if c in df.columns])
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    reader = df.sparkSession.read.schema(df.schema).format(fmt)
    return (reader.option("header", True) if fmt == "csv" else reader).load(path)


def table_rows(spark: SparkSession, path: str) -> int | None:
    """Row count from Parquet metadata, or None when there is no table."""
    try:
        return spark.read.parquet(path).count()
    except AnalysisException:
        return None


def load_once(df: DataFrame, path: str, *, refresh: bool = False) -> str:
    """Create, skip when the counts agree, fail on a partial table unless ``refresh``."""
    spark = df.sparkSession
    stored = table_rows(spark, path)
    if stored is not None and not refresh:
        expected = df.count()
        if stored == expected:
            return "skipped"
        raise ValueError(f"table holds {stored} of {expected} rows; load again with refresh")
    df.write.mode("overwrite").parquet(path)
    return "created" if stored is None else "refreshed"


def load_partitions(df: DataFrame, path: str, by: str, *, refresh: Sequence = ()) -> DataFrame:
    """Load a table partition by partition: rows (partition, action, n_rows).

    A missing partition is created, one with as many rows as ``df`` has is skipped, and one with another number fails
    the load, before anything is written, unless it is to be refreshed. Only created and refreshed partitions are
    written (dynamic overwrite), so a repeated load writes nothing and a changed year rewrites one year. The counts
    are one row a partition.
    """
    spark = df.sparkSession
    expected = {r[by]: r["n"] for r in df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()}
    try:
        stored = {r[by]: r["n"] for r in spark.read.parquet(path).groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()}
    except AnalysisException:
        stored = {}
    actions = {}
    for key, n in expected.items():
        actions[key] = "refreshed" if key in refresh and key in stored else "created" if key not in stored else "skipped" if stored[key] == n else "partial"
    partial = sorted(k for k, a in actions.items() if a == "partial")
    if partial:
        raise ValueError(f"partitions {partial} hold {[stored[k] for k in partial]} of {[expected[k] for k in partial]} rows; load again with refresh")
    changed = [k for k, a in actions.items() if a != "skipped"]
    if changed:
        rows = df.where(F.col(by).isin(changed)).repartition(by)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    return spark.createDataFrame([(str(k), actions[k], expected[k]) for k in sorted(expected)], "partition string, action string, n_rows long")


def serving_history(panel: DataFrame) -> DataFrame:
    """One boolean benefit-day flag instead of three state columns."""
    return panel.withColumn("snap_active", store_snap() == 1).drop(*SNAP_COLUMNS.values())


def recent_window(panel: DataFrame, days: int = 120, newest=None) -> DataFrame:
    """Last ``days`` calendar days (inclusive of the newest) of every series.

    With the newest day given, the bounds are literals, also on the partition column of a panel stored by year: only
    the files of the years concerned are listed and read.
    """
    if newest is None:
        return panel.where(F.col("date") >= F.date_sub(panel.agg(F.max("date")).scalar(), days - 1))
    first = newest - timedelta(days=days - 1)
    recent = panel.where(F.col("date").between(F.lit(first), F.lit(newest)))
    return recent.where(F.col("year").between(first.year, newest.year)) if "year" in panel.columns else recent


def model_metadata(forecast: DataFrame, model: str, policy: str) -> DataFrame:
    return forecast.agg(
        F.max("forecast_origin").alias("forecast_origin"), F.max("horizon_day").alias("max_horizon_days")
    ).select(F.lit(model).alias("model_name"), "forecast_origin", "max_horizon_days", F.lit(policy).alias("policy_name"))


def fingerprint(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Order-free content hash: row count and the decimal sum of row hashes, written out."""
    hashes = hash_int(*[F.col(c) for c in columns]).cast("decimal(28,0)")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(hashes), F.lit(0)).cast("string").alias("content_hash")
    ).select(F.lit(label).alias("table_name"), "n_rows", "content_hash")
