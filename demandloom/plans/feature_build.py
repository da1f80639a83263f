"""Stage plan: line items -> daily sales -> panel -> feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from demandloom.operators import features as ft
from demandloom.sources import retail
from demandloom.sources.parameters import SERIES
from demandloom.sources.sinks import write_table
from demandloom.sources.tables import read_table


def build_daily_sales(spark: SparkSession, folder: str, target: str, *, item: str = "p_type") -> DataFrame:
    """Scan and join the line items once; everything later reads the stored daily sales."""
    tables = [read_table(spark, folder, name) for name in ("lineitem", "part", "supplier", "nation", "region")]
    return write_table(retail.store_item_sales(*tables, item=item), target)


def build_features(facts: DataFrame, bounds: retail.Bounds, target: str) -> DataFrame:
    """Feature table partitioned by year, so cutoffs prune files."""
    bands = ft.assign_bands(ft.item_mean_demand(facts, bounds.days))
    series_bands = facts.select(*SERIES).distinct().join(bands.select("item_id", "demand_band"), "item_id")
    return write_table(ft.feature_table(retail.daily_panel(facts, bounds), series_bands), target, partition_by=["year"])
