"""Exact linear-interpolated quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandloom.session import cut_lineage


def quantiles(
    df: DataFrame,
    value: str | Column,
    probabilities: dict[str, float],
    by: Sequence[str] = (),
    *,
    small_domain: bool = False,
) -> DataFrame:
    """Named exact quantiles of ``value`` per group, one row per group.

    Values are counted first (map-side combined), so a repeated value is one row whatever its number of rows. Where
    the domain is small by nature (``small_domain``: day counts, daily units) the percentile is taken of those counts.
    All other values are ranked in range partitions, so no group's values ever meet in one task.
    """
    column = F.col(value) if isinstance(value, str) else value
    counted = (
        df.select(*by, column.cast("double").alias("_v"))
        .where(F.col("_v").isNotNull())
        .groupBy(*by, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    if small_domain:
        return counted.groupBy(*by).agg(
            *[F.percentile("_v", F.lit(p), F.col("_n")).alias(name) for name, p in probabilities.items()]
        )
    return _by_ranges(counted, probabilities, list(by))


def _by_ranges(counted: DataFrame, probabilities: dict[str, float], by: list[str]) -> DataFrame:
    """Range-partition by (group, value); a value's rank is its place in the partition plus the sizes of those before.

    The partitioned rows are checkpointed, because partition numbers must be the same in both uses.
    """
    ranged = counted.repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id())
    rows = cut_lineage(ranged)
    parts = rows.groupBy(*by, "_part").agg(F.sum("_n").alias("_size"))  # a group has one row per partition it reaches
    upto = W.partitionBy(*by).orderBy("_part")
    whole = W.partitionBy(*by)
    placed = parts.select(
        *by, "_part", (F.sum("_size").over(upto) - F.col("_size")).alias("_before"), F.sum("_size").over(whole).alias("_total")
    )
    inside = W.partitionBy(*by, "_part").orderBy("_v")
    ranked = rows.join(placed, [*by, "_part"]).withColumn("_end", F.col("_before") + F.sum("_n").over(inside))
    answers = []
    for name, p in probabilities.items():
        place = F.lit(p) * (F.col("_total") - 1)
        low, high = (F.max(_at(edge.cast("bigint"))) for edge in (F.floor(place), F.ceil(place)))
        share = F.max(place - F.floor(place))
        answers.append((low + (high - low) * share).alias(name))
    return ranked.groupBy(*by).agg(*answers)


def _at(rank: Column) -> Column:
    """The value if it holds the zero-based rank, else null."""
    return F.when((rank < F.col("_end")) & (rank >= F.col("_end") - F.col("_n")), F.col("_v"))
