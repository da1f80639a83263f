"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.llm.shared import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to its smallest one."""
    both = edges.union(edges.select("low", "high")).toDF("node", "near")
    smallest = both.groupBy("node").agg(F.min("near").alias("near"))
    roots = stage(smallest.select("node", F.least("node", "near").alias("root")))
    moved = both.where("near > node").join(roots, "node")
    return moved.select(F.col("near").alias("high"), F.col("root").alias("low")).where("high <> low").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours, and itself, to the smallest of them."""
    roots = stage(edges.groupBy("high").agg(F.min("low").alias("root")))
    moved = edges.join(roots, "high").select(F.col("low").alias("high"), F.col("root").alias("low"))
    return moved.union(roots.select("high", F.col("root").alias("low"))).where("high <> low").distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    total = F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), total, F.sum((F.col("low")).cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component) for every node of ``links`` (two id columns): the smallest id reachable.

    Links to itself and links with a null end are ignored. Rounds are logarithmic in the longest chain; minima are
    aggregated map-side, and both sides of each join come from written tables, so the partition of a node with very
    many links can be split.
    """
    first, second = links.columns[:2]
    edges = links.select(F.greatest(first, second).alias("high"), F.least(first, second).alias("low"))
    edges = stage(edges.where((F.col(first) != F.col(second))).distinct())
    before = _fingerprint(edges)
    while before[0]:
        edges = stage(_small_star(stage(_large_star(edges))))
        after = _fingerprint(edges)
        if after == before:
            break
        before = after
    roots = edges.select("low").distinct()
    return edges.select(F.col("high").alias("node"), F.col("low").alias("component")).union(roots.select("low", "low"))
