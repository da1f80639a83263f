"""Embedding near-dedup by sorted projection passes.

In each pass a vector gets a concatenation of random hashes (the signs of random projections), vectors are ordered
lexicographically by label and hash, and each is compared with the ``window`` vectors after it. Close vectors share long
prefixes, so most of them come near each other in some pass; the verified pairs of all passes are united.

The order is global: vectors are range-partitioned and numbered through, then compared in blocks of consecutive
numbers that overlap by a window, so every task is bounded and no label or hash, however common, lies in one task.
Equal vectors are one class before the passes, and a class counts as often as it has members.

Dense groups do not end at a window: a vector that still links in the second half of its window is compared with twice
as many after it, and so on until no link is near the end. That is done in pairs of blocks, spread over the tasks.
Equal hashes are ordered differently in each pass. The number of passes grows with the vectors of a label, so that
a pair right at the threshold still shares a long enough prefix in one of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import spark_partition_id

from demandloom.llm.components import components
from demandloom.llm.shared import broadcast_if_small, shuffle_partitions, stage

COSINE = 0.93
PASSES, BITS, WINDOW, BLOCK = 16, 32, 256, 1024
SEED = 20_231
#: Chance that no pass brings a pair at the threshold together, by which passes are added.
MISSED = 1e-4


def usable(vectors: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """Rows (vec_id, label, vector) that can have links, label as string and vector as array of doubles."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("vector", lambda x: x != 0))


def classes(rows: DataFrame) -> DataFrame:
    """One row per distinct vector of a label: rep (smallest vec_id), label, vector, size."""
    positive_zero = F.transform("vector", lambda x: x + F.lit(0.0))
    return rows.groupBy("label", positive_zero.alias("vector")).agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"))


def passes_for(n: int, least: int = PASSES, cosine: float = COSINE, window: int = WINDOW) -> int:
    """Passes over n vectors: a pair must share about log2(n / (2 * window)) signs, each equal with 1 - angle / pi."""
    signs = max(0.0, math.log2(max(n, 1) / (2 * window)))
    together = (1 - math.acos(cosine) / math.pi) ** signs
    return least if together == 1 else max(least, math.ceil(math.log(MISSED) / math.log1p(-together)))


def with_passes(reps: DataFrame, least: int = PASSES) -> DataFrame:
    """Adds ``passes``, by the number of vectors of the label."""
    counts = stage(reps.groupBy("label").agg(F.count("*").alias("n")))
    power = F.floor(F.log2(F.col("n").cast("double"))).cast("int") + 1
    table = F.array(*[F.lit(passes_for(1 << k, least)) for k in range(64)])
    return reps.join(broadcast_if_small(counts.select("label", table[power].alias("passes"))), "label")


def signatures(reps: DataFrame, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """Rows (turn, label, dim, sign, rep, unit): one per vector and pass; unit is the normalised vector."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        weights = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            dims = batch["vector"].map(len)
            for dim, part in batch.groupby(dims):
                most = int(part["passes"].max())
                for turn in range(most):
                    if (dim, turn) not in planes:
                        planes[dim, turn] = np.random.default_rng([seed, dim, turn]).standard_normal((dim, bits))
                x = np.stack(part["vector"].to_numpy()).astype(np.float64)
                x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                unit = np.array([v.tobytes() for v in x], object)
                for turn in range(most):
                    own = part["passes"].to_numpy() > turn
                    signs = (x[own] @ planes[dim, turn] > 0) @ weights
                    yield pd.DataFrame({"turn": turn, "label": part["label"].to_numpy()[own], "dim": dim, "sign": signs, "rep": part["rep"].to_numpy()[own], "unit": unit[own]})

    return reps.select("label", "vector", "rep", "passes").mapInPandas(rows, "turn int, label string, dim int, sign long, rep long, unit binary")


def numbered(signed: DataFrame) -> DataFrame:
    """Adds ``number``, the place of each row in the order of (turn, label, dim, sign, tie) over all partitions.

    The tie is a hash of turn and rep, so equal signs do not give the same neighbours in every pass.
    """
    order = ["turn", "label", "dim", "sign", "tie", "rep"]
    parts = signed.withColumn("tie", F.xxhash64("turn", "rep")).repartitionByRange(shuffle_partitions(signed.sparkSession), *order).sortWithinPartitions(*order).drop("tie")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = 0
        for batch in batches:
            yield batch.assign(place=np.arange(at, at + len(batch)))
            at += len(batch)

    placed = parts.withColumn("part", spark_partition_id()).mapInPandas(count, "turn int, label string, dim int, sign long, rep long, unit binary, part int, place long")
    placed = stage(placed)
    sizes = placed.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()  # one row per partition
    starts, total = [], 0
    for r in sizes:
        starts.append((r["part"], total))
        total += r["n"]
    offsets = placed.sparkSession.createDataFrame(starts, "part int, first long")
    return placed.join(F.broadcast(offsets), "part").select("turn", "label", "dim", "rep", "unit", (F.col("first") + F.col("place")).alias("number"))


PAIRS = "a long, b long, open long"


def _found(a: np.ndarray, b: np.ndarray, still_open: np.ndarray) -> pd.DataFrame:
    """Pairs (a, b), and the numbers of the rows that link near the end of what they were compared with."""
    pairs = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "open": None})
    return pd.concat([pairs, pd.DataFrame({"a": None, "b": None, "open": np.unique(still_open)})], ignore_index=True).astype("Int64")


def _within(rows: DataFrame, cosine: float, window: int, block: int) -> DataFrame:
    """Rows of ``PAIRS``: every row against the ``window`` rows after it."""
    own = F.floor(F.col("number") / block)
    ahead = F.when((F.col("number") % block < window) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    dealt = rows.withColumn("block", F.explode(ahead))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("number")
        first = int(frame["block"].iloc[0]) * block
        number = frame["number"].to_numpy()
        run = frame[["turn", "label", "dim"]].ne(frame[["turn", "label", "dim"]].shift()).any(axis=1).cumsum().to_numpy()
        rep, left, right = frame["rep"].to_numpy(), [], []
        for r in np.unique(run):
            at = np.flatnonzero(run == r)
            x = np.stack([np.frombuffer(u) for u in frame["unit"].iloc[at]])
            i, j = np.nonzero(np.triu(x @ x.T >= cosine, 1))
            take = (j - i <= window) & (number[at[i]] < first + block)
            left.append(at[i[take]])
            right.append(at[j[take]])
        i, j = np.concatenate(left), np.concatenate(right)
        return _found(rep[i], rep[j], number[i[number[j] - number[i] > window // 2]])

    return dealt.groupBy("block").applyInPandas(compare, PAIRS)


def _beyond(rows: DataFrame, still_open: DataFrame, low: int, high: int, cosine: float, block: int) -> DataFrame:
    """Rows of ``PAIRS``: the open rows against those more than ``low`` and at most ``high`` after them, by pairs of blocks."""
    place = lambda number: F.floor(number / block)
    others = F.explode(F.sequence(place(F.col("open") + low + 1), place(F.col("open") + high)))
    meets = stage(still_open.select(place(F.col("open")).alias("own"), others.alias("other")).distinct())
    columns = ["own", "other", "ahead", "turn", "label", "dim", "rep", "unit", "number"]
    tiled = rows.withColumn("tile", place(F.col("number")))
    opened = tiled.join(still_open, F.col("number") == F.col("open")).withColumn("ahead", F.lit(False)).withColumnRenamed("tile", "own")
    dealt = opened.join(meets, "own").select(*columns).union(tiled.withColumn("ahead", F.lit(True)).withColumnRenamed("tile", "other").join(meets, "other").select(*columns))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        number, rep, ahead, left, right = frame["number"].to_numpy(), frame["rep"].to_numpy(), frame["ahead"].to_numpy(), [], []
        for at in frame.groupby(["turn", "label", "dim"], sort=False).indices.values():
            a, b = at[~ahead[at]], at[ahead[at]]
            if len(a) and len(b):
                x, y = (np.stack([np.frombuffer(u) for u in frame["unit"].iloc[k]]) for k in (a, b))
                i, j = np.nonzero(x @ y.T >= cosine)
                far = number[b[j]] - number[a[i]]
                take = (far > low) & (far <= high)
                left.append(a[i[take]])
                right.append(b[j[take]])
        i, j = (np.concatenate(k) if k else np.zeros(0, np.int64) for k in (left, right))
        return _found(rep[i], rep[j], number[i[number[j] - number[i] > (low + high) // 2]])

    return dealt.groupBy("own", "other").applyInPandas(compare, PAIRS)


def near_pairs(rows: DataFrame, cosine: float = COSINE, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Rows (a, b), a < b: vectors near each other in a pass whose cosine is large enough, each pair once.

    Every row meets the ``window`` rows after it; as long as it links in the second half of them, twice as many.
    """
    found = stage(_within(rows, cosine, window, block))
    pairs, low = found, window
    while True:
        still_open = stage(found.where("open IS NOT NULL").select("open").distinct())
        if still_open.isEmpty():
            return pairs.where("a IS NOT NULL").select("a", "b").distinct()
        found = stage(_beyond(rows, still_open, low, 2 * low, cosine, block))
        pairs, low = pairs.union(found), 2 * low


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", passes: int = PASSES) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id (smallest vec_id reachable), kept (vec_id = component_id).

    Two vectors link when their labels are equal and not null and their cosine is at least 0.93. Vectors that are null,
    zero or hold null or non-finite components link with nothing, nor do rows without id or vectors of different length.
    Repeated rows are vectors of their own. An empty table gives no rows; other columns are ignored.
    """
    rows = usable(vectors, id_col, label_col, vector_col)
    groups = stage(classes(rows))
    pairs = stage(near_pairs(numbered(signatures(with_passes(groups, passes)))))
    sizes = groups.select("rep", "size")
    ways = pairs.union(pairs.select("b", "a")).toDF("rep", "other")
    others = ways.join(sizes.toDF("other", "more"), "other").groupBy("rep").agg(F.sum("more").alias("more"))
    joined = components(pairs).toDF("rep", "component")
    per_class = groups.join(others, "rep", "left").join(joined, "rep", "left")
    facts = stage(per_class.select("label", "vector", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component")))
    member = rows.select("vec_id", "label", F.transform("vector", lambda x: x + F.lit(0.0)).alias("vector")).join(facts, ["label", "vector"])
    linked = member.groupBy("vec_id").agg(F.max("links").alias("links"), F.min("component").alias("component"))
    out = vectors.select(F.col(id_col).cast("long").alias("vec_id")).join(linked, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
