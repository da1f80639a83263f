"""Filter interaction audit: what each of five filters does in each of the 120 orders they can be applied in.

A document is only its mask: which of the filters it fails. An order and a step turn a mask into an outcome: still
kept, removed here, or redundant (fails here, was removed before). All 600 outcomes of a mask are the fields of one
wide integer, each field three counters of 64 bits. The integer of a part is the sum over its masks of documents times
mask integer; counts of rows stay below 2^63, so no counter runs into the next one, and the sum is cut back into
fields at the end. Two more sums, over the good and over the toxic documents, give what is lost of them.

Texts are read once, in tasks that pass on (doc_id, part, digest, mask) alone. Filter E asks whether a smaller doc_id
of the table has the same text; copies are counted per text, part and label before texts meet, so a text that a third
of all rows share is a handful of rows when its smallest doc_id is looked up. At most 32 masks x 4 label pairs of each
part reach the integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandloom.llm.shared import documents

FILTERS = "ABCDE"
ORDERS = ["".join(order) for order in permutations(FILTERS)]
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITALS_PERCENT = 3
MARKS = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FACTS = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("digest", pa.binary()), ("mask", pa.int32())])
_SCHEMA = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
           "good_lost long, toxic_lost long, shapley long")


def own_mask(text: bytes, code_points: int) -> int:
    """The filters A to D as bits: too short, too repetitive, too many capitals, marks."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, CAPITALS))
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)) << 1
        | (100 * capitals > MAX_CAPITALS_PERCENT * code_points) << 2
        | (len(text.translate(None, MARKS)) < len(text)) << 3
    )


def facts(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, part, digest, mask) with the bits of A to D."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, points = batch.column("text"), pc.utf8_length(batch.column("text")).to_pylist()
            digests, masks = [], []
            for i, n in enumerate(points):
                text = texts[i].as_py().encode()
                digests.append(hashlib.sha256(text).digest())
                masks.append(own_mask(text, n))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(digests, pa.binary()), pa.array(masks, pa.int32())], schema=_FACTS)

    return docs.mapInArrow(read, "doc_id long, part string, digest binary, mask int")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (part, mask, good, toxic, n) over all five filters."""
    rows = facts(documents(docs, keep=["lang"]))
    per_id = rows.groupBy("digest", "part", "mask", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    labelled = per_id.join(known, "doc_id", "left").na.fill(False, ["good", "toxic"])
    order = F.struct("doc_id")  # a null id sorts before all others
    copies = labelled.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(order).alias("low"), F.min_by("n", order).alias("n_low")
    )
    first = F.min("low").over(W.partitionBy("digest"))  # one row a part and label pair
    split = copies.withColumn("passing", F.when(F.col("low") == first, F.col("n_low")).otherwise(0))
    outcome = F.explode(F.array(
        F.struct(F.col("mask"), F.col("passing").alias("n")),
        F.struct(F.col("mask").bitwiseOR(16).alias("mask"), (F.col("n") - F.col("passing")).alias("n")),
    )).alias("o")
    masks = split.select("part", "good", "toxic", outcome).select("part", "good", "toxic", "o.mask", "o.n")
    return masks.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).where("n > 0")


def packed_outcomes(mask: int) -> int:
    """The wide integer of a mask: 600 fields of the counters kept, removed, redundant, in the order of ORDERS."""
    fields = np.zeros((len(ORDERS), len(FILTERS), 3), "<u8")
    for o, order in enumerate(ORDERS):
        passed = True
        for step, name in enumerate(order):
            fails = bool(mask >> FILTERS.index(name) & 1)
            fields[o, step] = (passed and not fails, passed and fails, fails and not passed)
            passed = passed and not fails
    return int.from_bytes(fields.tobytes(), "little")


def unpack(total: int) -> np.ndarray:
    """Counters [order, step, (kept, removed, redundant)] of a sum of wide integers."""
    size = len(ORDERS) * len(FILTERS) * 3
    return np.frombuffer(total.to_bytes(8 * size, "little"), "<u8").astype(np.int64).reshape(len(ORDERS), len(FILTERS), 3)


def part_audit(rows: pd.DataFrame) -> pd.DataFrame:
    """600 rows of one part, from its (mask, good, toxic, n)."""
    sums = {"all": 0, "good": 0, "toxic": 0}
    alone = dict.fromkeys(FILTERS, 0)
    for mask, good, toxic, n in zip(rows["mask"].tolist(), rows["good"].tolist(), rows["toxic"].tolist(), rows["n"].tolist()):
        wide = n * packed_outcomes(mask)
        sums["all"] += wide
        sums["good"] += wide * good
        sums["toxic"] += wide * toxic
        if mask.bit_count() == 1:
            alone[FILTERS[mask.bit_length() - 1]] += n
    counters, good, toxic = (unpack(sums[k]) for k in ("all", "good", "toxic"))
    shapley = {f: sum(int(counters[o, order.index(f), 1]) for o, order in enumerate(ORDERS)) for f in FILTERS}
    names = [(order, step, f) for order in ORDERS for step, f in enumerate(order, 1)]
    return pd.DataFrame({
        "part": rows["part"].iloc[0], "filter_order": [n[0] for n in names], "step": [n[1] for n in names],
        "kept": counters[:, :, 0].ravel(), "removed": counters[:, :, 1].ravel(), "redundant": counters[:, :, 2].ravel(),
        "unique_fails": [alone[n[2]] for n in names], "good_lost": good[:, :, 1].ravel(), "toxic_lost": toxic[:, :, 1].ravel(),
        "shapley": [shapley[n[2]] for n in names],
    })


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (lang), order of the filters and step; see the contract's columns in ``_SCHEMA``.

    Null text and null lang count as empty. A null doc_id is smaller than any other and has no label; rows that share
    the smallest id of a text all pass E. Of contradicting label rows the 1 counts. Whole texts of any length are
    read. An empty table gives no rows; other columns are ignored.
    """
    return mask_counts(docs, labels).groupBy("part").applyInPandas(part_audit, _SCHEMA)
