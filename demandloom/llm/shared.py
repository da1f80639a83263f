"""Helpers that several corpus operators use: shared scratch tables, size-checked broadcasts, clean inputs."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labels are learned only from documents whose crc32 falls outside this remainder.
HELD_OUT_REMAINDER = 2
#: A side of a join is broadcast only when it was counted and has at most this many (narrow) rows.
BROADCAST_ROWS = 1_000_000
#: Rows of texts travel to Python in batches of so many bytes; a worker holds two of them, the executor one a task.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: the session's spark.checkpoint.dir.

    Only a local master may go without the setting; a cluster gets an error instead of a folder
    that its executors cannot read.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="demandloom-shared-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Python workers get batches of at most ``BATCH_BYTES`` meanwhile, however long the texts; a session's own limit stays."""
    if spark.conf.get(BATCH_SETTING, None) is not None:
        yield
        return
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(BATCH_SETTING)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/demandloom-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def give_back() -> None:
    """Hand memory that Python and Arrow hold but no longer use back to the system; workers live on between stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its memory
        pass


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its own."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after counting; larger sides are left to a shuffled join."""
    return F.broadcast(df) if df.count() <= limit else df


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Deal rows over the session's shuffle partitions, by key or evenly."""
    return df.repartition(shuffle_partitions(df.sparkSession), *columns)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Only (doc_id, text) and the strings ``keep``, nulls as empty; other columns cannot clash with an operator's own."""
    strings = {"text": text_col, **{name: name for name in keep or []}}
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        *[F.coalesce(F.col(column).cast("string"), F.lit("")).alias(name) for name, column in strings.items()],
    )


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def held_out(doc_id: Column, folds: int) -> Column:
    """True for the documents a model must not learn from; a null id counts as the empty string."""
    key = F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")
    return F.crc32(key) % folds == HELD_OUT_REMAINDER


def is_held_out(doc_id: int | None, folds: int) -> bool:
    """The same rule for Python code."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == HELD_OUT_REMAINDER


def binary_labels(labels: DataFrame, column: str) -> DataFrame:
    """One 0/1 label per known document; of contradicting rows the larger counts, nulls are ignored."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when(F.col(column) != 0, 1).otherwise(0)).alias("label"))
