"""Exact dedup through content-defined chunk recipes.

A text is cut where its own content says so (after a sentence end, at least 512 characters on), so equal
passages of different documents give equal chunks. Chunks are deduplicated by (fingerprint, chunk text):
each distinct chunk moves once, after map-side combine. The fingerprint is accepted as identifier only if no
two distinct chunks of the corpus share it; otherwise a wider one is tried. Documents are then compared by
their ordered identifier lists alone, a few per cent of the text.

Everything runs in Spark SQL functions. Groups are aggregated map-side, so a group that holds a third of all
rows is one row per task before it is shuffled; the join back to documents is a plain shuffled join whose
skewed partitions Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.llm.shared import broadcast_if_small, documents, fresh_name, stage

#: At least 512 characters, then up to the next sentence end or line end; without one, 8192 characters.
CHUNK_PATTERN = r"(?s).{512,8192}?[.!?\n]|.{1,8192}"
#: Hex digits of SHA-256 that are tried as chunk identifier, in order.
FINGERPRINT_DIGITS = (32, 64)


def chunks_of(text: Column, pattern: str = CHUNK_PATTERN) -> Column:
    """The chunks of a text in order; joined they are the text, and an empty text has none."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def fingerprint(chunk: Column, digits: int) -> Column:
    return F.unhex(F.substring(F.sha2(chunk.cast("binary"), 256), 1, digits))


def has_collisions(docs: DataFrame, digits: int, pattern: str = CHUNK_PATTERN) -> bool:
    """Whether two distinct chunks share a fingerprint, found by comparing the chunk texts themselves."""
    chunks = docs.select(F.explode(chunks_of(F.col("text"), pattern)).alias("chunk"))
    distinct = chunks.select(fingerprint(F.col("chunk"), digits).alias("identifier"), "chunk").distinct()
    shared = distinct.groupBy("identifier").agg(F.count("*").alias("texts")).where("texts > 1")
    return shared.agg(F.count("*").alias("n")).first()["n"] > 0


def recipes(docs: DataFrame, digits: tuple[int, ...] = FINGERPRINT_DIGITS, pattern: str = CHUNK_PATTERN) -> DataFrame:
    """Rows (doc_id, text_sha256, recipe): the ordered list of verified chunk identifiers of each document."""
    for width in digits:
        if not has_collisions(docs, width, pattern):
            identifiers = F.transform(chunks_of(F.col("text"), pattern), lambda chunk: fingerprint(chunk, width))
            return stage(docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), identifiers.alias("recipe")))
    raise ValueError("distinct chunks share the widest fingerprint")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical. Of equal texts the row with the largest doc_id is kept. Null text counts as
    empty; a null doc_id is smaller than any other. Of repeated rows with the same id and text one is kept.
    An empty table gives an empty result; other columns are ignored.
    """
    rows = recipes(documents(docs, id_col, text_col), **options)
    per_id = rows.groupBy("recipe", "doc_id").agg(F.count("*").alias("copies"), F.max("text_sha256").alias("text_sha256"))
    # staged, so that the join below shuffles both sides itself and Spark may split the partition of a hot recipe
    groups = stage(per_id.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")))
    joined = per_id.join(groups, "recipe").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return joined.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The documents that exact dedup keeps, with all their columns, whatever their names; of repeated rows one stays.

    Only the keys of what goes are joined, (doc_id, digest) of each dropped copy, so texts move only where rows with
    the same key are repeated. Null text counts as empty; a text of any length is compared whole.
    """
    rows = exact_dedup(docs).groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept"))
    digest, gone_id, gone_sha = (fresh_name(docs, name) for name in ("digest", "gone_id", "gone_sha"))
    rows = stage(rows.where("n > 1 OR NOT kept"))
    keys = [F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_sha)]
    marked = docs.withColumn(digest, F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(gone_id)) & (F.col(digest) == F.col(gone_sha))
    single = marked.join(broadcast_if_small(rows.select(*keys)), same, "left_anti")
    repeated = marked.join(broadcast_if_small(stage(rows.where("kept").select(*keys))), same, "left_semi").dropDuplicates(["doc_id", digest])
    return single.unionByName(repeated).select(docs.columns)
