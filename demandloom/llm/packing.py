"""Sum-of-squares packing of tokenised documents into fixed-length sequences.

Each document is cut into pieces of at most ``capacity`` tokens. A piece of size s goes to the gap whose choice
makes the sum over gaps g of (open sequences with gap g) squared smallest; opening a new sequence is one of the
choices. Pieces come largest first, so the small ones at the end close what is left open.

Packing works on shards: pieces are dealt by the hash of their number over ceil(pieces / shard_pieces) shards, each packed in its own
task, so memory is bounded and sequences waste at most a few gaps a shard. Only lengths are moved, never tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.llm.shared import documents, give_back, stage
from demandloom.llm.wordcache import document_ids

CAPACITY = 4096
END_OF_DOCUMENT = 1
SHARD_PIECES = 50_000

_PIECE = pa.schema([("number", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def piece_rows(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """Rows (number, doc_id, piece, start, length, ids_crc32) of every piece of every document; numbers are unique."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for row, stream, bounds in document_ids(batch, vocabulary, end_id):
                out, view = [], memoryview(stream)
                for doc_id, begin, stop in zip(doc_ids[row:], bounds[:-1].tolist(), bounds[1:].tolist()):
                    for piece, at in enumerate(range(begin, stop, capacity)):
                        upto = min(at + capacity, stop)
                        out.append((number, doc_id, piece, at - begin, upto - at, zlib.crc32(view[at:upto])))
                        number += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _PIECE.types)], schema=_PIECE)
        give_back()

    return docs.mapInArrow(cut, "number long, doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, for pieces in the given order."""
    n = len(lengths)
    sequence, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    open_count = np.zeros(capacity + 1, np.int64)  # open sequences by gap; a gap of 0 or of the whole capacity does not count
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    opened = 0
    for i in range(n):
        s = int(lengths[i])
        gaps = open_count[s:capacity]  # gaps s .. capacity-1 that could take the piece
        after = open_count[: capacity - s].copy()  # what is left: 0 .. capacity-1-s
        after[:1] = -1  # a closed sequence adds nothing: 2 * (-1) + 1 + 1 = 0
        change = 2 * (after - gaps) + 2  # (N(g)-1)^2 - N(g)^2 + (N(g-s)+1)^2 - N(g-s)^2
        if s < capacity:
            change[:1] += 1  # exactly full: -2 N(s) + 1, no other count changes
        change[gaps == 0] = np.iinfo(np.int64).max
        fresh = 2 * int(open_count[capacity - s]) + 1 if s < capacity else 0
        best = int(change.argmin()) if len(change) else -1
        if best >= 0 and change[best] <= fresh:
            gap = s + best
            target = by_gap[gap].pop()
            open_count[gap] -= 1
        else:
            gap, target = capacity, opened
            opened += 1
        sequence[i], offset[i] = target, capacity - gap
        if gap > s:
            by_gap[gap - s].append(target)
            open_count[gap - s] += 1
    return sequence, offset


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_OF_DOCUMENT,
                   shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text counts as empty, and an empty document is one piece of one id. Repeated rows are packed as often as
    they come; a null doc_id stays null. An empty table gives no rows. Pieces of equal length are placed by
    (doc_id, piece). Other columns are ignored.
    """
    pieces = stage(piece_rows(documents(docs), vocabulary, capacity, end_id))
    shards = max(1, -(-pieces.count() // shard_pieces))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        local, frame["offset"] = sum_of_squares(frame["length"].to_numpy(), capacity)
        frame["sequence_id"] = local * shards + frame["shard"]
        return frame.drop(columns="shard")

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("number"), F.lit(shards)).cast("long")).drop("number")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, offset long, sequence_id long"
    packed = dealt.groupBy("shard").applyInPandas(pack, schema)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
