"""Mixture-controlled packing: deficit round-robin over source queues.

Every sequence (window) of ``capacity`` tokens is filled from all source queues in their target proportions. A queue
earns its quantum, capacity x its share, with every window; it spends what it has earned, whole tokens only, and what
is left (or overdrawn, to finish a document) is carried to the next window.

1. Texts become token rows, staged once: a document is one row, or several of at most CHUNK_TOKENS. Each row knows its
   place in the part of its source that its task wrote.
2. Running sums over tasks, then over the sources within one, turn places into positions in whole queues.
3. A queue of T tokens gives shard k of K its positions floor(T k / K) .. floor(T (k+1) / K). So any shard holds all
   queues in the same proportions and about SHARD_TOKENS tokens, whatever a source's size; a source with a third of
   all rows is spread over all shards. The fraction that the floor cuts off at its start is the deficit that the shard
   takes over from the one before: no task waits for another.
4. Each shard runs the rounds in its own task. Its last part window is cut into sequences whose lengths are powers of
   two, which need no padding.

Sources below one token a window share one queue, so there are at most ``capacity`` + 1 queues besides the targets.
With targets other than the sources' own shares, queues run dry one after the other; between two such moments the
proportions are fixed, and each such phase is packed as above.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandloom.llm.shared import broadcast_if_small, documents, stage
from demandloom.llm.wordcache import document_ids

CAPACITY = 2048
END_OF_DOCUMENT = 1
CHUNK_TOKENS = 16_384
SHARD_TOKENS = 1 << 20
#: A document may overdraw its queue by this share of the quantum, if that finishes it.
SLACK = 0.125

_ROW = pa.schema([
    ("part", pa.int64()), ("source", pa.string()), ("at", pa.int64()), ("doc_id", pa.int64()), ("doc_tokens", pa.int64()),
    ("start", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()),
])
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def token_rows(docs: DataFrame, vocabulary: str, end_id: int, width: str) -> DataFrame:
    """Staged rows (part, source, at, doc_id, doc_tokens, start, n, ids); ``docs`` has doc_id, text and source."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, written = TaskContext.get().partitionId(), {}
        for batch in batches:
            doc_ids, sources = batch.column("doc_id").to_pylist(), batch.column("source").to_pylist()
            for row, stream, bounds in document_ids(batch, vocabulary, end_id):
                out, view = [], memoryview(stream.astype(width))
                for i, (begin, stop) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist()), row):
                    for a in range(begin, stop, CHUNK_TOKENS):
                        b = min(a + CHUNK_TOKENS, stop)
                        at = written.get(sources[i], 0)
                        out.append((part, sources[i], at, doc_ids[i], stop - begin, a - begin, b - a, bytes(view[a:b])))
                        written[sources[i]] = at + b - a
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ROW.types)], schema=_ROW)

    return stage(docs.mapInArrow(encode, "part long, source string, at long, doc_id long, doc_tokens long, start long, n long, ids binary"))


def phases(tokens: list[int], weights: list[Fraction]) -> list[list[int]]:
    """What each queue gives in each phase. In a phase all queues with tokens and a weight run in proportion to their
    weights until the first is empty; queues of weight 0 come last, in proportion to their tokens."""
    left, given, out = list(tokens), [Fraction(0)] * len(tokens), []
    while any(left):
        active = [i for i, n in enumerate(left) if n and weights[i] > 0]
        if not active:
            out.append(left)
            break
        time = min((tokens[i] - given[i]) / weights[i] for i in active)
        now = [0] * len(tokens)
        for i in active:
            given[i] += time * weights[i]
            now[i] = int(given[i]) - (tokens[i] - left[i])
            left[i] -= now[i]
        if any(now):
            out.append(now)
    return out


def sequence_sizes(total: int, capacity: int) -> list[int]:
    """Whole windows, then the rest as powers of two."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def deficit_rounds(ends: list[list[int]], shares: list[int], carried: list[int], unit: int, sizes: list[int], slack: float = SLACK) -> Iterator[list[tuple[int, int]]]:
    """For each window the (queue, tokens) it takes, in order.

    ``ends`` are the ends of the documents in each queue, ``shares`` / ``unit`` what a queue earns per token of a
    window, and ``carried`` / ``unit`` what it holds at first. Queues with the largest credit choose first.
    """
    credit, at, head = list(carried), [0] * len(ends), [0] * len(ends)
    length = [e[-1] if e else 0 for e in ends]
    for size in sizes:
        room, take = size, [0] * len(ends)
        for q, share in enumerate(shares):
            credit[q] += share * size
        order = sorted(range(len(ends)), key=lambda q: (-credit[q], q))
        for q in order:
            due = min(credit[q] // unit, room, length[q] - at[q])
            if due <= 0:
                continue
            documents = ends[q]
            while documents[head[q]] < at[q] + due:
                head[q] += 1
            over = documents[head[q]] - at[q] - due
            if over <= slack * shares[q] * size / unit and over <= room - due:
                due += over
            take[q], room = due, room - due
            credit[q] -= due * unit
        while room:  # what the floors left over: one token each, to the largest credits
            order = sorted((q for q in order if at[q] + take[q] < length[q]), key=lambda q: (-credit[q], q))
            for q in order[:room]:
                take[q] += 1
                credit[q] -= unit
            room -= min(room, len(order))
        yield [(q, n) for q, n in enumerate(take) if n]
        at = [a + n for a, n in zip(at, take)]


def pack_mixture(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_OF_DOCUMENT,
                 targets: dict[str, float] | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    ``targets`` are weights of sources; without them every window has the proportions of all tokens. A source without
    a target comes after all others have run dry. Null text and null source count as empty; an empty document is one
    piece of one id. Repeated rows are packed as often as they come; a null doc_id stays null. A text of any length is
    cut as its windows ask, each id lies in one piece. Documents of a source keep the order of the table, ties have no
    meaning. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    if capacity < 1 or shard_tokens < capacity:
        raise ValueError("capacity must be positive and no larger than a shard")
    if targets is not None and not (targets and all(w > 0 for w in targets.values())):
        raise ValueError("targets must be positive weights")
    width = 2 if _vocabulary_size(vocabulary) <= 1 << 16 and end_id < 1 << 16 else 4
    rows = token_rows(documents(docs, keep=["source"]), vocabulary, end_id, f"<u{width}")

    per_task = stage(rows.groupBy("source", "part").agg(F.sum("n").alias("n")))
    per_source = per_task.groupBy("source").agg(F.sum("n").alias("n"))
    total = per_task.agg(F.sum("n").alias("n")).first()["n"] or 0
    named = sorted(targets or {})
    large = per_source.where((F.col("n").cast("decimal(38,0)") * capacity >= total) | F.col("source").isin(named))
    queues = sorted((r["source"], r["n"]) for r in large.collect())  # at most capacity + the targets, by the line above
    tokens = [n for _, n in queues] + [total - sum(n for _, n in queues)]
    weights = [Fraction(n) for n in tokens] if targets is None else [Fraction(targets.get(s, 0)) for s, _ in queues] + [Fraction(0)]
    spans, done, first_shard = [], [0] * len(tokens), 0
    for phase, given in enumerate(phases(tokens, weights)):
        shards = max(1, -(-sum(given) // shard_tokens))
        spans += [(phase, q, done[q], n, sum(given), shards, first_shard) for q, n in enumerate(given) if n]
        done = [d + n for d, n in zip(done, given)]
        first_shard += shards
    windows = (shard_tokens + len(tokens)) // capacity + capacity.bit_length() + 1  # sequences a shard can have

    names = F.broadcast(spark.createDataFrame([(s, q) for q, (s, _) in enumerate(queues)], "source string, queue int"))
    of_task = per_task.join(names, "source", "left").withColumn("queue", F.coalesce("queue", F.lit(len(queues))))
    before = _before(of_task.groupBy("queue", "part").agg(F.sum("n").alias("n")), ["queue"], "part").select("queue", "part", F.col("base").alias("task_base"))
    bases = _before(of_task, ["queue", "part"], "source").join(before, ["queue", "part"])
    bases = stage(bases.select("source", "part", "queue", (F.col("task_base") + F.col("base")).alias("base")))
    schema = "phase int, queue int, span_start long, tokens long, total long, shards long, first_shard long"
    placed = rows.join(broadcast_if_small(bases), ["source", "part"]).withColumn("at", F.col("at") + F.col("base"))
    placed = placed.join(broadcast_if_small(spark.createDataFrame(spans, schema)), "queue")
    placed = placed.withColumn("low", F.greatest(F.lit(0), F.col("at") - F.col("span_start")))
    placed = placed.withColumn("high", F.least(F.col("tokens"), F.col("at") + F.col("n") - F.col("span_start"))).where("low < high")

    # position x lies in the last shard k with floor(tokens k / shards) <= x
    shard_of = "CAST((CAST({} + 1 AS DECIMAL(20,0)) * shards + tokens - 1) div tokens AS BIGINT) - 1"
    cut = "CAST((CAST(tokens AS DECIMAL(20,0)) * {}) div shards AS BIGINT)"
    dealt = placed.withColumn("shard", F.explode(F.sequence(F.expr(shard_of.format("low")), F.expr(shard_of.format("(high - 1)")))))
    dealt = dealt.withColumn("x", F.greatest("low", F.expr(cut.format("shard")))).withColumn("y", F.least("high", F.expr(cut.format("(shard + 1)"))))
    skipped = F.col("x") + F.col("span_start") - F.col("at")
    dealt = dealt.select(
        "phase", "shard", "queue", "x", "doc_id", "doc_tokens", "source", "tokens", "total", "shards", "first_shard",
        (F.col("start") + skipped).alias("start"),
        F.substring("ids", (skipped * width + 1).cast("int"), ((F.col("y") - F.col("x")) * width).cast("int")).alias("ids"),
    )

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["queue", "x"])
        head = frame.iloc[0]
        k, shards, total = int(head["shard"]), int(head["shards"]), int(head["total"])
        parts = [part for _, part in frame.groupby("queue", sort=True)]
        ids = [np.frombuffer(b"".join(part["ids"]), f"<u{width}").astype("<u4") for part in parts]
        ends = [(part["ids"].map(len) // width).cumsum().tolist() for part in parts]
        given = [int(part["tokens"].iloc[0]) for part in parts]
        unit = total * shards
        rounds = deficit_rounds(ends, [g * shards for g in given], [total * (g * k % shards) for g in given], unit,
                                sequence_sizes(sum(map(len, ids)), capacity))
        columns = [list(zip(part["doc_id"].astype("object").where(part["doc_id"].notna(), None), part["start"], part["doc_tokens"], part["source"])) for part in parts]
        at, document, out = [0] * len(parts), [0] * len(parts), []
        for local, taken in enumerate(rounds):
            sequence, offset = (int(head["first_shard"]) + k) * windows + local, 0
            for q, n in taken:
                upto = at[q] + n
                while at[q] < upto:
                    end = ends[q][document[q]]
                    stop = min(end, upto)
                    doc_id, start, doc_tokens, name = columns[q][document[q]]
                    begin = ends[q][document[q] - 1] if document[q] else 0
                    out.append((doc_id, start + at[q] - begin, stop - at[q], zlib.crc32(memoryview(ids[q])[at[q] : stop]), doc_tokens, sequence, offset, name))
                    offset += stop - at[q]
                    at[q] = stop
                    document[q] += stop == end
        made = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])
        return made.astype({"doc_id": "Int64"})

    return dealt.groupBy("phase", "shard").applyInPandas(fill, _PIECES)


def _before(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds ``base``: the tokens of the rows before, within the keys."""
    window = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("base", F.coalesce(F.sum("n").over(window), F.lit(0)))


def _vocabulary_size(vocabulary: str) -> int:
    from demandloom.llm.wordcache import _tokenizer

    return _tokenizer(vocabulary).get_vocab_size()
