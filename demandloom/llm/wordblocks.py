"""Work on distinct words instead of occurrences, for corpora whose texts should not move.

1. ``blocks``: every task cuts its documents into blocks and turns each into its distinct words and a stream of
   positions-in-order: the rank of the word at each place. One row a block, written once.
2. ``code``: the distinct words of all blocks are dealt over buckets by their hash, so each distinct word of the corpus
   lies in one bucket, where a function sees it once, with its summed count. Its answer goes back to the blocks.
3. ``reassemble``: block and answers meet again by block id, and each place of the stream gets the answer of its word.

A word that stands in a third of all places is one entry a block. Rows are packed (lengths, then bytes, compressed):
what is shuffled is about a byte and a half a place, and a few bytes a distinct word and block. The number of buckets follows the
number of words, so tasks stay bounded.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.llm.shared import give_back, stage

BLOCK_PLACES = 6_000_000
BUCKET_WORDS = 400_000
#: So many words of a block are ranked by frequency, the rest by their bytes.
FREQUENT = 16_384
#: Text whose words are numbered at a time; a block is closed behind it.
SLICE_BYTES = 1 << 19
BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("ranks", pa.binary()), ("words", pa.binary()), ("counts", pa.binary()), ("n_words", pa.int64())])


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=9).compress(data)


def _expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _planes(body: bytes, width: int) -> bytes:
    """All first bytes of ``width``-byte items, then all second bytes and so on: like bytes compress better together."""
    return np.frombuffer(body, np.uint8).reshape(-1, width).T.tobytes()


def _items(planes: bytes, width: int) -> bytes:
    return np.frombuffer(planes, np.uint8).reshape(width, -1).T.tobytes()


def pack(items: list[bytes], width: int = 1) -> bytes:
    """A list of byte strings, each a multiple of ``width`` long."""
    lengths = np.array([len(i) // width for i in items], "<u4").tobytes()
    return _squeeze(len(items).to_bytes(4, "little") + _planes(lengths, 4) + _planes(b"".join(items), width))


def unpack(packed: bytes, width: int = 1) -> list[bytes]:
    data = _expand(packed)
    n = int.from_bytes(data[:4], "little")
    lengths = np.frombuffer(_items(data[4 : 4 + 4 * n], 4), "<u4").astype(np.int64) * width
    ends = np.cumsum(lengths)
    body = _items(data[4 + 4 * n :], width)
    return [body[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist())]


def pack_numbers(values: np.ndarray) -> bytes:
    """Numbers below 2^32, compressed plane by plane."""
    return _squeeze(_planes(np.asarray(values, "<u4").tobytes(), 4))


def unpack_numbers(packed: bytes) -> np.ndarray:
    return np.frombuffer(_items(_expand(packed), 4), "<u4")


class OneByOne:
    """The words of a block as ``split`` gives them for each text, numbered as they come."""

    def __init__(self, split: Callable[[str], list]):
        self._split, self._index, self._ranks = split, {}, [np.zeros(0, np.uint32)]

    def add(self, texts: pa.Array) -> list[int]:
        """Words of each text."""
        index = self._index
        found = [np.array([index.setdefault(w, len(index)) for w in self._split(text)], np.uint32) for text in texts.to_pylist()]
        self._ranks += found
        return [len(f) for f in found]

    def numbered(self) -> tuple[np.ndarray, list[bytes]]:
        """The number of the word at each place, and the words by number."""
        return np.concatenate(self._ranks), [w if isinstance(w, bytes) else w.encode() for w in self._index]


class LoweredAtSpaces:
    """The same for ``text.encode().lower().split()``, in Arrow calls on whole texts and blocks."""

    def __init__(self):
        self._words: list[pa.Array] = []

    def add(self, texts: pa.Array) -> list[int]:
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        words, bounds = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
        filled = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # white space at the ends of a text makes empty words
        if not filled.all():
            words, bounds = words.filter(pa.array(filled)), np.concatenate([[0], np.cumsum(filled)])[bounds]
        self._words.append(words)
        return np.diff(bounds).tolist()

    def numbered(self) -> tuple[np.ndarray, list[bytes]]:
        coded = pa.chunked_array(self._words, pa.string()).dictionary_encode().combine_chunks()
        coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
        return coded.indices.to_numpy().astype(np.uint32), coded.dictionary.cast(pa.binary()).to_pylist()


def blocks(docs: DataFrame, split: Callable[[str], list], counted: Callable[[int | None], bool], numbering: Callable[[], LoweredAtSpaces] | None = None) -> DataFrame:
    """Staged rows (block, doc_ids, places, ranks, words, counts).

    ``split`` gives the words of a text as str or bytes; ``numbering``, if given, does the same for many texts at a time.
    ``counts`` holds, per word, its places in documents for which ``counted`` is true. The frequent words are ranked by
    frequency, so that most ranks are small; the others by their bytes, so that the words and ranks of a bucket are
    increasing.
    """
    begin = numbering or (lambda: OneByOne(split))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids, sizes, learnt, held, numbers = [], [], [], 0, begin()

        def block() -> pa.RecordBatch:
            ranks, words = numbers.numbered()
            frequency = np.bincount(ranks, minlength=len(words))
            order = np.argsort(-frequency, kind="stable")
            rare = order[FREQUENT:]
            order[FREQUENT:] = rare[pc.sort_indices(pa.array(words, pa.large_binary()).take(pa.array(rare))).to_numpy()]
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order))
            seen = np.repeat(np.array(learnt, bool), np.array(sizes, np.int64)) if learnt else np.zeros(0, bool)
            counts = np.bincount(ranks[seen], minlength=len(words))[order]
            row = {"block": (part << 32) + made, "doc_ids": ids, "places": sizes, "ranks": pack_numbers(place[ranks]), "words": pack([words[i] for i in order.tolist()]), "counts": pack_numbers(counts), "n_words": len(words)}
            return pa.RecordBatch.from_pylist([row], schema=BLOCK_SCHEMA)

        for batch in batches:
            texts = batch.column("text")
            own_ids = batch.column("doc_id").to_pylist()
            for at, upto in _slices(texts):
                places = numbers.add(texts.slice(at, upto - at))
                ids += own_ids[at:upto]
                sizes += places
                learnt += [counted(doc_id) for doc_id in own_ids[at:upto]]
                held += sum(places)
                if held >= BLOCK_PLACES or len(ids) >= BLOCK_PLACES:
                    yield block()
                    ids, sizes, learnt, held, numbers, made = [], [], [], 0, begin(), made + 1
                    give_back()
        if ids:
            yield block()
        give_back()

    return stage(docs.select("doc_id", "text").mapInArrow(rows, "block long, doc_ids array<long>, places array<int>, ranks binary, words binary, counts binary, n_words long"))


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Where rows of about ``SLICE_BYTES`` of text begin and end; one longer text stands alone."""
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield at, upto
        at = upto


def code(made: DataFrame, coder: Callable[[], Callable[[list[bytes], np.ndarray], list[bytes]]]) -> DataFrame:
    """Rows (block, bucket, ranks, answers, distinct_counted, total_counted), not staged.

    ``coder()`` gives a function from the distinct words of a bucket and their counts to one
    answer each, some 32-bit numbers. The last two columns are set in one row of each bucket: its words with a count, and the sum.
    """
    total = made.agg(F.sum("n_words").alias("n")).first()["n"] or 0
    buckets = max(1, -(-total // BUCKET_WORDS))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, packed, counts in zip(batch["block"], batch["words"], batch["counts"]):
                words, counts = unpack(packed), unpack_numbers(counts)
                bucket = np.array([zlib.crc32(w) for w in words], np.int64) % buckets
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order])) + 1
                out = []
                for own in np.split(order, cuts) if len(order) else []:
                    out.append((int(bucket[own[0]]), block, pack_numbers(np.diff(own, prepend=0)), pack([words[i] for i in own]), pack_numbers(counts[own])))
                yield pd.DataFrame(out, columns=["bucket", "block", "ranks", "words", "counts"])

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        words = [unpack(w) for w in frame["words"]]
        index: dict[bytes, int] = {}
        places = [np.array([index.setdefault(w, len(index)) for w in own], np.int64) for own in words]
        counts = np.zeros(len(index), np.int64)
        for own, packed in zip(places, frame["counts"]):
            np.add.at(counts, own, unpack_numbers(packed).astype(np.int64))
        answers = coder()(list(index), counts)
        first = np.arange(len(frame)) == 0
        return pd.DataFrame({"block": frame["block"], "bucket": frame["bucket"], "ranks": frame["ranks"], "answers": [pack([answers[i] for i in own], 4) for own in places], "distinct_counted": np.where(first, int((counts > 0).sum()), 0), "total_counted": np.where(first, int(counts.sum()), 0)})

    dealt = made.select("block", "words", "counts").mapInPandas(deal, "bucket long, block long, ranks binary, words binary, counts binary")
    return dealt.groupBy("bucket").applyInPandas(answer, "block long, bucket long, ranks binary, answers binary, distinct_counted long, total_counted long")


def reassemble(made: DataFrame, coded: DataFrame, use: Callable[[list, list, np.ndarray, list[bytes]], pd.DataFrame], schema: str) -> DataFrame:
    """``use(doc_ids, places, ranks, answers)`` for each block: answers by rank, ranks of all documents in order."""

    def join(block: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        answers = [b""] * int(block["n_words"].iloc[0])
        for ranks, packed in zip(parts["ranks"], parts["answers"]):
            for rank, item in zip(np.cumsum(unpack_numbers(ranks), dtype=np.int64).tolist(), unpack(packed, 4)):
                answers[rank] = item
        row = block.iloc[0]
        out = use([None if pd.isna(i) else int(i) for i in row["doc_ids"]], list(row["places"]), unpack_numbers(row["ranks"]), answers)
        give_back()
        return out

    left = made.select("block", "doc_ids", "places", "ranks", "n_words").groupBy("block")
    return left.cogroup(coded.select("block", "ranks", "answers").groupBy("block")).applyInPandas(join, schema)
