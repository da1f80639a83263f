"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word shingles. Two sets with Jaccard similarity of at least 3/4 differ in at most a
third of the smaller set's size. Shingles are dealt by hash over segments, and the hashes in a segment are XORed into one
word: each differing shingle changes at most one word, so the number of differing words never exceeds the symmetric
difference. With d the largest difference a document allows, at most d of its words are missing in a partner, so any
common order of words puts a shared word among the first d + 1 of both (pigeonhole). Only those are joined.

Segments are laid out per size band (a power of two), and a document also joins the band below when a partner may lie
there. Words that many documents share are found first, over all documents, and come last in the order, so common
passages hardly ever make candidates. A document that fills too few segments is joined by its shingles themselves.

Candidates are verified in three steps: sizes, a bit-parity sketch whose Hamming distance also bounds the symmetric
difference, and the shingle sets, recomputed from the texts of the documents that occur in candidates.

Only components are computed, not all links: first every document is compared with the smallest document of each of its
words (hot words are salted, and the smallest of each salt are compared in turn); then all pairs with a common word
that are still in different components, where of a component with many documents of a word only the nearest to a
document is told; last, documents that this did not join are compared with the whole component, each once, in blocks.
Pairs within a component need no comparison.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, BooleanType
from pyspark.sql.window import Window

from demandloom.llm.components import components
from demandloom.llm.shared import broadcast_if_small, documents, fresh_name, give_back, spread, stage

SHINGLE_WORDS = 5
#: Bands of sets smaller than this are joined by shingles, not by segments.
SMALLEST_SEGMENTED = 16
#: Words seen in at least so many documents are ordered last; the most common ones are told to all tasks.
HOT_DOCUMENTS, HOT_WORDS = 32, 65_536
#: Rows of a hot word are dealt over so many salts.
SALTS = 32
#: Documents of one word that are compared with each other in one run.
RUN_DOCUMENTS = 4096
#: From so many documents of a component in one run on, only the nearest of them is told at first.
BIG_COMPONENT = 8

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)


def _salt(number: int) -> np.uint64:
    return np.uint64(number * int(_MULTIPLIER) % 2**64)


def _mix(values: np.ndarray) -> np.ndarray:
    """Spread every input bit over the output."""
    values = (values ^ (values >> np.uint64(32))) * _ODD
    values = (values ^ (values >> np.uint64(32))) * _ODD
    return values ^ (values >> np.uint64(32))


def shingle_set(text: str, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words make one shingle, no words none."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)
    if len(words) < size:
        total = np.full(1, len(words), np.uint64)
        for value in hashed:
            total = total * _MULTIPLIER + value
        return _mix(total)
    places = len(words) - size + 1
    total = hashed[:places].copy()
    for j in range(1, size):
        total = total * _MULTIPLIER + hashed[j : j + places]
    total = np.sort(_mix(total))
    return total[np.concatenate(([True], total[1:] != total[:-1]))]


def band(n: int) -> int:
    return n.bit_length() - 1


def bands_joined(n: int) -> list[int]:
    """The band of a set of n, and the one below if a set there can be three quarters as large."""
    own = band(n)
    return [own, own - 1] if own and 3 * n <= 4 * ((1 << own) - 1) else [own]


def allowed_difference(n: int) -> int:
    return n // 3


def words_of(shingles: np.ndarray, level: int) -> np.ndarray:
    """Parity words of a set in the layout of a band; below the smallest segmented size the shingles themselves."""
    salt = _salt(level + 1)
    if 1 << level < SMALLEST_SEGMENTED:
        return _mix(shingles ^ salt)
    segments = np.uint64((5 << level) // 4)
    place = (shingles >> np.uint64(20)) % segments
    order = np.argsort(place.astype(np.uint16) if segments <= 1 << 16 else place, kind="stable")  # short numbers sort by radix
    place = place[order]
    starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    parity = np.bitwise_xor.reduceat(shingles[order], starts)
    return _mix(parity + _mix(place[starts] + salt))


def all_words(shingles: np.ndarray) -> Iterator[np.ndarray]:
    """The word sets a document joins by: one per band, and the shingles where segments do not suffice."""
    n = len(shingles)
    for level in bands_joined(n) if n else []:
        words = words_of(shingles, level)
        yield words
        if len(words) <= allowed_difference(n):
            yield _mix(shingles ^ _salt(level + 101))


def first_words(words: np.ndarray, n: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first d + 1 words, cold ones before hot ones, and which of them are hot."""
    keep = allowed_difference(n) + 1
    heat = np.zeros(len(words), bool)
    if len(hot):
        heat = hot[np.minimum(np.searchsorted(hot, words), len(hot) - 1)] == words
    order = np.lexsort((words, heat))[:keep]
    return words[order], heat[order]


def sketch_of(shingles: np.ndarray) -> bytes:
    """Bit parities: bit (hash mod m) is flipped by each shingle, m the power of two from 2n on, 64 at least."""
    m = max(64, 1 << (2 * max(len(shingles), 1) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _folded(sketch: np.ndarray, length: int) -> np.ndarray:
    """A shorter sketch of the same set: halves XORed, as long as it is too long."""
    while len(sketch) > length:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def hamming(a: bytes, b: bytes) -> int:
    """Distance of two sketches, the longer one folded."""
    shorter = min(len(a), len(b))
    x, y = _folded(np.frombuffer(a, np.uint8), shorter), _folded(np.frombuffer(b, np.uint8), shorter)
    return int(np.bitwise_count(x ^ y).sum())


def describe(docs: DataFrame, chunk_words: int = 1_000_000) -> DataFrame:
    """Staged rows (doc_id, n_shingles, digest, sketch) of the documents and, with ``met`` instead of a digest, the
    words that a task met twice in a chunk of its documents: pairs of 64-bit numbers (word, times)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pending, held = [], 0

        def counted() -> bytes:
            words, n = np.unique(np.concatenate(pending), return_counts=True) if pending else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            return np.stack([words[n > 1].view(np.int64), n[n > 1].astype(np.int64)], 1).tobytes()

        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"]):
                shingles = shingle_set(text)
                out.append((doc_id, len(shingles), hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), sketch_of(shingles), None))
                for words in all_words(shingles):
                    pending.append(words)
                    held += len(words)
                if held >= chunk_words:
                    out.append((None, None, None, None, counted()))
                    pending, held = [], 0
                if len(out) >= 2000:
                    yield _described(out)
                    out = []
            yield _described(out)
        yield _described([(None, None, None, None, counted())])
        give_back()

    return stage(docs.mapInPandas(rows, "doc_id long, n_shingles long, digest binary, sketch binary, met binary"))


def _described(out: list) -> pd.DataFrame:
    return pd.DataFrame(out, columns=["doc_id", "n_shingles", "digest", "sketch", "met"]).astype({"doc_id": "Int64", "n_shingles": "Int64"})


def hot_words(described: DataFrame) -> np.ndarray:
    """The words that most documents share, sorted; at most HOT_WORDS of them.

    Tasks have reported the words they met twice; Spark adds the reports up. The list only decides the order of words,
    so a common word that it misses costs time, not links.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for packed in batch["met"]:
                pairs = np.frombuffer(packed, np.int64).reshape(-1, 2)
                yield pd.DataFrame({"word": pairs[:, 0], "n": pairs[:, 1]})

    told = described.where("met IS NOT NULL").select("met")
    counts = told.mapInPandas(rows, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= HOT_DOCUMENTS).orderBy(F.desc("n"), "word").limit(HOT_WORDS).select("word").collect()
    return np.sort(np.array([r["word"] for r in top], np.int64).view(np.uint64))


def incidences(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """Rows (word, salt, doc_id) of the first words of each document; equal sets of one task are told once."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told: set[bytes] = set()
        for batch in batches:
            words, salts, owners = [], [], []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                shingles = shingle_set(text)
                digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
                if digest in told:
                    continue
                if len(told) < 200_000:
                    told.add(digest)
                for own in all_words(shingles):
                    first, heat = first_words(own, len(shingles), hot)
                    words.append(first)
                    salts.append(np.where(heat, 1 + digest[0] % SALTS, 0))
                    owners.append(np.full(len(first), doc_id, np.int64))
                if len(words) > 2000:
                    yield pd.DataFrame({"word": np.concatenate(words).view(np.int64), "salt": np.concatenate(salts).astype(np.int32), "doc_id": np.concatenate(owners)})
                    words, salts, owners = [], [], []
            if words:
                yield pd.DataFrame({"word": np.concatenate(words).view(np.int64), "salt": np.concatenate(salts).astype(np.int32), "doc_id": np.concatenate(owners)})
        give_back()

    return docs.where("doc_id IS NOT NULL").mapInPandas(rows, "word long, salt int, doc_id long")


@pandas_udf(BooleanType())
def may_link(n_a: pd.Series, n_b: pd.Series, sketch_a: pd.Series, sketch_b: pd.Series) -> pd.Series:
    """Sizes and sketches allow a similarity of 3/4: 7 * difference <= n_a + n_b."""
    fits = (4 * np.minimum(n_a, n_b) >= 3 * np.maximum(n_a, n_b)).to_numpy()
    return pd.Series([ok and 7 * hamming(a, b) <= x + y for ok, a, b, x, y in zip(fits, sketch_a, sketch_b, n_a, n_b)], dtype=bool)


@pandas_udf(BooleanType())
def linked(set_a: pd.Series, set_b: pd.Series) -> pd.Series:
    """100 * intersection >= 75 * union, on sorted distinct hashes."""
    out = []
    for a, b in zip(set_a, set_b):
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        common = len(np.intersect1d(x, y, assume_unique=True))
        out.append(common > 0 and 100 * common >= 75 * (len(x) + len(y) - common))
    return pd.Series(out, dtype=bool)


@pandas_udf(BinaryType())
def set_bytes(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: shingle_set(text).tobytes())


def verify(pairs: DataFrame, described: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked."""
    facts = described.where("doc_id IS NOT NULL").select("doc_id", "n_shingles", "sketch").dropDuplicates(["doc_id", "n_shingles", "sketch"])
    a = facts.toDF("a", "n_a", "sketch_a")
    b = facts.toDF("b", "n_b", "sketch_b")
    likely = pairs.join(a, "a").join(b, "b").where(may_link("n_a", "n_b", "sketch_a", "sketch_b"))
    likely = stage(likely.select("a", "b").distinct())
    wanted = stage(likely.select(F.col("a").alias("doc_id")).union(likely.select("b")).distinct())
    sets = stage(docs.join(broadcast_if_small(wanted), "doc_id").select("doc_id", set_bytes("text").alias("shingles")))
    both = likely.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    return stage(both.where(linked("set_a", "set_b")).select("a", "b").distinct())


def _hubs(shared: DataFrame) -> DataFrame:
    """Pairs (a, b): each document and the smallest one of its word; across the salts of a word, their smallest ones."""
    within = shared.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b"))
    per_salt = shared.where("salt > 0").groupBy("word", "salt").agg(F.min("hub").alias("hub"))
    whole = stage(per_salt.groupBy("word").agg(F.min("hub").alias("first")))
    across = per_salt.join(whole, "word").where("hub <> first").select(F.col("first").alias("a"), F.col("hub").alias("b"))
    return within.union(across).distinct()


def _near(bits: np.ndarray, size: np.ndarray, own_bits: np.ndarray, own_size: int) -> np.ndarray:
    """Sketch distance to each row where sizes and sketches allow a link, and a number above all distances elsewhere."""
    distance = np.bitwise_count(bits ^ own_bits).sum(axis=1, dtype=np.int64)
    fits = (4 * np.minimum(size, own_size) >= 3 * np.maximum(size, own_size)) & (7 * distance <= size + own_size)
    return np.where(fits, distance, np.iinfo(np.int64).max)


def _bits(sketches: list[bytes], length: int) -> np.ndarray:
    return np.stack([_folded(np.frombuffer(s, np.uint8), length) for s in sketches]).view(np.uint64)


def _likely_in_run(docs: np.ndarray, component: np.ndarray, sizes: np.ndarray, sketches: list[bytes], block: np.ndarray) -> set[tuple[int, int, bool]]:
    """Pairs of one word in different components whose sizes and sketches allow a link; of two blocks only pairs across.

    Of a component with many documents in the run, a document is told the nearest one alone, marked as such: all
    others follow only if that pair does not join the two.
    """
    across, found = block.min() != block.max(), set()
    if len(docs) <= BIG_COMPONENT:  # most words: no component can be large here
        for i, j in combinations(range(len(docs)), 2):
            if component[i] != component[j] and not (across and block[i] == block[j]):
                n, m = int(sizes[i]), int(sizes[j])
                if 4 * min(n, m) >= 3 * max(n, m) and 7 * hamming(sketches[i], sketches[j]) <= n + m:
                    found.add((min(docs[i], docs[j]), max(docs[i], docs[j]), False))
        return found
    bits, none = _bits(sketches, min(map(len, sketches))), np.iinfo(np.int64).max
    order = np.argsort(component, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], np.diff(component[order]) != 0)))
    ends = np.append(starts[1:], len(order))
    big = ends - starts >= BIG_COMPONENT
    small = np.sort(np.concatenate([np.zeros(0, np.int64), *(order[a:b] for a, b in zip(starts[~big], ends[~big]))]))
    for k, i in enumerate(small[:-1]):
        rest = small[k + 1 :]
        rest = rest[(component[rest] != component[i]) & ((block[rest] != block[i]) | (not across))]
        near = rest[_near(bits[rest], sizes[rest], bits[i], sizes[i]) < none]
        found.update((min(docs[i], j), max(docs[i], j), False) for j in docs[near].tolist())
    for a, b in zip(starts[big], ends[big]):
        members = order[a:b]
        for i in np.flatnonzero(component != component[members[0]]):
            rest = members[block[members] != block[i]] if across else members
            distance = _near(bits[rest], sizes[rest], bits[i], sizes[i])
            if len(rest) and distance.min() < none:
                found.add((docs[i], docs[rest[distance.argmin()]], True))
    return found


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows (word, low, high, ...) to likely pairs (a, b, nearest); only one run of equal keys is held at a time."""
    held = None
    for batch in chain(batches, [None]):
        frame = batch if held is None else held if batch is None else pd.concat([held, batch], ignore_index=True)
        if frame is None or not len(frame):
            continue
        keys = frame[["word", "low", "high"]].to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
        ends = np.append(starts[1:], len(frame))
        if batch is not None:
            held = frame.iloc[starts[-1] :]
            starts, ends = starts[:-1], ends[:-1]
        docs, component, sizes, block = (frame[c].to_numpy() for c in ("doc_id", "component", "n_shingles", "block"))
        sketches, found = frame["sketch"].tolist(), set()
        for a, b in zip(starts.tolist(), ends.tolist()):
            found |= _likely_in_run(docs[a:b], component[a:b], sizes[a:b], sketches[a:b], block[a:b])
        yield pd.DataFrame(list(found), columns=["a", "b", "nearest"]).astype({"a": np.int64, "b": np.int64, "nearest": bool})


def _against_component(outside: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
    """Likely pairs (a, b) of documents and the members of a component: one block of each."""
    if not len(outside) or not len(members):
        return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
    sketches = [*outside["sketch"], *members["sketch"]]
    bits = _bits(sketches, min(map(len, sketches)))
    own, other = bits[: len(outside)], bits[len(outside) :]
    size, docs, parts = members["n_shingles"].to_numpy(), members["doc_id"].to_numpy(), []
    for i, (doc, n) in enumerate(zip(outside["doc_id"].tolist(), outside["n_shingles"].tolist())):
        near = docs[_near(other, size, own[i], n) < np.iinfo(np.int64).max]
        parts.append(np.stack([np.full(len(near), doc, np.int64), near], 1))
    found = np.concatenate(parts)
    return pd.DataFrame({"a": found.min(1), "b": found.max(1)})


def _rest_of_components(told: DataFrame, open_rows: DataFrame, before: DataFrame, after: DataFrame, facts: DataFrame) -> DataFrame:
    """All likely pairs behind the nearest ones that did not join their components.

    ``before`` are the labels the runs were made with, ``after`` those with the links found since. Each document is
    compared once with the members of a component, in blocks of both; no word is involved, so no pair comes twice.
    """
    old, new = before.toDF("doc_id", "component"), after.toDF("doc_id", "now")
    pairs = told.where("nearest").select(F.col("a").alias("doc_id"), F.col("b").alias("member"))
    pairs = pairs.join(new, "doc_id", "left").withColumnRenamed("now", "own").join(new.withColumnRenamed("doc_id", "member"), "member", "left")
    pairs = pairs.where(~F.coalesce("own", "doc_id").eqNullSafe(F.coalesce("now", "member")))
    pairs = pairs.join(old.withColumnRenamed("doc_id", "member"), "member")  # a member of a large component has a label
    wanted = stage(pairs.select("component", "doc_id").distinct())
    if wanted.isEmpty():
        return wanted.selectExpr("doc_id AS a", "doc_id AS b")
    members = stage(open_rows.select("component", "doc_id").distinct().join(wanted.select("component").distinct(), "component"))
    counts = members.groupBy("component").agg(F.ceil(F.count("*") / RUN_DOCUMENTS).alias("m")).join(
        wanted.groupBy("component").agg(F.ceil(F.count("*") / RUN_DOCUMENTS).alias("o")), "component")
    counts = stage(counts)

    def blocks(rows: DataFrame, own: str, other: str, own_name: str, other_name: str) -> DataFrame:
        dealt = rows.join(counts, "component").withColumn(own_name, F.pmod(F.hash("doc_id"), F.col(own).cast("int")))
        dealt = dealt.withColumn(other_name, F.explode(F.sequence(F.lit(0), F.col(other).cast("int") - 1)))
        names = ["component", "mb", "ob", "doc_id", "n_shingles", "sketch"]
        return dealt.join(facts, "doc_id").select(*names).toDF(*names)  # columns of its own on each side

    keys = ["component", "mb", "ob"]
    outside = blocks(wanted, "o", "m", "ob", "mb").groupBy(*keys)
    return outside.cogroup(blocks(members, "m", "o", "mb", "ob").groupBy(*keys)).applyInPandas(_against_component, "a long, b long").distinct()


def _open_rows(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Staged rows (word, doc_id, component, blocks) of the words that lie in more than one component."""
    named = shared.join(labels.toDF("doc_id", "component"), "doc_id", "left")
    named = stage(named.select("word", "doc_id", F.coalesce("component", "doc_id").alias("component")).distinct())
    spans = named.groupBy("word").agg(F.min("component").alias("lowest"), F.max("component").alias("highest"), F.count("*").alias("n"))
    open_words = stage(spans.where("lowest <> highest").select("word", F.ceil(F.col("n") / RUN_DOCUMENTS).cast("int").alias("blocks")))
    return stage(named.join(open_words, "word"))


def _open_pairs(open_rows: DataFrame, facts: DataFrame) -> DataFrame:
    """The likely pairs among all that share a word and lie in different components.

    The documents of a word are compared in blocks of ``RUN_DOCUMENTS``: each pair of blocks is a run of its own, so a
    word that very many documents share is split over tasks.
    """
    mixed = open_rows.withColumn("block", F.pmod(F.hash("doc_id"), F.col("blocks")))
    meets = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = mixed.select("word", "doc_id", "component", "block", meets)
    dealt = dealt.select("word", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "doc_id", "component", "block")
    runs = spread(dealt.join(facts, "doc_id"), "word", "low", "high").sortWithinPartitions("word", "low", "high")
    return runs.mapInPandas(_runs, "a long, b long, nearest boolean").distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Two documents link when 100 * intersection >= 75 * union of their shingle sets. Null and empty texts, and texts of
    white space, have no shingles and no links. Rows with the same doc_id are one node; a null doc_id links with
    nothing and keeps a null component. An empty table gives no rows; other columns are ignored.
    """
    rows = documents(docs, id_col, text_col)
    described = describe(rows)
    told_words, described = described, described.where("met IS NULL")
    filled = described.where("doc_id IS NOT NULL AND n_shingles > 0")
    first = stage(filled.groupBy("digest").agg(F.min("doc_id").alias("first")))
    copies = filled.join(first, "digest").where("doc_id <> first").select("first", "doc_id")

    by_word = Window.partitionBy("word", "salt")
    met = spread(incidences(rows, hot_words(told_words)), "word", "salt")
    grouped = met.withColumn("hub", F.min("doc_id").over(by_word)).withColumn("high", F.max("doc_id").over(by_word))
    shared = stage(grouped.where("salt > 0 OR hub < high").drop("high"))

    links = copies.union(verify(stage(_hubs(shared)), described, rows))
    labels = stage(components(links))
    facts = described.where("doc_id IS NOT NULL").select("doc_id", "n_shingles", "sketch").distinct()
    open_rows = _open_rows(shared, labels)
    told = stage(_open_pairs(open_rows, facts))
    more = verify(told.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), described, rows)
    joined = labels if more.isEmpty() else stage(components(labels.select("node", "component").union(more)))
    rest = stage(_rest_of_components(told, open_rows, labels, joined, facts))
    rest = rest if rest.isEmpty() else verify(rest, described, rows)
    labels = joined if rest.isEmpty() else stage(components(joined.select("node", "component").union(rest)))
    named = described.select("doc_id", "n_shingles").join(labels.toDF("doc_id", "component"), "doc_id", "left")
    return named.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The documents, all columns, of which no similar one has a smaller doc_id; rows without id stay.

    Columns of any name pass through; nulls, long texts and ties are treated as in ``jaccard_components``.
    """
    own = fresh_name(docs, "dropped")
    dropped = jaccard_components(docs).where("component_id <> doc_id").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(broadcast_if_small(stage(dropped)), F.col("doc_id") == F.col(own), "left_anti")
