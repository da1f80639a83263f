"""Source divergence audit: how far the term shares of each source lie from those of every other source of its language.

The divergence of two groups is a sum over all kept terms of f(p, q) = (p-q)^2 div (p+q), where p and q are smoothed
shares in billionths, so a term that neither group has still counts. Row accumulation after Gustavson:

1. Tasks count their texts per (lang, source, term), with the number of documents; Spark adds the counts up and keeps
   the terms with enough documents in their language.
2. The postings of a language are dealt by term over blocks of about BLOCK_POSTINGS. In a block they lie term by term
   (the index), and each group is one row: it walks its own terms, and for each the posting list of that term, and
   scatters into one dense accumulator over its peers. Postings meet in the accumulator; pairs of postings are never
   written.
3. Only terms that both groups have are met that way. A term that one of them or both lack has the share of a count of
   zero there, which depends on the group alone; these baselines are added per group from its distinct shares, and
   taken off again where both have the term.
4. A block gives one dense row of partial sums per group; their sums over the blocks are the divergences.

A group with a third of all rows is one row of a block like any other; its texts are counted where they lie. Everything
is integer arithmetic; shares are computed as decimals, sums stay below 2^63.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandloom.llm.shared import broadcast_if_small, documents, stage

MIN_DOCUMENTS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
#: Terms a task holds before it hands its counts on.
HELD_TERMS = 400_000
BLOCK_POSTINGS = 1_000_000
#: Cells of the dense rows that one task gives back.
TILE_CELLS = 4_000_000

_LETTERS = bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: A-Z to a-z, everything else in ASCII to a space.
TERM_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _LETTERS else 0x20 for c in range(256))
_COUNT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("n_docs", pa.int64())])


def term_counts(docs: DataFrame) -> DataFrame:
    """Rows (lang, source, term, n, n_docs), several for a term that several tasks meet."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for (lang, source), (places, texts) in held.items():
                if places:
                    terms = pa.array(list(places), pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([
                        pa.array([lang] * len(places), pa.string()), pa.array([source] * len(places), pa.string()), terms,
                        pa.array(list(places.values()), pa.int64()), pa.array([texts[t] for t in places], pa.int64()),
                    ], schema=_COUNT)

        for batch in batches:
            texts = batch.column("text")
            for i, group in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())):
                terms = texts[i].as_py().encode().translate(TERM_BYTES).split()
                places, met = held.setdefault(group, (Counter(), Counter()))
                places.update(terms)
                met.update(set(terms))
            if sum(len(places) for places, _ in held.values()) > HELD_TERMS:
                yield from told()
                held.clear()
        yield from told()

    return docs.mapInArrow(count, "lang string, source string, term string, n long, n_docs long")


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * kept)), exact for any counts."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    return F.call_function("div", top, (total + 2 * kept).cast("decimal(20,0)")).cast("long") + 1


def gap(p, q):
    """f of two shares; arrays of 64-bit integers."""
    return (p - q) * (p - q) // (p + q)


def block_rows(group: np.ndarray, term: np.ndarray, share_of: np.ndarray, zero: np.ndarray, rows: range) -> np.ndarray:
    """Partial divergences [row, peer] over the terms of one block.

    Postings are (group, term, share); ``zero`` holds the share of a count of zero in each group.
    """
    out = np.zeros((len(rows), len(zero)), np.int64)
    if not len(term):
        return out
    by_term = np.lexsort((group, term))
    peer, peer_share = group[by_term], share_of[by_term]
    starts = np.flatnonzero(np.r_[True, np.diff(term[by_term]) != 0])
    lengths = np.diff(np.r_[starts, len(term)])
    slot = np.empty(len(term), np.int64)  # which list of the index each posting belongs to
    slot[by_term] = np.repeat(np.arange(len(starts)), lengths)
    by_group = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[by_group], np.arange(len(zero) + 1))
    has = np.diff(bounds)
    pairs, times = np.unique(np.stack([group, share_of], 1), axis=0, return_counts=True)  # distinct shares of each group
    pair_bounds = np.searchsorted(pairs[:, 0], np.arange(len(zero) + 1))
    for at, g in enumerate(rows):
        own = by_group[bounds[g] : bounds[g + 1]]
        row = (len(starts) - has[g] - has) * gap(zero[g], zero)  # terms that neither has
        mine = slice(pair_bounds[g], pair_bounds[g + 1])
        for p, n in zip(pairs[mine, 1], times[mine]):
            row += n * gap(p, zero)  # terms of this group, as if no peer had them
        np.add.at(row, pairs[:, 0], times * gap(zero[g], pairs[:, 1]))  # terms of the peers, as if this group had none
        size = lengths[slot[own]]
        if len(own):
            places = np.repeat(starts[slot[own]] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            p, h, q = np.repeat(share_of[own], size), peer[places], peer_share[places]
            np.add.at(row, h, gap(p, q) - gap(p, zero[h]) - gap(zero[g], q) + gap(zero[g], zero[h]))
        out[at] = row
    return out


def source_divergence(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank).

    Part ``pair``: every other source of the language. Part ``term``: the ``top_terms`` kept terms that stand out
    most. Ties rank by item. Null text, lang and source count as empty; a group without terms is compared like any
    other, and where a language keeps no term all values are 0. Texts of any length are counted whole, repeated rows
    as often as they come; doc_id and other columns are ignored. An empty table gives no rows.
    """
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
    texts = documents(docs.withColumn("doc_id", F.lit(None).cast("long")), keep=["lang", "source"])
    counts = term_counts(texts).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    same_term = W.partitionBy("lang", "term")  # at most the sources of the language
    kept = counts.withColumns({
        "in_docs": F.sum("n_docs").over(same_term), "lang_n": F.sum("n").over(same_term), "first": F.min("source").over(same_term) == F.col("source"),
    }).where(F.col("in_docs") >= min_documents)
    kept = stage(kept.select("lang", "source", "term", "n", "lang_n", "first"))

    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("postings"), F.count_if("first").alias("firsts"))
    of_lang = W.partitionBy("lang")
    groups = stage(
        named.distinct().join(totals, ["lang", "source"], "left").na.fill(0, ["total", "postings", "firsts"])
        .withColumns({
            "kept": F.sum("firsts").over(of_lang), "lang_total": F.sum("total").over(of_lang), "peers": F.count(F.lit(1)).over(of_lang),
            "blocks": F.ceil(F.sum("postings").over(of_lang) / BLOCK_POSTINGS).cast("long"),
            "g": F.row_number().over(of_lang.orderBy("source")).cast("long") - 1,
        })
        .withColumn("blocks", F.greatest("blocks", F.lit(1)))
        .withColumn("tile_rows", F.greatest(F.lit(1), F.lit(TILE_CELLS) / F.col("peers")).cast("long"))
        .withColumn("zero", F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.col("kept"))).otherwise(1))
    )
    small = broadcast_if_small(groups)
    postings = kept.join(small, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))
    ranks = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    q = share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    terms = postings.withColumn("q", q).where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= top_terms)

    tiles = F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(peers - 1) div tile_rows"))).alias("tile")
    of_block = postings.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks"))).select("lang", "block", tiles, "g", "term", "p")
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    peers = groups.select("lang", blocks, F.col("g").alias("peer"), "zero", "tile_rows", "peers").select("lang", "block", tiles, "peer", "zero", "tile_rows")

    def accumulate(key: tuple, index: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        zero = own.sort_values("peer")["zero"].to_numpy()
        first, step = key[2] * int(own["tile_rows"].iloc[0]), int(own["tile_rows"].iloc[0])
        rows = range(first, min(first + step, len(zero)))
        term = pd.factorize(index["term"])[0]
        made = block_rows(index["g"].to_numpy(np.int64), term.astype(np.int64), index["p"].to_numpy(np.int64), zero, rows)
        return pd.DataFrame({"lang": key[0], "g": list(rows), "row": list(made)})

    keys = ["lang", "block", "tile"]
    dense = of_block.groupBy(*keys).cogroup(peers.groupBy(*keys)).applyInPandas(accumulate, "lang string, g long, row array<long>")
    cells = dense.select("lang", "g", F.posexplode("row").alias("h", "value")).where("g <> h")
    sums = cells.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    names = groups.select("lang", "g", "source")
    pairs = sums.join(broadcast_if_small(names), ["lang", "g"]).join(
        broadcast_if_small(names.select("lang", F.col("g").cast("int").alias("h"), F.col("source").alias("item"))), ["lang", "h"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranks))
    return pairs.unionByName(terms)
