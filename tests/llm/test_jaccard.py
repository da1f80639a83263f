import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from demandloom.llm.components import components
from demandloom.llm.jaccard import all_words, allowed_difference, drop_near_copies, first_words, hamming, jaccard_components, shingle_set, sketch_of


def brute(rows):
    """Components by comparing all pairs of exact word-shingle sets."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set()))
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None:
                continue
            common = len(sets[a] & sets[b])
            if rows[a][0] == rows[b][0] or (common and 100 * common >= 75 * len(sets[a] | sets[b])):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    smallest = {}
    for (i, _), x in zip(rows, label):
        if i is not None:
            smallest[x] = min(i, smallest.get(x, i))
    return sorted(((i, len(s), smallest[x] if i is not None else None) for (i, _), s, x in zip(rows, sets, label)), key=str)


@pytest.fixture(scope="module")
def edited():
    """Texts of many sizes with edited copies around the threshold, chains of copies and a common passage."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = rng.choices(vocabulary, k=60)
    rows = []
    for size in [1, 3, 4, 5, 6, 8, 12, 17, 20, 25, 33, 40, 64, 90, 128, 150, 300, 700] * 2:
        words = rng.choices(vocabulary, k=size)
        if rng.random() < 0.5:
            words = words + passage
        for _ in range(8):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, max(1, size // 60)])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words = words[: max(1, int(len(words) * rng.uniform(0.7, 1)))]
    return rows


def test_components_match_all_pairs(spark, edited):
    frame = spark.createDataFrame(edited, "doc_id long, text string")
    assert sorted((tuple(r) for r in jaccard_components(frame).collect()), key=str) == brute(edited)


def test_hot_words_change_nothing(spark, edited, monkeypatch):
    monkeypatch.setattr("demandloom.llm.jaccard.HOT_DOCUMENTS", 2)
    frame = spark.createDataFrame(edited, "doc_id long, text string")
    assert sorted((tuple(r) for r in jaccard_components(frame).collect()), key=str) == brute(edited)


@pytest.mark.parametrize("blocks", [3, 4096])
def test_large_components_change_nothing(spark, edited, monkeypatch, blocks):
    monkeypatch.setattr("demandloom.llm.jaccard.BIG_COMPONENT", 2)
    monkeypatch.setattr("demandloom.llm.jaccard.RUN_DOCUMENTS", blocks)
    frame = spark.createDataFrame(edited, "doc_id long, text string")
    assert sorted((tuple(r) for r in jaccard_components(frame).collect()), key=str) == brute(edited)


def test_clashing_columns_pass_through(edge_docs, edge_rows):
    docs = edge_docs.withColumn("dropped", edge_docs["doc_id"]).withColumn("__dropped", edge_docs["doc_id"])
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _, c in brute(edge_rows) if c is None or c == i)


def test_edge_cases(edge_docs, edge_rows, no_docs):
    assert sorted((tuple(r) for r in jaccard_components(edge_docs).collect()), key=str) == brute(edge_rows)
    assert jaccard_components(no_docs).count() == 0
    assert drop_near_copies(edge_docs).columns == edge_docs.columns


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 2**32))
def test_similar_sets_share_a_first_word(n, seed):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
    gone = rng.integers(0, allowed_difference(len(a)) + 1)
    b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**63, rng.integers(0, gone + 1), dtype=np.uint64)]))
    common = len(np.intersect1d(a, b))
    different = len(a) + len(b) - 2 * common
    assert hamming(sketch_of(a), sketch_of(b)) <= different
    if common and 100 * common >= 75 * (common + different):
        none = np.zeros(0, np.uint64)
        first = [set(np.concatenate([first_words(w, len(s), none)[0] for w in all_words(s)]).tolist()) for s in (a, b)]
        assert first[0] & first[1]


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_short_texts_are_one_shingle():
    assert len(shingle_set("A b")) == 1 and len(shingle_set(" \n")) == 0
    assert shingle_set("A b") == shingle_set("a  B")
