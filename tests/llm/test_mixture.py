import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from demandloom.llm.mixture import deficit_rounds, pack_mixture, phases, sequence_sizes

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(VOCABULARY)
TOKENIZER.encode_special_tokens = True


@given(st.integers(0, 5000), st.integers(0, 9).map(lambda b: 1 << b))
def test_sizes_need_no_padding(total, capacity):
    sizes = sequence_sizes(total, capacity)
    assert sum(sizes) == total and all(s == capacity or s & (s - 1) == 0 for s in sizes)


@given(st.lists(st.integers(0, 300), min_size=1, max_size=6), st.data())
def test_phases_give_everything_in_proportion(tokens, data):
    weights = [Fraction(data.draw(st.integers(0, 5))) for _ in tokens]
    made = phases(tokens, weights)
    assert [sum(p[i] for p in made) for i in range(len(tokens))] == tokens
    assert phases(tokens, [Fraction(n) for n in tokens]) == ([tokens] if any(tokens) else [])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 40), min_size=1, max_size=30), min_size=1, max_size=5), st.integers(3, 64))
def test_rounds_keep_shares_and_carry_deficits(queues, capacity):
    ends = [np.cumsum(q).tolist() for q in queues]
    tokens, total = [e[-1] for e in ends], sum(e[-1] for e in ends)
    sizes = sequence_sizes(total, capacity)
    taken, passed = [0] * len(queues), 0
    for size, window in zip(sizes, deficit_rounds(ends, tokens, [0] * len(queues), total, sizes)):
        assert sum(n for _, n in window) == size
        passed += size
        for q, n in window:
            taken[q] += n
        for q, n in enumerate(tokens):  # served tokens stay near the share of all tokens passed, over all windows
            assert abs(taken[q] - passed * n / total) <= 2 + 0.125 * capacity * (n / total + 1)
    assert taken == tokens


def check(frame, rows, capacity):
    """rows: (doc_id, text). Every id in one piece, sequences gapless, full or a power of two; gives {sequence: {source: tokens}}."""
    documents = Counter()
    ids_of = {}
    for i, text in rows:
        ids = np.array(TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        ids_of[i, len(ids)] = ids
        documents[i, len(ids)] += 1
    covered, sequences, mix = defaultdict(list), defaultdict(list), defaultdict(Counter)
    for r in frame.collect():
        part = ids_of[r.doc_id, r.doc_tokens][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(part.tobytes()) and len(part) == r.length > 0
        covered[r.doc_id, r.doc_tokens] += range(r.start, r.start + r.length)
        sequences[r.sequence_id].append((r.offset, r.length))
        mix[r.sequence_id][r.source] += r.length
    assert {k: sorted(v) for k, v in covered.items()} == {k: sorted(list(range(k[1])) * n) for k, n in documents.items()}
    for parts in sequences.values():
        parts.sort()
        size = sum(parts[-1])
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
        assert size == capacity or size < capacity and size & (size - 1) == 0
    return mix


def test_edge_cases(edge_docs, edge_rows, no_docs):
    check(pack_mixture(edge_docs, VOCABULARY), edge_rows, 2048)
    check(pack_mixture(edge_docs, VOCABULARY, capacity=64, shard_tokens=640), edge_rows, 64)
    assert pack_mixture(no_docs, VOCABULARY).count() == 0
    null_source = edge_docs.drop("source").selectExpr("*", "CAST(NULL AS STRING) AS source")
    check(pack_mixture(null_source, VOCABULARY), edge_rows, 2048)
    with pytest.raises(ValueError):
        pack_mixture(no_docs, VOCABULARY, targets={})


def test_every_window_has_the_mixture(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    for shard_tokens in (1 << 20, 20_480):
        mix = check(pack_mixture(documents, VOCABULARY, shard_tokens=shard_tokens), rows, 2048)
        total = sum(mix.values(), Counter())
        size = sum(total.values())
        for window in mix.values():
            if sum(window.values()) == 2048:
                for source, n in total.items():
                    assert abs(window[source] - 2048 * n / size) <= 0.5 * 2048 * n / size + 4


def test_targets_hold_until_a_source_runs_dry(spark):
    rows = [(i, "word " * 99, "ab"[i % 2]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = check(pack_mixture(docs, VOCABULARY, capacity=256, targets={"a": 3.0, "b": 1.0}), [r[:2] for r in rows], 256)
    both = [w for w in mix.values() if set(w) == {"a", "b"} and sum(w.values()) == 256]
    assert len(both) > 90 and all(abs(w["a"] - 192) <= 26 for w in both)
    assert all(set(w) == {"b"} for w in mix.values() if w not in both and sum(w.values()) == 256)


def test_small_sources_share_a_queue(spark):
    rows = [(i, "two words", f"s{i}") for i in range(300)] + [(1000 + i, "word " * 50, "big") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = check(pack_mixture(docs, VOCABULARY, capacity=128, shard_tokens=1024), [r[:2] for r in rows], 128)
    assert sum(mix.values(), Counter())["big"] == 300 * 51
