import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from demandloom.llm import divergence
from demandloom.llm.divergence import block_rows, gap, source_divergence

LOWER = {c: c + 32 for c in range(65, 91)}


def naive(rows, least=10, top=10):
    """rows: (text, lang, source). The definition, term by term."""
    groups, met, counts = defaultdict(set), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        counts[lang, source].update(terms)
        met[lang].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in met[lang].items() if n >= least]

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1000000000 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out |= {(lang, s, part, item, -value, rank) for rank, (value, _, item) in enumerate(sorted(found)[:most], 1)}
    return out


def got(frame):
    rows = [(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in frame.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 9), st.integers(1, 3)), unique_by=lambda r: r[:2]), st.integers(1, 5))
def test_row_accumulation(postings, step):
    total = [sum(n for g, _, n in postings if g == i) + 20 for i in range(5)]
    share = [[1 + 1000000000 * (2 + sum(n for g, u, n in postings if (g, u) == (i, t))) // total[i] for t in range(10)] for i in range(5)]
    zero = np.array([1 + 2000000000 // n for n in total])
    used = sorted({t for _, t, _ in postings})
    index = np.array([(g, t, share[g][t]) for g, t, _ in postings], np.int64).reshape(-1, 3)
    made = np.concatenate([block_rows(*index.T, zero, range(a, min(a + step, 5))) for a in range(0, 5, step)])
    for g in range(5):
        for h in range(5):
            assert made[g, h] == sum(gap(share[g][t], share[h][t]) for t in used)


def test_definition_on_documents(documents, monkeypatch):
    rows = [(r.text, r.lang, r.source) for r in documents.collect()]
    assert got(source_divergence(documents)) == naive(rows)
    monkeypatch.setattr(divergence, "BLOCK_POSTINGS", 500)
    monkeypatch.setattr(divergence, "TILE_CELLS", 70)
    assert got(source_divergence(documents, min_documents=3)) == naive(rows, least=3)


def test_edge_cases(spark, edge_docs, edge_rows, no_docs):
    assert got(source_divergence(edge_docs, min_documents=1)) == naive([(t, "en", "s") for _, t in edge_rows], least=1)
    assert source_divergence(no_docs).count() == 0
    rows = [(None, "a", "x"), ("", None, None), ("b B é1É _c", "a", "y"), ("É B", "a", None), ("b", "a", "x"), ("b b", "a", "x"), ("zz zz", "q", "1"), ("...", "q", "2")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    for least in (1, 2, 3, 10):
        assert got(source_divergence(docs, min_documents=least)) == naive(rows, least=least)
