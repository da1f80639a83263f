import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from demandloom.llm.toxicity import drop_toxic, fit_toxicity, log_odds, maximal_segments, score_toxicity, tokens


def brute_segments(scores):
    """Recursive definition: the best segment (longest of equals from the left), then both sides of it."""
    if not len(scores) or max(scores) <= 0:
        return []
    best, where = 0, None
    for a in range(len(scores)):
        for b in range(a, len(scores)):
            total = sum(scores[a : b + 1])
            if total > best:
                best, where = total, (a, b)
    a, b = where
    return brute_segments(scores[:a]) + [(a, b, best)] + [(x + b + 1, y + b + 1, s) for x, y, s in brute_segments(scores[b + 1 :])]


@given(st.lists(st.integers(-9, 9).filter(bool), max_size=12, unique=True))
def test_maximal_segments(values):
    scores = [v + 1.37e-3 * v * v + 1e-5 * v**3 for v in values]  # no ties
    got = maximal_segments(np.array(scores))
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute_segments(scores)]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(2)
    plain, bad = [f"plain{i}" for i in range(400)], [f"bad{i}" for i in range(6)]
    docs, labels = [], []
    for i in range(600):
        words = rng.choice(plain, rng.integers(20, 120)).tolist()
        toxic = i % 6 == 0
        if toxic:
            at = rng.integers(0, len(words))
            words[at:at] = rng.choice(bad, 6).tolist()
        docs.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(toxic)))
    labels += [(5, 1, None), (None, 1, 1), (999_999, 1, 1), (7, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(corpus, edge_docs):
    docs, labels = corpus
    model = fit_toxicity(docs, labels)
    rows = [r for r in score_toxicity(docs, model).collect() if r.held_out]
    assert len(rows) > 100
    assert np.mean([(r.doc_id % 6 == 0) == (r.predicted == 1) for r in rows]) > 0.98
    kept = {r.doc_id for r in drop_toxic(docs, model).collect()}
    assert kept == {r.doc_id for r in score_toxicity(docs, model).collect() if r.predicted == 0}
    edge = score_toxicity(edge_docs, model).collect()
    assert len(edge) == edge_docs.count() and all(0 <= r.score <= 1 for r in edge)
    assert drop_toxic(edge_docs, model).columns == edge_docs.columns


def test_passages_hold_the_toxic_words(corpus):
    docs, labels = corpus
    model = fit_toxicity(docs, labels)
    texts = {r.doc_id: tokens(r.text) for r in docs.collect()}
    for r in score_toxicity(docs.where("doc_id % 6 = 0 AND doc_id < 120"), model).collect():
        best = max(r.passages, key=lambda s: s["score"])
        inside = texts[r.doc_id][best["first"] : best["last"] + 1]
        assert sum(w.startswith(b"bad") for w in inside) >= 4


def test_nothing_to_learn_from(corpus, no_docs):
    docs, labels = corpus
    model = fit_toxicity(docs, labels.where("doc_id < 0"))
    assert {r.predicted for r in score_toxicity(docs, model).collect()} == {0}
    assert score_toxicity(no_docs, fit_toxicity(no_docs, labels)).count() == 0


def plain_log_odds(rows, prior_share, min_z, min_log_odds):
    """The same rule over lists: each text counts a token once, then at most once for each different token before it."""
    counts, before = ({}, {}), {}
    for text, label in rows:
        words = tokens(text)
        for w in set(words):
            counts[label][w] = counts[label].get(w, 0) + 1
        if label:
            for b, w in zip([b"", *words], words):
                before.setdefault(w, set()).add(b)
    n_toxic, n_clean = sum(counts[1].values()), sum(counts[0].values())
    weight = prior_share * (n_toxic + n_clean)

    def telling(toxic_of):
        out = {}
        for w, t in toxic_of.items():
            c = counts[0].get(w, 0)
            prior = weight * (t + c) / (n_toxic + n_clean)
            delta = np.log((t + prior) / (n_toxic + weight - t - prior)) - np.log((c + prior) / (n_clean + weight - c - prior))
            if delta >= min_log_odds and delta / np.sqrt(1 / (t + prior) + 1 / (c + prior)) >= min_z:
                out[w] = delta
        return out

    fewer = {w: min(counts[1][w], len(before[w])) for w in telling(counts[1])}
    top = telling(fewer)
    rest_toxic, rest_clean = n_toxic - sum(fewer[w] for w in top), n_clean - sum(counts[0].get(w, 0) for w in top)
    return top, min(np.log(max(rest_toxic, 1) / n_toxic) - np.log(max(rest_clean, 1) / n_clean), -0.02)


def test_log_odds_by_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        words = [f"plain{w}" for w in rng.zipf(1.4, 40) % 200]
        label = int(i % 5 == 0)
        if label:
            words[10:10] = [f"bad{w}" for w in rng.integers(0, 9, 5)]
        rows.append((" ".join(words), label))
    rows += [("copied insult here once more", 1)] * 40 + [("", 0), ("", 1)]
    expected, neutral = plain_log_odds(rows, 0.1, 3.0, 1.0)
    got, got_neutral = log_odds(spark.createDataFrame(rows, "text string, label int").repartition(5), 0.1, 3.0, 1.0, 20_000)
    assert any(w.startswith(b"bad") for w in got) and b"insult" not in got
    assert got == pytest.approx(expected) and got_neutral == pytest.approx(neutral)
