import numpy as np
import pytest
from pyspark.sql import functions as F

from demandloom.llm.quality import describe_text, score_quality, site_posteriors
from demandloom.llm.shared import is_held_out


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(8)
    docs, labels = [], []
    for i in range(500):
        good = rng.random() < (0.9 if i % 5 else 0.3)
        words = [f"word{rng.integers(0, 300)}" for _ in range(60)]
        if not good:
            words = [w for w in words[:12] for _ in range(5)] if rng.random() < 0.5 else [w + "%%%" for w in words]
        docs.append((i, " ".join(words), f"p{i % 2}", f"host{i % 5}"))
        if i % 3:
            labels.append((i, int(good), 0))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    rows = score_quality(docs, labels, F.col("source"), F.col("lang")).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) > 0.97


def test_sparse_sites_shrink(spark):
    rows = [("big", "a", 1)] * 300 + [("big", "b", 0)] * 300 + [("big", "c", 0)] * 2 + [("tiny", "a", 0)]
    sites, rate = site_posteriors(spark.createDataFrame(rows, "host string, path string, label int"))
    got = {(r.host, r.path): r.posterior for r in sites.collect()}
    assert got["big", "a"] > 0.95 and got["big", "b"] < 0.05
    assert got["big", "b"] < got["big", "c"] < got["big", None]
    assert 0.05 < got["tiny", "a"] < rate


def test_edge_cases(corpus, edge_docs, no_docs):
    docs, labels = corpus
    got = score_quality(edge_docs, labels.where("quality > 1"), F.col("source"), F.col("lang")).collect()
    assert len(got) == edge_docs.count() and {r.score for r in got} == {0.5}
    assert score_quality(no_docs, labels, F.col("source"), F.col("lang")).count() == 0
    joined = score_quality(docs.union(edge_docs.select(docs.columns)), labels, F.lit(None), F.col("lang")).collect()
    assert all(0 <= r.score <= 1 for r in joined)
    assert describe_text("") == [0.0] * 10


def plain_strength(groups):
    """From (n, good, expected rate) of each group."""
    groups = [g for g in groups if g[0] > 1]
    noise = sum(m * (1 - m) for _, _, m in groups)
    if not noise:
        return 10.0
    scatter = sum(n * (good / n - m) ** 2 for n, good, m in groups)
    mass = sum((n - 1) * m * (1 - m) for n, _, m in groups)
    return 1 / min(max((scatter - noise) / mass, 1e-4), 0.5) - 1


def plain_sites(rows):
    paths, hosts = {}, {}
    for host, path, label in rows:
        for table, key in ((paths, (host, path)), (hosts, host)):
            n, good = table.get(key, (0, 0))
            table[key] = n + 1, good + label
    rate = (sum(r[2] for r in rows) + 1) / (len(rows) + 2)
    strength = plain_strength([(n, good, rate) for n, good in hosts.values()])
    of_host = {h: (good + rate * strength) / (n + strength) for h, (n, good) in hosts.items()}
    strength = plain_strength([(n, good, of_host[h]) for (h, _), (n, good) in paths.items()])
    told = {(h, p): (good + of_host[h] * strength) / (n + strength) for (h, p), (n, good) in paths.items()}
    return {**told, **{(h, None): p for h, p in of_host.items()}}, rate


def plain_evidence(x, y, regularisation=1e-3):
    """Newton steps on the mean logistic loss, with a penalty on the coefficients of features scaled to unit deviation."""
    scale = x.std(axis=0, ddof=1)
    scale[scale == 0] = np.inf
    z = np.hstack([(x - x.mean(axis=0)) / scale, np.ones((len(x), 1))])
    penalty = np.diag([regularisation] * x.shape[1] + [0.0])
    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z.T * (p * (1 - p))) @ z / len(z) + penalty + 1e-12 * np.eye(len(w)), z.T @ (p - y) / len(z) + penalty @ w)
    return lambda features: np.append((features - x.mean(axis=0)) / scale, 1) @ w


def test_posteriors_and_scores_by_brute_force(corpus, spark):
    docs, labels = corpus
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = docs.collect()
    training = [r for r in rows if r.doc_id in truth and not is_held_out(r.doc_id, 4)]
    sited = [(r.source, r.lang, truth[r.doc_id]) for r in training]
    expected, rate = plain_sites(sited)
    sites, got_rate = site_posteriors(spark.createDataFrame(sited, "host string, path string, label int"))
    got = {(r.host, r.path): r.posterior for r in sites.collect()}
    assert got_rate == pytest.approx(rate) and got == pytest.approx(expected)

    shapes = np.array([describe_text(r.text) for r in training])
    evidence = plain_evidence(shapes, np.array([truth[r.doc_id] for r in training], float))
    logit = lambda p: np.log(p / (1 - p))
    scored = {r.doc_id: r.score for r in score_quality(docs, labels, F.col("source"), F.col("lang")).collect()}
    assert len(scored) == len(rows)
    for r in rows:
        site = expected.get((r.source, r.lang), expected.get((r.source, None), rate))
        odds = evidence(np.array(describe_text(r.text))) + logit(site) - logit(rate)
        assert scored[r.doc_id] == pytest.approx(1 / (1 + np.exp(-odds)), abs=0.01)
