import numpy as np
import pytest

from demandloom.llm.near_vectors import near_vectors, passes_for


def brute(rows):
    links = {}
    for i, v, label in rows:
        links.setdefault(i, set())
        for j, w, other in rows:
            if i != j and label is not None and label == other and v and w and len(v) == len(w) and None not in v and None not in w:
                x, y = np.array(v, float), np.array(w, float)
                if np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any() and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                    links[i].add(j)
    return links


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    for c in range(60):
        centre = rng.standard_normal(16)
        for _ in range(rng.integers(1, 9)):
            out.append((len(out), (centre + 0.12 * rng.standard_normal(16)).tolist(), int(c % 3)))
    same = rng.standard_normal(16).tolist()
    out += [(1000 + i, same, 1) for i in range(50)] + [(2000, same, 2), (2001, [2 * x for x in same], 1), (2002, same, None)]
    out += [(3000, None, 1), (3001, [0.0] * 16, 1), (3002, [float("nan")] + same[1:], 1), (3003, [float("inf")] + same[1:], 1), (3004, [None] + same[1:], 1), (3005, same[:8], 1), (3006, [], 1)]
    return out


def test_links_and_components(spark, rows):
    frame = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, label int, sign long")
    links = brute(rows)
    got = {r.vec_id: r for r in near_vectors(frame).collect()}
    assert len(got) == len(rows)
    found, true = sum(r.n_links for r in got.values()), sum(map(len, links.values()))
    assert all(got[i].n_links <= len(links[i]) for i in links) and found >= 0.99 * true
    for i, r in got.items():
        reach, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - reach:
                reach.add(j)
                todo.append(j)
        if found == true:
            assert r.component_id == min(reach) and r.kept == (r.component_id == i)


def test_null_ids_and_empty_table(spark):
    frame = spark.createDataFrame([(None, [1.0, 2.0], 1), (4, [1.0, 2.0], 1), (4, [1.0, 2.0], 1)], "vec_id long, embedding array<double>, label int")
    got = sorted((tuple(r) for r in near_vectors(frame).collect()), key=str)
    assert [g[0] for g in got] == [4, 4, None] and [g[1] for g in got] == [1, 1, 0]
    assert near_vectors(frame.where("label = 9")).count() == 0


def test_dense_groups_lose_no_link(spark):
    rng = np.random.default_rng(8)
    one, other = rng.standard_normal((2, 16))
    rows = [(i, ((1 + i / 7000) * one).tolist(), 1) for i in range(1500)] + [(2000 + i, (other + 1e-3 * rng.standard_normal(16)).tolist(), 1) for i in range(700)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r.n_links, r.component_id) for r in got if r.vec_id < 2000} == {(1499, 0)}
    assert {(r.n_links, r.component_id) for r in got if r.vec_id >= 2000} == {(699, 2000)}


def test_passes_grow_with_the_vectors_of_a_label():
    assert [passes_for(n) for n in (0, 1, 512, 10_000)] == [16] * 4
    assert 16 < passes_for(300_000) < passes_for(3_000_000) < 60
