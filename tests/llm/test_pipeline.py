"""Each stage against a brute-force version over its own input."""

import re

import corpus_pipeline
from demandloom.llm.toxicity import fit_toxicity, score_toxicity


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def similar(rows):
    """Smallest id of each document's component, over all pairs that share a shingle."""
    sets, by_shingle = {r.doc_id: shingles(r.text) for r in rows}, {}
    for i, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    label = {i: i for i in sets}
    for ids in by_shingle.values():
        for a, b in zip(ids, ids[1:]):
            for c in ids:
                if label[a] != label[c] and 100 * len(sets[a] & sets[c]) >= 75 * len(sets[a] | sets[c]):
                    low, high = sorted((label[a], label[c]))
                    label = {i: low if x == high else x for i, x in label.items()}
    return label


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "n-gram Jaccard join", "PII", "best-fit packing"]
    results = []
    for k, (_, function) in enumerate(corpus_pipeline.STAGES):
        function(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        results.append(docs)
    given = spark.read.parquet(f"{folder}/documents.parquet")
    assert all(r.columns == given.columns for r in results[:-1])
    clean, unique, apart, redacted, pieces = [r.collect() for r in results]

    labels = spark.read.parquet(f"{folder}/labels.parquet")
    predicted = {r.doc_id: r.predicted for r in score_toxicity(given, fit_toxicity(given, labels)).collect()}
    assert {r.doc_id for r in clean} == {i for i, p in predicted.items() if p == 0}

    largest = {}
    for r in clean:
        largest[r.text] = max(r.doc_id, largest.get(r.text, r.doc_id))
    assert sorted(r.doc_id for r in unique) == sorted(largest.values())

    label = similar(unique)
    assert sorted(r.doc_id for r in apart) == sorted(i for i in label if label[i] == i)

    assert sorted(r.doc_id for r in redacted) == sorted(r.doc_id for r in apart)
    before = {r.doc_id: r.text for r in apart}
    for r in redacted:
        assert not re.search(r"[a-z0-9]@[a-z0-9]+\.[a-z]", r.text)
        if not re.search("[0-9@]", before[r.doc_id]):
            assert r.text == before[r.doc_id]
        assert r.n_chars == len(r.text)

    assert {r.doc_id for r in pieces} == {r.doc_id for r in redacted}
    assert sorted((tuple(r)[0], tuple(r)[1], tuple(r)[4]) for r in corpus_pipeline.run(spark, folder).collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in pieces)
