import hashlib

from pyspark.sql import functions as F

from demandloom.llm.exact_dedup import drop_exact_copies, exact_dedup


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        digest = hashlib.sha256(text.encode()).hexdigest()
        first = True
        for i in sorted(ids, key=lambda i: i != keep):
            out.append((i, keep, len(ids), i == keep and first, digest))
            first = first and i != keep
    return sorted(out, key=str)


def test_edge_cases(edge_docs, edge_rows):
    got = sorted((tuple(r) for r in exact_dedup(edge_docs).collect()), key=str)
    assert got == brute(edge_rows)


def test_empty_table(no_docs):
    assert exact_dedup(no_docs).count() == 0
    assert drop_exact_copies(no_docs).columns == no_docs.columns


def test_colliding_fingerprints_are_widened(edge_docs, edge_rows):
    got = sorted((tuple(r) for r in exact_dedup(edge_docs, digits=(1, 64), pattern=r"(?s).{1,20}").collect()), key=str)
    assert got == brute(edge_rows)


def test_stage_keeps_one_row_of_each_text(edge_docs, edge_rows):
    kept = drop_exact_copies(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted((r.text or "") for r in kept.collect()) == sorted({t or "" for _, t in edge_rows})


def test_dropping_copies_keeps_columns_of_any_name(edge_docs, edge_rows):
    docs = edge_docs
    for name in ["__digest", "kept_id", "kept_sha", "digest", "gone_id"]:
        docs = docs.withColumn(name, F.lit("mine"))
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    best = {}
    for i, text in edge_rows:
        best[text or ""] = max(best.get(text or "", -1 << 80), -1 << 80 if i is None else i)
    got = kept.collect()
    assert sorted((r.text or "", r.doc_id) for r in got) == sorted(best.items())
    assert {r.kept_id for r in got} == {"mine"}
