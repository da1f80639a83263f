import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from demandloom.llm.pii import expectation_maximisation, find_pii, luhn, redact_pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def checksum(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def proper(kind, body):
    digits = re.sub("[^0-9]", "", body)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in body.split(".")), "card": 12 <= len(digits) <= 19 and checksum(digits), "phone": 9 <= len(digits) <= 15}[kind]


def base_spans(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if proper(kind, m[0])]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


TRICKY = [
    "a@b.c_d@e.f x@y.z@q.r", "1.2.3.4.5.6.7.8.9 256.1.1.1 001.002.003.004", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (988) 555-2485, +12 +123456789. ++49 30 1234567",
    "😀 mail a.b@c.de 😀 10.0.0.1 😀", "254 4337166598464399", "x" * 3000 + "@" + "y.z" * 5, "7" * 5000, "1 2 3 4 5 6 7 8 9 " * 800, "call (030) 1234 5678 or me (at) site (dot) org", "+", "@", "1.2.3",
    "12345678901234567890123", "+1" + " " * 400 + "2", None, "", "5,6," * 300 + "user@host.com",
]


def check(frame, rows):
    expected = []
    for i, text in rows:
        spans = base_spans(text or "")
        expected.append((i, *[sum(s.startswith(k + ":") for s in spans) for k in PATTERNS], hashlib.sha256(",".join(spans).encode()).hexdigest()))
    got = frame.collect()
    assert sorted(map(str, [tuple(r)[:6] for r in got])) == sorted(map(str, expected))
    return got


def test_base_spans(spark, documents, edge_docs, edge_rows, no_docs):
    rows = list(enumerate(TRICKY))
    got = check(find_pii(spark.createDataFrame(rows, "doc_id long, text string")), rows)
    for r in got:
        assert set(base_spans(TRICKY[r.doc_id] or "")) <= set(r.spans.split(",")) | {""}
    check(find_pii(documents), [(r.doc_id, r.text) for r in documents.collect()])
    check(find_pii(edge_docs), edge_rows)
    assert find_pii(no_docs).count() == 0


@pytest.mark.parametrize("digits", ["4111111111111111", "4111111111111112", "123456789012", "0000000000000000000"])
def test_checksum(spark, digits):
    assert spark.range(1).select(luhn(F.lit(digits))).first()[0] == checksum(digits)


def test_estimated_reliabilities():
    """Two labelers that agree, one that says yes to everything: the posteriors follow the two."""
    counts = {("email", "11-1-"): 90, ("email", "00-1-"): 300, ("email", "10-1-"): 5, ("email", "---1-"): 10}
    posterior = expectation_maximisation(counts)
    assert posterior["email:11-1-"] > 0.95 and posterior["email:00-1-"] < 0.05


def test_redaction_keeps_rows_and_columns(edge_docs, edge_rows):
    redacted = redact_pii(edge_docs)
    assert redacted.columns == edge_docs.columns
    texts = sorted(r.text or "" for r in redacted.collect())
    assert len(texts) == len(edge_rows)
    assert "ünïcode ẞtraße — mail me: [EMAIL], [PHONE] or [IP]" in texts
    assert sum(t in {x or "" for _, x in edge_rows} for t in texts) == len(edge_rows) - 1


def test_added_spans_overlap_nothing(spark, documents):
    rows = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string").union(documents.select("doc_id", "text"))
    texts = {}
    for r in rows.collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    added = 0
    for r in find_pii(rows).collect():
        spans = [(int(a), int(b), kind) for kind, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        base = [{(int(a), int(b), k) for k, a, b in (s.split(":") for s in base_spans(t))} for t in texts[r.doc_id]]
        base = next(b for b in base if b <= set(spans))
        other = [s for s in spans if s not in base]
        added += len(other)
        assert spans == sorted(spans, key=lambda s: (s[0], list(PATTERNS).index(s[2])))
        assert all(a[1] <= b[0] for a, b in zip(other, other[1:]))
        assert not any(s[0] < b[1] and b[0] < s[1] for s in other for b in base)
    assert added


def test_long_text_takes_time_in_proportion(spark):
    text = " ".join(f"user{i}@host{i}.com +49 30 {1000000 + i}" for i in range(8000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    started = time.time()
    (row,) = find_pii(docs).collect()
    assert (row.n_email, row.n_phone) == (8000, 8000) and time.time() - started < 60


def test_clashing_columns_stay_as_they_are(edge_docs):
    names = ["__text", "__spans", "plain_text", "pii_spans"]
    docs = edge_docs
    for name in names:
        docs = docs.withColumn(name, F.lit("mine"))
    redacted = redact_pii(docs)
    assert redacted.columns == docs.columns
    assert {tuple(r) for r in redacted.select(*names).collect()} == {("mine",) * 4}
