import re
from collections import Counter
from itertools import permutations

import pandas as pd

from demandloom.llm.filter_audit import ORDERS, filter_audit, packed_outcomes, part_audit, unpack

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def naive(rows, labels):
    """rows: (doc_id, text, lang). Applies every order to every document."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    smallest = {}
    for i, text, _ in rows:
        smallest.setdefault(text or "", []).append(-1 << 80 if i is None else i)
    out = {}
    for i, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": (-1 << 80 if i is None else i) > min(smallest[text]),
        }
        for order in map("".join, permutations("ABCDE")):
            there = True
            for step, f in enumerate(order, 1):
                c = out.setdefault((lang or "", order, step), Counter())
                c["removed"] += there and fails[f]
                c["good_lost"] += there and fails[f] and i in good
                c["toxic_lost"] += there and fails[f] and i in toxic
                c["redundant"] += fails[f] and not there
                c["unique_fails"] += fails[f] and sum(fails.values()) == 1
                there = there and not fails[f]
                c["kept"] += there
    for (part, order, step), c in out.items():
        c["shapley"] = sum(out[part, o, o.index(order[step - 1]) + 1]["removed"] for o in map("".join, permutations("ABCDE")))
    return {k: tuple(c[n] for n in COUNTS) for k, c in out.items()}


def got(frame):
    return {(r.part, r.filter_order, r.step): tuple(r[n] for n in COUNTS) for r in frame.collect()}


def test_edge_cases(spark, edge_rows, edge_docs, no_docs):
    rows = [(i, t, "en") for i, t in edge_rows]
    given = [(2, 1, None), (2, 0, 1), (None, 1, 1), (6, 0, 0), (8, 1, 1), (9, None, 1), (77, 1, 1)]
    labels = spark.createDataFrame(given, "doc_id long, quality int, toxic int")
    assert got(filter_audit(edge_docs, labels)) == naive(rows, given)
    assert filter_audit(no_docs, labels).count() == 0
    assert got(filter_audit(edge_docs, labels.limit(0))) == naive(rows, [])


def test_parts_and_copies_across_them(spark):
    text = "Words # " * 150
    rows = [(5, text, "a"), (3, text, "b"), (4, text, None), (3, text, "b"), (9, "SHOUT " * 300, "a"), (8, None, "a"), (7, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(5, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    assert got(filter_audit(docs, labels)) == naive(rows, [(5, 1, 0), (3, 0, 1)])


def test_counters_do_not_run_into_each_other():
    n = (1 << 63) - 1
    assert (unpack(n * packed_outcomes(0b10101)) == n * (unpack(packed_outcomes(0b10101)) > 0)).all()
    half = 1 << 61
    rows = pd.DataFrame({"part": "", "mask": [31, 0, 4], "good": [True, False, False], "toxic": [False, True, False], "n": [half, half, half]})
    made = part_audit(rows).set_index(["filter_order", "step"])
    assert made.loc[("CABDE", 1), "removed"] == 2 * half and made.loc[("CABDE", 5), "kept"] == half and made.loc[("CABDE", 2), "redundant"] == half
    assert len(made) == 600 and sorted(set(made.reset_index()["filter_order"])) == sorted(ORDERS)
