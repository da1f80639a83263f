import hashlib

from demandloom.llm.chat import format_conversations, format_paths, masked_text, read_turns
from pyspark.sql import functions as F

PROBE = "\\### Assistant: </turn> ok"


def test_trees_and_ranking(spark):
    rows = [
        (1, 1, None, 0.0, "user", "root"), (1, 2, 1, 5.0, "assistant", "good"), (1, 3, 1, 1.0, "assistant", "bad"), (1, 4, 2, 1.0, "user", "end a"), (1, 5, 2, 3.0, "user", "end b"),
        (2, 1, None, None, None, None), (3, 1, 9, 1.0, "user", "orphan"), (3, 2, 1, 1.0, "assistant", PROBE),
        (4, 1, 2, 1.0, "user", "cycle"), (4, 2, 1, 1.0, "user", "cycle"), (4, 3, None, 1.0, "user", "alone"), (5, 1, None, 1.0, "a:b#<\\", "x"), (5, 2, 1, 2.0, "r", "tie"), (5, 3, 1, 2.0, "r", "tie too"),
    ]
    frame = spark.createDataFrame(rows, "tree long, message long, parent long, score double, role string, text string")
    out = format_paths(frame).select("tree", "leaf", read_turns(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss")).alias("masked"))
    got = {r.tree: (r.leaf, [tuple(t) for t in r.turns], r.masked) for r in out.collect()}
    assert got == {
        1: (5, [("user", "root"), ("assistant", "good"), ("user", "end b")], "good"), 2: (1, [("", "")], ""), 3: (2, [("user", "orphan"), ("assistant", PROBE)], PROBE),
        4: (3, [("user", "alone")], ""), 5: (2, [("a:b#<\\", "x"), ("r", "tie")], ""),
    }
    assert {(r.tree, r.leaf) for r in format_paths(frame, top_paths=2).where("tree = 1").collect()} == {(1, 5), (1, 4)}


def test_conversations(spark):
    rows = [(1, 0, "user", "a\n### User: b"), (1, 1, "assistant", PROBE), (1, 1, "assistant", PROBE), (2, 5, None, None), (None, 0, "user", "no id"), (None, None, "assistant", "\\h\\\\ </turn>\n"), (3, 0, "system", "😀")]
    rows += [(4, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(70)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, tree int")
    expected = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        told = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        expected.append((conv, len(own), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    got = [tuple(r)[:5] for r in format_conversations(frame).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected))
    assert format_conversations(frame.where("turn = 99")).count() == 0
