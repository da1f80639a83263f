import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from demandloom.llm import shared
from demandloom.llm.packing import pack_documents, sum_of_squares
from demandloom.llm.wordcache import WordEncoder

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(VOCABULARY)
TOKENIZER.encode_special_tokens = True


def naive(lengths, capacity):
    """The rule itself: try every gap and a new sequence, keep the smallest sum of squares."""
    open_count, gaps, out = {}, [], []
    for s in lengths:
        def total(change):
            after = dict(open_count)
            for g, n in change:
                after[g] = after.get(g, 0) + n
            return sum(n * n for g, n in after.items() if 0 < g < capacity)
        choices = [(total([(g, -1), (g - s, 1)]), 0, g) for g in sorted({g for g in gaps if g >= s and g > 0 and g < capacity})]
        choices.append((total([(capacity - s, 1)]), 1, capacity))
        _, fresh, gap = min(choices)
        if fresh:
            gaps.append(capacity - s)
        else:
            gaps[gaps.index(gap)] = gap - s
            open_count[gap] -= 1
        open_count[gap - s] = open_count.get(gap - s, 0) + 1
        out.append(gap)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=60))
def test_rule_and_layout(lengths):
    sequence, offset = sum_of_squares(np.array(lengths, np.int64), 12)
    assert [12 - o for o in offset] == naive(lengths, 12)
    for q in set(sequence.tolist()):
        at = sorted((int(o), n) for o, n, s in zip(offset, lengths, sequence) if s == q)
        assert at[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(at, at[1:])) and sum(at[-1]) <= 12


def check(frame, rows, capacity):
    expected = []
    for i, text in rows:
        ids = np.array(TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for k in range(0, len(ids), capacity):
            expected.append((i, k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(ids[k : k + capacity].tobytes())))
    got = frame.collect()
    assert sorted(map(str, [tuple(r)[:5] for r in got])) == sorted(map(str, expected))
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= capacity
    return len(sequences), -(-sum(e[3] for e in expected) // capacity)


def test_edge_cases(edge_docs, edge_rows, no_docs):
    check(pack_documents(edge_docs, VOCABULARY), edge_rows, 4096)
    check(pack_documents(edge_docs, VOCABULARY, capacity=50, shard_pieces=100), edge_rows, 50)
    assert pack_documents(no_docs, VOCABULARY).count() == 0


def test_documents_fill_their_sequences(documents):
    used, bound = check(pack_documents(documents, VOCABULARY), [(r.doc_id, r.text) for r in documents.collect()], 4096)
    assert used <= 1.05 * bound + 1


def test_exact_fit_counts_as_one_closed_sequence():
    """The last piece goes to the sequence with gap 5: the change there is smaller than for an exact fit of gap 1."""
    _, offset = sum_of_squares(np.array([7, 7, 9, 2, 1], np.int64), 12)
    assert (12 - offset).tolist() == [12, 12, 12, 3, 5]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \t\n\x1c\xa0aZzéÉßẞİıσςΣ'’.,&$-!=<>019²½…̸̀⃣中क्😀|_`~\x7f\x85"), max_size=30), max_size=6))
def test_words_give_the_ids_of_whole_texts(texts):
    texts = [*texts, "the quick brøwn fôxes jumped über œuvre ßtraße ÿ aaaaaaaaaaaaaaaaaaaaaaaaaaaa ö ﬁne ŉ", "it's we'll.don't-'re 's'S '.t &'m a.'s <|endoftext|>x"]
    encoder = WordEncoder(VOCABULARY, remembered=3)
    got = [stream[a:b].tolist() for _, stream, bounds in encoder.texts(pa.array(texts, pa.string())) for a, b in zip(bounds[:-1], bounds[1:])]
    assert got == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]


def test_workers_hold_bounded_batches_and_words(spark):
    """Pipeline: a batch is bounded by its bytes, not its rows, and of a full memory only the words that came again stay."""
    assert spark.conf.get(shared.BATCH_SETTING, None) is None
    texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("long text "), 1000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes]})

    told = [r["bytes"] for r in shared.stage(texts.mapInArrow(sizes, "bytes long")).collect()]
    assert len(told) > 5 and max(told) <= shared.BATCH_BYTES + 20_000
    assert spark.conf.get(shared.BATCH_SETTING, None) is None

    encoder = WordEncoder(VOCABULARY, remembered=40)
    for i in range(30):
        text = "the old stone " + " ".join(f"w{chr(97 + i % 26)}{chr(97 + j)}q{i}" for j in range(20))
        ((_, stream, _),) = encoder.texts(pa.array([text]))
        assert stream.tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids
        assert len(encoder._number) <= 40 + 2 * 23
        assert list(encoder._number)[:3] == ["the", "old", "stone"] and len(encoder._again) == len(encoder._number) == len(encoder._start) - 1
