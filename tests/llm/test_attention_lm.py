import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from demandloom.llm import wordcache
from demandloom.llm.attention_lm import AttentionLM, Coded, Scratch, Weights, cut_windows, gather, neighbourhoods, local_steps, loss_and_gradient, lower_words, score_documents, window_starts, word_answers, WordCounts
from demandloom.llm.shared import documents as plain
from demandloom.llm.shared import is_held_out, stage
from demandloom.llm.wordblocks import LoweredAtSpaces, blocks, code

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def doubles(w):
    return Weights(*[p.astype(np.float64) for p in w.parts()])


def test_gradient_by_differences():
    rng = np.random.default_rng(0)
    w = doubles(Weights.start(5))
    before, target = rng.integers(0, 5, (3, 32)), rng.integers(0, 5, (3, 32))
    gradient = loss_and_gradient(w, before, target)[1].flat()

    def moved(i, by):
        flat, parts, at = w.flat(), [], 0
        flat[i] += by
        for p in w.parts():
            parts.append(flat[at : at + p.size].reshape(p.shape))
            at += p.size
        return loss_and_gradient(Weights(*parts), before, target)[0]

    for i in rng.integers(0, len(gradient), 40):
        assert abs((moved(i, 1e-5) - moved(i, -1e-5)) / 2e-5 - gradient[i]) < 1e-5


def model():
    rng = np.random.default_rng(1)
    classes = np.arange(30) % 4
    classes[29] = 4
    weight = rng.random(30) + 0.1
    inside = np.log(weight / np.bincount(classes, weight)[classes])
    return AttentionLM(classes, inside, Weights.start(5, seed=9), 29)


def test_each_id_scored_once_from_what_stands_before():
    lm, rng = model(), np.random.default_rng(2)
    streams = [np.append(rng.integers(0, 29, n), 29) for n in (0, 1, 15, 31, 32, 33, 47, 48, 49, 200)]
    got = lm.scores(streams, batch=3)
    w, scale = doubles(lm.weights), 1 / np.sqrt(16)
    for stream, score in zip(streams, got):
        classes = lm.classes[np.concatenate(([29], stream))]
        total = 0.0
        for t in range(len(stream)):
            start = 0 if t < 32 else (t - 16) // 16 * 16  # the window whose second half holds t
            x = w.embed[classes[start : t + 1]]
            logits = (x[-1] @ w.query) @ (x @ w.key).T * scale + w.bias[np.arange(len(x))[::-1]]
            attention = np.exp(logits) / np.exp(logits).sum()
            out = np.concatenate([x[-1], attention @ (x @ w.value)]) @ w.out + w.offset
            p = np.exp(out) / np.exp(out).sum()
            total += math.log10(p[lm.classes[stream[t]]]) + lm.inside[stream[t]] / math.log(10)
        assert score == pytest.approx(total, rel=1e-4)


def test_probabilities_of_all_next_ids_sum_to_one():
    lm = model()
    prefix = np.arange(20) % 29
    longer = lm.scores([np.append(prefix, i) for i in range(30)])
    assert np.sum(10 ** (longer - lm.scores([prefix])[0])) == pytest.approx(1, abs=1e-4)


def test_training_learns_a_rule():
    rng = np.random.default_rng(3)
    first = rng.integers(0, 4, (400, 1))
    ids = (first + np.arange(33)) % 4
    w, seen = local_steps(Weights.start(5), iter([ids[:150], ids[150:]]), 400, 0, least=300)
    assert seen == 400
    assert loss_and_gradient(w, ids[:, :-1], ids[:, 1:])[0] < 0.2


def check(frame, rows):
    counts = Counter()
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    for i, text in rows:
        if not out(i):
            counts.update((text or "").encode().lower().split() + [None])
    n, v = sum(counts.values()), len(counts)
    expected = []
    for i, text in rows:
        words = (text or "").encode().lower().split() + [None]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        expected.append((str(i), out(i), len(words), sum(counts[w] > 0 for w in words), n, round(base, 5)))
    got = frame.collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == sorted(expected)
    assert all(r.score < 0 for r in got)
    return got


def test_base_scores_and_held_out_likelihood(documents):
    got = check(score_documents(documents, VOCABULARY), [(r.doc_id, r.text) for r in documents.collect()])
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) / sum(r.n_tokens for r in held) > -5.5  # log10 a word; even odds over all ids give about -9
    familiar = [r for r in held if r.n_known == r.n_tokens]
    assert sum(r.score for r in familiar) >= sum(r.base_score for r in familiar)


def test_edge_cases(edge_docs, edge_rows, no_docs):
    check(score_documents(edge_docs, VOCABULARY), edge_rows)
    assert score_documents(no_docs, VOCABULARY).count() == 0


def test_word_probabilities_by_hand_and_their_sum():
    lm = model()
    begun, begun_once, once = np.arange(30), np.arange(30) % 3, np.arange(30) % 4
    words = WordCounts.of(lm.classes, lm.inside, begun, begun_once, once)
    for c in range(5):
        own = lm.classes == c
        assert np.exp(words.inside_new[own]).sum() == pytest.approx(1)
        assert words.begun[c] == begun[own].sum()
        assert words.new_rate[c] == pytest.approx((begun_once[own].sum() + (begun_once.sum() + 1) / (begun.sum() + 2)) / (begun[own].sum() + 1))
    stream = np.array([3, 8, 12, 5, 29])  # words 3+8, 12, 5, end
    got = lm.word_logs([stream], np.array([2, 1, 1, 1]), np.array([0, 4, 7, 6]), words)
    of_class = lm.class_logs([stream])
    for word, places, count in ((0, (0, 1), 0), (1, (2,), 4), (2, (3,), 7), (3, (4,), 6)):
        first = lm.classes[stream[places[0]]]
        spelled = words.new_rate[first] * math.exp(sum(of_class[p] + words.inside_new[stream[p]] for p in places))
        known = (1 - words.new_rate[first]) * math.exp(of_class[places[0]]) * count / words.begun[first]
        assert got[word] == pytest.approx(math.log(spelled + known))
    # all words of one id after the same words, of which each occurs as often as its id begins one
    each = [math.exp(lm.word_logs([np.array([3, i])], np.array([1, 1]), np.array([1, begun[i]]), words)[1]) for i in range(30)]
    assert sum(each) == pytest.approx(1, abs=1e-4)


def test_windows_hold_every_training_id(spark):
    texts = [" ".join(f"w{i}x{j}" for j in range(n)) for i, n in enumerate((0, 1, 7, 900))]
    made = blocks(plain(spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")), lower_words, lambda doc_id: True)
    rows = gather(made, stage(code(made, word_answers(VOCABULARY))), 49407).collect()
    windows = np.concatenate([np.frombuffer(r.windows, "<u4").reshape(-1, 33) for r in rows if r.id < 0])
    assert sum(r.n for r in rows if r.id < 0) == len(windows)
    assert {r.id for r in rows if r.id >= 0} == set(windows[:, 1:].ravel().tolist())
    learnt = [text.split() for i, text in enumerate(texts, 1) if not is_held_out(i, 7)]
    assert sum(r.begun for r in rows) == sum(len(words) + 1 for words in learnt)
    assert sum(r.begun_once for r in rows) == sum(n == 1 for n in Counter(w for words in learnt for w in words).values())
    for n in range(1, 200):
        assert {s + j for s in window_starts(n) for j in range(32)} >= set(range(n))


ODD = ["", " ", "Two  words\tand\nlines\x0b\x0c\r", "ÀÉ ünïcode ẞ\u00a0x\u2003y \x85z", "a,b a, b a", " lead", "trail ", "ZZ \x1f \x00 q"]


def test_words_numbered_for_many_texts_are_those_of_each():
    numbers = LoweredAtSpaces()
    places = [n for at in range(0, len(ODD), 3) for n in numbers.add(pa.array(ODD).slice(at, 3))]
    ranks, words = numbers.numbered()
    expected = [lower_words(t) for t in ODD]
    assert places == [len(w) for w in expected]
    assert [words[r] for r in ranks] == [w for own in expected for w in own]
    assert len(set(words)) == len(words) == ranks.max() + 1
    none = LoweredAtSpaces()
    assert none.add(pa.array(["", " \n"])) == [0, 0] and len(none.numbered()[0]) == 0


def test_words_share_the_tokens_of_their_pieces(monkeypatch):
    words = [f"{a}{w}{b}" for w in ("some", "straße", "don't", "x9", "né") for a in ("", "(", "<|") for b in ("", ",", "...", "|>", "\u00a0")] + ["<|endoftext|>", "\ufffd", "ünï-code", "É"]
    told, ids = [], wordcache.word_ids
    monkeypatch.setattr(wordcache, "_ENCODERS", {})
    monkeypatch.setattr(wordcache, "word_ids", lambda vocabulary, own: told.extend(own) or ids(vocabulary, own))
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.encode_special_tokens = True
    got = wordcache.encode_words(VOCABULARY, [w.encode() for w in words])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    assert len(told) < len(words) / 2  # before, each word of marks was merged anew


def test_answers_in_flat_arrays_and_windows_of_many_texts():
    rng = np.random.default_rng(6)
    ids = [rng.integers(0, 90, n).astype("<u4") for n in (2, 0, 1, 3)]
    counts = [4, 1, 0, 1 << 40]
    coded = Coded.of([c.to_bytes(8, "little") + i.tobytes() for c, i in zip(counts, ids)], 99, 6)
    assert coded.counts.tolist() == [*counts, 6] and coded.sizes.tolist() == [2, 0, 1, 3, 1]
    texts = [rng.integers(0, 4, n) for n in (0, 1, 40, 3, 0, 200, 16)]
    streams = [np.concatenate([*(ids[r] for r in t), [99]]).astype(np.int64) for t in texts]
    for most in (1, 60, 10_000):
        parts = list(coded.texts(np.concatenate(texts), np.array([len(t) for t in texts]), most))
        assert [a for a, *_ in parts] + [len(texts)] == [0] + [b for _, b, *_ in parts]
        assert np.concatenate([words for _, _, words, *_ in parts]).tolist() == [r for t in texts for r in [*t, 4]]
        assert [n for p in parts for n in p[3]] == [len(t) + 1 for t in texts]
        assert np.concatenate([p[4] for p in parts]).tolist() == np.concatenate(streams).tolist()
        assert [n for p in parts for n in p[5]] == [len(s) for s in streams]
        expected = []
        for s in streams:
            padded = np.concatenate(([99], s, np.full(32, 99)))
            expected += [padded[i : i + 33].tolist() for i in window_starts(len(s))]
        assert [w.tolist() for p in parts for w in cut_windows(p[4], p[5], 99)] == expected


def test_gradient_with_used_memory_and_with_wide_logits():
    rng = np.random.default_rng(7)
    scratch = Scratch()
    for n, factor in ((40, 1), (7, 1), (40, 60)):
        w = Weights.start(81)
        w = w.like(w.flat() * factor)
        before, target = rng.integers(0, 81, (2, n, 32))
        loss, fresh = loss_and_gradient(w, before, target)
        again = loss_and_gradient(w, before, target, scratch, False)[1]
        assert np.isfinite(loss) and np.isfinite(fresh.flat()).all()
        assert np.array_equal(fresh.flat(), again.flat())


def test_neighbours_against_pairs(spark):
    rng = np.random.default_rng(8)
    windows = rng.choice(60, (50, 33)).astype("<u4")
    windows[40:] = rng.choice(np.arange(20, 60), (10, 33))
    frame = stage(spark.createDataFrame([(bytearray(windows[a:b].tobytes()),) for a, b in ((0, 13), (13, 40), (40, 50))], "windows binary").repartition(3))
    anchors, ends_word = np.array([7, 3, 11]), np.arange(60) % 2
    expected = np.zeros((60, 5))
    for row in windows:
        for place, i in enumerate(row[1:], 1):
            expected[i] += [*((row == a).sum() for a in anchors), 1, ends_word[row[place - 1]] == 0]
    assert np.array_equal(neighbourhoods(frame, anchors, 60, ends_word), expected)
