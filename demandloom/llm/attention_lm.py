"""Causal self-attention language model on subword ids, trained in numpy.

The network gives each subword id and the end P(class of id | ids before). P(text) is the product over its words and its
end of P(class of the first id | ids before) times the sum of two parts, so the sum over all texts is at most one:

* as a new word: the rate of new words that begin with the class, times P(id | class) of the first id and P(class | ids
  before) * P(id | class) of the others, with P(id | class) of words seen once;
* as a known word: the rest, times the word's share of the training words that begin with the class.

The rate of new words is that of words seen once in training.

* Ids come from a public tokenizer, each distinct word of the corpus encoded once (see ``wordblocks``).
* P(id | class) are add-one counts over all training documents, and beside them counts in the words seen once. Classes group ids that stand near the same frequent ids
  and agree in whether they end a word and whether they mostly go on with one.
* P(class | before) is a self-attention layer with relative position bias over at most ``CONTEXT`` ids. It is trained by
  rounds of local Adam steps: every task works on the windows of its partition, some at a time, Spark averages the weights by windows.
  The windows cover every id of every training document. Each round takes its own share of them, so the whole text is
  learned from once, and the neighbourhoods are counted over all of it.
* Scoring cuts a document into windows that overlap by half. The first scores all its ids, each later one its second
  half, so every id is scored once with at least half a window before it. Windows are scored in batches under a causal mask.

The base score is an add-one unigram model on words whose counts the distinct-word shuffle adds up over all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.llm.shared import documents, held_out, is_held_out, shuffle_partitions, stage
from demandloom.llm.wordblocks import LoweredAtSpaces, blocks, code, reassemble
from demandloom.llm.wordcache import encode_words

FOLDS = 7
CONTEXT, WIDTH, CLUSTERS = 32, 16, 20
#: Batches are so small that their arrays stay in the cache of a core.
ROUNDS, BATCH, LEAST_STEPS, RATE, SCORED_WINDOWS = 3, 128, 240, 0.01, 128
#: Ids of documents that are cut or scored at a time.
GROUP_IDS = 300_000
#: Places whose class probabilities are worked on at a time in training.
OUT_ROWS = 512
ANCHORS = 48
#: Windows whose neighbours are counted at a time.
NEAR_WINDOWS = 16_384
#: Windows a training task works on at least, so that one pass over them makes enough steps; it holds no more at a time.
TASK_WINDOWS = LEAST_STEPS * BATCH
#: Windows of a staged row at most; a block of few windows is cut into more rows, so that every round gets some.
ROW_WINDOWS, BLOCK_ROWS = 256, 64
#: Bytes before the ids of an answer: the training count of the word.
HEAD = 8


def lower_words(text: str) -> list[bytes]:
    """ASCII capitals lowered, split at ASCII white space."""
    return text.encode().lower().split()


def word_answers(vocabulary: str):
    """Coder for ``wordblocks.code``: training count of the word, then its subword ids."""

    def build():
        def answer(words: list[bytes], counts: np.ndarray) -> list[bytes]:
            heads = np.asarray(counts, "<u8").tobytes()
            return [heads[HEAD * i : HEAD * i + HEAD] + ids for i, ids in enumerate(encode_words(vocabulary, words))]

        return answer

    return build


@dataclass(frozen=True)
class Coded:
    """The answers of a block by rank, in flat arrays, and behind them the end as a word of its own.

    counts: training count of the word; sizes: its ids; start: where they begin in ids.
    """

    counts: np.ndarray
    sizes: np.ndarray
    start: np.ndarray
    ids: np.ndarray

    @staticmethod
    def of(answers: list[bytes], end_id: int, ends: int = 0) -> Coded:
        flat = np.frombuffer(b"".join([*answers, ends.to_bytes(HEAD, "little"), end_id.to_bytes(4, "little")]), "<u4")
        lengths = np.append(np.fromiter(map(len, answers), np.int64, len(answers)) // 4, HEAD // 4 + 1)
        at = np.cumsum(lengths) - lengths
        counts = flat[at].astype(np.int64) + (flat[at + 1].astype(np.int64) << 32)
        return Coded(counts, lengths - HEAD // 4, at + HEAD // 4, flat)

    def stream(self, ranks: np.ndarray) -> np.ndarray:
        """Subword ids of these words in order."""
        sizes = self.sizes[ranks]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.start[ranks] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))].astype(np.int64)

    def texts(self, ranks: np.ndarray, places: np.ndarray, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Documents in order, of about ``most`` ids at a time (one longer alone): first and last, the ranks of their words, each with its
        end, and how many a document has; their ids, and how many a document has."""
        stop = np.cumsum(places)
        words = np.insert(np.asarray(ranks, np.uint32), stop, np.uint32(len(self.sizes) - 1))
        stop += np.arange(1, len(places) + 1)
        size = np.concatenate([[0], np.cumsum(self.sizes[words])])[stop]
        at = 0
        while at < len(places):
            upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
            own = words[stop[at - 1] if at else 0 : stop[upto - 1]]
            yield at, upto, own, places[at:upto] + 1, self.stream(own), np.diff(size[at:upto], prepend=size[at - 1] if at else 0)
            at = upto


@dataclass(frozen=True)
class Weights:
    """embed (classes + 1, d), query, key, value (d, d), bias (context), out (2 d, classes), offset (classes)."""

    embed: np.ndarray
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    offset: np.ndarray

    @staticmethod
    def start(classes: int, width: int = WIDTH, context: int = CONTEXT, seed: int = 5) -> Weights:
        draw = np.random.default_rng(seed)
        small = lambda *shape: (draw.standard_normal(shape) * 0.2).astype(np.float32)
        return Weights(small(classes, width), small(width, width), small(width, width), small(width, width), np.zeros(context, np.float32), small(2 * width, classes), np.zeros(classes, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.query, self.key, self.value, self.bias, self.out, self.offset]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def like(self, flat: np.ndarray) -> Weights:
        out, at = [], 0
        for p in self.parts():
            out.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Weights(*out)


@lru_cache
def _distances(queries: int, keys: int, most: int) -> np.ndarray:
    """Distance of the last ``queries`` places to all places, up to ``most`` - 1, and ``most`` ahead."""
    distance = np.arange(keys - queries, keys)[:, None] - np.arange(keys)[None, :]
    return np.where(distance >= 0, np.clip(distance, 0, most - 1), most)


def _position_bias(w: Weights, queries: int, keys: int) -> np.ndarray:
    """Bias by distance of the last ``queries`` places to all places, and minus infinity ahead."""
    return np.append(w.bias, -1e9).astype(np.float32).take(_distances(queries, keys, len(w.bias)))


@dataclass(frozen=True)
class Tables:
    """What depends on one class alone: its query (scaled), key and value (with a 1 behind it), and its own part of the logits."""

    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    own: np.ndarray
    clipped: bool

    @staticmethod
    def of(w: Weights) -> Tables:
        d = w.embed.shape[1]
        query, key, value = w.embed @ w.query * w.embed.dtype.type(1 / np.sqrt(d)), w.embed @ w.key, w.embed @ w.value
        own = w.embed @ w.out[:d] + w.offset
        # attention averages values, so no logit lies beyond the sum of these two
        near, far = np.abs(query @ key.T).max() + np.abs(w.bias).max(), np.abs(own).max() + np.abs(value @ w.out[d:]).max()
        return Tables(query, key, np.concatenate([value, np.ones((len(value), 1), value.dtype)], axis=1), own, not max(near, far) < 40)

    def exp(self, logits: np.ndarray) -> np.ndarray:
        """In place; only where some logit of two classes could leave the range is it looked for."""
        if self.clipped:
            np.clip(logits, -40, 40, out=logits)
        return np.exp(logits, out=logits)


class Scratch:
    """Arrays that are written anew for each batch; fresh memory for them would cost as much as the sums."""

    def __init__(self):
        self._held: dict[str, np.ndarray] = {}

    def array(self, name: str, kind: np.dtype, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self._held or len(self._held[name]) < size or self._held[name].dtype != kind:
            self._held[name] = np.empty(size, kind)
        return self._held[name][:size].reshape(shape)

    def rows(self, name: str, table: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The rows of a table at these places."""
        return table.take(places, axis=0, out=self.array(name, table.dtype, *places.shape, table.shape[1]), mode="clip")

    def product(self, name: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.matmul(a, b, out=self.array(name, a.dtype, *a.shape[:-1], b.shape[-1]))


def log_probabilities(w: Weights, tables: Tables, bias: np.ndarray, before: np.ndarray, goal: np.ndarray, scratch: Scratch) -> np.ndarray:
    """ln P(class ``goal``) at the last places of each window; ``before`` holds the class before each place.

    ``bias`` is the ``_position_bias`` of these windows. Sums of exponentials are divided out last.
    """
    n, queries = goal.shape
    d = w.embed.shape[1]
    last = before[:, -queries:]
    attention = scratch.product("attention", scratch.rows("q", tables.query, last), scratch.rows("k", tables.key, before).transpose(0, 2, 1))
    attention += bias
    attention = _exp(attention) if tables.clipped else np.exp(attention, out=attention)
    o = scratch.product("o", attention, scratch.rows("v", tables.value, before)).reshape(-1, d + 1)
    logits = scratch.product("logits", o[:, :d] / o[:, d:], w.out[d:])
    logits += scratch.rows("own", tables.own, last.ravel())
    picked = logits[np.arange(n * queries), goal.ravel()].astype(np.float64)
    logits = _exp(logits) if tables.clipped else np.exp(logits, out=logits)
    return np.maximum(np.minimum(picked, 80.0) - np.log((logits @ np.ones(logits.shape[1], logits.dtype)).astype(np.float64)), -28.0).reshape(n, queries)


def _exp(logits: np.ndarray) -> np.ndarray:
    """In place; float32 holds exponents up to 88."""
    if logits.max(initial=0) > 80:
        np.minimum(logits, 80, out=logits)
    return np.exp(logits, out=logits)


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where the runs of equal numbers begin."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1])))


def loss_and_gradient(w: Weights, before: np.ndarray, target: np.ndarray, scratch: Scratch | None = None, with_loss: bool = True) -> tuple[float, Weights]:
    """Mean cross-entropy of the target classes of full windows (0 unless asked for), and its gradient.

    Gradients of what depends on one class alone are summed by class first. The output layer works on the places sorted by
    the class before them, so that these sums are runs of rows.
    """
    scratch = scratch or Scratch()
    n, t = before.shape
    d, size, kind, n_classes = w.embed.shape[1], before.size, w.embed.dtype, w.out.shape[1]
    scale, tables, distinct = kind.type(1 / np.sqrt(d)), Tables.of(w), len(w.embed)
    flat_before = before.ravel()
    order = np.argsort(flat_before.astype(np.uint8) if distinct <= 256 else flat_before, kind="stable")
    ordered, goal = flat_before[order], target.ravel()[order]
    q, k, v = (scratch.rows(name, getattr(tables, name), before) for name in ("query", "key", "value"))
    attention = scratch.product("attention", q, k.transpose(0, 2, 1))
    attention += _position_bias(w, t, t)
    attention = tables.exp(attention)
    o = scratch.product("o", attention, v).reshape(size, d + 1)
    part = 1 / o[:, d:]
    o *= part
    mixed = scratch.rows("mixed", o, order)[:, :d]
    loss, do = 0.0, scratch.array("do", kind, size, d + 1)
    own, out = np.zeros((distinct, n_classes), kind), np.zeros((d, n_classes), kind)
    ones, inner, back = np.ones(n_classes, kind), w.out[d:], np.ascontiguousarray(w.out[d:].T)
    for at in range(0, size, OUT_ROWS):
        some = slice(at, at + OUT_ROWS)
        here, rows, x = goal[some], np.arange(min(OUT_ROWS, size - at)), mixed[some]
        p = scratch.product("p", x, inner)
        p += scratch.rows("own", tables.own, ordered[some])
        p = tables.exp(p)
        part_of = 1 / (p @ ones)
        if with_loss:
            loss -= float(np.log(np.maximum(p[rows, here] * part_of, 1e-12)).sum())
        p *= (part_of / kind.type(size))[:, None]
        p[rows, here] -= kind.type(1 / size)
        do[order[some], :d] = p @ back
        out += x.T @ p
        first = _starts(ordered[some])
        own[ordered[some][first]] += np.add.reduceat(p, first, axis=0)
    # the last column takes the mean of the gradient over a row of attention away
    do[:, d] = -np.einsum("ij,ij->i", do[:, :d], o[:, :d])
    do *= part
    do = do.reshape(n, t, d + 1)
    ds = scratch.product("ds", do, v.transpose(0, 2, 1))
    ds *= attention
    moved = scratch.array("moved", kind, n, t, 3 * d)
    np.matmul(ds, k, out=moved[:, :, :d])
    np.matmul(ds.transpose(0, 2, 1), q, out=moved[:, :, d : 2 * d])
    np.matmul(attention.transpose(0, 2, 1), do[:, :, :d], out=moved[:, :, 2 * d :])
    first, by_class = _starts(ordered), np.zeros((distinct, 3 * d), kind)
    by_class[ordered[first]] = np.add.reduceat(scratch.rows("sorted", moved.reshape(size, 3 * d), order), first, axis=0)
    dq, dk, dv = by_class[:, :d] * scale, by_class[:, d : 2 * d], by_class[:, 2 * d :]
    embed = own @ w.out[:d].T + dq @ w.query.T + dk @ w.key.T + dv @ w.value.T
    by_distance = np.ones(n, kind) @ ds.reshape(n, t * t)
    bias = np.bincount(_distances(t, t, len(w.bias)).ravel(), by_distance, len(w.bias) + 1)[:-1].astype(np.float32)
    turn = w.embed.T
    return loss / size, Weights(embed, turn @ dq, turn @ dk, turn @ dv, bias, np.concatenate([turn @ own, out]), own.sum(axis=0))


class Adam:
    """Steps of one task: ``learn`` makes one for every batch of the windows it is given, in shuffled order.

    The pace falls in a straight line over ``total`` steps to a tenth.
    """

    def __init__(self, w: Weights, total: int, seed: int, batch: int = BATCH, rate: float = RATE):
        self.start, self.flat = w, w.flat().astype(np.float64)
        self.first, self.second = np.zeros(len(self.flat)), np.zeros(len(self.flat))
        self.step, self.total, self.batch, self.rate, self.draw, self.scratch = 0, total, batch, rate, np.random.default_rng(seed), Scratch()

    def learn(self, before: np.ndarray, target: np.ndarray) -> None:
        order = self.draw.permutation(len(before))
        for at in range(0, len(order), self.batch):
            pick = order[at : at + self.batch]
            g = loss_and_gradient(self.weights(), before[pick], target[pick], self.scratch, False)[1].flat().astype(np.float64)
            self.step += 1
            self.first *= 0.9
            self.first += 0.1 * g
            g *= g
            g *= 0.01
            self.second *= 0.99
            self.second += g
            pace = self.rate * (1 - 0.9 * min(self.step - 1, self.total) / self.total)
            root = np.sqrt(self.second / (1 - 0.99**self.step), out=g)
            root += 1e-8
            self.flat -= pace / (1 - 0.9**self.step) * self.first / root

    def weights(self) -> Weights:
        return self.start.like(self.flat)


def local_steps(w: Weights, chunks: Iterator[np.ndarray], expected: int, seed: int, least: int = LEAST_STEPS) -> tuple[Weights, int]:
    """Weights after one pass over the chunks of windows (class before the first place, then the classes), and their number.

    Where the windows are too few for ``least`` steps, the last chunk is gone over again until they are made.
    """
    adam, seen, chunk = Adam(w, max(-(-expected // BATCH), least), seed), 0, None
    for chunk in chunks:
        seen += len(chunk)
        adam.learn(chunk[:, :-1], chunk[:, 1:])
    while chunk is not None and adam.step < least:
        adam.learn(chunk[:, :-1], chunk[:, 1:])
    return adam.weights(), seen


@dataclass(frozen=True)
class WordCounts:
    """Per class: training words (and ends) that begin with it, rate of new words among them; per id: ln P(id | class) in new words."""

    begun: np.ndarray
    new_rate: np.ndarray
    inside_new: np.ndarray

    @staticmethod
    def of(classes: np.ndarray, inside: np.ndarray, begun: np.ndarray, begun_once: np.ndarray, once: np.ndarray) -> WordCounts:
        """From counts by id: words that begin with it, those of them seen once, and places in words seen once."""
        by_class = lambda n: np.bincount(classes, n, classes.max() + 1)
        overall = (begun_once.sum() + 1) / (begun.sum() + 2)
        rate = (by_class(begun_once) + overall) / (by_class(begun) + 1)
        kinds = by_class(once > 0) + 1  # as likely an id not met in such words as the kinds of ids met
        inside_new = np.log((once + kinds[classes] * np.exp(inside)) / (by_class(once) + kinds)[classes])
        return WordCounts(by_class(begun), rate, inside_new)


@dataclass(frozen=True)
class AttentionLM:
    """Class of each id, log P(id | class), and the weights of the attention layer."""

    classes: np.ndarray
    inside: np.ndarray
    weights: Weights
    end_id: int

    def scores(self, streams: list[np.ndarray], context: int = CONTEXT, batch: int = SCORED_WINDOWS) -> np.ndarray:
        """log10 P of each id stream (end id included) with the ids alone."""
        if not streams:
            return np.zeros(0)
        lengths = np.array([len(s) for s in streams], np.int64)
        per_id = self.class_logs(streams, context, batch) + self.inside[np.concatenate(streams)]
        return np.add.reduceat(per_id, np.cumsum(lengths) - lengths) / np.log(10)

    def word_logs(self, streams: list[np.ndarray], sizes: np.ndarray, counts: np.ndarray, words: WordCounts) -> np.ndarray:
        """ln P of each word of all streams; a stream's end is its last word.

        ``sizes``: ids of each word, at least one; ``counts``: its training count.
        """
        ids, begin = np.concatenate(streams), np.cumsum(sizes) - sizes
        of_class, heads = self.class_logs(streams), self.classes[ids[begin]]
        told = np.log(words.new_rate)[heads] + np.add.reduceat(of_class + words.inside_new[ids], begin)
        known = counts > 0
        share = np.log1p(-words.new_rate) - np.log(np.maximum(words.begun, 1))  # a class that begins no word has no known one
        told[known] = np.logaddexp(told[known], of_class[begin[known]] + share[heads[known]] + np.log(counts[known]))
        return told

    def class_logs(self, streams: list[np.ndarray], context: int = CONTEXT, batch: int = SCORED_WINDOWS) -> np.ndarray:
        """ln P(class of id | ids before) of the ids of all streams, every id scored once."""
        half = context // 2
        ids = np.concatenate(streams) if streams else np.zeros(0, np.int64)
        lengths = np.array([len(s) for s in streams], np.int64)
        starts = np.cumsum(lengths) - lengths
        after = self.classes[ids]
        before = np.empty_like(after)
        before[1:] = after[:-1]
        before[starts] = self.classes[self.end_id]  # a text begins after an end
        later = np.maximum(0, -(-(lengths - context) // half))
        which = np.repeat(np.arange(len(streams)), later)
        order = np.arange(len(which)) - np.repeat(np.cumsum(later) - later, later)
        groups = ((starts, starts + lengths, context), (starts[which] + (order + 1) * half, (starts + lengths)[which], half))
        tables, scratch = Tables.of(self.weights), Scratch()
        # what stands behind a text is not seen by the places before it, so windows may reach into the next one
        padded = np.concatenate([before, np.zeros(context, before.dtype)])
        goals = np.concatenate([after, np.zeros(context, after.dtype)])
        per_id = np.zeros(len(ids) + context)
        windows = np.lib.stride_tricks.sliding_window_view(padded, context)
        for begin, stop, queries in groups:
            bias = _position_bias(self.weights, queries, context)
            goal_rows = np.lib.stride_tricks.sliding_window_view(goals, queries)
            told_rows = np.lib.stride_tricks.sliding_window_view(per_id, queries, writeable=True)
            whole = begin + context <= stop
            for full, own in ((True, np.flatnonzero(whole)), (False, np.flatnonzero(~whole))):
                for at in range(0, len(own), batch):
                    some = begin[own[at : at + batch]]
                    first = some + context - queries
                    told = log_probabilities(self.weights, tables, bias, windows[some], goal_rows[first], scratch)
                    if full:
                        told_rows[first] = told
                    else:
                        scored = first[:, None] + np.arange(queries)
                        real = scored < stop[own[at : at + batch], None]
                        per_id[scored[real]] = told[real]
        per_id = per_id[: len(ids)]
        return per_id


def window_starts(length: int, context: int = CONTEXT) -> np.ndarray:
    """Where windows begin so that they hold every id of a document; the last one may overlap the one before."""
    return np.minimum(np.arange(0, max(length, 1), context), max(0, length - context))


def cut_windows(stream: np.ndarray, lengths: np.ndarray, end_id: int, context: int = CONTEXT) -> np.ndarray:
    """The windows of texts that stand one behind the other, by ``window_starts``, each with the id before it; what a text
    lacks is padded by end ids."""
    stop = np.cumsum(lengths)
    each = -(-lengths // context)
    of = np.repeat(np.arange(len(lengths)), each)
    turn = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
    at = (stop - lengths)[of] + np.minimum(turn * context, np.maximum(0, lengths - context)[of])
    place = at[:, None] + np.arange(context + 1)
    padded = np.concatenate(([end_id], stream)).astype("<u4")  # the id before a text is an end
    return np.where(place <= stop[of][:, None], padded[np.minimum(place, len(stream))], np.uint32(end_id))


def gather(made: DataFrame, coded: DataFrame, end_id: int) -> DataFrame:
    """Staged rows of two kinds: counts of an id in the training documents of a block, and some of their windows as bytes.

    The counts: ``n`` places, ``begun`` words (and ends) that begin with it, and of both those in words seen once. A window is the id before it and ``CONTEXT`` ids; texts shorter
    than that are padded by end ids. ``n`` counts the windows of a row, ``turn`` is the round that learns from them.
    """

    def use(doc_ids: list, places: list, ranks: np.ndarray, answers: list[bytes]) -> pd.DataFrame:
        words, places = Coded.of(answers, end_id), np.array(places, np.int64)
        learnt = np.array([not is_held_out(doc_id, FOLDS) for doc_id in doc_ids], bool)
        ranks, places = ranks[np.repeat(learnt, places)], places[learnt]
        found = np.bincount(ranks, minlength=len(words.sizes))
        found[-1] = len(places)
        once_found = np.where(words.counts == 1, found, 0)
        has_ids = words.sizes > 0
        heads, inside = words.ids[words.start[has_ids]], words.stream(np.arange(len(words.sizes)))
        total = lambda ids, n: np.bincount(ids, n, end_id + 1).astype(np.int64)
        counts, once = (total(inside, np.repeat(n, words.sizes)) for n in (found, once_found))
        begun, begun_once = (total(heads, n[has_ids]) for n in (found, once_found))
        cuts = [cut_windows(stream, lengths, end_id) for *_, stream, lengths in words.texts(ranks, places, GROUP_IDS)]
        windows = np.concatenate(cuts) if cuts else np.zeros((0, CONTEXT + 1), "<u4")
        each = max(1, min(ROW_WINDOWS, len(windows) // BLOCK_ROWS))
        rows = [windows[i : i + each] for i in range(0, len(windows), each)]
        seen = np.flatnonzero(counts)
        return pd.concat([
            pd.DataFrame({"id": seen, "n": counts[seen], "begun": begun[seen], "begun_once": begun_once[seen], "once": once[seen], "windows": None}),
            pd.DataFrame({"id": -1, "n": [len(r) for r in rows], "begun": 0, "begun_once": 0, "once": 0, "windows": [r.tobytes() for r in rows]})])

    rows = reassemble(made, coded, use, "id int, n long, begun long, begun_once long, once long, windows binary")
    return stage(rows.withColumn("turn", F.pmod(F.xxhash64("windows"), F.lit(ROUNDS))))


def id_counts(gathered: DataFrame, size: int) -> dict[str, np.ndarray]:
    """The counts of ``gather`` by id."""
    names = ("n", "begun", "begun_once", "once")
    counts = {name: np.zeros(size, np.int64) for name in names}
    for r in gathered.where("id >= 0").groupBy("id").agg(*[F.sum(n).alias(n) for n in names]).collect():  # at most one row per id of the vocabulary
        for name in names:
            counts[name][r["id"]] = r[name]
    return counts


def _read_windows(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u4").reshape(-1, CONTEXT + 1)


def neighbourhoods(windows: DataFrame, anchors: np.ndarray, size: int, ends_word: np.ndarray) -> np.ndarray:
    """How often each id shares a window with each of the frequent ids; last two columns: how
    often it occurs, and how often it goes on with a word."""
    width = len(anchors) + 2

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        column = np.full(size, -1, np.int64)
        column[anchors] = np.arange(len(anchors))
        near_counts, own_counts, inner_counts, held, n = np.zeros((len(anchors), size), np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64), [], 0

        def count() -> None:
            ids = np.concatenate(held).astype(np.int64)
            own, near = np.ascontiguousarray(ids[:, 1:]), column[ids]
            place = near >= 0
            anchor_of, windows_of = near[place], np.nonzero(place)[0]
            order = np.argsort(anchor_of.astype(np.uint16), kind="stable")
            first = _starts(anchor_of[order])
            for anchor, some in zip(anchor_of[order[first]], np.split(windows_of[order], first[1:])):
                near_counts[anchor] += np.bincount(own[some].ravel(), minlength=size)
            own_counts[:] += np.bincount(own.ravel(), minlength=size)
            inner_counts[:] += np.bincount(own[ends_word[ids[:, :-1]] == 0], minlength=size)

        for batch in batches:
            for packed in batch["windows"]:
                held.append(_read_windows(packed))
                n += len(held[-1])
                if n >= NEAR_WINDOWS:
                    count()
                    held, n = [], 0
        if held:
            count()
        table = np.column_stack([near_counts.T, own_counts, inner_counts])
        seen = np.flatnonzero(table.any(axis=1))
        for at in range(0, len(seen), 5000):
            yield pd.DataFrame({"id": seen[at : at + 5000], "near": list(table[seen[at : at + 5000]])})

    partial = windows.select("windows").mapInPandas(rows, "id int, near array<long>")
    sums = [F.sum(F.col("near")[j]).alias(f"n{j}") for j in range(width)]
    table = np.zeros((size, width))
    for r in partial.groupBy("id").agg(F.array(*sums).alias("near")).collect():  # at most one row per id of the vocabulary
        table[r["id"]] = r["near"]
    return table


def cluster(table: np.ndarray, counts: np.ndarray, clusters: int, rounds: int = 12) -> np.ndarray:
    """Weighted k-means over neighbourhood profiles, started from ids at even steps of frequency."""
    share = (table + 0.05 * table.sum(axis=0) / max(table.sum(), 1)) / (table.sum(axis=1, keepdims=True) + 0.05)
    points = np.sqrt(np.maximum(share, 0))
    order = np.argsort(-counts, kind="stable")
    centres = points[order[: clusters * 8 : 8]].copy()
    for _ in range(rounds):
        nearest = np.argmax(points @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)
        for c in range(len(centres)):
            weight = counts * (nearest == c)
            if weight.sum():
                centres[c] = weight @ points / weight.sum()
    return nearest


def train(windows: DataFrame, classes: np.ndarray, n_classes: int) -> Weights:
    weights = Weights.start(n_classes)
    sizes = {r["turn"]: r["n"] for r in windows.groupBy("turn").agg(F.sum("n").alias("n")).collect()}  # one row a round
    for turn, size in sorted(sizes.items()):
        tasks = min(shuffle_partitions(windows.sparkSession), max(1, size // TASK_WINDOWS))
        parts = windows.where(F.col("turn") == turn).select("windows").repartition(tasks)

        def fit(batches: Iterator[pd.DataFrame], now: Weights = weights, seed: int = turn, expected: int = size // tasks) -> Iterator[pd.DataFrame]:
            def chunks() -> Iterator[np.ndarray]:
                held, n = [], 0
                for batch in batches:
                    for packed in batch["windows"]:
                        held.append(_read_windows(packed))
                        n += len(held[-1])
                        if n >= TASK_WINDOWS:
                            yield classes[np.concatenate(held)]
                            held, n = [], 0
                if held:
                    yield classes[np.concatenate(held)]

            fitted, seen = local_steps(now, chunks(), expected, seed)
            if seen:
                yield pd.DataFrame({"n": [seen], "weights": [fitted.flat().astype(np.float64)]})

        told = parts.mapInPandas(fit, "n long, weights array<double>").select("n", F.posexplode("weights").alias("place", "weight"))
        mean = told.groupBy("place").agg((F.sum(F.col("weight") * F.col("n")) / F.sum("n")).alias("weight")).collect()  # one row per weight
        flat = weights.flat().astype(np.float64)
        for r in mean:
            flat[r["place"]] = r["weight"]
        weights = weights.like(flat)
    return weights


def fit_lm(made: DataFrame, coded: DataFrame, vocabulary: str) -> tuple[AttentionLM, WordCounts]:
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(vocabulary).get_vocab()
    size = max(tokens.values()) + 1
    end_id = tokens["<|endoftext|>"]
    gathered = gather(made, coded, end_id)
    windows = gathered.where("id = -1").select("turn", "n", "windows")
    by_id = id_counts(gathered, size)
    counts = by_id["n"]
    anchors = np.argsort(-counts, kind="stable")[:ANCHORS]
    ends_word = np.zeros(size, np.int64)
    ends_word[[i for t, i in tokens.items() if t.endswith("</w>")]] = 1
    ends_word[end_id] = 1
    near = neighbourhoods(windows, anchors, size, ends_word)
    groups = cluster(near[:, :-2], counts, CLUSTERS)
    goes_on = near[:, -1] > 0.5 * near[:, -2]
    classes = 4 * groups + 2 * ends_word + goes_on
    classes[end_id] = 4 * CLUSTERS
    n_classes = 4 * CLUSTERS + 1
    in_class = np.bincount(classes, counts, n_classes) + np.bincount(classes, minlength=n_classes)
    inside = np.log((counts + 1) / in_class[classes])
    words = WordCounts.of(classes, inside, by_id["begun"], by_id["begun_once"], by_id["once"])
    return AttentionLM(classes, inside, train(windows, classes, n_classes), end_id), words


def score_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the documents outside the held-out fold. Null text counts as empty: it is one end. Repeated rows count as
    often as they come; a null id hashes as the empty string; other columns are ignored; an empty table gives no rows.
    """
    rows = documents(docs)
    made = blocks(rows, lower_words, lambda doc_id: not is_held_out(doc_id, FOLDS), LoweredAtSpaces)
    coded = stage(code(made, word_answers(vocabulary)))
    words = coded.agg(F.sum("total_counted").alias("n"), F.sum("distinct_counted").alias("v")).first()
    ends = rows.where(~held_out(F.col("doc_id"), FOLDS)).count()
    total, distinct = (words["n"] or 0) + ends, (words["v"] or 0) + (ends > 0)
    model, word_counts = fit_lm(made, coded, vocabulary)

    def use(doc_ids: list, places: list, ranks: np.ndarray, answers: list[bytes]) -> pd.DataFrame:
        coded_words, parts = Coded.of(answers, model.end_id, ends), []
        logs = np.log10((coded_words.counts + 1) / (total + distinct + 1))
        for at, upto, own, n_tokens, stream, lengths in coded_words.texts(ranks, np.array(places, np.int64), GROUP_IDS):
            sizes, counts, base = coded_words.sizes[own], coded_words.counts[own], logs[own]
            told = base * np.log(10)  # what has no ids keeps its base probability
            has_ids = sizes > 0
            told[has_ids] = model.word_logs(np.split(stream, np.cumsum(lengths)[:-1]), sizes[has_ids], counts[has_ids], word_counts)
            first = np.cumsum(n_tokens) - n_tokens
            parts.append(pd.DataFrame({
                "doc_id": pd.array(doc_ids[at:upto], "Int64"), "held_out": [is_held_out(doc_id, FOLDS) for doc_id in doc_ids[at:upto]], "n_tokens": n_tokens, "n_known": np.add.reduceat((counts > 0).astype(np.int64), first),
                "train_tokens": total, "base_score": np.add.reduceat(base, first), "score": np.add.reduceat(told, first) / np.log(10)}))
        return pd.concat(parts)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return reassemble(made, coded, use, schema)
