"""Ids of ``word_bpe_49k.json`` word by word.

This tokenizer drops white space before it merges, so the ids of a text are the ids of its words in order, and a cut
that its own rules make anyway may be written as a space: texts are split at ASCII white space and between an ASCII or
Latin-1 letter and an ASCII mark other than the apostrophe, which begins contractions. Lower-casing comes before the
split, as in the tokenizer, so ``Word``, ``word`` and ``word.`` share one entry.

Splitting, numbering of the words and joining of their ids are Arrow and numpy calls on whole batches; Python touches
each distinct word of a batch once.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from demandloom.llm.shared import give_back

#: Words handed to the tokenizer at a time.
BATCH = 20_000
#: Words a Python worker remembers before it forgets those that came once.
REMEMBERED = 150_000
#: Bytes of text handled at a time (one longer text is handled alone).
CHUNK_BYTES = 1 << 20

#: Words of a line, and lines handed over at a time, where words need no normalising.
LINE = 128

PLAIN = "^[a-zß-öø-ÿ]+$"
_LETTER = "[a-zÀ-ÖØ-öø-ÿ]"
_MARK = r"[!-&(-/:-@\[-`{-~]"


def encode_words(vocabulary: str, words: list[bytes]) -> list[bytes]:
    """The ids of each word as little-endian 32-bit numbers; special tokens in a word are ordinary text."""
    texts = [w.decode("utf-8", "replace") for w in words]
    plain = pc.match_substring_regex(pa.array(texts, pa.string()), PLAIN).to_numpy(zero_copy_only=False)
    out = [b""] * len(words)
    for chosen, encode in ((plain, plain_word_ids), (~plain, _by_pieces)):
        own = np.flatnonzero(chosen).tolist()
        if own:
            flat, lengths = encode(vocabulary, [texts[i] for i in own])
            body, ends = flat.tobytes(), (4 * np.cumsum(lengths)).tolist()
            for i, a, b in zip(own, [0, *ends], ends):
                out[i] = body[a:b]
    return out


def _by_pieces(vocabulary: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """As ``word_ids``; words that differ only in the marks around them share their pieces."""
    made = list(worker_encoder(vocabulary).texts(pa.array(words, pa.string())))
    return np.concatenate([ids for _, ids, _ in made]), np.concatenate([np.diff(bounds) for _, _, bounds in made])


def word_ids(vocabulary: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the words in order, and how many each word has."""
    tokenizer = _tokenizer(vocabulary)
    flat, lengths = [], []
    for at in range(0, len(words), BATCH):
        ids = [e.ids for e in tokenizer.encode_batch_fast(words[at : at + BATCH], add_special_tokens=False)]
        lengths.append(np.fromiter(map(len, ids), np.int64, len(ids)))
        flat.append(np.fromiter(chain.from_iterable(ids), "<u4", int(lengths[-1].sum())))
    return np.concatenate([np.zeros(0, "<u4"), *flat]), np.concatenate([np.zeros(0, np.int64), *lengths])


def plain_word_ids(vocabulary: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The same for words of PLAIN letters alone. Such a word is one pre-token and needs no normalising, so the merges
    are all that is left to do; words are handed over in lines, and the ids that end a word tell where it ends."""
    tokenizer, last = _plain_tokenizer(vocabulary)
    lines = [" ".join(words[at : at + LINE]) for at in range(0, len(words), LINE)]
    flat = [np.zeros(0, "<u4")]
    for at in range(0, len(lines), LINE):
        flat += [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(lines[at : at + LINE], add_special_tokens=False)]
    ids = np.concatenate(flat)
    return ids, np.diff(np.flatnonzero(last[ids]), prepend=-1)


_TOKENIZERS: dict = {}
_PLAIN_TOKENIZERS: dict = {}


def _plain_tokenizer(vocabulary: str):
    if vocabulary not in _PLAIN_TOKENIZERS:
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer = Tokenizer(_tokenizer(vocabulary).model)  # the tables of the merges are there once for both
        tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        last = np.zeros(tokenizer.get_vocab_size(), bool)
        for token, i in tokenizer.get_vocab().items():
            last[i] = token.endswith("</w>")
        _PLAIN_TOKENIZERS[vocabulary] = tokenizer, last
    return _PLAIN_TOKENIZERS[vocabulary]


def _tokenizer(vocabulary: str):
    if vocabulary not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _TOKENIZERS[vocabulary] = Tokenizer.from_file(vocabulary)
        _TOKENIZERS[vocabulary].encode_special_tokens = True
    return _TOKENIZERS[vocabulary]


def split_words(texts: pa.Array) -> pa.Array:
    """The words of each text, with empty ones at its ends."""
    lowered = pc.ascii_lower(texts)
    lowered = pc.replace_substring_regex(lowered, f"({_LETTER})({_MARK})", r"\1 \2")
    lowered = pc.replace_substring_regex(lowered, f"({_MARK})({_LETTER})", r"\1 \2")
    return pc.ascii_split_whitespace(lowered)


class WordEncoder:
    """Texts to ids with a memory of words: a number for each word, and its ids in one growing array."""

    def __init__(self, vocabulary: str, remembered: int = REMEMBERED):
        self._vocabulary, self._remembered = vocabulary, remembered
        self._forget()

    def _forget(self) -> None:
        self._number: dict[str, int] = {}
        self._ids, self._start = np.zeros(0, "<u4"), np.zeros(1, np.int64)
        self._again = np.zeros(0, bool)  # met in a later chunk too

    def _forget_rare(self) -> None:
        """Keep the words that came again, unless they alone fill half of the memory: then start afresh."""
        kept = np.flatnonzero(self._again)
        if 2 * len(kept) > self._remembered:
            return self._forget()
        words = [w for w, again in zip(self._number, self._again.tolist()) if again]  # a dict keeps the order of numbers
        lengths = np.diff(self._start)[kept]
        ends = np.cumsum(lengths)
        places = np.arange(int(lengths.sum())) + np.repeat(self._start[kept] - (ends - lengths), lengths)
        self._ids, self._start = self._ids[places], np.concatenate([[0], ends])
        self._number, self._again = {w: n for n, w in enumerate(words)}, np.zeros(len(words), bool)
        give_back()

    def _numbers(self, words: list[str]) -> np.ndarray:
        if len(self._number) > self._remembered:
            self._forget_rare()
        known = len(self._number)
        unknown = pa.array([w for w in words if w not in self._number], pa.string())
        plain = pc.match_substring_regex(unknown, PLAIN)
        for own, encode in ((unknown.filter(plain), plain_word_ids), (unknown.filter(pc.invert(plain)), word_ids)):
            own = own.to_numpy(zero_copy_only=False).tolist()
            if own:
                flat, lengths = encode(self._vocabulary, own)
                self._number.update(zip(own, range(len(self._number), len(self._number) + len(own))))
                self._ids = np.concatenate([self._ids, flat])
                self._start = np.concatenate([self._start, self._start[-1] + np.cumsum(lengths)])
        numbers = np.fromiter(map(self._number.__getitem__, words), np.int64, len(words))
        self._again = np.concatenate([self._again, np.zeros(len(self._number) - known, bool)])
        self._again[numbers[numbers < known]] = True
        return numbers

    def _chunk(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = split_words(texts)
        coded = split.flatten().dictionary_encode()
        numbers = self._numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        at = self._start[numbers].astype(np.int32)[coded.indices.to_numpy()]
        lengths = np.diff(self._start)[numbers][coded.indices.to_numpy()]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at -= (ends - lengths).astype(np.int32)
        stream = self._ids[np.arange(total, dtype=np.int32) + np.repeat(at, lengths)]
        bounds = np.concatenate([[0], ends])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return stream, bounds

    def texts(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of the rows, where each row begins and the last one ends) of successive chunks."""
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        row = 0
        while row < len(texts):
            upto = int(np.searchsorted(size, (size[row - 1] if row else 0) + CHUNK_BYTES, "right"))
            upto = max(row + 1, upto)
            yield row, *self._chunk(texts.slice(row, upto - row))
            row = upto


_ENCODERS: dict[str, WordEncoder] = {}


def worker_encoder(vocabulary: str) -> WordEncoder:
    """One encoder a Python worker, so that its memory serves all its tasks."""
    return _ENCODERS.setdefault(vocabulary, WordEncoder(vocabulary))


def document_ids(batch: pa.RecordBatch, vocabulary: str, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """As ``texts``, for the column ``text`` of a batch, with ``end_id`` behind each document."""
    column = batch.column("text")
    for row, stream, bounds in worker_encoder(vocabulary).texts(column.cast(pa.string()) if column.type != pa.string() else column):
        yield row, np.insert(stream, bounds[1:], end_id), bounds + np.arange(len(bounds))
