"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

Pre-tokens are the matches of the published pattern. Each block of documents keeps them as positions, the distinct ones
meet in buckets where each distinct pre-token of the corpus is encoded once, and the ids are joined back and reassembled
by position (see ``wordblocks``). Decoding looks the ids of a block's distinct pre-tokens up in the token-byte table, which
each task reads from the rank file; no Spark join is made for it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from demandloom.llm.shared import documents
from demandloom.llm.wordblocks import blocks, code, reassemble


def read_ranks(vocabulary: str) -> dict[bytes, int]:
    """Token bytes to ids from a file of base64 and rank."""
    with open(vocabulary, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def splitter(pattern: str) -> Callable[[str], list[str]]:
    compiled = []

    def split(text: str) -> list[str]:
        if not compiled:
            import regex

            compiled.append(regex.compile(pattern))
        return compiled[0].findall(text)

    return split


def word_coder(vocabulary: str, pattern: str):
    """Coder for ``wordblocks.code``: the ids of each word as little-endian 32-bit numbers."""

    def build():
        import tiktoken

        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(vocabulary), special_tokens={})
        return lambda words, counts: [np.array(encoding._encode_single_piece(w), "<u4").tobytes() for w in words]

    return build


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (decoded bytes).

    Null text counts as empty and has no ids. Repeated rows and null ids are encoded like any row; other columns are
    ignored and an empty table gives no rows.
    """
    no_counts = lambda doc_id: False
    made = blocks(documents(docs), splitter(pattern), no_counts)
    coded = code(made, word_coder(vocabulary, pattern))

    def digest(doc_ids: list, places: list, ranks: np.ndarray, answers: list[bytes]) -> pd.DataFrame:
        token_bytes = {rank: token for token, rank in read_ranks(vocabulary).items()}
        ids = [np.frombuffer(a, "<u4").tolist() for a in answers]
        written = [",".join(map(str, i)).encode() for i in ids]
        decoded = [b"".join(map(token_bytes.__getitem__, i)) for i in ids]
        length = np.array([len(i) for i in ids], np.int64)
        out, at = [], 0
        for doc_id, n in zip(doc_ids, places):
            own = ranks[at : at + n]
            at += n
            order = own.tolist()
            ids_hash = hashlib.sha256(b",".join([written[r] for r in order])).hexdigest()
            text_hash = hashlib.sha256(b"".join([decoded[r] for r in order])).hexdigest()
            out.append((doc_id, int(length[own].sum()) if n else 0, ids_hash, text_hash))
        frame = pd.DataFrame(out, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        return frame.astype({"doc_id": "Int64"})

    return reassemble(made, coded, digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
