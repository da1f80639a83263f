import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given
from hypothesis import strategies as st

from demandloom.llm.byte_bpe import encode_documents, read_ranks
from demandloom.llm.wordblocks import pack, pack_numbers, unpack, unpack_numbers

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def check(frame, rows):
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    expected = []
    for i, text in rows:
        ids = encoding.encode_ordinary(text or "")
        expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(str, (tuple(r) for r in frame.collect()))) == sorted(map(str, expected))


def test_like_the_library(documents, edge_docs, edge_rows, no_docs):
    check(encode_documents(documents, RANKS, public_tokenizers.PATTERN), [(r.doc_id, r.text) for r in documents.collect()])
    check(encode_documents(edge_docs, RANKS, public_tokenizers.PATTERN), edge_rows)
    assert encode_documents(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


def test_blocks_and_buckets(documents, monkeypatch):
    monkeypatch.setattr("demandloom.llm.wordblocks.BLOCK_PLACES", 700)
    monkeypatch.setattr("demandloom.llm.wordblocks.BUCKET_WORDS", 500)
    monkeypatch.setattr("demandloom.llm.wordblocks.FREQUENT", 10)
    check(encode_documents(documents, RANKS, public_tokenizers.PATTERN), [(r.doc_id, r.text) for r in documents.collect()])


@given(st.lists(st.binary(max_size=9)), st.lists(st.integers(0, 2**32 - 1)))
def test_packing_round_trip(items, numbers):
    assert unpack(pack(items)) == items
    assert unpack_numbers(pack_numbers(np.array(numbers, np.int64))).tolist() == numbers
    wide = [i * 4 for i in items]
    assert unpack(pack(wide, 4), 4) == wide
