import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from helpers import SF, clashing, documents, odd_rows, parquet_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from censusloom.llm import bpe
from censusloom.llm.queries import QUERIES


@pytest.fixture(scope="module")
def own():
    return bpe.encoder(bpe.default_ranks())


@pytest.fixture(scope="module")
def library(own):
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_pieces_equal_the_library(own, library):
    draw = random.Random(4)
    parts = ["a", "b", " ", "\n", "'s", "é", "中", "1", "!", "  ", "\x85", "aaaa", "the", "ing", "\t", "😀", "<|endoftext|>"]
    for _ in range(3_000):
        text = "".join(draw.choices(parts, k=draw.randint(0, 30)))
        assert own.encode(text) == library.encode_ordinary(text), text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", max_codepoint=0x2FFF), max_size=60))
def test_any_text_equals_the_library_and_comes_back(own, library, text):
    ids = own.encode(text)
    assert ids == library.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_one_long_piece(own, library):
    text = "ab" * 20_000 + "z" * 5_000
    assert own.encode(text) == library.encode_ordinary(text)


def test_full_memos_start_anew(own, library):
    small = bpe.ByteBpe(own.ranks, public_tokenizers.PATTERN, memo_entries=16)
    text = parquet_rows("documents", "text")[0][0]
    assert small.encode(text) == library.encode_ordinary(text)


def test_a_merge_across_the_border_is_seen(own):
    ranks = own.ranks
    assert not own._compatible[ranks[b"t"], ranks[b"h"]]
    assert own._compatible[ranks[b"the"], ranks[b" the"]]


def test_tables(spark):
    docs = clashing(documents(spark, odd_rows()))
    encoded = bpe.encode(docs)
    texts = sorted((t or "").encode() for _, t, *_ in odd_rows())
    assert sorted(bytes(r.decoded) for r in bpe.decode(encoded).collect()) == texts
    assert bpe.encode(docs.limit(0)).count() == 0
    assert bpe.round_trip_digests(docs).count() == len(odd_rows())


def test_query(spark, library):
    found = {r.doc_id: r for r in QUERIES["op3_byte_bpe"](spark, SF).collect()}
    rows = parquet_rows("documents", "doc_id, text")
    assert len(found) == len(rows)
    for ident, text in rows:
        ids = library.encode_ordinary(text or "")
        row = found[ident]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
