import random
import zlib
from collections import defaultdict

import pytest
from helpers import SF, clashing, documents, odd_rows, parquet_rows

from censusloom.llm import packing
from censusloom.llm.queries import QUERIES


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(packing.default_tokenizer())
    found.encode_special_tokens = True
    return found


def reference_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_OF_TEXT]


def check_pieces(pieces, expected):
    """pieces: (id, start, length, crc, doc_tokens, sequence, offset); expected: id -> ids."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for doc, start, length, crc, total, sequence, offset in pieces:
        by_doc[doc].append((start, length, crc, total))
        by_sequence[sequence].append((offset, length))
    assert set(by_doc) == set(expected)
    for doc, parts in by_doc.items():
        at = 0
        for start, length, crc, total in sorted(parts):
            assert start == at and length > 0 and total == len(expected[doc])
            body = b"".join(i.to_bytes(4, "little") for i in expected[doc][start : start + length])
            assert crc == zlib.crc32(body)
            at += length
        assert at == len(expected[doc])
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0  # a power of two: nothing is padded


def test_ids_by_ranks_equal_the_library(tokenizer):
    ids_of = packing.TokenIds(packing.default_tokenizer(), special_tokens=False)
    assert ids_of.ranked is not None
    draw = random.Random(2)
    parts = ["word", " ", "  ", "\n", "é", "中", "'s", "1", ".", "\t", "ing", "\x85", "\xa0", "<|endoftext|>"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 25))) for _ in range(2_000)]
    expected = [b"".join(i.to_bytes(4, "little") for i in reference_ids(tokenizer, t)[:-1]) for t in texts]
    assert [ids_of(t) for t in texts] == expected
    ids_of.ranked = None  # the library itself
    assert [ids_of(t) for t in texts] == expected


@pytest.mark.parametrize("seed", range(8))
def test_windows_are_full_and_whole(seed):
    draw = random.Random(seed)
    lengths = [draw.choice([1, 2, 40, 255, 256, 257, 700, 1500, 2047, 2048, 2049, 9000]) for _ in range(draw.randint(0, 60))]
    docs = {i: [draw.randrange(50_000) for _ in range(n)] for i, n in enumerate(lengths)}
    packed = packing.pack_documents(
        ((i, b"".join(t.to_bytes(4, "little") for t in ids)) for i, ids in docs.items()), pool_tokens=20_000
    )
    pieces, steps = [], defaultdict(int)
    for number, (step, window, parts) in enumerate(packed):
        offset = 0
        steps[step] += window
        for doc, start, length, body, total in parts:
            pieces.append((doc, start, length, zlib.crc32(body), total, number, offset))
            offset += length
        assert offset == window
    check_pieces(pieces, docs)
    assert all(tokens <= packing.STEP_TOKENS for tokens in steps.values())


def test_documents_are_routed_to_their_tier():
    docs = [(i, bytes(4 * n)) for i, n in enumerate([1500, 500, 40, 600, 300, 200, 1000, 24])]
    packed = list(packing.pack_documents(iter(docs)))
    first = next(parts for _, window, parts in packed if window == 2048)
    assert first[0][0] == 0 and len(first) > 1  # the long rest opens the window, shorter ones fill its gap


def test_tables(spark, tokenizer):
    rows = [r for r in odd_rows() if r[0] not in (1, 5, None)]
    docs = clashing(documents(spark, rows))
    found = packing.pack(docs).selectExpr(
        "doc_id", "start", "length", "crc32(ids)", "doc_tokens", "sequence_id", "offset"
    )
    check_pieces([tuple(r) for r in found.collect()], {r[0]: reference_ids(tokenizer, r[1]) for r in rows})
    assert packing.pack(docs.limit(0)).count() == 0
    everything = packing.pack(documents(spark, odd_rows())).agg({"length": "sum"}).first()[0]
    assert everything == sum(len(reference_ids(tokenizer, r[1])) for r in odd_rows())


def test_query(spark, tokenizer):
    found = QUERIES["op5_packing"](spark, SF).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
    expected = {i: reference_ids(tokenizer, t) for i, t in parquet_rows("documents", "doc_id, text")}
    check_pieces([tuple(r) for r in found.collect()], expected)


def test_special_tokens_in_texts_are_the_library_s(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.default_tokenizer())
    draw = random.Random(5)
    parts = ["word", " ", " ", "  ", "\n", "é", "1", ".", "<|endoftext|>", "<|endoftext|>", " <|endoftext|> "]
    texts = ["a b<|endoftext|> c", *("".join(draw.choices(parts, k=draw.randint(0, 20))) for _ in range(600))]
    ids_of = packing.TokenIds(packing.default_tokenizer())
    for ranked in (ids_of.ranked, None):
        ids_of.ranked = ranked
        assert [ids_of(t) for t in texts] == [b"".join(i.to_bytes(4, "little") for i in reference_ids(library, t)[:-1]) for t in texts]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    pieces = packing.pack(documents(spark, rows)).selectExpr(
        "doc_id", "start", "length", "crc32(ids)", "doc_tokens", "sequence_id", "offset"
    )
    check_pieces([tuple(r) for r in pieces.collect()], {r[0]: reference_ids(library, r[1]) for r in rows})


def test_long_texts_without_spaces_take_linear_time():
    ids_of = packing.TokenIds(packing.default_tokenizer())
    for text in ("a" * 300_000, " " * 300_000, "\n" * 300_000, "\u4e2d" * 100_000, "abc" * 100_000):
        library = ids_of.tokenizer.encode(text, add_special_tokens=False).ids
        assert ids_of(text) == b"".join(i.to_bytes(4, "little") for i in library)


def test_other_kinds_of_files_are_left_to_the_library(tokenizer):
    import json

    settings = json.loads(tokenizer.to_str())
    assert packing._ranked(settings)[0] is not None
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}):
        assert packing._ranked(settings | change) == (None, None)
    swapped = json.loads(tokenizer.to_str())
    swapped["model"]["merges"][:2] = swapped["model"]["merges"][1::-1]
    assert packing._ranked(swapped) == (None, None)
