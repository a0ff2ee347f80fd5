import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from helpers import SF, clashing, documents, odd_rows, parquet_rows, prose

from censusloom.llm import run_index as ri
from censusloom.llm.queries import QUERIES


def brute(rows, length=100):
    """[(key, text)] in order -> {key: (bytes, removed, spans, digest)}"""
    seen, out = set(), {}
    for key, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - length + 1):
            window = data[at : at + length]
            if window in seen:
                gone[at : at + length] = b"\1" * length
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[key] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def check(found, rows):
    names = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert {r.doc_id: tuple(r[n] for n in names) for r in found.collect()} == brute(rows)


def digests(docs, hot=ri.HOT_SEGMENTS):
    from pyspark.sql import functions as F

    found = ri.remove_repeats(docs, hot_segments=hot)
    removed = F.expr("aggregate(zip_with(starts, stops, (a, b) -> b - a), 0L, (t, x) -> t + x)")
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@pytest.mark.parametrize("seed", range(12))
def test_index_finds_all_repeats(seed):
    draw = random.Random(seed)
    base = bytes(draw.choice(b"ab") for _ in range(80))
    pieces = [
        bytes(draw.choice(b"abc") for _ in range(draw.randint(0, 30)))
        + base[draw.randint(0, 30) : draw.randint(30, 80)] * draw.randint(1, 2)
        for _ in range(draw.randint(1, 12))
    ]
    for length in (1, 3, 8, 20):
        seen, expected = set(), []
        for piece, data in enumerate(pieces):
            for at in range(len(data) - length + 1):
                if data[at : at + length] in seen:
                    expected.append((piece, at))
                seen.add(data[at : at + length])
        found = ri.repeated_windows(pieces, length)
        assert sorted(zip(*(x.tolist() for x in found))) == expected


def test_suffix_array_runs_and_statistics():
    pieces = [b"banana", b"ananas", b"banana", b"", b"an"]
    text = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8)
    ends = np.flatnonzero(text == 0xFF)
    begins = ends - [len(p) for p in pieces]
    order = ri.suffix_array(text, ends)
    # Separators rise with their place, so compare (byte or separator, its place).
    suffix = [[(int(b), 0 if b != 0xFF else i + k) for k, b in enumerate(text[i:])] for i in range(len(text))]
    assert order.tolist() == sorted(range(len(text)), key=suffix.__getitem__)
    heads = ri.run_heads(text, order, begins)
    assert len(heads) < len(text)
    shared = ri.matching_statistics(text, ends, order, heads)
    for row in range(1, len(order)):
        a, b = suffix[order[row]], suffix[order[row - 1]]
        common = next(i for i, (x, y) in enumerate(zip(a, b)) if x != y or x[0] == 0xFF)
        assert shared[order[row]] == common


def test_windows_have_one_name():
    """Equal windows lie at the same place of segments with the same gram."""
    shared = prose(5, 60).encode()
    data = [prose(8, 40).encode() + shared + b"x" * 150, b"yy" + shared + prose(9, 30).encode(), b"ab" * 200]
    names = {}
    for text in data:
        first, last, place, gram = ri.segments(np.frombuffer(text, np.uint8))
        assert first[0] == 0 and last[-1] == len(text) - 100 and (first[1:] == last[:-1] + 1).all()
        for a, b, p, g in zip(first, last, place, gram):
            for at in range(a, b + 1):
                assert names.setdefault(text[at : at + 100], (g, p - at)) == (g, p - at)


def test_blocks_of_a_long_text(monkeypatch):
    data = np.frombuffer(prose(2, 3_000).encode(), np.uint8)
    whole = ri.segments(data)
    monkeypatch.setattr(ri, "_BLOCK", 700)
    first, last, place, gram = ri.segments(data)
    assert first[0] == 0 and (first[1:] == last[:-1] + 1).all() and last[-1] == whole[1][-1]
    expected = dict(zip(whole[2].tolist(), whole[3].tolist()))
    assert all(expected[p] == g for p, g in zip(place.tolist(), gram.tolist()))


def test_query(spark):
    check(QUERIES["op6_run_index"](spark, SF), sorted(parquet_rows("documents", "doc_id, text")))


def crowded():
    passage, other = prose(50, 60), prose(51, 40)
    texts = [prose(100 + i, 20 + i % 5) + " " + passage + " " + prose(200 + i, 15) for i in range(60)]
    texts += [other * 3, other, passage[:99], passage[:100], "é" * 120, "aé" * 80, "z" * 500, "z" * 99, "", None]
    texts += [texts[0], texts[0][:200], texts[3] + texts[4]]
    return list(enumerate(texts))


@pytest.mark.parametrize("hot", [ri.HOT_SEGMENTS, 3, 0])
def test_shared_passages_with_and_without_hot_grams(spark, hot):
    rows = crowded()
    check(digests(documents(spark, [(i, t, "en", "s", 1) for i, t in rows]), hot), rows)


def test_small_batches_and_indexes(spark, monkeypatch):
    monkeypatch.setattr(ri, "INDEX_BYTES", 500)
    rows = crowded()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        check(digests(documents(spark, [(i, t, "en", "s", 1) for i, t in rows])), rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_odd_tables(spark):
    docs = clashing(documents(spark, odd_rows()))
    found = ri.remove_repeats(docs)
    assert found.count() == len(odd_rows())
    order = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    expected = brute(list(enumerate(r[1] for r in order)))
    assert sorted((r.n_bytes, len(r.starts)) for r in found.collect()) == sorted((e[0], e[2]) for e in expected.values())
    changed = ri.without_repeats(docs)
    assert changed.columns == docs.columns and changed.count() == len(odd_rows())
    assert ri.remove_repeats(docs.limit(0)).count() == 0 and ri.without_repeats(docs.limit(0)).count() == 0


def test_texts_of_documents(spark):
    passage = prose(77, 60)
    docs = documents(spark, [(1, passage, "en", "s", 5), (2, "ü" + passage, "en", "s", 5), (3, None, "en", "s", None),
                             (4, "short", "en", "s", 99)])
    found = {r.doc_id: (r.text, r.n_chars) for r in ri.without_repeats(docs).collect()}
    assert found == {1: (passage, 5), 2: ("ü", 1), 3: (None, None), 4: ("short", 99)}


def test_documents_are_joined_to_their_spans_only(spark):
    docs = documents(spark, [(i, t, "en", "s", 1) for i, t in crowded()])
    plan = ri.without_repeats(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join" in line.split() for line in plan.replace("+-", " ").replace(":-", " ").splitlines()) == 1


def _gram_batches(sizes):
    """Batches of 10 rows: ``sizes[g]`` different segments of 120 bytes for gram g."""
    draw = random.Random(3)
    rows = [
        (0, gram, at, at, 0, 120, bytes(draw.choice(b"abcdefgh") for _ in range(120)))
        for gram, size in enumerate(sizes)
        for at in range(size)
    ]
    names = ("kind", "gram", "body", "key", "start", "size")
    for at in range(0, len(rows), 10):
        part = rows[at : at + 10]
        batch = {n: pa.array([r[i] for r in part], pa.int64()) for i, n in enumerate(names)}
        yield batch | {"bytes": pa.array([r[6] for r in part], pa.binary())}


def test_a_large_gram_is_indexed_apart_from_the_grams_before_it(monkeypatch):
    seen = []
    monkeypatch.setattr(ri, "INDEX_BYTES", 2_400)
    monkeypatch.setattr(ri, "repeated_windows", lambda pieces: seen.append(len(pieces)) or (np.empty(0, int),) * 2)
    sizes = [15, 4, 100, 3, 16, 2, 60]
    list(ri._index(_gram_batches(sizes)))
    assert seen == [19, 100, 19, 2, 60]


def test_an_index_takes_few_bytes_of_memory_for_each_byte_of_text():
    draw = random.Random(4)
    words = [bytes(draw.choice(b"abcdefgh") for _ in range(draw.randint(2, 9))) for _ in range(500)]
    pieces = [b" ".join(draw.choice(words) for _ in range(30))[:140] for _ in range(4_000)]
    tracemalloc.start()
    try:
        ri.repeated_windows(pieces)
        assert tracemalloc.get_traced_memory()[1] < 55 * sum(map(len, pieces))
    finally:
        tracemalloc.stop()
