import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import DOCS, clashing, documents, odd_rows, rows_of

from censusloom.llm import collocations as C

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def by_hand(rows, least=10, keep=2000):
    """The contract, literally."""
    counts, totals = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in (1, 2, 3):
                for i in range(len(words) - n + 1):
                    counts[lang, tuple(words[i : i + n])] += 1
    found = {}
    candidates = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    for (lang, words), a in candidates.items():
        longer = [
            f for (other, w), f in candidates.items()
            if other == lang and len(w) > len(words) and any(w[i : i + len(words)] == words for i in range(len(w)))
        ]
        if any(100 * f >= 50 * a for f in longer):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1000000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted(
        (lang, i + 1, phrase.decode(), -a, left, right, totals[lang], -score)
        for lang, rows in found.items()
        for i, (score, a, phrase, left, right) in enumerate(sorted(rows)[:keep])
    )


def rows_with_phrases(seed=3, n=120):
    draw = random.Random(seed)
    words = ["new", "York", "city", "of", "the", "ünd", "中文", "x\x00y", "a b", "THE"]
    rows = []
    for i in range(n):
        text = "".join(draw.choice(words) + draw.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "!?"]) for _ in range(60))
        rows.append((i, text, draw.choice(["en", "en", "de", None, "und"]), "s", 1))
    return rows


def test_against_the_definition(spark):
    rows = rows_with_phrases()
    assert rows_of(C.collocations(documents(spark, rows)), *COLUMNS) == sorted(by_hand(rows), key=repr)


def test_beyond_the_vocabulary_bound(spark):
    rows = rows_with_phrases(4, 60)
    found = C.collocations(documents(spark, rows), max_words=3)
    assert rows_of(found, *COLUMNS) == sorted(by_hand(rows), key=repr)


def test_many_ranges_and_flushes(spark, monkeypatch):
    rows = rows_with_phrases(5, 60)
    monkeypatch.setattr(C, "RANGE_WORDS", 50)
    assert rows_of(C.collocations(documents(spark, rows)), *COLUMNS) == sorted(by_hand(rows), key=repr)


def test_odd_rows_and_clashing_columns(spark):
    rows = odd_rows() * 3
    expected = sorted(by_hand([r for r in rows]), key=repr)
    assert rows_of(C.collocations(clashing(documents(spark, rows))), *COLUMNS) == expected


def test_empty_table(spark):
    assert C.collocations(spark.createDataFrame([], DOCS)).collect() == []
    assert C.collocations(documents(spark, [(1, None, None, None, None)])).collect() == []


def test_ties_follow_the_bytes(spark):
    rows = [(i, "b c. a b. Z z. é f", "en", "s", 1) for i in range(10)]
    found = C.collocations(documents(spark, rows)).where("score = 1000000").orderBy("rank").collect()
    assert [r["phrase"] for r in found] == ["é f"]
    assert rows_of(C.collocations(documents(spark, rows)), *COLUMNS) == sorted(by_hand(rows), key=repr)


@pytest.mark.parametrize("bits", [1, 2, 7, 20, 42, 63])
def test_permutation_is_invertible(bits):
    draw = np.random.default_rng(bits)
    keys = draw.integers(0, 1 << bits, 2000, dtype=np.uint64) if bits > 10 else np.arange(1 << bits, dtype=np.uint64)
    moved = C.permute(keys, bits)
    assert (moved < np.uint64(1 << bits)).all() and (C.restore(moved, bits) == keys).all()
    assert len(np.unique(moved)) == len(np.unique(keys))


@pytest.mark.parametrize("bits", [1, 9, 16, 40, 62])
@pytest.mark.parametrize("n", [0, 1, 2, 3, 500])
def test_filters_are_lossless(bits, n):
    draw = np.random.default_rng(n)
    keys = np.unique(draw.integers(0, 1 << bits, n, dtype=np.uint64))
    counts = draw.choice([1, 254, 255, 256, 1 << 40], len(keys)).astype(np.int64)
    found = C.read_filter(C.write_filter(keys, counts, bits))
    assert (found[0] == keys).all() and (found[1] == counts).all()


def test_merging_filters_adds_counters():
    draw = np.random.default_rng(1)
    total, parts = Counter(), []
    for _ in range(20):
        keys, counts = C.counted(draw.integers(0, 300, 400, dtype=np.uint64))
        parts.append(C.write_filter(keys, counts, 30))
        total.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
    keys, counts = C.merged(iter(parts))
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == total


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(C, "_SLICE", 7)
    text = "One two. three\tfour,five six\r\nseven  eight".encode()
    whole = text.lower().translate(C._TO_LINES).replace(b"\n", b" . ").split()
    assert [w for s in C.word_slices(text) for w in s] == whole
