import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import SF, WORD, clashing, documents, odd_rows, parquet_rows, prose

from censusloom.llm import ngram_join as nj
from censusloom.llm.components import components
from censusloom.llm.queries import QUERIES


def word_sets(rows):
    out = {}
    for key, text in rows:
        words = WORD.findall(text or "")
        width = min(5, len(words))
        out[key] = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()
    return out


def brute(rows):
    """id -> (class, copy, links, linked texts) over (key, text) with unique keys."""
    sets = word_sets(rows)
    common = Counter()
    places = defaultdict(list)
    for key, found in sets.items():
        for shingle in found:
            places[shingle].append(key)
    for keys in places.values():
        common.update(itertools.combinations(sorted(keys), 2))
    linked = defaultdict(set)
    for (a, b), n in common.items():
        if 9 * n >= 4 * (len(sets[a]) + len(sets[b])):
            linked[a].add(b)
            linked[b].add(a)
    out = {}
    for key in sorted(sets):
        seen, todo = {key}, [key]
        while todo:
            for other in linked[todo.pop()] - seen:
                seen.add(other)
                todo.append(other)
        copies = [k for k in seen if sets[k] == sets[key]] if sets[key] else [key]
        texts = {frozenset(sets[k]) for k in linked[key]} - {frozenset(sets[key])}
        out[key] = (min(seen), min(copies), len(linked[key]), len(texts))
    return out


def near(seed, words, changes):
    made = prose(seed, words).split(" ")
    for at in range(changes):
        made[(at * 37 + seed) % len(made)] = f"changed{seed}x{at}"
    return " ".join(made)


def check(found, rows):
    expected = brute(rows)
    assert {r.doc_id: (r.class_id, r.copy_id, r.n_links, r.n_linked_texts) for r in found.collect()} == expected


def test_thresholds():
    assert nj.similar_enough(8, 9, 9) and nj.similar_enough(80, 90, 90) and not nj.similar_enough(79, 90, 90)
    tail = [nj.least_matches(n, 0.8, 1e-6) for n in (16, 32, 64)]
    assert tail == sorted(tail) and 0 < tail[0] < 16 * 0.8
    rng = np.random.default_rng(2)  # pairs exactly at the threshold nearly always survive
    assert (rng.binomial(64, 0.8, 100_000) >= tail[-1]).mean() > 0.9999


def test_signatures_estimate_similarity():
    left = nj.shingles(prose(1, 2_000))
    right = nj.shingles(near(1, 2_000, 30))
    exact = len(np.intersect1d(left, right)) / len(np.union1d(left, right))
    assert abs((nj.signature(left) == nj.signature(right)).mean() - exact) < 0.12


def test_query(spark):
    check(QUERIES["op7_ngram_join"](spark, SF), parquet_rows("documents", "doc_id, text"))


@pytest.mark.parametrize("blocks", [(512, 256), (8, 5)])
def test_large_groups_and_common_passages(spark, monkeypatch, blocks):
    monkeypatch.setattr(nj, "BUCKET_BLOCK", blocks[0])
    monkeypatch.setattr(nj, "FAMILY_BLOCK", blocks[1])
    passage = prose(500, 60)
    texts = [near(3, 200, n % 7) for n in range(40)]  # near copies of each other, some exact
    texts += [prose(3, 200) + f" tail{n}" for n in range(30)]
    texts += [prose(600 + n, 100) + " " + passage for n in range(40)]  # share a passage only
    texts += ["short text", "short text", "short text here", "", None]
    rows = list(enumerate(texts))
    check(nj.similarity_join(documents(spark, [(i, t, "en", "s", 1) for i, t in rows])), rows)


def test_odd_tables(spark):
    docs = clashing(documents(spark, odd_rows()))
    found = nj.similarity_join(docs)
    assert found.count() == len(odd_rows())
    copies = [r for r in found.collect() if r.doc_id == 1]
    assert [(r.class_id, r.n_links) for r in copies] == [(None, 3), (None, 3)]  # the null id sorts first
    kept = nj.without_near_copies(docs)
    assert kept.columns == docs.columns
    texts = Counter(r.text for r in kept.collect())
    assert texts[odd_rows()[0][1]] == 0 and texts["4 word text only"] == 1 and texts[None] == 2
    assert nj.similarity_join(docs.limit(0)).count() == 0
    assert nj.without_near_copies(docs.limit(0)).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (20, 21), (21, 22), (22, 23), (23, 24), (24, 20), (3, 1)]
    links += [(100 + i, 101 + i) for i in range(40)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()}
    expected = {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, **{i: 20 for i in range(20, 25)}, **{100 + i: 100 for i in range(41)}}
    assert found == expected
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0
