import random

import pytest
from helpers import clashing

from censusloom.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, k, every):
    import math

    usable = {(i, tuple(v)) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    scaled = [(i, [math.floor(256 * x) for x in v]) for i, v in usable]
    out = []
    for q, left in scaled:
        if q % every == 0:
            scores = [(-sum(a * b for a, b in zip(left, right)), c) for c, right in scaled if c != q and len(right) == len(left)]
            out += [(q, rank, c, -s) for rank, (s, c) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def as_floats(rows):
    import numpy as np

    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], n) for i, v, n in rows]


@pytest.mark.parametrize(("count", "block", "values"), [(300, 64, None), (120, 1000, (-1, 0, 0.5, 1)), (3, 10, None)])
def test_equals_brute_force(spark, count, block, values):
    draw = random.Random(count)
    rows = as_floats([(i, [draw.choice(values) if values else draw.gauss(0, 1) for _ in range(8)], 0) for i in range(count)])
    vectors = topk.integer_vectors(spark.createDataFrame(rows, SCHEMA))
    found = topk.top_k(vectors.where("vec_id % 5 = 0"), vectors, 5, query_block=16, candidate_block=block)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, 5, 5)


def test_odd_vectors(spark):
    rows = as_floats([
        (0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (1, [1.0, 2.0], None), (2, None, 1), (3, [None, 1.0], 1),
        (4, [float("nan"), 1.0], 1), (5, [float("inf"), 1.0], 1), (6, [], 1), (7, [3.0], 1), (None, [1.0, 1.0], 1),
        (8, [0.0, 0.0], 1), (10, [1e9, -1e9], 1), (15, [-0.001, 5.0], 1),
    ])
    frame = clashing(spark.createDataFrame(rows, SCHEMA))
    vectors = topk.integer_vectors(frame)
    found = topk.top_k(vectors.where("vec_id % 5 = 0"), vectors, 2)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, 2, 5)
    empty = topk.integer_vectors(frame.limit(0))
    assert topk.top_k(empty, empty).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_bound_is_the_maximum(seed):
    """No vector within the limits and the norm scores more, and one scores as much."""
    import numpy as np

    draw = np.random.default_rng(seed)
    size = int(draw.integers(1, 7))
    weights, limits = draw.uniform(0.1, 2, size), draw.normal(0.3, 1, size)
    radius = float(draw.uniform(0.2, 3))
    bound = topk.bound_of(weights, limits, radius)
    lowest = np.minimum(limits, 0)
    if np.linalg.norm(lowest) > radius:
        assert bound == -np.inf
        return
    best = -np.inf
    for scale in np.linspace(0, 50, 20_001):
        x = np.minimum(limits, scale * weights)
        if np.linalg.norm(x) <= radius:
            best = max(best, float(weights @ x))
    assert best - 1e-9 <= bound <= best + 0.02 * weights.sum()
    for _ in range(300):
        x = np.minimum(draw.normal(0, 1, size), limits)
        if np.linalg.norm(x) <= radius:
            assert weights @ x <= bound + 1e-9


def test_scan_stops_early():
    import numpy as np

    draw = np.random.default_rng(1)
    vectors = draw.normal(size=(20_000, 2)).round(3)
    vectors[5] = (50.0, 50.0)
    order = np.argsort(vectors, axis=0, kind="stable")
    radius = float(np.linalg.norm(vectors, axis=1).max())
    scores, ids, scored = topk.scan(np.array([1.0, 1.0]), -1, vectors, np.arange(20_000), order, 1, radius)
    assert ids.tolist() == [5] and scored < 100
    assert topk.scan(np.array([1.0, 1.0]), 5, vectors, np.arange(20_000), order, 1, radius, floor=90.0)[2] < 2_000


def clustered(count, size, clusters, seed=4):
    import numpy as np

    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(clusters, size))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    vectors = centres[draw.integers(0, clusters, count)] + draw.normal(0, 0.01, (count, size))
    return as_floats([(i, v.tolist(), 0) for i, v in enumerate(vectors / np.linalg.norm(vectors, axis=1)[:, None])])


def test_few_rows_of_clusters_are_scored(spark):
    rows = clustered(3_000, 8, 60)
    vectors = topk.integer_vectors(spark.createDataFrame(rows, SCHEMA).repartition(4))
    queries = vectors.where("vec_id % 100 = 0")
    assert sorted(tuple(r) for r in topk.top_k(queries, vectors, 5, candidate_block=1_000).collect()) == brute(rows, 5, 100)
    assert topk.scored_share(queries, vectors, candidate_block=1_000) < 0.3


def test_one_id_with_two_vectors(spark):
    rows = as_floats([(0, [1.0, 0.0], 0), (0, [0.0, 1.0], 0), *((i, [1.0 / i, 0.5], 0) for i in range(1, 60))])
    vectors = topk.integer_vectors(spark.createDataFrame(rows, SCHEMA))
    one = topk.top_k(vectors.where("vec_id = 0"), vectors, 5, candidate_block=1_000)
    many = topk.top_k(vectors.where("vec_id = 0"), vectors, 5, query_block=1, candidate_block=7)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect())) and one.count() == 5
