"""Exact top-k inner products by the threshold algorithm over sorted lists.

Candidates are dealt to blocks by the hash of their ids; a block is made once, as one row with
its vectors and, for every dimension, the order of its rows. A query walks the lists of its
dimensions, from the largest values where its own component is positive, from the smallest where
it is negative, and scores each row when it first appears. A row not seen yet has no component
beyond the present place in any list, and no norm above the block's largest: the most that such
a vector could score is the bound. The lists that give it most of its size are walked further. Once the k-th score exceeds it, the query stops.
A bound equal to the k-th score does not stop it, as a tie may have a smaller id.

Every query first meets the block of its own id. Its k-th score there is a floor for all other
blocks, which stop as soon as their bound falls below it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from censusloom.llm.common import ship, stored

SCALE = 256
QUERY_BLOCK = 2_048
CANDIDATE_BLOCK = 16_384
_FIRST_DEPTH = 4
_SAFE = 1e-9  # relative allowance for rounding in a bound


def most_of(weights, limits, radius: float):
    """The x <= limits of a norm of at most ``radius`` with the largest weights . x; weights > 0.

    It is ``scale * weights`` cut off at the limits: the components are sorted by the scale at
    which they meet their limits, and the scale follows from the norm. Without any such x, all
    components are minus infinity.
    """
    import numpy as np

    ratio = limits / weights
    by = np.argsort(ratio)
    w, t, ratio = weights[by], limits[by], ratio[by]
    cut = np.concatenate([[0.0], np.cumsum(t * t)])  # squares of the first m at their limits
    free = np.concatenate([np.cumsum((w * w)[::-1])[::-1], [0.0]])
    left = radius * radius * (1 + _SAFE) - cut
    fixed = int((t < 0).sum())  # limits below zero hold in any case
    if left[fixed] < 0:
        return np.full(len(limits), -np.inf)
    if left[-1] >= 0:
        return limits
    scales = np.sqrt(np.maximum(left[:-1], 0.0) / free[:-1])
    m = fixed + int(np.argmax((scales <= ratio)[fixed:]))
    return np.minimum(limits, scales[m] * weights)


def bound_of(weights, limits, radius: float) -> float:
    """The largest weights . x over all x <= limits of a norm of at most ``radius``."""
    return float(weights @ most_of(weights, limits, radius))


def scan(query, own: int, vectors, ids, order, k: int, radius: float, floor: float = -float("inf")):
    """The best ``k`` (score, id) of one query in one block, and the number of rows scored.

    ``order`` sorts each column ascending. With a ``floor``, rows that score less may be left out.
    """
    import numpy as np

    rows = len(ids)
    # The lists walked: a column with its step from the best end.
    columns = np.flatnonzero(query != 0)
    signs = np.where(query[columns] > 0, 1.0, -1.0)
    weights = np.abs(query[columns]).astype(float)
    seen = ids == own
    best_scores, best_ids = np.empty(0, vectors.dtype), np.empty(0, ids.dtype)
    depths, reached, scored = np.minimum(np.full(len(columns), _FIRST_DEPTH), rows), np.zeros(len(columns), int), 0
    while True:
        fresh = np.zeros(rows, bool)
        for i in np.flatnonzero(depths > reached):
            column = order[:, columns[i]]
            part = column[rows - depths[i] : rows - reached[i]] if signs[i] > 0 else column[reached[i] : depths[i]]
            fresh[part] = True
        if not len(columns):  # a zero vector has no lists: see all
            fresh[:] = True
        fresh &= ~seen
        seen |= fresh
        scored += int(fresh.sum())
        scores = np.concatenate([best_scores, vectors[fresh] @ query])
        names = np.concatenate([best_ids, ids[fresh]])
        if len(scores) > k:
            tail = np.sort(scores)[-k]
            close = scores >= tail
            scores, names = scores[close], names[close]
        chosen = np.lexsort((names, -scores))[:k]
        best_scores, best_ids = scores[chosen], names[chosen]
        reached = depths
        if not len(columns) or reached.max() >= rows:  # a list at its end: all rows are seen
            return best_scores, best_ids, scored
        at = np.where(signs > 0, order[rows - 1 - reached, columns], order[reached, columns])
        limits = (vectors[at, columns] * signs).astype(float)
        most = most_of(weights, limits, radius)
        if np.isneginf(most).any():
            return best_scores, best_ids, scored
        parts = weights * most
        bound = float(parts.sum())
        least = max(floor, float(best_scores[-1]) if len(best_scores) == k else floor)
        if least > bound + _SAFE * abs(bound):
            return best_scores, best_ids, scored
        # Go on where the bound gets most of its size: lists of small weights only cost rows.
        depths = np.where(parts >= parts.mean(), np.minimum(2 * reached, rows), reached)


def _pack(table: pa.Table) -> pa.Table:
    """The vectors of a block as one row of bytes: ids, vectors, the order of each column, the largest norm."""
    import numpy as np

    flat = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    vectors = flat.reshape(table.num_rows, -1).astype("<i8")
    order = np.argsort(vectors, axis=0, kind="stable").astype("<i4")
    radius = float(np.sqrt((vectors.astype(float) ** 2).sum(axis=1).max()))
    row = {
        "length": table["length"][0].as_py(), "part": table["part"][0].as_py(), "rows": table.num_rows,
        "ids": table["vec_id"].to_numpy().astype("<i8").tobytes(), "vectors": vectors.tobytes(), "order": order.tobytes(),
        "radius": radius,
    }
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64())
    return pa.table({n: pa.array([v], k) for (n, v), k in zip(row.items(), kinds, strict=True)})


_BLOCK = "length int, part int, rows bigint, ids binary, vectors binary, order binary, radius double"
_FOUND = "query_id bigint, vec_id bigint, score bigint, scored bigint"


def _block_top(k: int):
    def best(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        import numpy as np

        out = {"query_id": [], "vec_id": [], "score": [], "scored": []}
        if queries.num_rows and blocks.num_rows:
            block = blocks.slice(0, 1).to_pylist()[0]
            rows, length = block["rows"], block["length"]
            ids = np.frombuffer(block["ids"], "<i8")
            right = np.frombuffer(block["vectors"], "<i8").reshape(rows, length)
            order = np.frombuffer(block["order"], "<i4").reshape(rows, length)
            left = queries["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            left = left.reshape(queries.num_rows, -1).astype(np.int64)
            # Integers as doubles where that is exact for all inner products, else as Python integers.
            most = float(np.abs(left.astype(float)).max()) * float(np.abs(right.astype(float)).max())
            kind = float if most * length < 2**53 else object
            left, right = left.astype(kind), right.astype(kind)
            floors = queries["floor"].to_pylist()
            for own, query, floor in zip(queries["vec_id"].to_pylist(), left, floors, strict=True):
                floor = -float("inf") if floor is None else float(floor)
                scores, names, scored = scan(query, own, right, ids, order, k, block["radius"], floor)
                out["query_id"] += [own] * len(names)
                out["vec_id"] += names.tolist()
                out["score"] += [int(s) for s in scores]
                out["scored"] += [scored] + [0] * (len(names) - 1) if len(names) else []
        return pa.table({name: pa.array(values, pa.int64()) for name, values in out.items()})

    return best


def integer_vectors(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vector) with floor(256 * x); unusable vectors and repeated rows are left out.

    Vectors that are null, empty, or hold null or non-finite components take no part,
    nor do rows without an id. Rows that repeat both id and vector count once.
    """
    slim = vectors.select(F.col(ident).alias("vec_id"), F.col(vector).alias("vector"))
    finite = F.forall(
        "vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )
    usable = slim.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & finite)
    scaled = F.transform("vector", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("bigint"))
    return usable.select("vec_id", scaled.alias("vector")).dropDuplicates()


def top_k(
    queries: DataFrame,
    candidates: DataFrame,
    k: int = 5,
    query_block: int = QUERY_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best candidates of another id.

    Both tables hold (vec_id, vector) from :func:`integer_vectors`. Ties go to the
    smaller id; with fewer than ``k`` candidates all are returned; a query without any
    gives no rows. Vectors meet vectors of their own length only. Rows with one id and
    different vectors are separate candidates; as queries they share one list of results.
    Scores beyond 64 bits are an error.
    """
    found = _candidates_found(queries, candidates, k, query_block, candidate_block)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _candidates_found(queries: DataFrame, candidates: DataFrame, k: int, query_block: int, candidate_block: int) -> DataFrame:
    """The best of every (query, block), with the number of rows scored for it in ``scored``."""
    ship(queries.sparkSession)
    query_blocks = max(1, -(-queries.count() // query_block))
    parts = max(1, -(-candidates.count() // candidate_block))
    hashed = F.xxhash64("vec_id")
    part = F.pmod(hashed, F.lit(parts)).cast("int")
    length = F.size("vector").alias("length")
    blocks = candidates.select("vec_id", "vector", length, part.alias("part")).groupBy("length", "part")
    blocks = stored(blocks.applyInArrow(_pack, _BLOCK), "blocks")
    asked = queries.select("vec_id", "vector", length, part.alias("part"), F.pmod(F.shiftrightunsigned(hashed, 20), F.lit(query_blocks)).alias("deal"))

    def meet(asked: DataFrame, blocks: DataFrame) -> DataFrame:
        keys = ["length", "part", "deal"]
        return asked.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInArrow(_block_top(k), _FOUND)

    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(query_blocks - 1).cast("bigint"))).alias("deal")
    dealt = blocks.select("*", every)
    home = stored(meet(asked.withColumn("floor", F.lit(None).cast("bigint")), dealt), "home")
    if parts == 1:
        return home
    # The k-th score at home: k rows that score as much are known already.
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc()))
    floors = home.withColumn("place", place).where(F.col("place") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    away = asked.join(floors, "vec_id", "left").withColumn("home", F.col("part")).drop("part")
    others = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    away = away.select("vec_id", "vector", "length", "floor", "deal", "home", others).where(F.col("part") != F.col("home")).drop("home")
    return home.unionByName(meet(away, dealt))


def scored_share(queries: DataFrame, candidates: DataFrame, k: int = 5, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> float:
    """The share of all (query, candidate) pairs whose score the search computes, for a report.

    Blocks in which a query finds nothing are not counted.
    """
    found = _candidates_found(queries, candidates, k, query_block, candidate_block)
    pairs = queries.count() * candidates.count()
    return (found.agg(F.sum("scored")).first()[0] or 0) / max(pairs, 1)


ORACLE_SQL = """
WITH usable AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vector
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_inner_product(q.vector, c.vector) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored)
WHERE place <= 5"""
