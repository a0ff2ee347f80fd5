"""Similarity join on word shingles: MinHash candidates, Bayesian pruning, exact check.

1. Every text becomes its set of five-word shingles, a MinHash signature, and a hash of
   the set. Texts with the same set are one class; the rest works on one row per class.
2. Bands of the signature put classes into buckets. Only buckets with several classes go
   on; large ones are cut into blocks, and pairs of blocks are the units of work.
3. In each unit, signatures are compared a few values at a time. A pair is dropped as
   soon as the probability that its similarity reaches the threshold, given the matches
   so far and a uniform prior, falls below a tolerance. What survives is not emitted as
   pairs: each row is linked to the least row it is connected with.
4. Connected survivors form families. All pairs inside a family are compared exactly, on
   the sets, again by blocks; tasks return each class's number of links and a forest of
   the links.
5. The forests' components are the groups of near copies.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from censusloom.llm.common import WORD, free_name, map_batches, remembered, stored, with_key
from censusloom.llm.components import components

SHINGLE_WORDS = 5
SIMILAR = (4, 5)  # the threshold as a fraction: 0.8
BANDS, BAND_VALUES = 32, 4
PRUNE_STEP, PRUNE_VALUES = 16, 64
TOLERANCE = 1e-6
BUCKET_BLOCK = 512
FAMILY_BLOCK = 256
_MEMO_WORDS = 200_000
_WORD = re.compile(WORD)
_SEED = np.random.default_rng(20_240_607)
_FACTORS = (_SEED.integers(0, 2**31, BANDS * BAND_VALUES, np.uint32) << np.uint32(1)) | np.uint32(1)
_SHIFTS = _SEED.integers(0, 2**32, BANDS * BAND_VALUES, np.uint32)
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)]


def _mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of the input."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * _MIX[0]
        values = (values ^ (values >> np.uint64(27))) * _MIX[1]
    return values ^ (values >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= _MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode())
        return value


def shingles(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all windows of ``size`` words.

    A text of fewer words is one shingle of all of them; one without words has none.
    """
    words = _WORD.findall(text or "")
    if not words:
        return np.empty(0, np.uint64)
    known = remembered("words", _WordHashes)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    count = len(words) - width + 1
    found = np.full(count, width, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(width):
            found = found * _MIX[2] + hashes[at : at + count]
            found ^= found >> np.uint64(32)
    return np.unique(_mixed(found))


def signature(sets: np.ndarray) -> np.ndarray:
    """MinHash values of a set of shingles."""
    low = (sets >> np.uint64(16)).astype(np.uint32)
    least = np.full(len(_FACTORS), 2**32 - 1, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(low), 256):
            least = np.minimum(least, (low[at : at + 256, None] * _FACTORS + _SHIFTS).min(axis=0))
    return least


def least_matches(values: int, similar: float, tolerance: float) -> int:
    """Fewest matches among ``values`` that leave similarity >= ``similar`` as probable as the tolerance.

    With a uniform prior, that posterior is P(Binomial(values + 1, similar) <= matches).
    """
    total = 0.0
    for matches in range(values + 1):
        total += math.comb(values + 1, matches) * similar**matches * (1 - similar) ** (values + 1 - matches)
        if total >= tolerance:
            return matches
    return values + 1


def similar_enough(common, left, right):
    """Whether sets of sizes ``left`` and ``right`` with ``common`` elements reach the threshold, exactly."""
    top, bottom = SIMILAR
    return (top + bottom) * common >= top * (left + right)


def _sketch(batches: Iterator[dict]) -> Iterator[dict]:
    for batch in batches:
        names = ("size", "set_a", "set_b", "values")
        rows = []
        for text in batch["text"]:
            found = shingles(text.as_py())
            if not len(found):
                rows.append((0, None, None, None))
                continue
            with np.errstate(over="ignore"):
                total, other = found.sum(dtype=np.uint64), _mixed(found ^ _MIX[2]).sum(dtype=np.uint64)
            signed = [int(x.astype(np.int64)) for x in (total, other)]
            rows.append((len(found), *signed, signature(found).tobytes()))
        yield dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)) | {"key": batch["key"]}


def _bands(batches: Iterator[dict]) -> Iterator[dict]:
    """One row per band: a hash of the band's number and values."""
    for batch in batches:
        keys = batch["key"].to_numpy()
        values = np.frombuffer(b"".join(batch["values"].to_pylist()), np.uint32).reshape(len(keys), BANDS, BAND_VALUES)
        found = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(keys), BANDS))
        for at in range(BAND_VALUES):
            found = _mixed(found ^ (values[:, :, at].astype(np.uint64) << np.uint64(8)))
        yield {"band": _arrow(found.ravel().view(np.int64)), "key": _arrow(np.repeat(keys, BANDS))}


def _arrow(values: np.ndarray):
    import pyarrow as pa

    return pa.array(values)


def _forest(rows: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least row that each row is connected with through the pairs (left, right)."""
    label = np.arange(rows)
    while True:
        fresh = label.copy()
        np.minimum.at(fresh, left, label[right])
        np.minimum.at(fresh, right, label[left])
        fresh = fresh[fresh]
        if (fresh == label).all():
            return label
        label = fresh


def _grouped(batches: Iterator[dict], keys: tuple[str, ...], columns: tuple[str, ...]) -> Iterator[list]:
    """Whole groups of rows sorted by ``keys``: (array of group numbers, column lists) of many groups at a time."""
    held: list | None = None

    def split(done: list) -> np.ndarray:
        change = np.zeros(len(done[0]), bool)
        for column in done[: len(keys)]:
            change[1:] |= column[1:] != column[:-1]
        return change

    for batch in batches:
        fresh = [batch[k].to_numpy() for k in keys] + [
            np.array(batch[c].to_pylist(), object) if str(batch[c].type).endswith("binary") else batch[c].to_numpy()
            for c in columns
        ]
        if not len(fresh[0]):
            continue
        held = fresh if held is None else [np.concatenate(x) for x in zip(held, fresh, strict=True)]
        starts = np.flatnonzero(split(held))
        if len(starts):
            cut = starts[-1]
            done = [c[:cut] for c in held]
            held = [c[cut:] for c in held]
            yield [np.cumsum(split(done)), *done]
    if held is not None:
        yield [np.cumsum(split(held)), *held]


def _pairs(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of the same group; rows of a group are neighbours and few."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    for size in np.unique(sizes[sizes > 1]):
        first, second = np.triu_indices(size, 1)
        chosen = starts[sizes == size]
        step = max(1, 500_000 // len(first))
        for at in range(0, len(chosen), step):
            base = chosen[at : at + step, None]
            yield (base + first).ravel(), (base + second).ravel()


def _prune(batches: Iterator[dict]) -> Iterator[dict]:
    """Links of rows that survive the incremental comparison, as a forest."""
    top, bottom = SIMILAR
    steps = range(PRUNE_STEP, PRUNE_VALUES + 1, PRUNE_STEP)
    needed = [least_matches(n, top / bottom, TOLERANCE) for n in steps]
    for group, _, _, _, keys, sizes, values in _grouped(
        batches, ("band", "part_a", "part_b"), ("key", "size", "values")
    ):
        signs = np.frombuffer(b"".join(values), np.uint16).reshape(len(keys), PRUNE_VALUES)
        kept_left, kept_right = [], []
        for left, right in _pairs(group):
            # The smaller set cannot cover enough of the larger one beyond this ratio.
            alive = bottom * np.minimum(sizes[left], sizes[right]) >= top * np.maximum(sizes[left], sizes[right])
            left, right = left[alive], right[alive]
            matches = np.zeros(len(left), np.int64)
            for stop, least in zip(steps, needed, strict=True):
                part = slice(stop - PRUNE_STEP, stop)
                matches += (signs[left, part] == signs[right, part]).sum(axis=1)
                alive = matches >= least
                left, right, matches = left[alive], right[alive], matches[alive]
            kept_left.append(left)
            kept_right.append(right)
        if kept_left:
            label = _forest(len(keys), np.concatenate(kept_left), np.concatenate(kept_right))
            linked = label != np.arange(len(keys))
            yield {"a": _arrow(keys[linked]), "b": _arrow(keys[label[linked]])}


def _exact(batches: Iterator[dict]) -> Iterator[dict]:
    """Exact links in a family's pair of blocks: per row its links, and the least row it is connected with."""
    for group, _, _, _, keys, copies, block, sizes, sets in _grouped_by_family(batches):
        for start, stop in _spans(group):
            rows = stop - start
            own = [np.frombuffer(s, np.uint64) for s in sets[start:stop]]
            ids = np.concatenate(own)
            owner = np.repeat(np.arange(rows), [len(s) for s in own])
            _, place, count = np.unique(ids, return_inverse=True, return_counts=True)
            shared = count[place] > 1
            column = np.cumsum(count > 1)[place[shared]] - 1
            owner = owner[shared]
            common = np.zeros((rows, rows), np.float64)
            width = 1 + (column.max() if len(column) else 0)
            by = np.argsort(column, kind="stable")
            column, owner = column[by], owner[by]
            for low in range(0, width, 4096):
                a, b = np.searchsorted(column, (low, low + 4096))
                if a == b:
                    continue
                hold = np.zeros((rows, 4096), np.float32)
                hold[owner[a:b], column[a:b] - low] = 1
                common += hold @ hold.T
            size = sizes[start:stop].astype(np.float64)
            linked = similar_enough(common, size[:, None], size[None, :])
            np.fill_diagonal(linked, False)
            sides = block[start:stop]
            if sides.min() != sides.max():  # pairs inside one block are another unit's work
                linked &= sides[:, None] != sides[None, :]
            left, right = np.nonzero(np.triu(linked))
            label = _forest(rows, left, right)
            yield {
                "key": _arrow(keys[start:stop]),
                "texts": _arrow(linked.sum(axis=1).astype(np.int64)),
                "links": _arrow((linked @ copies[start:stop].astype(np.float64)).astype(np.int64)),
                "least": _arrow(keys[start:stop][label]),
            }


def _grouped_by_family(batches: Iterator[dict]) -> Iterator[list]:
    return _grouped(batches, ("family", "part_a", "part_b"), ("key", "copies", "block", "size", "sets"))


def _spans(group: np.ndarray) -> Iterator[tuple[int, int]]:
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    yield from zip(starts.tolist(), [*starts[1:].tolist(), len(group)], strict=True)


def _in_blocks(df: DataFrame, group: str, rows: str, block_rows: int) -> DataFrame:
    """Repeat each row for all pairs of blocks of its group that its own block belongs to."""
    blocks = F.ceil(F.col(rows) / F.lit(block_rows)).cast("int")
    cut = df.withColumn("_blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key"), F.col("_blocks")).cast("int"))
    other = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    placed = other.withColumn("part_a", F.least("block", "_other")).withColumn("part_b", F.greatest("block", "_other"))
    return placed.drop("_blocks", "_other").repartition(group, "part_a", "part_b").sortWithinPartitions(
        group, "part_a", "part_b", "key"
    )


def join_keyed(plain: DataFrame) -> DataFrame:
    """:func:`similarity_join` for (key, text) with unique long keys: (key, class, copy, n_links, n_linked_texts)."""
    sketches = stored(
        map_batches(plain, _sketch, "key bigint, size bigint, set_a bigint, set_b bigint, values binary"), "sketches"
    )
    same = ["size", "set_a", "set_b"]
    classes = stored(
        sketches.where("size > 0").groupBy(*same).agg(F.min("key").alias("copy"), F.count("*").alias("copies")),
        "classes",
    )
    firsts = classes.select(F.col("copy").alias("key"), "copies")
    signed = stored(sketches.select("key", "size", "values").join(firsts, "key"), "signed")

    banded = map_batches(signed.select("key", "values"), _bands, "band bigint, key bigint")
    crowded = banded.groupBy("band").agg(F.count("*").alias("rows")).where("rows > 1")
    short = F.expr(f"substring(values, 1, {4 * PRUNE_VALUES})")
    halves = map_batches(
        signed.select("key", "size", short.alias("values")), _upper_halves, "key bigint, size bigint, values binary"
    )
    members = banded.join(crowded, "band").join(halves, "key")
    units = _in_blocks(members, "band", "rows", BUCKET_BLOCK).select(
        "band", "part_a", "part_b", "key", "size", "values"
    )
    families = components(map_batches(units, _prune, "a bigint, b bigint"), "a", "b")
    counted = families.groupBy("component").agg(F.count("*").alias("rows"))
    kin = families.join(counted, "component").select(F.col("node").alias("key"), F.col("component").alias("family"), "rows")
    kin = stored(kin.join(firsts, "key"), "families")

    texts = plain.join(kin, "key")
    sets = map_batches(
        texts.select("key", "family", "rows", "copies", "text"),
        _sets,
        "key bigint, family bigint, rows bigint, copies bigint, size bigint, sets binary",
    )
    checked = stored(
        map_batches(
            _in_blocks(sets, "family", "rows", FAMILY_BLOCK).select(
                "family", "part_a", "part_b", "key", "copies", "block", "size", "sets"
            ),
            _exact,
            "key bigint, texts bigint, links bigint, least bigint",
        ),
        "links",
    )
    groups = components(checked.select("key", "least").where("key <> least"), "key", "least")
    degrees = checked.groupBy("key").agg(F.sum("texts").alias("texts"), F.sum("links").alias("links"))
    facts = (
        classes.join(degrees, classes["copy"] == degrees["key"], "left")
        .join(groups, F.col("copy") == F.col("node"), "left")
        .select(
            *same,
            "copy",
            F.coalesce("component", "copy").alias("class"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("texts", F.lit(0)).cast("bigint").alias("n_linked_texts"),
        )
    )
    return (
        sketches.select("key", *same)
        .join(facts, same, "left")
        .select(
            "key",
            F.coalesce("class", "key").alias("class"),
            F.coalesce("copy", "key").alias("copy"),
            F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
            F.coalesce("n_linked_texts", F.lit(0)).cast("bigint").alias("n_linked_texts"),
        )
    )


def similarity_join(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Near copies of every document: (id, class_id, copy_id, n_links, n_linked_texts).

    ``copy_id`` is the least id with the same shingles, ``class_id`` the least id
    connected through similar texts. ``n_links`` counts the other documents of similarity
    0.8 or more, copies included; ``n_linked_texts`` the different sets among them. Texts
    without words (null and empty ones, too) link to nothing and are classes of their
    own. Repeated rows are copies of each other. An empty table gives no rows.
    """
    slim = docs.select(F.col(ident).alias("ident"), F.col(text).alias("text"))
    keyed, odd = with_key(slim, "ident", "text", "key")
    found = join_keyed(keyed.select("key", "text"))
    if not odd:
        named = {"key": ident, "class": "class_id", "copy": "copy_id"}
        return found.select(*[F.col(c).alias(named.get(c, c)) for c in found.columns])
    # Ids repeat or are null: the keys are row numbers, so look the ids up.
    names = keyed.select(F.col("key").alias("_key"), F.col("ident").alias("_id"))
    for column, name in (("key", ident), ("class", "class_id"), ("copy", "copy_id")):
        found = found.join(names, F.col(column) == F.col("_key")).drop("_key", column).withColumnRenamed("_id", name)
    return found.select(ident, "class_id", "copy_id", "n_links", "n_linked_texts")


def _upper_halves(batches: Iterator[dict]) -> Iterator[dict]:
    """The upper 16 bits of each value are enough to compare."""
    for batch in batches:
        values = np.frombuffer(b"".join(batch["values"].to_pylist()), np.uint32) >> np.uint32(16)
        rows = values.astype(np.uint16).reshape(-1, PRUNE_VALUES)
        yield {"key": batch["key"], "size": batch["size"], "values": [r.tobytes() for r in rows]}


def _sets(batches: Iterator[dict]) -> Iterator[dict]:
    for batch in batches:
        found = [shingles(t.as_py()) for t in batch["text"]]
        yield {k: batch[k] for k in ("key", "family", "rows", "copies")} | {
            "size": [len(s) for s in found], "sets": [s.tobytes() for s in found]
        }


def without_near_copies(docs: DataFrame) -> DataFrame:
    """All columns of the first document (by id, then text) of each group of near copies.

    Of repeated rows one stays. Documents without near copies or words all stay.
    """
    key = free_name(docs, "_key")
    keyed, _ = with_key(docs, "doc_id", "text", key)
    found = join_keyed(keyed.select(F.col(key).alias("key"), "text"))
    first = found.where(F.col("key") == F.col("class")).select(F.col("key").alias(key))
    return keyed.join(first, key, "left_semi").select(*docs.columns)
