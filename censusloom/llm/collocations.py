"""Phrase collocations per language, counted in counting quotient filters.

A word with fewer than ``least`` occurrences is in no phrase that has ``least``, nor in a part
of one, so only the other words get ids. An n-gram of word ids is packed into one number, and an
invertible permutation spreads the packed numbers evenly. The upper bits of the permuted number
are its *range* (one group of the shuffle) and its *quotient* in the filter of that range, the
other bits are its remainder, kept in full: the filter is lossless, and the n-gram comes back
from (range, quotient, remainder) by the inverse permutation. Each task counts its own texts in
sorted filters; the filters of all tasks for one range are merged by one group.

Bounds: ranges are cut so that a range has some ``RANGE_WORDS`` occurrences on average, however
large the corpus or one language is. The words with ids are broadcast, up to ``MAX_WORDS`` of
them; with more, n-grams are counted by a plain grouping on their words instead.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from censusloom.llm.common import map_batches, remembered, ship, stored

MAX_WORDS = 2_000_000
MAX_BYTES = 64 << 20
RANGE_WORDS = 1_000_000
_SLICE = 1 << 19
_COUNTED = 150_000  # distinct words a task holds before it hands them on
_BUFFERED = 1 << 18  # n-grams of one language and length a task holds before it sorts them
_HELD = 1 << 20  # counters a task holds before it hands them on
_MARK = 255  # a counter from here on is stored outside its byte

# Characters that end a piece.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TO_LINES = bytes.maketrans(_ENDS, b"\n" * len(_ENDS))
_FIRST, _SECOND = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd multipliers


def word_slices(text: bytes) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text in slices of bounded size; ``.`` stands between two pieces."""
    text = text.lower().translate(_TO_LINES)  # bytes: only A-Z change
    start = 0
    while start < len(text):
        end = start + _SLICE
        if end < len(text):
            stops = [at for at in (text.find(b" ", end), text.find(b"\n", end), text.find(b"\t", end)) if at >= 0]
            end = min(stops, default=len(text))
        yield text[start:end].replace(b"\n", b" . ").split()
        start = end


# ---- permutation and filter


def permute(keys: np.ndarray, bits: int) -> np.ndarray:
    """A bijection of the numbers below 2 ** bits."""
    mask, half = np.uint64((1 << bits) - 1), np.uint64((bits + 1) // 2)
    for factor in (_FIRST, _SECOND):
        keys = (keys * np.uint64(factor)) & mask
        keys = keys ^ (keys >> half)
    return keys


def restore(keys: np.ndarray, bits: int) -> np.ndarray:
    """The inverse of :func:`permute`."""
    mask, half = np.uint64((1 << bits) - 1), np.uint64((bits + 1) // 2)
    for factor in (_SECOND, _FIRST):
        keys = keys ^ (keys >> half)
        keys = (keys * np.uint64(pow(factor, -1, 1 << 64))) & mask
    return keys


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order and the sums of their counts."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    if counts is None:
        return keys[starts], np.diff(np.append(starts, len(keys)))
    return keys[starts], np.add.reduceat(counts, starts)


def write_filter(keys: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """A counting quotient filter of sorted distinct ``keys`` below 2 ** bits.

    One bit per quotient tells whether it is occupied, one bit per entry whether it ends the
    run of its quotient; remainders take the fewest whole bytes, counters one byte or, from
    255 on, eight more at the end.
    """
    n = len(keys)
    quotient_bits = min(bits, max(0, n.bit_length() - 1))
    remainder_bits = bits - quotient_bits
    width = (remainder_bits + 7) // 8
    quotients = (keys >> np.uint64(remainder_bits)).astype(np.int64) if remainder_bits < 64 else np.zeros(n, np.int64)
    occupied = np.zeros(1 << quotient_bits, bool)
    occupied[quotients] = True
    ends = np.append(quotients[1:] != quotients[:-1], True) if n else np.zeros(0, bool)
    remainders = (keys & np.uint64((1 << remainder_bits) - 1)).astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]
    small = np.minimum(counts, _MARK).astype(np.uint8)
    large = counts[counts >= _MARK].astype("<i8")
    parts = [np.array([n, bits], "<i8"), np.packbits(occupied), np.packbits(ends), remainders, small, large]
    return b"".join(np.ascontiguousarray(p).tobytes() for p in parts)


def read_filter(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a filter made by :func:`write_filter`."""
    n, bits = (int(v) for v in np.frombuffer(data, "<i8", 2))
    quotient_bits = min(bits, max(0, n.bit_length() - 1))
    remainder_bits = bits - quotient_bits
    width, at = (remainder_bits + 7) // 8, 16

    def take(size: int) -> np.ndarray:
        nonlocal at
        at += size
        return np.frombuffer(data, np.uint8, size, at - size)

    slots = 1 << quotient_bits
    occupied = np.unpackbits(take((slots + 7) // 8))[:slots]
    ends = np.unpackbits(take((n + 7) // 8))[:n]
    remainders = np.zeros((n, 8), np.uint8)
    remainders[:, :width] = take(n * width).reshape(n, width)
    counts = take(n).astype(np.int64)
    counts[counts == _MARK] = np.frombuffer(data, "<i8", -1, at)
    run = np.cumsum(ends) - ends  # the number of runs that ended before each entry
    quotients = np.flatnonzero(occupied).astype(np.uint64)[run] if n else np.zeros(0, np.uint64)
    keys = remainders.view("<u8").reshape(n)
    return (quotients << np.uint64(remainder_bits) if remainder_bits < 64 else np.uint64(0)) | keys, counts


def merged(filters: Iterator[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of filters over one range of keys; at most twice the result and one filter are held."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for data in filters:
        waiting.append(read_filter(data))
        held += len(waiting[-1][0])
        if held > max(len(keys), 1 << 18):
            keys, counts = counted(
                np.concatenate([keys, *(w[0] for w in waiting)]), np.concatenate([counts, *(w[1] for w in waiting)])
            )
            waiting, held = [], 0
    return counted(np.concatenate([keys, *(w[0] for w in waiting)]), np.concatenate([counts, *(w[1] for w in waiting)]))


# ---- counting in tasks


def _count_words(batches: Iterator[dict]) -> Iterator[dict]:
    held: dict[str, Counter] = {}

    def out() -> Iterator[dict]:
        for lang, counts in held.items():
            yield {"lang": [lang] * len(counts), "word": list(counts), "n": list(counts.values())}
        held.clear()

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
            counts = held.setdefault(lang, Counter())
            for words in word_slices(text.as_py()):
                counts.update(words)
            if sum(map(len, held.values())) > _COUNTED:
                yield from out()
    yield from out()


def _ids_of(text: bytes, ids: dict[bytes, int]) -> np.ndarray:
    found = [np.fromiter(map(ids.get, words, repeat(0)), np.uint64, len(words)) for words in word_slices(text)]
    return np.concatenate([*found, np.zeros(1, np.uint64)])


class _Shard:
    """What one task has counted for one language and one n."""

    def __init__(self, n: int, width: int, range_bits: int):
        self.n, self.width, self.range_bits = n, width, range_bits
        self.bits = n * width
        self.raw: list[np.ndarray] = []
        self.waiting = 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray) -> None:
        parts = [ids[k : len(ids) - self.n + 1 + k] for k in range(self.n)]
        real = np.logical_and.reduce([p > 0 for p in parts])
        packed = np.zeros(int(real.sum()), np.uint64)
        for part in parts:
            packed = (packed << np.uint64(self.width)) | part[real]
        self.raw.append(packed)
        self.waiting += len(packed)
        if self.waiting > max(_BUFFERED, len(self.keys) // 2):
            self.settle()

    def settle(self) -> None:
        if self.raw:
            keys, counts = counted(permute(np.concatenate(self.raw), self.bits))
            self.raw, self.waiting = [], 0
            self.keys, self.counts = counted(
                np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts])
            )

    def filters(self) -> Iterator[tuple[int, bytes]]:
        """(range, filter) for each range with an entry; the shard is empty afterwards."""
        self.settle()
        rest = self.bits - self.range_bits
        ranges = (self.keys >> np.uint64(rest)).astype(np.int64)
        present, starts = np.unique(ranges, return_index=True)
        ends = [*starts[1:], len(ranges)][: len(present)]
        for r, a, b in zip(present, starts, ends, strict=True):
            keys = self.keys[a:b] & np.uint64((1 << rest) - 1)
            yield int(r), write_filter(keys, self.counts[a:b], rest)
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)


def _plan(n: int, width: int, words: int) -> int:
    """Bits of the range number: as many as keep a range at ``RANGE_WORDS`` occurrences."""
    return min(max(0, (words // RANGE_WORDS).bit_length()), n * width - 1)


def _count_grams(docs: DataFrame, vocabulary: dict[str, list[bytes]], words: dict[str, int], longest: int, least: int) -> DataFrame:
    """(lang, n, packed, f) of every n-gram of frequent words with at least ``least`` occurrences."""
    spark = docs.sparkSession
    ship(spark)
    width = max((len(v) for v in vocabulary.values()), default=1).bit_length()
    plans = {(lang, n): _plan(n, width, words[lang]) for lang in vocabulary for n in range(2, longest + 1)}
    sent = spark.sparkContext.broadcast({lang: b"\n".join(v) for lang, v in vocabulary.items()})
    token = uuid.uuid4().hex  # workers outlive one call, and so does what they remember

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        held = remembered("collocations", dict)
        if held.get("of") != token:
            held.clear()
            held["ids"] = {lang: {w: i + 1 for i, w in enumerate(v.split(b"\n"))} for lang, v in sent.value.items()}
            held["of"] = token
        ids = held["ids"]
        shards: dict[tuple[str, int], _Shard] = {}

        def out() -> Iterator[dict]:
            for (lang, n), shard in shards.items():
                for r, data in shard.filters():
                    yield {"lang": [lang], "n": [n], "range": [r], "filter": [data]}

        for batch in batches:
            texts: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
                if lang in ids:
                    texts.setdefault(lang, []).append(_ids_of(text.as_py(), ids[lang]))
            for lang, found in texts.items():
                joined = np.concatenate(found)
                for n in range(2, longest + 1):
                    if (lang, n) not in shards:
                        shards[lang, n] = _Shard(n, width, plans[lang, n])
                    shards[lang, n].add(joined)
            if sum(len(s.keys) for s in shards.values()) > _HELD:
                yield from out()
        yield from out()

    def merge(table: pa.Table) -> pa.Table:
        lang, n, r = (table.column(c)[0].as_py() for c in ("lang", "n", "range"))
        keys, counts = merged(v.as_py() for v in table.column("filter"))
        often = counts >= least
        bits = n * width
        whole = keys[often] | np.uint64(r << (bits - plans[lang, n]))
        packed = restore(whole, bits).astype(np.int64)
        size = len(packed)
        return pa.table({
            "lang": pa.array([lang] * size, pa.string()), "n": pa.array([n] * size, pa.int32()),
            "packed": pa.array(packed), "f": pa.array(counts[often].astype(np.int64)),
        })

    filters = map_batches(docs, count, "lang string, n int, range bigint, filter binary")
    grams = filters.groupBy("lang", "n", "range").applyInArrow(merge, "lang string, n int, packed bigint, f bigint")
    mask = (1 << width) - 1
    parts = [
        F.expr(f"CASE WHEN n >= {k} THEN shiftrightunsigned(packed, (n - {k}) * {width}) & bigint({mask}) END")
        for k in range(1, longest + 1)
    ]
    return grams.select("lang", "n", F.array_compact(F.array(*parts)).alias("ids"), "f")


def _count_by_words(docs: DataFrame, longest: int, least: int) -> DataFrame:
    """The same counts by a grouping on the words themselves, for vocabularies beyond the bound."""
    lower = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pieces = docs.select("lang", F.explode(F.split(lower, r"[.,;:!?\x0A-\x0D]")).alias("piece"))
    words = pieces.select("lang", F.regexp_extract_all("piece", F.lit(r"([^\x20\x09]+)")).alias("words"))
    grams = [
        words.where(F.size("words") >= n).select(
            "lang",
            F.lit(n).alias("n"),
            F.explode(F.expr(f"transform(sequence(1, size(words) - {n - 1}), i -> slice(words, i, {n}))")).alias("words"),
        )
        for n in range(2, longest + 1)
    ]
    every = grams[0]
    for more in grams[1:]:
        every = every.unionAll(more)
    return every.groupBy("lang", "n", "words").agg(F.count("*").alias("f")).where(F.col("f") >= least)


def phrases(docs: DataFrame, *, lang: str = "lang", text: str = "text", longest: int = 3, least: int = 10, max_words: int = MAX_WORDS) -> DataFrame:
    """Counts of every phrase of 1 to ``longest`` words with at least ``least`` occurrences.

    Returns lang, n, words (array of strings), f, and total (all word occurrences of the
    language). Null languages count as ``und``, null texts as empty; repeated rows count as
    often as they occur; other columns are not read. Empty tables give no rows.
    """
    docs = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    per_task = map_batches(docs, _count_words, "lang string, word binary, n bigint")
    counts = per_task.where(F.col("word") != F.lit(b".")).groupBy("lang", "word").agg(F.sum("n").alias("f"))
    counts = stored(counts, "words")
    totals = {r["lang"]: r["total"] for r in counts.groupBy("lang").agg(F.sum("f").alias("total")).collect()}
    frequent = counts.where(F.col("f") >= least)
    size = frequent.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("word") + 1), F.lit(0)).alias("b")).first()
    single = frequent.select("lang", F.lit(1).alias("n"), F.array(F.col("word").cast("string")).alias("words"), "f")
    if size["n"] <= max_words and size["b"] <= MAX_BYTES:
        vocabulary: dict[str, list[bytes]] = {}
        for row in frequent.select("lang", "word").toLocalIterator():
            vocabulary.setdefault(row["lang"], []).append(bytes(row["word"]))
        for found in vocabulary.values():
            found.sort()
        grams = _count_grams(docs, vocabulary, totals, longest, least)
        grams = stored(_with_words(grams, vocabulary), "grams")
    else:
        grams = stored(_count_by_words(docs, longest, least), "grams")
    sums = counts.groupBy("lang").agg(F.sum("f").alias("total"))
    return single.unionByName(grams.select("lang", "n", "words", "f")).join(F.broadcast(sums), "lang")


def _with_words(grams: DataFrame, vocabulary: dict[str, list[bytes]]) -> DataFrame:
    """Ids back to words, by the table that gave them."""
    sent = grams.sparkSession.sparkContext.broadcast({lang: b"\n".join(v) for lang, v in vocabulary.items()})

    def name(batches: Iterator[dict]) -> Iterator[dict]:
        words = {lang: v.decode().split("\n") for lang, v in sent.value.items()}
        for batch in batches:
            langs = batch["lang"].to_pylist()
            found = [" ".join(words[lang][i - 1] for i in ids) for lang, ids in zip(langs, batch["ids"].to_pylist(), strict=True)]
            yield {"lang": batch["lang"], "n": batch["n"], "phrase": found, "f": batch["f"]}

    named = map_batches(grams, name, "lang string, n int, phrase string, f bigint")
    return named.select("lang", "n", F.split("phrase", " ").alias("words"), "f")


def collocations(docs: DataFrame, *, lang: str = "lang", text: str = "text", longest: int = 3, least: int = 10, keep: int | None = 2000, max_words: int = MAX_WORDS) -> DataFrame:
    """The phrases of 2 to ``longest`` words that hold together best, ranked per language.

    A phrase is cut after k words where floor(10^6 a a / (l r)) is lowest (ties: smallest k),
    with a, l, r the occurrences of the phrase and its two parts; that number is its score. A
    phrase inside a longer one with at least half its occurrences is left out. ``keep`` is the
    length of the report per language (None: all). Nulls, repeated rows and empty tables are
    as in :func:`phrases`. Returns lang, rank, phrase, a, l, r, n, score.

    Counts up to 10^15 are exact: the products are decimals of 38 digits.
    """
    every = phrases(docs, lang=lang, text=text, longest=longest, least=least, max_words=max_words)
    parts = every.select("lang", F.col("words").alias("part"), F.col("f").alias("part_f"))
    found = every.where("n >= 2").select("lang", "n", "words", F.col("f").alias("a"), "total")
    cut = found.select("*", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    left = parts.select("lang", F.col("part").alias("left"), F.col("part_f").alias("l"))
    right = parts.select("lang", F.col("part").alias("right"), F.col("part_f").alias("r"))
    cut = (
        cut.withColumn("left", F.slice("words", F.lit(1), F.col("k")))
        .withColumn("right", F.slice("words", F.col("k") + 1, F.col("n") - F.col("k")))
        .join(left, ["lang", "left"])
        .join(right, ["lang", "right"])
    )
    exact = "cast((cast(a AS decimal(15,0)) * cast(a AS decimal(15,0)) * cast(1000000 AS decimal(7,0))) div (cast(l AS decimal(15,0)) * cast(r AS decimal(15,0))) AS bigint)"
    scored = cut.withColumn("score", F.expr(exact))
    best = scored.groupBy("lang", "words").agg(
        F.first("a").alias("a"), F.first("total").alias("total"), F.min(F.struct("score", "k", "l", "r")).alias("cut")
    )
    # Every contiguous part of a phrase, with the most occurrences of a longer phrase around it.
    around = (
        found.where("n >= 3")
        .select("n", "words", "lang", "a", F.explode(F.sequence(F.lit(2), F.col("n") - 1)).alias("m"))
        .select("lang", "a", "m", "words", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("m") + 1)).alias("at"))
        .select("lang", F.slice("words", F.col("at"), F.col("m")).alias("words"), F.col("a").alias("longer"))
        .groupBy("lang", "words")
        .agg(F.max("longer").alias("longer"))
    )
    alone = best.join(around, ["lang", "words"], "left").where("longer IS NULL OR 2 * longer < a")
    ranked = alone.select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = ranked.withColumn("place", F.row_number().over(order))
    if keep is not None:
        ranked = ranked.where(F.col("place") <= keep)
    return ranked.select("lang", F.col("place").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle_sql(least: int = 10, keep: int = 2000) -> str:
    """DuckDB SQL for phrases of up to three words."""
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, 1 AS size, unnest(w) AS phrase FROM worded
  UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) FROM worded
  UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) FROM worded
), counts AS (
  SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang
), often AS (
  SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE f >= {least}
), cuts AS (
  SELECT lang, phrase, f AS a, 1 AS k, w[1] AS p, array_to_string(w[2:], ' ') AS q FROM often WHERE size >= 2
  UNION ALL SELECT lang, phrase, f, 2, w[1] || ' ' || w[2], w[3] FROM often WHERE size = 3
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r,
    ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.p JOIN counts y ON y.lang = c.lang AND y.phrase = c.q
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, phrase, max(f) AS longer FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, f FROM often WHERE size = 3
    UNION ALL SELECT lang, w[2] || ' ' || w[3], f FROM often WHERE size = 3) GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a
)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, t.n, score
FROM kept k JOIN totals t ON t.lang = k.lang
QUALIFY row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) <= {keep}
"""
