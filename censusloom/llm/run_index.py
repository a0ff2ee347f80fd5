"""Removal of repeated passages with run-compressed suffix indexes.

A byte goes if a ``LENGTH``-byte string that covers it also starts earlier: in a document
of smaller id, or earlier in the same document.

1. *Segments.* The window of ``LENGTH`` bytes at each position is named by the least hash
   among its ``GRAM``-byte grams, the leftmost on ties. Equal windows have the same least
   gram at the same place, so only segments (the windows next to each other that share
   one least gram) with the same gram can hold equal windows. Segments that are equal as
   a whole are collapsed, first inside each batch, then by a shuffle on the gram: all but
   the earliest are removed, and grams with a single kind of segment need nothing more.
2. *Index.* Different segments of one gram meet in one task, many grams at a time. Their
   text, in document order, gets a suffix array and a Burrows-Wheeler transform in runs.
   Matching statistics (how long each suffix agrees with the one sorted before it) are
   computed at the run heads only and streamed from there: inside a run the next suffix
   agrees with the same neighbour one byte less. Suffixes linked by matches of ``LENGTH``
   or more are copies; all but the earliest are removed.
3. *Hot grams.* A gram with more than ``HOT_SEGMENTS`` different segments would be too much
   for one task. Its windows are shuffled one by one on their own 128-bit hash, after
   equal ones of a batch are collapsed, so no window's copies meet in large numbers.
4. *Texts.* The removed spans are joined back to the documents and cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from censusloom.llm.common import change_batches, free_name, map_batches, replace_texts, stored, with_key

LENGTH = 100
GRAM = 32
HOT_SEGMENTS = 20_000
INDEX_BYTES = 500_000  # a task's memory grows with this, or with the largest gram that is not hot
_BLOCK = 1 << 19  # windows of a long text are named block by block
_LOW = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_SEPARATOR = 0xFF  # not a byte of UTF-8

# Rows of both shuffles: segments or windows by hash, or spans that are already removed.
_OPEN, _SPAN = 0, 1


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hash of the GRAM bytes at each position, by doubling."""
    size, found, factor = 1, data.astype(np.uint64) + np.uint64(1), _BASE
    with np.errstate(over="ignore"):
        while size < GRAM:
            found = found[:-size] * np.uint64(factor) + found[size:]
            size, factor = 2 * size, factor * factor % 2**64
        found ^= found >> np.uint64(30)
        found *= _MIX[0]
        found ^= found >> np.uint64(27)
        found *= _MIX[1]
        found ^= found >> np.uint64(31)
    return found


def segments(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, place of the gram, hash of the gram) of each segment of a text."""
    windows = len(data) - length + 1
    if windows <= 0:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    span = length - GRAM + 1  # grams in a window
    parts = []
    for start in range(0, windows, _BLOCK):
        stop = min(windows, start + _BLOCK)
        hashes = _gram_hashes(data[start : stop + length - 1])
        least = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = span - width
        if rest:
            least = np.minimum(least[:-rest], least[rest:])
        place = (least & _LOW).astype(np.int64)
        change = np.flatnonzero(place[1:] != place[:-1]) + 1
        first = np.r_[0, change]
        last = np.r_[change, len(place)] - 1
        parts.append((first + start, last + start, place[first] + start, hashes[place[first]]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _merged(keys: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join spans of equal length class that overlap or touch; both ends rise with the start."""
    by = np.lexsort((starts, keys))
    keys, starts, stops = keys[by], starts[by], stops[by]
    fresh = np.r_[True, (keys[1:] != keys[:-1]) | (starts[1:] > stops[:-1])]
    last = np.r_[np.flatnonzero(fresh)[1:] - 1, len(keys) - 1]
    return keys[fresh], starts[fresh], stops[last]


def _first_of(keys: np.ndarray, starts: np.ndarray, *names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (names, key, start), and whether a row in that order is the first of its name."""
    by = np.lexsort((starts, keys, *reversed(names)))
    fresh = np.zeros(len(by), bool)
    if len(by):
        fresh[0] = True
        for name in names:
            ordered = name[by]
            fresh[1:] |= ordered[1:] != ordered[:-1]
    return by, fresh


def _rows(
    kind: int, gram: np.ndarray, body: np.ndarray, keys: np.ndarray, starts: np.ndarray, sizes: np.ndarray
) -> dict[str, np.ndarray]:
    return {
        "kind": np.full(len(keys), kind, np.int32), "gram": gram, "body": body, "key": keys, "start": starts,
        "size": sizes,
    }


def _with_removed(rows: dict[str, np.ndarray], keys, starts, stops) -> dict[str, np.ndarray]:
    """Add removed spans to open rows; they are dealt out by their own key."""
    if not len(keys):
        return rows
    keys, starts, stops = _merged(keys, starts, stops)
    spans = _rows(_SPAN, keys, starts, keys, starts, stops - starts)
    return {name: np.concatenate([rows[name], spans[name]]) for name in rows}


def _arrow(rows: dict[str, np.ndarray]) -> dict:
    return {name: pa.array(values) for name, values in rows.items()}


def _name_segments(batches: Iterator[dict]) -> Iterator[dict]:
    """Segments of whole texts, equal ones of a batch collapsed to the earliest."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        keys, firsts, lasts, grams, bodies = [], [], [], [], []
        for key, text in zip(batch["key"].to_pylist(), batch["text"], strict=True):
            data = (text.as_py() or "").encode()
            if len(data) < LENGTH:
                continue
            first, last, place, gram = segments(np.frombuffer(data, np.uint8))
            keys.append(np.full(len(first), key, np.int64))
            firsts.append(first)
            lasts.append(last)
            grams.append(gram)
            bodies += [
                digest(data[a:b], o)
                for a, b, o in zip(first.tolist(), (last + LENGTH).tolist(), (place - first).tolist(), strict=True)
            ]
        if not keys:
            continue
        key, start, stop = np.concatenate(keys), np.concatenate(firsts), np.concatenate(lasts) + LENGTH
        gram, body = np.concatenate(grams).view(np.int64), np.array(bodies, np.uint64).view(np.int64)
        by, fresh = _first_of(key, start, gram, body)
        kept, gone = by[fresh], by[~fresh]
        rows = _rows(_OPEN, gram[kept], body[kept], key[kept], start[kept], (stop - start)[kept])
        yield _arrow(_with_removed(rows, key[gone], start[gone], stop[gone]))


def _columns(batch: dict, names: tuple[str, ...]) -> list[np.ndarray]:
    return [batch[name].to_numpy() for name in names]


def _collapse(batches: Iterator[dict]) -> Iterator[dict]:
    """Rows sorted by (kind, gram, body, key, start) -> removed spans, and what needs an index.

    The earliest row of each (gram, body) stays; it is open if its gram has another body.
    Only one row is held back between batches, whatever the size of a group.
    """
    names = ("kind", "gram", "body", "key", "start", "size")
    held: list | None = None  # the first row of the last gram, and whether it was passed on
    last: tuple | None = None  # gram and body of the last row
    for batch in batches:
        kind, gram, body, key, start, size = _columns(batch, names)
        spans = kind == _SPAN
        done = _rows(_SPAN, gram[spans], body[spans], key[spans], start[spans], size[spans])
        if not spans.all():
            gram, body, key, start, size = (x[~spans] for x in (gram, body, key, start, size))
            new_gram = np.r_[last is None or gram[0] != last[0], gram[1:] != gram[:-1]]
            new_body = new_gram | np.r_[last is None or body[0] != last[1], body[1:] != body[:-1]]
            gone = ~new_body
            other = new_body & ~new_gram  # the gram has had a different body before: open
            group = np.cumsum(new_gram)
            several = np.zeros(group[-1] + 1, bool)
            several[group[other]] = True
            is_open = new_body & several[group]
            out = _rows(_OPEN, gram[is_open], body[is_open], key[is_open], start[is_open], size[is_open])
            if held is not None and several[0]:
                out = {n: np.r_[np.array([v], out[n].dtype), out[n]] for n, v in zip(names, held, strict=True)}
                held = None
            if new_gram.any():
                at = np.flatnonzero(new_gram)[-1]
                held = None if several[group[at]] else [_OPEN, gram[at], body[at], key[at], start[at], size[at]]
            last = (gram[-1], body[-1])
            removed = _rows(_SPAN, gram[gone], body[gone], key[gone], start[gone], size[gone])
            done = {n: np.concatenate([done[n], out[n], removed[n]]) for n in names}
        yield _arrow(done)


def _places(size: int) -> type:
    """The smallest integers that count the places of a text and one more."""
    return np.int32 if size < 2**31 - 1 else np.int64


def _bytes_left(ends: np.ndarray, size: int) -> np.ndarray:
    """Bytes from each place of a text to the next separator, at ``ends``."""
    kind = _places(size)
    left = np.repeat(ends.astype(kind), np.diff(ends, prepend=-1))
    left -= np.arange(size, dtype=kind)
    return left


def suffix_array(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``text``; each ends at the next separator, at ``ends``.

    Separators are larger than all bytes and rise with their place.
    """
    size = len(text)
    kind = _places(size)
    left = _bytes_left(ends, size)
    padded = np.r_[text, np.full(8, _SEPARATOR, np.uint8)]
    key = np.zeros(size, np.uint64)
    for at in range(8):
        key <<= np.uint64(8)
        key |= np.where(at <= left, padded[at : at + size], np.uint8(_SEPARATOR))
    length = 8
    rank = np.empty(size, kind)

    def sort(key: np.ndarray) -> tuple[np.ndarray, int]:
        """The order of the keys, whose places become the ranks; and the largest rank."""
        order = np.argsort(key, kind="stable").astype(kind)
        key = key[order]
        step = np.zeros(size, kind)
        np.cumsum(key[1:] != key[:-1], out=step[1:])
        rank[order] = step
        return order, int(step[-1])

    order, most = sort(key)
    longest = int(left.max(initial=0)) + 1
    while length < longest and most < size - 1:
        # Beyond its separator a suffix has nothing to compare: ties keep the order of places.
        key = rank.astype(np.int64)
        key *= size + 1
        more = np.flatnonzero(left >= length)
        key[more] += rank[more + length] + kind(1)
        del more
        order, most = sort(key)
        length *= 2
    return order


def run_heads(text: np.ndarray, order: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Rows of the Burrows-Wheeler transform where a run of equal bytes begins.

    A suffix at the begin of a segment follows a separator, which is a run of its own.
    """
    before = text[order - 1].astype(np.int16)
    at_begin = np.zeros(len(text), bool)
    at_begin[begins] = True
    before[at_begin[order]] = -1
    head = np.ones(len(order), bool)
    head[1:] = (before[1:] != before[:-1]) | (before[1:] < 0)
    return np.flatnonzero(head)


def matching_statistics(text: np.ndarray, ends: np.ndarray, order: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """For each suffix, how many bytes it shares with the suffix sorted before it.

    Counted at the heads of runs; other suffixes agree one byte less than the suffix one
    byte to their left, as both neighbours moved along the same run.
    """
    size, kind = len(text), _places(len(text))
    here, before = order[heads], order[np.maximum(heads - 1, 0)]
    left = _bytes_left(ends, size)
    most = np.minimum(left[here], left[before])
    del left
    most[heads == 0] = 0
    shared = np.zeros(len(heads), kind)
    padded = np.r_[text, np.full(8, _SEPARATOR, np.uint8)]
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    alive = np.flatnonzero(most > 0)
    while len(alive):
        a = words[here[alive] + shared[alive]]
        b = words[before[alive] + shared[alive]]
        same = np.logical_and.accumulate(a == b, axis=1).sum(axis=1, dtype=kind)
        shared[alive] += same
        alive = alive[(same == 8) & (shared[alive] < most[alive])]
    # At a head the shared bytes plus its place; what follows up to the next head has the same sum.
    heads_at = np.sort(here)
    sums = np.empty(size, kind)
    sums[here] = np.minimum(shared, most) + here
    found = np.repeat(sums[heads_at], np.diff(heads_at, append=size))
    found -= np.arange(size, dtype=kind)
    return np.maximum(found, kind(0), out=found)


def repeated_windows(pieces: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(piece, offset) of every window that also starts earlier; pieces are in document order."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    separator = bytes([_SEPARATOR])
    text = np.frombuffer(separator.join(pieces) + separator, np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    order = suffix_array(text, ends)
    shared = matching_statistics(text, ends, order, run_heads(text, order, begins))
    linked = shared[order] >= length
    copies = np.cumsum(~linked)
    earliest = np.minimum.reduceat(order, np.flatnonzero(~linked))
    gone = np.sort(order[order != earliest[copies - 1]])
    # A suffix alone among its copies is its own earliest, so only copies are left here.
    piece = np.searchsorted(ends, gone)
    return piece, gone - begins[piece]


def _index(batches: Iterator[dict]) -> Iterator[dict]:
    """Rows sorted by (kind, gram, body, key, start) -> removed spans (key, start, size)."""
    held: list[tuple] = []  # rows of whole grams
    group: list[tuple] = []  # rows of the gram being read
    held_bytes = group_bytes = 0
    window: tuple | None = None

    def removed(rows: list[tuple]) -> dict:
        rows = sorted(rows, key=lambda r: (r[1], r[2]))
        piece, offset = repeated_windows([r[3] for r in rows])
        keys = np.array([r[1] for r in rows], np.int64)[piece]
        starts = np.array([r[2] for r in rows], np.int64)[piece] + offset
        keys, starts, stops = _merged(keys, starts, starts + LENGTH) if len(keys) else (keys, starts, starts)
        return _arrow({"key": keys, "start": starts, "size": stops - starts})

    for batch in batches:
        kinds, grams, bodies, keys, starts, sizes = (
            batch[n].to_pylist() for n in ("kind", "gram", "body", "key", "start", "size")
        )
        spans: list[tuple] = []
        for at, (kind, gram, body, key, start, size) in enumerate(
            zip(kinds, grams, bodies, keys, starts, sizes, strict=True)
        ):
            if kind == _SPAN:
                spans.append((key, start, size))
                continue
            data = batch["bytes"][at].as_py()
            if not data:  # a window by its hash: the first of them is the earliest
                if window == (gram, body):
                    spans.append((key, start, size))
                window = (gram, body)
                continue
            if group and group[-1][0] != gram:
                if held and held_bytes + group_bytes > INDEX_BYTES:
                    yield removed(held)
                    held, held_bytes = [], 0
                held += group
                held_bytes += group_bytes
                group, group_bytes = [], 0
            group.append((gram, key, start, data))
            group_bytes += len(data)
        if spans:
            yield dict(zip(("key", "start", "size"), map(list, zip(*spans, strict=True)), strict=True))
    for rows in (held, group) if held_bytes + group_bytes > INDEX_BYTES else (held + group,):
        if rows:
            yield removed(rows)


def _extract(batches: Iterator[dict]) -> Iterator[dict]:
    """Bytes of open segments; for hot grams the hash of each window, equal ones of a batch collapsed."""
    import xxhash

    for batch in batches:
        rows: list[tuple] = []
        keys, starts, hashes = [], [], []
        for key, text, parts in zip(batch["key"].to_pylist(), batch["text"], batch["parts"].to_pylist(), strict=True):
            data = text.as_py().encode()
            for at in range(0, len(parts), 4):
                start, size, gram, hot = parts[at : at + 4]
                if not hot:
                    rows.append((_OPEN, gram, 0, key, start, size, data[start : start + size]))
                    continue
                for place in range(start, start + size - LENGTH + 1):
                    keys.append(key)
                    starts.append(place)
                    hashes.append(xxhash.xxh3_128_digest(data[place : place + LENGTH]))
        if keys:
            key, start = np.array(keys, np.int64), np.array(starts, np.int64)
            gram, body = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2).T
            by, fresh = _first_of(key, start, gram, body)
            kept, gone = by[fresh], by[~fresh]
            found = _rows(_OPEN, gram[kept], body[kept], key[kept], start[kept], np.full(len(kept), LENGTH))
            found = _with_removed(found, key[gone], start[gone], start[gone] + LENGTH)
            yield _arrow(found) | {"bytes": pa.array([b""] * len(found["key"]), pa.binary())}
        if rows:
            names = ("kind", "gram", "body", "key", "start", "size", "bytes")
            yield dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))


_ROW = "kind int, gram bigint, body bigint, key bigint, start bigint, size bigint"
_ORDER = ("kind", "gram", "body", "key", "start")


def removed_spans(keyed: DataFrame, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """(key, start, size) of spans to remove, unmerged, for unique keys that give the order."""
    named = map_batches(keyed.select("key", "text"), _name_segments, _ROW)
    dealt = named.repartition("gram").sortWithinPartitions(*_ORDER)
    collapsed = stored(map_batches(dealt, _collapse, _ROW), "segments")

    waiting = collapsed.where(F.col("kind") == _OPEN).select("gram", "key", "start", "size")
    # At most one hot gram for each ``hot_segments`` open segments: small enough to broadcast.
    hot = waiting.groupBy("gram").count().where(F.col("count") > hot_segments).select("gram", F.lit(1).alias("_hot"))
    marked = waiting.join(F.broadcast(hot), "gram", "left")
    part = F.array("start", "size", "gram", F.coalesce("_hot", F.lit(0)).cast("bigint"))
    parts = marked.groupBy("key").agg(F.flatten(F.collect_list(part)).alias("parts"))
    texts = keyed.select("key", "text").join(parts, "key")
    opened = map_batches(texts.select("key", "text", "parts"), _extract, _ROW + ", bytes binary")
    sorted_rows = opened.repartition("gram").sortWithinPartitions(*_ORDER)
    indexed = map_batches(sorted_rows, _index, "key bigint, start bigint, size bigint")
    spans = collapsed.where(F.col("kind") == _SPAN).select("key", "start", "size")
    return stored(spans.unionByName(indexed), "spans")


def _cut(batches: Iterator[dict]) -> Iterator[dict]:
    for batch in batches:
        out: dict[str, list] = {n: [] for n in ("n_bytes", "starts", "stops", "kept")}
        for text, spans in zip(batch["text"], batch["spans"].to_pylist(), strict=True):
            data = (text.as_py() or "").encode()
            starts: list[int] = []
            stops: list[int] = []
            pairs = sorted(zip(spans[::2], spans[1::2], strict=True)) if spans else ()
            for start, size in pairs:
                if starts and start <= stops[-1]:
                    stops[-1] = max(stops[-1], start + size)
                else:
                    starts.append(start)
                    stops.append(start + size)
            kept = b"".join(data[a:b] for a, b in zip([0, *stops], [*starts, len(data)], strict=True))
            for name, value in zip(out, (len(data), starts, stops, kept), strict=True):
                out[name].append(value)
        yield out | {"key": batch["key"]}


def _spans_by_key(plain: DataFrame, hot_segments: int) -> DataFrame:
    """(key, spans): the removed spans of each text that loses some, as start, size, start, size ..."""
    spans = removed_spans(plain, hot_segments)
    return spans.groupBy("key").agg(F.flatten(F.collect_list(F.array("start", "size"))).alias("spans"))


def cut_keyed(plain: DataFrame, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """(key, n_bytes, starts, stops, kept) for (key, text) with unique long keys that give the order."""
    schema = "key bigint, n_bytes bigint, starts array<bigint>, stops array<bigint>, kept binary"
    met = plain.select("key", "text").join(_spans_by_key(plain, hot_segments), "key", "left")
    return map_batches(met.select("key", "text", "spans"), _cut, schema)


def remove_repeats(
    docs: DataFrame, ident: str = "doc_id", text: str = "text", hot_segments: int = HOT_SEGMENTS
) -> DataFrame:
    """(id, n_bytes, starts, stops, kept): removed byte spans and the bytes left of each text.

    Spans are maximal. Null and empty texts have no bytes and lose none; nor do texts of
    fewer than ``LENGTH`` bytes. Rows that repeat an id are ordered by their texts, and
    the later one repeats the earlier. An empty table gives no rows.
    """
    slim = docs.select(F.col(ident).alias("ident"), F.col(text).alias("text"))
    keyed, odd = with_key(slim, "ident", "text", "key")
    found = cut_keyed(keyed.select("key", "text"), hot_segments)
    if not odd:
        return found.withColumnRenamed("key", ident)
    return found.join(keyed.select("key", "ident"), "key").drop("key").withColumnRenamed("ident", ident)


def _shortened(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Documents whose last column has their spans -> documents with the whole characters that are left."""
    docs = batch.select(batch.schema.names[:-1])
    texts = docs.column("text")
    (cut,) = _cut(iter([{"key": texts, "text": texts, "spans": batch.column(batch.num_columns - 1)}]))
    changed = [bool(starts) for starts in cut["starts"]]
    left = [
        kept.decode("utf-8", "ignore") if new else text
        for kept, text, new in zip(cut["kept"], texts.to_pylist(), changed, strict=True)
    ]
    return replace_texts(docs, left, changed)


def without_repeats(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, with repeated passages cut out of ``text`` (and ``n_chars`` to match).

    A character that loses some of its bytes goes as a whole. Texts that nothing was cut
    from stay as they are; those that lose everything become empty.
    """
    key, gone = free_name(docs, "_key"), free_name(docs, "_gone")
    keyed, _ = with_key(docs, "doc_id", "text", key)
    spans = _spans_by_key(keyed.select(F.col(key).alias("key"), "text"), HOT_SEGMENTS)
    # Whole documents meet their spans and are cut on the spot, so texts are not joined back to them.
    met = keyed.join(spans.withColumnsRenamed({"key": key, "spans": gone}), key, "left").drop(key)
    return change_batches(met, _shortened, docs.schema)


def digests(docs: DataFrame) -> DataFrame:
    """Counts and the digest of what is left of each document."""
    found = remove_repeats(docs)
    removed = F.aggregate(
        F.zip_with("starts", "stops", lambda a, b: b - a), F.lit(0).cast("bigint"), lambda total, x: total + x
    )
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("starts").cast("bigint").alias("n_spans"),
        F.sha2(F.col("kept"), 256).alias("kept_sha256"),
    )
