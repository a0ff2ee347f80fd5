"""Hierarchical packing of tokenised documents into sequences of several lengths.

Each task packs the documents of its own partition while it reads them, so ids never
cross a shuffle. Documents are gathered into pools of a bounded number of tokens:

1. Full windows of the longest tier are cut off long documents. The rest of a document
   is routed to the smallest tier that holds it.
2. Tier by tier, the longest first, every rest opens a window of its tier. Its gap is
   filled with the largest rests that fit, from shorter tiers, then by one cut: a rest
   gives just the missing ids and goes back to its tier with what is left.
3. Rests of the shortest tier share windows in the same way.
4. Windows go to step groups of equal token budget, the costliest first, each to the
   group with the least tokens so far (then the least attention cost).

What cannot fill a window waits for the next pool. At the end of a partition it becomes
sequences whose lengths are falling powers of two, so nothing is padded at all.
"""

from __future__ import annotations

import bisect
import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from censusloom.llm.common import map_batches, remembered

TIERS = (2048, 1024, 512, 256)
STEP_TOKENS = 16_384
POOL_TOKENS = 2_000_000
END_OF_TEXT = 1


def default_tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


class TokenIds:
    """Token ids of whole texts, as the tokenizers library gives them, as little-endian 32-bit bytes.

    A byte-level BPE file whose tokens come in the order of their merges says the same as a
    table of ranks; tiktoken encodes by such a table several times as fast, in time linear in
    the text, and nothing has to be remembered. Files of another kind, and texts that tiktoken
    refuses, are encoded by the library itself. A special token written in a text gets its own
    id, as in the library, unless ``special_tokens`` is off.
    """

    def __init__(self, path: str, special_tokens: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special_tokens
        self.allowed = "all" if special_tokens else set()
        self.ranked, self.ids = _ranked(json.loads(self.tokenizer.to_str()))

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.ranked is not None:
            try:
                return self.ids[self.ranked.encode(text, allowed_special=self.allowed, disallowed_special=())].tobytes()
            except (RuntimeError, ValueError):  # its pattern gave up
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _ranked(settings: dict) -> tuple[tiktoken.Encoding | None, np.ndarray | None]:
    """The same tokenizer by ranks, and the id of each rank; (None, None) where that is not sure."""
    model, cut = settings["model"], settings.get("pre_tokenizer") or {}
    vocabulary, added = model.get("vocab"), settings["added_tokens"]
    plain = (
        model["type"] == "BPE"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and settings.get("normalizer") is None
        and (cut.get("type"), cut.get("use_regex", True), cut.get("add_prefix_space")) == ("ByteLevel", True, False)
        and all(a["special"] and not (a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"]) for a in added)
    )
    if not plain:
        return None, None
    special = {a["content"]: a["id"] for a in added}
    tokens = sorted((i, t) for t, i in vocabulary.items() if t not in special)
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    merged = [vocabulary.get("".join(pair)) for pair in pairs]
    # The bytes first, then one token per merge, in the order of the merges.
    if [i for i, _ in tokens[256:]] != merged or any(len(t) != 1 for _, t in tokens[:256]):
        return None, None
    # Fixed rule of byte-level vocabularies: printable bytes stand for themselves, others for 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {bytes(byte_of[c] for c in token): rank for rank, (_, token) in enumerate(tokens)}
    ids = [i for i, _ in tokens] + list(special.values())
    names = {content: len(tokens) + k for k, content in enumerate(special)}
    ranked = tiktoken.Encoding("by ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=names)
    return ranked, np.array(ids, "<u4")


def _ids_of(path: str) -> TokenIds:
    """One tokenizer per Python worker."""
    return remembered(path, lambda: TokenIds(path))


class _Rest:
    """The ids of a document from ``start`` on that are not packed yet."""

    __slots__ = ("ident", "ids", "start", "total")

    def __init__(self, ident, ids: bytes, start: int, total: int):
        self.ident, self.ids, self.start, self.total = ident, ids, start, total

    def __len__(self) -> int:
        return self.total - self.start

    def take(self, length: int) -> tuple:
        """Cut ``length`` ids off the front: (id, start, length, bytes, document's tokens)."""
        piece = (self.ident, self.start, length, self.ids[4 * self.start : 4 * (self.start + length)], self.total)
        self.start += length
        return piece


class _Pool:
    """Rests ordered by length."""

    def __init__(self):
        self.lengths: list[int] = []
        self.rests: list[_Rest] = []

    def add(self, rest: _Rest) -> None:
        if len(rest):
            at = bisect.bisect_right(self.lengths, len(rest))
            self.lengths.insert(at, len(rest))
            self.rests.insert(at, rest)

    def pop(self, at: int = -1) -> _Rest:
        self.lengths.pop(at)
        return self.rests.pop(at)

    def tokens(self) -> int:
        return sum(self.lengths)

    def fitting(self, length: int) -> int:
        """Index of the largest rest of at most ``length`` ids, or -1."""
        return bisect.bisect_right(self.lengths, length) - 1


def _tier_of(length: int, tiers: tuple[int, ...]) -> int:
    return min(t for t in tiers if t >= length)


def _pack_pool(pool: _Pool, tiers: tuple[int, ...]) -> Iterator[tuple[int, list[tuple]]]:
    """Full windows (tier, pieces) until less than a window is left; ``pool`` keeps that."""
    left = pool.tokens()
    while pool.rests:
        tier = _tier_of(pool.lengths[-1], tiers)
        if left < tier:
            smaller = [t for t in tiers if t <= left]
            if not smaller:
                return
            tier = smaller[0]
        gap, pieces = tier, []
        while gap:
            at = pool.fitting(gap)
            if at >= 0:
                rest = pool.pop(at)
                gap -= len(rest)
                pieces.append(rest.take(len(rest)))
            else:  # only longer rests are left: cut the shortest of them
                rest = pool.pop(0)
                pieces.append(rest.take(gap))
                gap = 0
                pool.add(rest)
        left -= tier
        yield tier, pieces


def _in_steps(windows: list[tuple[int, list[tuple]]], step_tokens: int) -> list[tuple[int, int, list[tuple]]]:
    """(step, tier, pieces): steps of equal tokens and about equal attention cost."""
    steps = max(1, -(-sum(tier for tier, _ in windows) // step_tokens))
    heap = [(0, 0, step) for step in range(steps)]
    out = []
    for tier, pieces in sorted(windows, key=lambda w: (-w[0], -sum(p[2] ** 2 for p in w[1]))):
        tokens, cost, step = heapq.heappop(heap)
        heapq.heappush(heap, (tokens + tier, cost + sum(p[2] ** 2 for p in pieces), step))
        out.append((step, tier, pieces))
    return out


def pack_documents(
    documents: Iterator[tuple[object, bytes]],
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
    pool_tokens: int = POOL_TOKENS,
) -> Iterator[tuple[int, int, list[tuple]]]:
    """(step group, window length, pieces) for documents given as (id, ids as 32-bit bytes)."""
    longest, first_step = tiers[0], 0
    pool, windows, held = _Pool(), [], 0

    def flush() -> list[tuple[int, int, list[tuple]]]:
        nonlocal windows, first_step
        grouped = [(first_step + step, tier, pieces) for step, tier, pieces in _in_steps(windows, step_tokens)]
        first_step += max((step for step, _, _ in grouped), default=first_step - 1) - first_step + 1
        windows = []
        return grouped

    for ident, ids in documents:
        rest = _Rest(ident, ids, 0, len(ids) // 4)
        held += len(rest)
        while len(rest) >= longest:
            windows.append((longest, [rest.take(longest)]))
        pool.add(rest)
        if held >= pool_tokens:
            windows += _pack_pool(pool, tiers)
            yield from flush()
            held = pool.tokens()
    windows += _pack_pool(pool, tiers)
    # The last rests: sequences of falling powers of two, without padding.
    size = tiers[-1]
    while pool.rests:
        while size > pool.tokens():
            size //= 2
        windows += _pack_pool(pool, (longest, *(s for s in (size,) if s < longest)))
    yield from flush()


def pack(
    docs: DataFrame,
    ident: str = "doc_id",
    text: str = "text",
    tokenizer_path: str | None = None,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
    pool_tokens: int = POOL_TOKENS,
    end_id: int = END_OF_TEXT,
) -> DataFrame:
    """Pieces of packed sequences with their ids, one row per piece.

    A document is the ids of its whole text (null: empty; a special token written in the
    text has its own id) and ``end_id``; every id lies
    in exactly one piece. ``ids`` are little-endian unsigned 32-bit numbers. ``window``
    is the length of the sequence and always full. A repeated or null id is packed as a
    document of its own each time. An empty table gives no rows. Sequence and step
    numbers are unique, not gapless; they follow the partition of the input.
    """
    path = tokenizer_path or default_tokenizer()

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        base = TaskContext.get().partitionId() << 32
        ids_of, end = _ids_of(path), end_id.to_bytes(4, "little")

        def documents() -> Iterator[tuple[object, bytes]]:
            for batch in batches:
                for d, text in zip(batch["ident"].to_pylist(), batch["text"], strict=True):
                    yield d, ids_of(text.as_py()) + end

        names = ("ident", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "window", "step_group")
        rows: list[tuple] = []
        for number, (step, window, pieces) in enumerate(pack_documents(documents(), tiers, step_tokens, pool_tokens)):
            offset = 0
            for piece in pieces:
                rows.append((*piece, base + number, offset, window, base + step))
                offset += piece[2]
            if len(rows) >= 4_000:
                yield dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))
                rows = []
        if rows:
            yield dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

    slim = docs.selectExpr(f"`{ident}` AS ident", f"`{text}` AS text")
    schema = (
        "ident bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, "
        "offset bigint, window int, step_group bigint"
    )
    return map_batches(slim, run, schema).withColumnRenamed("ident", ident)
