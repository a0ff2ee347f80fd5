"""Byte-level BPE by longest matches and adjacent-token compatibility.

A piece of text is a string of bytes; mapped to Latin-1 it is a Python string with one
character per byte, so one Aho-Corasick automaton over the vocabulary finds every token
at every position in one pass. The encoder takes the longest token whose neighbour on
the left is *compatible* with it, and goes back a token when nothing fits.

Two adjacent tokens are compatible when the merges, run on their bytes alone, end in
just these two. A merge has a higher rank than both of its parts, so merges happen in
the order of their ranks, and each part of a token lives from its own rank to the rank
of the merge that consumes it. A merge across the border happens exactly if its two
parts are alive together when its rank comes up; among equal ranks the leftmost is first.
A sequence whose neighbours are all compatible is the sequence that the merges give, so
the result equals the exact merges. A position from which the text cannot be finished is
remembered, hence each position fails once and the work is linear in the bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from censusloom.llm.common import map_batches, remembered

_NEVER = 1 << 62


def default_ranks() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class _Memo(dict):
    """A dict that computes missing values and starts anew when it is full."""

    def __init__(self, compute, limit: int):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value


class ByteBpe:
    """Encoder and decoder for one rank file; ``memo_entries`` bounds each of its caches."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo_entries: int = 600_000):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.lengths = {rank: len(token) for token, rank in ranks.items()}
        #: The longest token that is a proper prefix of each token, or -1.
        self.shorter = {
            rank: next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in ranks), -1)
            for token, rank in ranks.items()
        }
        self.pattern = regex.compile(pattern)
        #: Whether the pattern takes letters after at most one space as one match.
        self.letters_match = r" ?\p{L}+" in pattern.split("|")
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token) - 1))
        self.automaton.make_automaton()
        self._spines = _Memo(self._spine, 2 * len(ranks))
        self._compatible = _Memo(self._check, memo_entries // 2)
        self._first = _Memo(lambda chunk: self._chunk(chunk, ""), memo_entries // 8)
        self._spaced = _Memo(lambda chunk: self._chunk(chunk, " "), memo_entries)
        self._piece = _Memo(self._piece_text, memo_entries // 8)
        self._texts = {rank: f" {rank}" for rank in self.tokens}
        self._by_text = {str(rank): token for token, rank in ranks.items()}

    # Compatibility of neighbours

    def _halves(self, token: bytes) -> tuple[bytes, bytes]:
        """The two parts whose merge makes ``token``: merge its bytes by all lower ranks."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
            if rank == _NEVER:
                raise ValueError(f"token {token!r} cannot be made by merges")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts[0], parts[1]

    def _spine(self, key: tuple[int, bool]) -> list[tuple[bytes, int]]:
        """Parts of a token at its right (True) or left edge, each with the rank that consumes it."""
        rank, right = key
        part, end, spine = self.tokens[rank], _NEVER, []
        while True:
            spine.append((part, end))
            if len(part) == 1:
                return spine
            end = self.ranks[part]
            part = self._halves(part)[right]

    def _check(self, pair: tuple[int, int]) -> bool:
        starts = self._spines[pair[1], False]
        for left, left_end in self._spines[pair[0], True]:
            for right, right_end in starts:
                merge = self.ranks.get(left + right)
                if merge is not None and merge < left_end and merge <= right_end:
                    return False
        return True

    # Encoding

    def encode_piece(self, piece: bytes) -> list[int]:
        """Token ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size, lengths, compatible = len(piece), self.lengths, self._compatible
        # The longest token from each byte on: matches come by their ends, so it is the last.
        longest = [0] * size
        for end, (rank, back) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - back] = rank
        dead = bytearray(size + 1)
        out: list[int] = []
        at, rank = 0, longest[0]
        while True:
            stop = at + lengths[rank]
            if not dead[stop] and (not out or compatible[out[-1], rank]):
                out.append(rank)
                if stop == size:
                    return out
                at, rank = stop, longest[stop]
                continue
            rank = self.shorter[rank]
            while rank < 0:  # nothing fits here: give up this position and shorten the token before
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                dead[at] = 1
                last = out.pop()
                at, rank = at - lengths[last], self.shorter[last]

    def _chunk(self, body: str, space: str) -> str | None:
        """Ids of a chunk after ``space``, each after a space; None if it is not safe by itself.

        The pattern always starts a match at a space that follows and precedes something
        other than white space, so chunks cut there may be encoded separately.
        """
        if body.isalpha() and self.letters_match:
            return self._piece_text(space + body)
        if not body or body[0].isspace() or body[-1].isspace():
            return None
        return "".join(map(self._piece_text, self.pattern.findall(space + body)))

    def _piece_text(self, piece: str) -> str:
        texts = self._texts
        return "".join([texts[rank] for rank in self.encode_piece(piece.encode())])

    def id_text(self, text: str) -> str:
        """The ids in decimal, each after one space."""
        if not text:
            return ""
        chunks = text.split(" ")
        try:
            return self._first[chunks[0]] + "".join(map(self._spaced.__getitem__, chunks[1:]))
        except TypeError:  # some chunk needs its surroundings
            return "".join(map(self._piece.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str | None) -> list[int]:
        return list(map(int, self.id_text(text or "").split()))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode_text(self, id_text: str) -> bytes:
        """Bytes of ids written in decimal and separated by spaces."""
        return b"".join(map(self._by_text.__getitem__, id_text.split()))


def encoder(ranks_path: str, pattern: str = public_tokenizers.PATTERN) -> ByteBpe:
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return ByteBpe(ranks, pattern)


def _own_encoder(ranks_path: str) -> ByteBpe:
    """One encoder per Python worker, so that its memos serve all tasks of the worker."""
    return remembered(ranks_path, lambda: encoder(ranks_path))


def encode(docs: DataFrame, ident: str = "doc_id", text: str = "text", ranks_path: str | None = None) -> DataFrame:
    """``ident`` and ``ids``, the token ids of the whole text (null and empty text: no ids).

    Keeps one row per input row, repeated or null ids included; other columns are not read.
    """
    path = ranks_path or default_ranks()

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        bpe = _own_encoder(path)
        for batch in batches:
            yield {"ident": batch["ident"], "ids": [bpe.encode(t) for t in batch["text"].to_pylist()]}

    slim = docs.selectExpr(f"`{ident}` AS ident", f"`{text}` AS text")
    return map_batches(slim, run, "ident bigint, ids array<int>").withColumnRenamed("ident", ident)


def decode(encoded: DataFrame, ident: str = "doc_id", ids: str = "ids", ranks_path: str | None = None) -> DataFrame:
    """``ident`` and ``decoded``, the bytes of the token ids (null ids: no bytes)."""
    path = ranks_path or default_ranks()

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        bpe = _own_encoder(path)
        for batch in batches:
            yield {"ident": batch["ident"], "decoded": [bpe.decode(x or ()) for x in batch["ids"].to_pylist()]}

    slim = encoded.selectExpr(f"`{ident}` AS ident", f"`{ids}` AS ids")
    return map_batches(slim, run, "ident bigint, decoded binary").withColumnRenamed("ident", ident)


def round_trip_digests(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """Digests of the ids of each text and of the bytes that decoding these ids gives."""
    path = ranks_path or default_ranks()

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        bpe = _own_encoder(path)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for text in batch["text"]:
                id_text = bpe.id_text(text.as_py() or "")
                counts.append(id_text.count(" "))
                ids.append(hashlib.sha256(id_text[1:].encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode_text(id_text)).hexdigest())
            yield {"doc_id": batch["doc_id"], "n_tokens": counts, "ids_sha256": ids, "decoded_sha256": decoded}

    return map_batches(
        docs.select("doc_id", "text"), run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
