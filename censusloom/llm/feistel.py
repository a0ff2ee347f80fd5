"""Pseudonyms for personal data that keep the format: a keyed permutation of each format.

A recognised value is read as a number below the size of its format, permuted by a
Feistel network over that range, and written back in the same format with its own check
digits. The permutation depends on the key and the format only, so equal values get
equal pseudonyms in all documents, different values different ones, and the holder of
the key can undo it. Nothing is looked up or shuffled.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from censusloom.llm.common import change_batches, map_batches, replace_texts

ROUNDS = 10
# Replace it by a secret of your own; whoever has it can undo the pseudonyms.
EXAMPLE_KEY = b"an example key, not a secret"

_DIGITS = "0123456789"
_LOWER = "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
_HEX = _DIGITS + "abcdef"
_FIRST_DAY, _LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()


class Feistel:
    """Keyed permutations of ranges; ``undo`` inverts them."""

    def __init__(self, key: bytes, rounds: int = ROUNDS):
        self.key, self.rounds = hashlib.sha256(key).digest(), rounds

    def _mix(self, tweak: str, step: int, value: int, below: int) -> int:
        width = (below.bit_length() + 7) // 8 + 16  # 16 bytes more: hardly any bias
        text = b"%b|%d|%d" % (tweak.encode(), step, value)
        out = b""
        while len(out) < width:
            out += hashlib.blake2b(text + b"|%d" % len(out), key=self.key).digest()
        return int.from_bytes(out[:width], "big") % below

    def _network(self, value: int, left: int, right: int, tweak: str, undo: bool) -> int:
        a, b = divmod(value, right)
        for step in reversed(range(self.rounds)) if undo else range(self.rounds):
            sign = -1 if undo else 1
            if step % 2 == 0:
                a = (a + sign * self._mix(tweak, step, b, left)) % left
            else:
                b = (b + sign * self._mix(tweak, step, a, right)) % right
        return a * right + b

    def permute(
        self, value: int, size: int, tweak: str, allowed: Callable[[int], bool] | None = None, undo: bool = False
    ) -> int:
        """Image of ``value`` in the permutation of the ``allowed`` numbers below ``size``."""
        if size < 2:
            return value
        left = math.isqrt(size - 1) + 1
        right = -(-size // left)
        tweak = f"{tweak}|{size}"
        while True:  # walk the cycle of the larger range until it is back inside
            value = self._network(value, left, right, tweak, undo)
            if value < size and (allowed is None or allowed(value)):
                return value


def _read(symbols: Sequence[str], alphabets: Sequence[str]) -> tuple[int, int]:
    """Mixed-radix number of the symbols, and how many such numbers there are."""
    value, size = 0, 1
    for symbol, alphabet in zip(symbols, alphabets, strict=True):
        value, size = value * len(alphabet) + alphabet.index(symbol), size * len(alphabet)
    return value, size


def _write(value: int, alphabets: Sequence[str]) -> str:
    out = []
    for alphabet in reversed(alphabets):
        value, at = divmod(value, len(alphabet))
        out.append(alphabet[at])
    return "".join(reversed(out))


def _by_alphabets(feistel: Feistel, kind: str, text: str, alphabets: Sequence[str], undo: bool, allowed=None) -> str:
    value, size = _read(text, alphabets)
    check = None if allowed is None else lambda v: allowed(_write(v, alphabets))
    form = ",".join(f"{a[0]}{len(a)}" for a in alphabets)
    return _write(feistel.permute(value, size, f"{kind}|{form}", check, undo), alphabets)


def _same_place(pattern: str, digits: str) -> str:
    """Put new letters and digits where the old ones are; separators stay."""
    fresh = iter(digits)
    return "".join(next(fresh) if c.isalnum() else c for c in pattern)


def _classes(text: str) -> list[str]:
    """An alphabet for each character; a symbol of none of them stays as it is."""
    return [next((a for a in (_DIGITS, _LOWER, _UPPER) if c in a), c) for c in text]


def luhn_valid(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def _card(feistel: Feistel, text: str, undo: bool) -> str | None:
    digits = "".join(filter(str.isdigit, text))
    if not (13 <= len(digits) <= 19 and luhn_valid(digits)) or len(set(digits)) == 1:
        return None
    # The issuer's digit stays, the check digit follows from the rest.
    body = digits[0] + _by_alphabets(feistel, "card", digits[1:-1], [_DIGITS] * (len(digits) - 2), undo)
    return _same_place(text, body + next(d for d in _DIGITS if luhn_valid(body + d)))


def _iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4]))


def _iban(feistel: Feistel, text: str, undo: bool) -> str | None:
    flat = text.replace(" ", "")
    if not 15 <= len(flat) <= 34 or _iban_number(flat) % 97 != 1:
        return None
    body = _by_alphabets(feistel, "iban" + flat[:2], flat[4:], _classes(flat[4:]), undo)
    check = 98 - _iban_number(flat[:2] + "00" + body) % 97
    return _same_place(text, f"{flat[:2]}{check:02d}{body}")


def _ssn_valid(digits: str) -> bool:
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def _ssn(feistel: Feistel, text: str, undo: bool) -> str | None:
    digits = "".join(filter(str.isdigit, text))
    if not _ssn_valid(digits):
        return None
    return _same_place(text, _by_alphabets(feistel, "ssn", digits, [_DIGITS] * 9, undo, _ssn_valid))


def _address(feistel: Feistel, text: str, undo: bool) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    # Each part keeps its number of digits.
    ranges = [((0, 10), (10, 100), (100, 256))[len(p) - 1] for p in parts]
    value, size = 0, 1
    for part, (low, high) in zip(parts, ranges, strict=True):
        value, size = value * (high - low) + int(part) - low, size * (high - low)
    value = feistel.permute(value, size, "address|" + ".".join(str(len(p)) for p in parts), None, undo)
    out = []
    for low, high in reversed(ranges):
        value, at = divmod(value, high - low)
        out.append(str(low + at))
    return ".".join(reversed(out))


# The assigned country codes of one and of two digits; all others have three.
_SHORT_CODES = frozenset("1 7".split())
_TWO_DIGIT_CODES = frozenset(
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 "
    "90 91 92 93 94 95 98".split()
)


def _country(digits: str) -> str:
    """The country code that an international number begins with; no code begins another."""
    return digits[: 1 if digits[:1] in _SHORT_CODES else 2 if digits[:2] in _TWO_DIGIT_CODES else 3]


def _phone(feistel: Feistel, text: str, undo: bool) -> str | None:
    digits = "".join(filter(str.isdigit, text))
    if not 7 <= len(digits) <= 15:
        return None
    # By the digits alone, so that all spellings of a number agree.
    prefix = _country(digits) if text[0] == "+" else ""
    rest = digits[len(prefix) :]
    if len(rest) < 6:
        return None
    # Leading zeros and ones keep their meaning; area codes start with 2 to 9.
    alphabets = [_DIGITS[2:] if i == 0 and c > "1" else c if i == 0 else _DIGITS for i, c in enumerate(rest)]
    return _same_place(text, prefix + _by_alphabets(feistel, "phone", rest, alphabets, undo))


def _split_date(text: str) -> tuple[str, list[str], str] | None:
    """Field order, the fields, and the separator; day before month unless only the other way is a date."""
    separator = next(c for c in text if not c.isdigit())
    fields = text.split(separator)
    if len(fields) != 3 or not all(fields):
        return None
    if len(fields[0]) == 4:
        return "YMD", fields, separator
    return ("MDY" if int(fields[1]) > 12 else "DMY"), fields, separator


def _parse_date(order: str, fields: Sequence[str]) -> int | None:
    named = dict(zip(order, map(int, fields), strict=True))
    try:
        day = dt.date(named["Y"], named["M"], named["D"]).toordinal()
    except ValueError:
        return None
    return day if _FIRST_DAY <= day <= _LAST_DAY else None


def _date(feistel: Feistel, text: str, undo: bool) -> str | None:
    split = _split_date(text)
    if split is None:
        return None
    order, fields, separator = split
    day = _parse_date(order, fields)
    if day is None:
        return None
    padded = all(len(f) > 1 for f in fields)

    def written(number: int) -> str:
        date = dt.date.fromordinal(_FIRST_DAY + number)
        values = {"Y": f"{date.year}", "M": f"{date.month}", "D": f"{date.day}"}
        return separator.join(values[c].zfill(2) if padded else values[c] for c in order)

    def same_form(number: int) -> bool:
        found = _split_date(written(number))
        return found[0] == order and all(len(f) > 1 for f in found[1]) == padded

    size = _LAST_DAY - _FIRST_DAY + 1
    return written(feistel.permute(day - _FIRST_DAY, size, f"date|{order}|{padded}", same_form, undo))


def _email(feistel: Feistel, text: str, undo: bool) -> str:
    local, _, domain = text.rpartition("@")
    return _by_alphabets(feistel, "email@" + domain.lower(), local, _classes(local), undo) + "@" + domain


def _secret(feistel: Feistel, text: str, undo: bool) -> str:
    if len(text) < 8 or any(c not in _HEX for c in text):
        return _by_alphabets(feistel, "secret", text, _classes(text), undo)
    digits = any(c in _DIGITS for c in text)  # kept, as a secret may be known by them
    return _by_alphabets(feistel, "secret", text, [_HEX] * len(text), undo, lambda s: any(c in _DIGITS for c in s) == digits)


def _cloud_key(feistel: Feistel, text: str, undo: bool) -> str:
    return text[:4] + _by_alphabets(feistel, "key", text[4:], [_UPPER + _DIGITS] * (len(text) - 4), undo)


@dataclass(frozen=True)
class Kind:
    """A sort of personal data: where to look, and how to permute what is valid (else None)."""

    name: str
    pattern: re.Pattern
    replace: Callable[[Feistel, str, bool], str | None]
    group: int = 0


_NUMBER_START, _NUMBER_END = r"(?<![\w.+-])", r"(?![\w-]|\.\d)"
_DATE_END = rf"(?:(?=T\d\d:)|{_NUMBER_END})"  # the time of an ISO timestamp may follow
# In order: where two overlap, the first kind wins.
KINDS = (
    Kind("email", re.compile(r"(?<![\w.+%-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"), _email),
    Kind(
        "secret",
        re.compile(
            # After a colon without quotes a plain word is just the next word of a sentence.
            r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s*"
            r"(?:=\s*[\"']?|:\s*[\"']|:\s*(?=[A-Za-z]*[0-9_+/=~!@#$%^&*]))([A-Za-z0-9_+/=.~!@#$%^&*-]{5,}[A-Za-z0-9_+/=-])"
        ),
        _secret,
        1,
    ),
    Kind("cloud_key", re.compile(r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"), _cloud_key),
    Kind("token", re.compile(r"\b(?:sk|pk|rk|ghp|gho|ghs|xox[abp])[-_]([A-Za-z0-9_-]{16,})"), _secret, 1),
    Kind("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"), _iban),
    Kind(
        "card",
        re.compile(
            _NUMBER_START + r"(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?![\w-])"
        ),
        _card,
    ),
    Kind("ssn", re.compile(_NUMBER_START + r"\d{3}-\d{2}-\d{4}" + _NUMBER_END), _ssn),
    Kind("address", re.compile(_NUMBER_START + r"\d{1,3}(?:\.\d{1,3}){3}" + _NUMBER_END), _address),
    Kind(
        "date",
        re.compile(_NUMBER_START + r"(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})" + _DATE_END),
        _date,
    ),
    Kind(
        "phone",
        re.compile(
            r"(?<![\w+-])(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}"
            r"|\+(?!1\b)\d{1,3}(?:[ .-]?\(\d{1,4}\)|[ .-]?\d{1,4})(?:[ .-]?\d{2,4}){1,4}"
            r"|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})" + _NUMBER_END
        ),
        _phone,
    ),
)
_HINT = re.compile(r"[0-9@=:]")


def find(text: str, feistel: Feistel, undo: bool = False) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of all valid values, in order, without overlaps."""
    found: list[tuple[int, int, str, str]] = []
    if not _HINT.search(text):
        return found
    for kind in KINDS:
        # Matches and what was found before are both in order: one walk over the two.
        more, at = [], 0
        for match in kind.pattern.finditer(text):
            start, end = match.span(kind.group)
            while at < len(found) and found[at][1] <= start:
                at += 1
            if at < len(found) and found[at][0] < end:
                continue
            value = match[kind.group]
            fresh = kind.replace(feistel, value, undo)
            while fresh is None and " " in value:  # what follows after a space may be something else
                value = value[: value.rindex(" ")]
                fresh = kind.replace(feistel, value, undo) if value else None
            if fresh is not None:
                more.append((start, start + len(value), kind.name, fresh))
        if more:
            found = sorted(found + more)
    return found


def pseudonymise(text: str | None, feistel: Feistel, undo: bool = False) -> tuple[str | None, list[str]]:
    """The text with pseudonyms, and the kinds replaced; null stays null."""
    if not text:
        return text, []
    spans = find(text, feistel, undo)
    out, at = [], 0
    for start, end, _, fresh in spans:
        out += [text[at:start], fresh]
        at = end
    return "".join([*out, text[at:]]), [kind for _, _, kind, _ in spans]


def pseudonymise_documents(
    docs: DataFrame, ident: str = "doc_id", text: str = "text", key: bytes = EXAMPLE_KEY, undo: bool = False
) -> DataFrame:
    """``ident``, ``text`` with pseudonyms, and ``n_replaced``, for every row.

    Null and empty texts stay as they are, with 0 replaced. Repeated rows give repeated
    rows, with the same pseudonyms. An empty table gives an empty table.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        feistel = Feistel(key)
        for batch in batches:
            done = [pseudonymise(t.as_py(), feistel, undo) for t in batch["text"]]
            yield {"ident": batch["ident"], "text": [t for t, _ in done], "n_replaced": [len(k) for _, k in done]}

    slim = docs.selectExpr(f"`{ident}` AS ident", f"`{text}` AS text")
    found = map_batches(slim, run, "ident bigint, text string, n_replaced bigint")
    return found.withColumnsRenamed({"ident": ident, "text": text})


def with_pseudonyms(docs: DataFrame, key: bytes = EXAMPLE_KEY) -> DataFrame:
    """All rows and columns of ``docs``, with pseudonyms in ``text`` (and ``n_chars`` to match)."""

    def run(batch):
        feistel = Feistel(key)
        done = [pseudonymise(t.as_py(), feistel) for t in batch.column("text")]
        return replace_texts(batch, [t for t, _ in done], [bool(kinds) for _, kinds in done])

    return change_batches(docs, run)
