"""Line-first cleaning: rules judge single lines, then documents by what they lost.

A line with at least one word fails if

* punctuation: none of its words ends like a sentence, more than ``SYMBOL_SHARE`` percent of its
  word characters are symbols, or more than ``SHOUT_SHARE`` percent of its words end in
  doubled exclamation or question marks;
* navigation: it has at least ``NAV_ITEMS`` separators, and at most ``NAV_WORDS`` words
  (separators included) for each of them;
* boilerplate: it contains a stock phrase, or equals an earlier line of the document.

Failed lines are removed. A document that loses more than ``LOSS_SHARE`` percent of its
word characters is rejected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from censusloom.llm.common import WORD, map_batches

SYMBOL_SHARE = 10
SHOUT_SHARE = 25
NAV_ITEMS = 3
NAV_WORDS = 4
LOSS_SHARE = 50
MIN_WORDS = 10
REPEAT_SHARE = 20
SYMBOLS = "#*$%&|<>"
SEPARATORS = ("|", "»", "•", "›")
# Phrases of boilerplate in English, German, French and Spanish, in lower case.
PHRASES = (
    "all rights reserved", "click here", "cookie policy", "copyright (c)", "copyright ©", "enable javascript",
    "licensed under", "privacy policy", "released under the", "sign up for", "skip to content", "subscribe to our",
    "terms of service", "terms of use",
    "aktivieren sie javascript", "alle rechte vorbehalten", "cookie-richtlinie", "datenschutzerklärung", "klicken sie hier",
    "lizenziert unter", "melden sie sich an", "newsletter abonnieren", "nutzungsbedingungen", "zum inhalt springen",
    "abonnez-vous à", "activez javascript", "aller au contenu", "cliquez ici", "conditions d'utilisation", "inscrivez-vous",
    "mentions légales", "politique de confidentialité", "sous licence", "tous droits réservés",
    "active javascript", "aviso legal", "bajo la licencia", "condiciones de uso", "haga clic aquí", "política de cookies",
    "política de privacidad", "saltar al contenido", "suscríbase a", "todos los derechos reservados", "términos de uso",
)
ENDS = r"""[.!?…。！？]["'”’»)\]]*$"""
SHOUT = r"(!!|\?\?)$"

_WORD, _END, _SHOUT = re.compile(WORD), re.compile(ENDS[:-1] + r"(?=[\x20\x09-\x0D]|\Z)"), ("!!", "??")
_PHRASE = re.compile("|".join(map(re.escape, PHRASES)))


@dataclass(frozen=True)
class Cleaned:
    """What the rules found in one text."""

    kept_lines: list[str]
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    n_failed_lines: int
    lost_chars: int

    @property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > REPEAT_SHARE * self.n_words

    @property
    def kept(self) -> bool:
        return not self.base_failed and 100 * self.lost_chars <= LOSS_SHARE * self.word_chars


def repeat_words(words: list[str], size: int = 5) -> int:
    """Words in windows of ``size`` words that occur at least twice, the first included."""
    windows = list(zip(*(words[i:] for i in range(size)), strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total, covered = 0, 0  # words before ``covered`` are counted or passed
    for at, window in enumerate(windows):
        if counts[window] > 1:
            total += at + size - max(at, covered)
            covered = at + size
    return total


def line_fails(line: str, words: list[str]) -> bool:
    """Whether a line with ``words`` breaks a rule by itself."""
    chars = sum(map(len, words))
    if not _END.search(line) or 100 * sum(map(line.count, SYMBOLS)) > SYMBOL_SHARE * chars:
        return True
    if 100 * sum(word.endswith(_SHOUT) for word in words) > SHOUT_SHARE * len(words):
        return True
    items = sum(map(line.count, SEPARATORS))
    return (items >= NAV_ITEMS and len(words) <= NAV_WORDS * items) or bool(_PHRASE.search(line.lower()))


def clean(text: str | None) -> Cleaned:
    """Judge all lines of a text; null is an empty text, without words and without lines."""
    all_words, kept, seen = [], [], set()
    dup = failed = lost = chars = 0
    for line in (text or "").split("\n"):
        words = _WORD.findall(line)
        if not words:
            kept.append(line)
            continue
        all_words += words
        size = sum(map(len, words))
        chars += size
        again = line in seen
        seen.add(line)
        dup += again
        if again or line_fails(line, words):
            failed += 1
            lost += size
        else:
            kept.append(line)
    symbols = sum(map((text or "").count, SYMBOLS))
    return Cleaned(kept, len(all_words), chars, symbols, dup, repeat_words(all_words), failed, lost)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_failed_lines", "lost_chars")


def clean_lines(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``ident``, ``clean_text`` (the lines kept), the counts, ``base_failed`` and ``kept``.

    One row per input row, whatever the ids; null and empty texts have no words, fail the
    base rules and give an empty clean text. An empty table gives an empty table.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            found = [clean(t.as_py()) for t in batch["text"]]
            out = {name: [getattr(x, name) for x in found] for name in (*COUNTS, "base_failed", "kept")}
            yield out | {"ident": batch["ident"], "clean_text": ["\n".join(x.kept_lines) for x in found]}

    slim = docs.selectExpr(f"`{ident}` AS ident", f"`{text}` AS text")
    counts = ", ".join(f"{name} bigint" for name in COUNTS)
    schema = f"ident bigint, clean_text string, {counts}, base_failed boolean, kept boolean"
    return map_batches(slim, run, schema).withColumnRenamed("ident", ident)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def oracle_sql() -> str:
    """The same verdicts in DuckDB SQL."""
    word = r"[^\x20\x09-\x0D]+"
    phrases = " OR ".join(f"contains(lower(line), {_text(p)})" for p in PHRASES)
    items = " + ".join(f"len(line) - len(replace(line, {_text(s)}, ''))" for s in SEPARATORS)
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    unnest(range(len(string_split(text, chr(10))))) AS line_no FROM texts),
lines AS (
  SELECT *, regexp_extract_all(line, '{word}') AS words,
    row_number() OVER (PARTITION BY doc_id, line ORDER BY line_no) > 1 AS again FROM split),
sized AS (
  SELECT *, list_sum(list_transform(words, lambda w: len(w))) AS chars,
    len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols,
    len(list_filter(words, lambda w: regexp_matches(w, {_text(SHOUT)}))) AS shouts, {items} AS items
  FROM lines WHERE len(words) > 0),
judged AS (
  SELECT *, again OR len(list_filter(words, lambda w: regexp_matches(w, {_text(ENDS)}))) = 0 OR 100 * symbols > {SYMBOL_SHARE} * chars
    OR 100 * shouts > {SHOUT_SHARE} * len(words)
    OR (items >= {NAV_ITEMS} AND len(words) <= {NAV_WORDS} * items) OR {phrases} AS fails FROM sized),
losses AS (
  SELECT doc_id, sum(chars) AS chars, sum(CASE WHEN fails THEN chars ELSE 0 END) AS lost,
    count(*) FILTER (WHERE again) AS dup FROM judged GROUP BY doc_id),
worded AS (
  SELECT doc_id, text, regexp_extract_all(text, '{word}') AS words FROM texts),
grams AS (
  SELECT doc_id, unnest(range(1, greatest(len(words) - 4, 0) + 1)) AS pos,
    unnest(list_transform(range(1, greatest(len(words) - 4, 0) + 1), lambda i: array_to_string(words[i:i + 4], ' '))) AS gram
  FROM worded),
twice AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams) WHERE n > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT pos + step) AS n FROM twice, range(5) AS s(step) GROUP BY doc_id),
base AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(l.chars, 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(coalesce(l.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
    coalesce(l.lost, 0) AS lost
  FROM worded w LEFT JOIN losses l USING (doc_id) LEFT JOIN repeats r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_SHARE} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_SHARE} * n_words)
    AND 100 * lost <= {LOSS_SHARE} * word_chars AS kept
FROM base"""
