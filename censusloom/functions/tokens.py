"""Multi-select answers: one ``;``-joined text standing for a set of options."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "__MISSING__"
INFREQUENT = "__INFREQUENT__"

# All Unicode white space, plus the four ASCII separators.
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def options(answer: Column, separator: str = ";") -> Column:
    """Distinct options of an answer, texts kept exactly as written."""
    return F.array_distinct(F.split(answer, separator))


def tokens(answer: Column, separator: str = ";") -> Column:
    """Distinct trimmed, non-empty options; a missing or blank answer is ``__MISSING__``.

    An answer made of separators only has no token at all.
    """
    stripped = F.transform(F.split(answer, separator), lambda t: F.regexp_replace(t, _EDGE_SPACE, ""))
    known = F.array_distinct(F.filter(stripped, lambda t: t != ""))
    blank = answer.isNull() | (F.regexp_replace(answer, _EDGE_SPACE, "") == "")
    return F.when(blank, F.array(F.lit(MISSING))).otherwise(known)


def keep_common(answer_tokens: Column, vocabulary: list[str]) -> Column:
    """Replace every token outside ``vocabulary`` by one ``__INFREQUENT__`` token.

    ``IN`` over a literal list becomes a hash-set test in Catalyst. The list goes there as one
    SQL text: a Column object for each of many thousand words would take longer than the rows.
    """
    known = ", ".join("'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'" for word in [*vocabulary, MISSING])
    kept = F.expr(f"t -> CASE WHEN t IN ({known}) THEN t ELSE '{INFREQUENT}' END")
    return F.array_distinct(F.call_function("transform", answer_tokens, kept))
