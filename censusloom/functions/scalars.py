"""Row-level expressions: coercion, label scores, ratios, logs, allocations.

Everything here is a built-in Spark expression, so it stays inside whole-stage
codegen. Spark 4 runs in ANSI mode, hence ``try_cast`` and explicit guards.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Plain decimal or scientific notation. Keeps out texts that a Java cast would
# take for a number, such as "1d" or "NaN".
_NUMBER_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def finite(value: Column) -> Column:
    """NaN and infinities become NULL, because one NaN would poison an aggregate.

    Spark orders NaN above every number, so one comparison catches all of them.
    """
    return F.when(F.abs(value) < float("inf"), value)


def text_to_number(text: Column) -> Column:
    """Number in ``text`` as double; anything else becomes NULL."""
    return finite(F.when(text.rlike(_NUMBER_TEXT), F.trim(text).try_cast("double")))


def number(df: DataFrame, name: str) -> Column:
    """Column ``name`` of ``df`` as a finite double, whatever its stored type."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return text_to_number(F.col(name))
    return finite(F.col(name).cast("double"))


def label_score(label: Column, scores: Mapping[str, float]) -> Column:
    """Look ``label`` up in a short fixed table; labels outside it become NULL."""
    pairs = [F.lit(item) for label_, score in scores.items() for item in (label_, float(score))]
    return F.create_map(*pairs)[label]


def score_label(score: Column, labels: Mapping[int, str]) -> Column:
    """Inverse of :func:`label_score` for whole-number scores."""
    pairs = [F.lit(item) for entry in sorted(labels.items()) for item in entry]
    return F.create_map(*pairs)[score.cast("int")]


def years_to_number(text: Column, boundary: Mapping[str, float]) -> Column:
    """Numeric text where some labels stand for a fixed number ("More than 50 years")."""
    return F.coalesce(label_score(text, boundary), text_to_number(text))


def bounded_ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` clipped to [0, 1]; NULL unless both are known and ``whole > 0``."""
    ratio = F.when(whole > 0, part / whole)
    # greatest/least skip NULLs, so the clip only runs on a known ratio.
    return F.when(ratio.isNotNull(), F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0)))


def floored_difference(left: Column, right: Column) -> Column:
    """``left - right``, but never below 0; NULL if either side is."""
    difference = left - right
    return F.when(difference.isNotNull(), F.greatest(difference, F.lit(0.0)))


def non_negative(value: Column) -> Column:
    """Values below 0 become 0; NULL stays NULL."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))


def log_scale(value: Column) -> Column:
    """``log(1 + value)``."""
    return F.log1p(value)


def linear_scale(value: Column) -> Column:
    """Inverse of :func:`log_scale`."""
    return F.expm1(value)


def safe_multiple(first: Column, second: Column) -> Column:
    """How many times the larger holds the smaller; NULL unless both are positive."""
    return F.when(
        (first > 0) & (second > 0), F.greatest(first, second) / F.least(first, second)
    )


def sums_to(parts: Sequence[Column], total: float, tolerance: float) -> Column:
    """Whether all parts are known and add up to ``total``."""
    added = reduce(lambda left, right: left + right, parts)
    return F.coalesce(F.abs(added - F.lit(total)) <= F.lit(tolerance), F.lit(False))


def mask_allocation(
    df: DataFrame, parts: Sequence[str], total: float = 100.0, tolerance: float = 0.011
) -> DataFrame:
    """Blank out every part of a row whose parts do not add up to ``total``.

    The default tolerance is an absolute 0.01 plus a relative 1e-5 of 100.
    """
    valid = sums_to([F.col(name) for name in parts], total, tolerance)
    masked = {name: F.when(valid, F.col(name)) for name in parts}
    return df.select(*[masked[name].alias(name) if name in masked else F.col(name) for name in df.columns])


def rounded(df: DataFrame, places: int) -> DataFrame:
    """Round every floating-point column for display."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[F.round(F.col(n), places).alias(n) if n in floating else F.col(n) for n in df.columns]
    )


def _json(value: Column) -> Column:
    """A value as JSON text, by way of an array of one."""
    listed = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def sorted_json(entries: Column, literal: bool = False) -> Column:
    """A map column as one JSON text with its keys in order: a fixed text for a set of parameters.

    Equal maps give equal texts, however they were built, so the text may be a key. With
    ``literal`` the values are JSON texts already, which lets their types differ. A NULL map
    gives NULL, a NULL value ``null``.
    """
    sorted_entries = F.array_sort(F.map_entries(entries))
    text = F.transform(
        sorted_entries,
        lambda e: F.concat(_json(e["key"]), F.lit(": "), F.coalesce(e["value"], F.lit("null")) if literal else _json(e["value"])),
    )
    return F.concat(F.lit("{"), F.array_join(text, ", "), F.lit("}"))
