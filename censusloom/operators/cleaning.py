"""Deduplication, valid-target filters, quantile trims and IQR fences."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from censusloom.functions.scalars import number
from censusloom.operators.layout import ROWS_PER_BUCKET, Layout, fit_layout, hot_keys, lookup_by_key
from censusloom.operators.quantiles import quantile_bounds
from censusloom.sources.contracts import duplicate_count, missing_cells, require_population


BROADCAST_BYTES = 64 << 20


def first_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Keep the first row of each key in the given order; a NULL key is one key.

    ``order`` must decide between any two rows of a key; NULLs come first. The keys
    are counted first, which shuffles keys only. Rows of keys that occur once then
    pass through unmoved, unless the repeated keys exceed ``broadcast_bytes``.
    """
    keys = list(keys)
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > 1)
    width = F.lit(64)  # an entry's own overhead in a hash table
    for name in keys:
        width = width + F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0))
    size = repeated.agg(F.sum(width)).first()[0]
    if size is None:
        return df
    if size > broadcast_bytes:
        return _smallest_per_key(df, keys, order)
    known = F.broadcast(repeated.select(*[F.col(name).alias(f"_key_{name}") for name in keys]))
    same = reduce(
        lambda left, right: left & right,
        [F.col(name).eqNullSafe(F.col(f"_key_{name}")) for name in keys],
    )
    once, often = df.join(known, same, "left_anti"), df.join(known, same, "left_semi")
    return once.unionByName(_smallest_per_key(often, keys, order))


def _smallest_per_key(df: DataFrame, keys: list[str], order: Sequence[str]) -> DataFrame:
    """The minimum of a struct combines on the map side, so a hot key never gathers
    its rows in one task, as it would in a ``row_number`` window."""
    sort_part = [name for name in order if name not in keys]
    others = [name for name in df.columns if name not in keys and name not in sort_part]
    kept = df.groupBy(*keys).agg(F.min(F.struct(*sort_part, *others)).alias("_first"))
    return kept.select(*[F.col(n) if n in keys else F.col(f"_first.{n}").alias(n) for n in df.columns])


def rows_of_large_groups(
    df: DataFrame, group: str, min_rows: int = 20, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Rows whose group, if known, has at least ``min_rows`` rows.

    Hot groups meet a broadcast of at most a thousand of them, so they stay spread.
    """
    known = df.where(F.col(group).isNotNull())
    sizes = known.groupBy(group).agg(F.count(F.lit(1)).alias("_group_rows"))
    sizes = sizes.where(F.col("_group_rows") >= min_rows)
    rows = known.count()
    layout = Layout(rows, () if rows <= rows_per_bucket else (0.0,))
    hot = hot_keys(sizes, [group], F.col("_group_rows"), layout)
    return lookup_by_key(known, sizes, [group], hot).select(*df.columns)


def valid_target(df: DataFrame, target: str) -> DataFrame:
    """Rows whose target is known and positive."""
    return df.where(F.col(target) > 0)


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with no NULL in the listed columns."""
    return df.dropna(subset=list(columns))


def quantile_trim(
    df: DataFrame,
    target: str,
    low_share: float = 0.01,
    high_share: float = 0.99,
    min_rows: int = 100,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> tuple[DataFrame, float, float]:
    """Keep valid targets between two exact quantiles, bounds included."""
    valid = valid_target(df, target)
    layout = fit_layout(valid, target, rows_per_bucket)
    require_population(layout.rows, min_rows, "the quantile trim")
    low, high = quantile_bounds(valid, target, [low_share, high_share], layout)
    return valid.where(F.col(target).between(low, high)), low, high


def iqr_fences(
    train: DataFrame, target: str, factor: float = 1.5, rows_per_bucket: int = ROWS_PER_BUCKET
) -> tuple[float, float]:
    """``Q1 - factor * IQR`` and ``Q3 + factor * IQR`` of the training rows."""
    first, third = quantile_bounds(train, target, [0.25, 0.75], rows_per_bucket=rows_per_bucket)
    spread = third - first
    return first - factor * spread, third + factor * spread


def within(df: DataFrame, target: str, low: float, high: float) -> DataFrame:
    """Rows whose target lies between two bounds, bounds included."""
    return df.where(F.col(target).between(low, high))


def clean(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    target: str,
    low_share: float = 0.01,
    high_share: float = 0.99,
    min_rows: int = 100,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> tuple[DataFrame, DataFrame]:
    """Deduplicate, drop invalid targets and trim; return (table, quality report).

    The target is coerced to a number and ``log_<target>`` is added. The quality
    report has eight (item, value) rows.
    """
    unique = first_per_key(df, key, order)
    unique = unique.withColumn(target, number(unique, target))
    trimmed, low, high = quantile_trim(unique, target, low_share, high_share, min_rows, rows_per_bucket)
    table = trimmed.withColumn(f"log_{target}", F.log1p(target))
    return table, quality_report(df, unique, table, key, target, low, high)


def quality_report(
    raw: DataFrame,
    unique: DataFrame,
    table: DataFrame,
    key: Sequence[str],
    target: str,
    low: float,
    high: float,
) -> DataFrame:
    """(item, value) numbers of a cleaning run, from one pass per table state."""
    value = F.col(target)
    positive = F.coalesce(value > 0, F.lit(False))
    before = raw.agg(F.count(F.lit(1)).cast("double").alias("rows_before"))
    repeated = duplicate_count(raw, key, "duplicate_keys").select(F.col("duplicate_keys").cast("double"))
    middle = unique.agg(
        F.count_if(~positive).cast("double").alias("invalid_target_rows"),
        F.lit(low).alias("lower_bound"),
        F.lit(high).alias("upper_bound"),
        F.count_if(positive & ~value.between(low, high)).cast("double").alias("outlier_rows"),
        F.count_if(positive & value.between(low, high)).cast("double").alias("rows_after"),
    )
    after = missing_cells(table).select(F.col("missing_cells").cast("double").alias("missing_cells_after"))
    report = None
    for part in (before, repeated, middle, after):
        items = part.unpivot([], part.columns, "item", "value")
        report = items if report is None else report.unionByName(items)
    return report
