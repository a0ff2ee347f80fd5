"""Ranks and row positions without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from censusloom.errors import check
from censusloom.operators.layout import ROWS_PER_BUCKET, Layout, fit_layouts, hot_keys, lookup_by_key
from censusloom.operators.quantiles import bucket_spans

_BEFORE = Window.unboundedPreceding


def running_counts(counts: DataFrame, keys: Sequence[str], value: str, layout: Layout) -> DataFrame:
    """Add ``_start``, the group's rows below each value, and ``_rows``, all its rows.

    ``counts`` has one row (keys, value, _count) per distinct value of a group.
    """
    keys = list(keys)
    if layout.single:
        group = Window.partitionBy(*keys)
        below = F.sum("_count").over(group.orderBy(value).rowsBetween(_BEFORE, -1))
        return counts.withColumn("_start", F.coalesce(below, F.lit(0))).withColumn(
            "_rows", F.sum("_count").over(group)
        )
    if not keys:
        whole = running_counts(counts.withColumn("_whole", F.lit(0)), ["_whole"], value, layout)
        return whole.drop("_whole")
    counts = layout.with_bucket(counts, value, "_bucket")
    totals = counts.groupBy(*keys, "_bucket").agg(F.sum("_count").alias("_size"))
    spans = bucket_spans(totals, keys).withColumnRenamed("_start", "_offset")
    within = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(_BEFORE, -1)
    return (
        counts.join(spans, [*keys, "_bucket"])
        .withColumn("_start", F.col("_offset") + F.coalesce(F.sum("_count").over(within), F.lit(0)))
        .drop("_bucket", "_offset", "_size")
    )


def average_ranks(counts: DataFrame, keys: Sequence[str], value: str, layout: Layout) -> DataFrame:
    """Rank every distinct value within its group; equal values share the average rank.

    The result adds ``avg_rank`` (1-based double) and ``_rows``, the group's size.
    """
    ranked = running_counts(counts, keys, value, layout)
    return ranked.withColumn("avg_rank", F.col("_start") + (F.col("_count") + 1) / 2.0).drop("_start")


def ranked_rows(
    counted: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: str,
    layout: Layout,
    suffix: str = "",
    source: DataFrame | None = None,
) -> DataFrame:
    """Add the average rank of ``value`` within its group to rows counted by ``weight``.

    Unlike in :func:`average_ranks`, a value may be on many rows here. Adds
    ``avg_rank``, ``_ties`` (rows with the value) and ``_rows`` (rows of the group),
    each followed by ``suffix``. ``source`` may give the same counted rows by a
    shorter plan, to take the ranks from.
    """
    keys = list(keys)
    names = {"avg_rank": f"avg_rank{suffix}", "_count": f"_ties{suffix}", "_rows": f"_rows{suffix}"}
    if layout.single:
        group = Window.partitionBy(*keys)
        up_to = F.sum(weight).over(group.orderBy(value).rangeBetween(_BEFORE, 0))
        ties = F.sum(weight).over(Window.partitionBy(*keys, value))
        return (
            counted.withColumn(names["_count"], ties)
            .withColumn(names["avg_rank"], up_to - (F.col(names["_count"]) - 1) / 2.0)
            .withColumn(names["_rows"], F.sum(weight).over(group))
        )
    distinct = (source or counted).groupBy(*keys, value).agg(F.sum(weight).alias("_count"))
    hot = hot_keys(distinct, [*keys, value], F.col("_count"), layout)
    ranks = average_ranks(distinct, keys, value, layout).withColumnsRenamed(names)
    return lookup_by_key(counted, ranks, [*keys, value], hot)


def with_group_rows(
    counted: DataFrame, keys: Sequence[str], weight: str, layout: Layout, name: str, minimum: int = 1
) -> DataFrame:
    """Add the group's rows to its counted rows; keep groups of at least ``minimum``."""
    if layout.single:
        rows = F.sum(weight).over(Window.partitionBy(*keys))
        return counted.withColumn(name, rows).where(F.col(name) >= minimum)
    sizes = counted.groupBy(*keys).agg(F.sum(weight).alias(name)).where(F.col(name) >= minimum)
    return lookup_by_key(counted, sizes, keys, hot_keys(sizes, keys, F.col(name), layout))


def row_positions(
    df: DataFrame,
    value: str,
    key: str,
    position: str = "position",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> tuple[DataFrame, int]:
    """Number all rows 1..n by (value, key); also return n.

    ``value`` and ``key`` are numeric and not NULL. The key breaks ties, so it should
    be unique. Many rows may share one value: such a value is split by key buckets.
    """
    layouts = fit_layouts(df, [value, key], rows_per_bucket)
    rows = layouts[value].rows
    check(layouts[key].rows == rows, f"{value} and {key} must be known together")
    if layouts[value].single and layouts[key].single:
        return df.withColumn(position, F.row_number().over(Window.orderBy(value, key)).cast("long")), rows

    tagged = layouts[key].with_bucket(df, key, "_tie_bucket")
    counts = layouts[value].with_bucket(
        tagged.groupBy(value, "_tie_bucket").agg(F.count(F.lit(1)).alias("_count")), value, "_bucket"
    )
    whole = counts.withColumn("_whole", F.lit(0))
    totals = whole.groupBy("_whole", "_bucket").agg(F.sum("_count").alias("_size"))
    within = Window.partitionBy("_bucket").orderBy(value, "_tie_bucket").rowsBetween(_BEFORE, -1)
    starts = whole.join(bucket_spans(totals, ["_whole"]), ["_whole", "_bucket"]).select(
        value,
        "_tie_bucket",
        (F.col("_start") + F.coalesce(F.sum("_count").over(within), F.lit(0))).alias("_start"),
    )
    local = F.row_number().over(Window.partitionBy(value, "_tie_bucket").orderBy(key))
    placed = (
        tagged.join(starts, [value, "_tie_bucket"])
        .withColumn(position, (F.col("_start") + local).cast("long"))
        .select(*df.columns, position)
    )
    return placed, rows


def hash_order(key: Column, seed: int | str) -> Column:
    """A fixed pseudo-random text per key; the same in every run and partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_positions(
    df: DataFrame,
    groups: Sequence[str],
    order: str,
    key: str,
    rows: int,
    position: str = "position",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Number rows 1..n per group in the order of the md5 column ``order``, then ``key``.

    md5 texts spread evenly, so their leading digits are ordered buckets of equal
    size and no group needs one task.
    """
    groups = list(groups)
    if rows <= rows_per_bucket:
        window = Window.partitionBy(*groups).orderBy(order, key)
        return df.withColumn(position, F.row_number().over(window).cast("long"))
    digits = 1
    while 16**digits < rows / rows_per_bucket and digits < 5:
        digits += 1
    tagged = df.withColumn("_bucket", F.substring(order, 1, digits)).withColumn("_whole", F.lit(0))
    keys = ["_whole", *groups]
    totals = tagged.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    spans = bucket_spans(totals, keys).select(*keys, "_bucket", "_start")
    local = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(order, key))
    return (
        tagged.join(spans, [*keys, "_bucket"])
        .withColumn(position, (F.col("_start") + local).cast("long"))
        .select(*df.columns, position)
    )


def quantile_bin(position: Column, rows: int, bins: int) -> Column:
    """Equal-frequency bin (0-based) of a 1-based position, edges interpolated linearly."""
    bins = min(bins, rows)
    check(bins >= 2, "at least two target bins are needed")
    return F.greatest(
        F.ceil((position - 1) * F.lit(float(bins)) / F.lit(float(rows - 1))) - 1, F.lit(0)
    ).cast("int")


def target_bins(
    df: DataFrame,
    target: str,
    key: str,
    bins: int = 10,
    bin_column: str = "target_bin",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> tuple[DataFrame, int]:
    """Assign rows to equal-frequency bins of ``target``; also return the row count."""
    placed, rows = row_positions(df, target, key, "_place", rows_per_bucket)
    return placed.withColumn(bin_column, quantile_bin(F.col("_place"), rows, bins)).drop("_place"), rows


def stratified_folds(
    df: DataFrame,
    target: str,
    key: str,
    folds: int = 5,
    bins: int = 10,
    seed: int = 42,
    fold_column: str = "fold",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Deal the rows of each target bin to ``folds`` folds in a fixed shuffled order.

    Within one bin, fold sizes differ by at most one row.
    """
    check(folds >= 2, "at least two folds are needed")
    binned, rows = target_bins(df, target, key, bins, "_bin", rows_per_bucket)
    binned = binned.withColumn("_shuffle", hash_order(F.col(key), seed))
    dealt = hash_positions(binned, ["_bin"], "_shuffle", key, rows, "_deal", rows_per_bucket)
    return dealt.withColumn(fold_column, ((F.col("_deal") - 1) % folds).cast("int")).drop(
        "_bin", "_shuffle", "_deal"
    )


def in_training_part(key: Column, test_share: float = 0.2, seed: int = 42) -> Column:
    """Fixed random holdout by key: true for the training part."""
    bucket = F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("bigint") % 100
    return bucket < round((1 - test_share) * 100)
