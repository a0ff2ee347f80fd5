"""Exact linear-interpolation quantiles, overall or per group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from censusloom.errors import check
from censusloom.operators.layout import ROWS_PER_BUCKET, Layout, fit_layout

_BEFORE = Window.unboundedPreceding


def _place(share: float) -> Column:
    return (F.col("_rows") - 1) * F.lit(float(share))


def _covers(place: Column, start: Column, count: Column) -> Column:
    return (start <= place) & (place < start + count)


def _interpolated(low: Column, high: Column, share: float) -> Column:
    return low + (high - low) * (_place(share) - F.floor(_place(share)))


def pick_quantiles(
    counts: DataFrame, spans: DataFrame, keys: Sequence[str], value: str, shares: Mapping[str, float]
) -> DataFrame:
    """Quantiles from counted values whose bucket offsets are known.

    ``counts`` has (keys, _bucket, value, _count); ``spans`` has (keys, _bucket,
    _start, _size, _rows): the position of a bucket's first row within its group,
    the bucket's rows and the group's rows. Only the buckets holding a wanted
    position are joined and ordered.
    """
    start, size = F.col("_start"), F.col("_size")
    wanted = F.lit(False)
    for share in shares.values():
        wanted = (
            wanted
            | _covers(F.floor(_place(share)), start, size)
            | _covers(F.ceil(_place(share)), start, size)
        )
    within = Window.partitionBy(*keys, "_bucket").orderBy(value)
    placed = counts.join(spans.where(wanted), [*keys, "_bucket"]).withColumn(
        "_start", start + F.coalesce(F.sum("_count").over(within.rowsBetween(_BEFORE, -1)), F.lit(0))
    )
    at = lambda place: F.max(F.when(_covers(place, start, F.col("_count")), F.col(value).cast("double")))
    ends = [
        column
        for name, share in shares.items()
        for column in (
            at(F.floor(_place(share))).alias(f"_low_{name}"),
            at(F.ceil(_place(share))).alias(f"_high_{name}"),
        )
    ]
    return (
        placed.groupBy(*keys)
        .agg(F.max("_rows").alias("_rows"), *ends)
        .select(
            *keys,
            *[
                _interpolated(F.col(f"_low_{name}"), F.col(f"_high_{name}"), share).alias(name)
                for name, share in shares.items()
            ],
        )
    )


def bucket_spans(totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Turn (keys, _bucket, _size) into running offsets; a group has few buckets."""
    group = Window.partitionBy(*keys)
    return totals.withColumn(
        "_start",
        F.coalesce(F.sum("_size").over(group.orderBy("_bucket").rowsBetween(_BEFORE, -1)), F.lit(0)),
    ).withColumn("_rows", F.sum("_size").over(group))


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    shares: Mapping[str, float],
    aggregates: Sequence[Column] = (),
    layout: Layout | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    sketch: int | None = None,
) -> DataFrame:
    """One row per group: ``aggregates``, then the quantile ``shares``.

    ``value`` and the keys must not be NULL. With no keys the result is one row. Quantiles
    are exact unless ``sketch`` gives the size of a KLL sketch: see
    :mod:`censusloom.operators.sketches`.
    """
    check(all(0 <= share <= 1 for share in shares.values()), "quantile shares must lie in [0, 1]")
    if sketch is not None:
        points = {name: F.kll_sketch_get_quantile_double("_sketch", F.lit(float(share))) for name, share in shares.items()}
        grouped = df.groupBy(*keys).agg(*aggregates, F.kll_sketch_agg_double(F.col(value).cast("double"), sketch).alias("_sketch"))
        return grouped.select("*", *[point.alias(name) for name, point in points.items()]).drop("_sketch")
    layout = layout or fit_layout(df, value, rows_per_bucket)
    if layout.single:
        points = F.percentile(value, F.array(*[F.lit(float(s)) for s in shares.values()]))
        grouped = df.groupBy(*keys).agg(*aggregates, points.alias("_points"))
        named = [F.col("_points")[i].alias(name) for i, name in enumerate(shares)]
        return grouped.select("*", *named).drop("_points")

    if not keys:
        whole = grouped_quantiles(
            df.withColumn("_whole", F.lit(0)), ["_whole"], value, shares, aggregates, layout
        )
        return whole.drop("_whole")
    keys = list(keys)
    counts = layout.with_bucket(
        df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_count")), value, "_bucket"
    )
    totals = counts.groupBy(*keys, "_bucket").agg(F.sum("_count").alias("_size"))
    quantiles = pick_quantiles(counts, bucket_spans(totals, keys), keys, value, shares)
    if not aggregates:
        return quantiles
    return df.groupBy(*keys).agg(*aggregates).join(quantiles, keys)


def counted_quantiles(
    counts: DataFrame,
    keys: Sequence[str],
    value: str,
    shares: Mapping[str, float],
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Exact quantiles per group from (keys, value, _count), one row per distinct value of a group.

    ``value`` and the keys must not be NULL. The buckets are balanced by distinct values.
    """
    check(all(0 <= share <= 1 for share in shares.values()), "quantile shares must lie in [0, 1]")
    keys = list(keys)
    layout = fit_layout(counts, value, rows_per_bucket)
    if layout.single:
        points = F.percentile(value, F.array(*[F.lit(float(s)) for s in shares.values()]), F.col("_count"))
        named = [F.col("_points")[i].alias(name) for i, name in enumerate(shares)]
        return counts.groupBy(*keys).agg(points.alias("_points")).select(*keys, *named)
    placed = layout.with_bucket(counts, value, "_bucket")
    totals = placed.groupBy(*keys, "_bucket").agg(F.sum("_count").alias("_size"))
    return pick_quantiles(placed, bucket_spans(totals, keys), keys, value, shares)


def quantile_bounds(
    df: DataFrame,
    value: str,
    shares: Sequence[float],
    layout: Layout | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> list[float]:
    """Exact quantiles of one column as Python numbers, e.g. to be pushed down as filters."""
    known = df.where(F.col(value).isNotNull())
    names = {f"q{i}": share for i, share in enumerate(shares)}
    row = grouped_quantiles(known, [], value, names, layout=layout, rows_per_bucket=rows_per_bucket).first()
    check(row is not None and row[0] is not None, f"{value} has no value to take quantiles of")
    return [row[name] for name in names]
