"""How the values of a column are spread over ordered buckets.

Ranks and exact quantiles need an order over all rows. A plain window or a
``percentile`` aggregate would put one whole group into one task, and one group
may hold a third of all rows. So these jobs first look at the row count:

* up to ``rows_per_bucket`` rows in total, one task can hold any group, and the
  plain Spark operator is used;
* beyond it, values are cut into ordered buckets. The cut points are quantiles of
  *all* values, so no bucket, and so no (group, bucket) pair, has more than about
  ``rows / buckets`` rows, however large one group is. Equal values are collapsed
  into one counted row before they are ordered.

Cut points steer balance only. Every result is exact for any cut points.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from censusloom.errors import check

ROWS_PER_BUCKET = 1_000_000
MAX_BUCKETS = 16_384
_SAMPLE_ROWS = 2_000_000


@dataclass(frozen=True)
class Layout:
    """Non-null rows and mean of a column, and the ordered cut points of its values."""

    rows: int
    cuts: tuple[float, ...] = ()
    mean: float = 0.0

    @property
    def single(self) -> bool:
        """Whether all rows may be ordered by one task."""
        return not self.cuts

    def with_bucket(self, df: DataFrame, value: str, bucket: str) -> DataFrame:
        """Add the ordered bucket number of ``value`` (binary search in the JVM)."""
        if self.single:
            return df.withColumn(bucket, F.lit(0.0))
        splits = [-math.inf, *self.cuts, math.inf]
        # Bucketizer reads a double column; the cast keeps the order.
        as_double = df.withColumn("_position", F.col(value).cast("double"))
        return Bucketizer(splits=splits, inputCol="_position", outputCol=bucket).transform(as_double).drop(
            "_position"
        )


def fit_layouts(
    df: DataFrame,
    values: Sequence[str],
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> dict[str, Layout]:
    """Count the non-null values of each column and choose cut points where needed."""
    check(rows_per_bucket >= 1, "rows_per_bucket must be at least 1")
    for name in values:
        kind = df.schema[name].dataType
        check(isinstance(kind, T.NumericType), f"{name} must be numeric to be ordered, not {kind.simpleString()}")
    facts = df.agg(
        *[F.count(F.col(name)).alias(f"rows_{name}") for name in values],
        *[F.avg(F.col(name)).alias(f"mean_{name}") for name in values],
    ).first()
    layouts = {}
    for name in values:
        rows, mean = facts[f"rows_{name}"], float(facts[f"mean_{name}"] or 0.0)
        buckets = min(MAX_BUCKETS, math.ceil(rows / rows_per_bucket))
        if buckets <= 1:
            layouts[name] = Layout(rows, (), mean)
            continue
        chosen = df.select(F.col(name).cast("double").alias(name)).where(F.col(name).isNotNull())
        if rows > _SAMPLE_ROWS:
            chosen = chosen.sample(False, _SAMPLE_ROWS / rows, 42)
        points = chosen.approxQuantile(name, [i / buckets for i in range(1, buckets)], 1 / (4 * buckets))
        layouts[name] = Layout(rows, tuple(sorted(set(points))), mean)
    return layouts


def fit_layout(df: DataFrame, value: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> Layout:
    """:func:`fit_layouts` for one column."""
    return fit_layouts(df, [value], rows_per_bucket)[value]


HOT_KEY_LIMIT = 1_000


def hot_keys(
    counts: DataFrame, on: Sequence[str], rows: Column, layout: Layout, limit: int = HOT_KEY_LIMIT
) -> list[tuple]:
    """Keys holding more than 1 / ``limit`` of the layout's rows: at most ``limit`` of them.

    ``counts`` has one row per key with its number of ``rows``. Up to the size one task
    may order there is nothing to split, and nothing is counted.
    """
    if layout.single:
        return []
    found = counts.where(rows > F.lit(layout.rows // limit)).select(*on)
    return [tuple(row) for row in found.collect()]


def lookup_by_key(facts: DataFrame, lookup: DataFrame, on: Sequence[str], hot: list[tuple]) -> DataFrame:
    """Inner-join ``facts`` to ``lookup`` (one row per key) with the ``hot`` keys split off.

    The lookup rows of the hot keys are broadcast, so their facts stay where they are;
    all other keys are light enough to be shuffled.
    """
    on = list(on)
    if not hot:
        return facts.join(lookup, on)
    keys = F.broadcast(facts.sparkSession.createDataFrame(hot, facts.select(*on).schema))
    heavy = facts.join(F.broadcast(lookup.join(keys, on, "left_semi")), on)
    light = facts.join(keys, on, "left_anti").join(lookup, on)
    return heavy.unionByName(light)
