"""Overviews and profiles of whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from censusloom.functions.scalars import number
from censusloom.operators.layout import ROWS_PER_BUCKET
from censusloom.operators.quantiles import grouped_quantiles
from censusloom.sources.contracts import duplicate_count


def dataset_overview(df: DataFrame, key: Sequence[str], target: str) -> DataFrame:
    """(item, value): rows, columns, duplicate keys, valid and missing targets.

    A target of 0 or less is neither valid nor missing.
    """
    value = number(df, target)
    sizes = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).cast("long").alias("columns"),
        F.count_if(value > 0).alias("valid_target_rows"),
        F.count_if(value.isNull()).alias("missing_target_rows"),
    )
    items = sizes.unpivot([], sizes.columns, "item", "value")
    repeated = duplicate_count(df, key, "duplicate_keys")
    return items.unionByName(repeated.unpivot([], repeated.columns, "item", "value"))


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Per column: type, missing count and share, distinct values; most missing first.

    Columns go through one shuffle of distinct (column, value) pairs, which are
    counted before they move; a value filling a third of the table is one row per
    map task. Long texts move as their SHA-256. Integers are counted in bitmaps where
    their range is dense: see :func:`distinct_integers`. ``exact=False`` shuffles only a
    sketch.
    """
    columns = list(columns or df.columns)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    integers = [c for c in columns if exact and kinds[c] in ("tinyint", "smallint", "int", "bigint")]
    if integers:
        return _profile_by_kind(df, columns, integers, kinds)
    texts = df.select(*[_compact(F.col(f"`{name}`").cast("string")).alias(name) for name in columns])
    long = texts.unpivot([], columns, "column", "text")
    if exact:
        pairs = long.groupBy("column", "text").agg(F.count(F.lit(1)).alias("_count"))
        counts = pairs.groupBy("column").agg(
            F.sum("_count").alias("rows"),
            F.coalesce(F.sum(F.when(F.col("text").isNull(), F.col("_count"))), F.lit(0)).alias(
                "missing_count"
            ),
            F.count("text").alias("unique_count"),
        )
    else:
        counts = long.groupBy("column").agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col("text").isNull()).alias("missing_count"),
            F.approx_count_distinct("text").alias("unique_count"),
        )
    # One row per column of the schema, so that an empty table is profiled too.
    schema = df.sparkSession.createDataFrame([(n, kinds[n]) for n in columns], "column string, dtype string")
    missing = F.coalesce(F.col("missing_count"), F.lit(0))
    return (
        schema.join(counts, "column", "left")
        .select(
            "column",
            "dtype",
            missing.alias("missing_count"),
            F.coalesce(missing * 100.0 / F.col("rows"), F.lit(0.0)).alias("missing_rate_pct"),
            F.coalesce(F.col("unique_count"), F.lit(0)).alias("unique_count"),
        )
        .orderBy(F.desc("missing_rate_pct"), "column")
    )


def _profile_by_kind(df: DataFrame, columns: list[str], integers: list[str], kinds: dict[str, str]) -> DataFrame:
    """:func:`column_profile` with the integer columns counted apart."""
    missing = df.select(*[F.col(f"`{c}`").isNull().cast("long").alias(f"m{i}") for i, c in enumerate(integers)])
    sums = missing.agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(f"m{i}"), F.lit(0)).alias(f"m{i}") for i in range(len(integers))])
    row = sums.first()
    table = [(c, kinds[c], row[f"m{i}"], row[f"m{i}"] * 100.0 / row["rows"] if row["rows"] else 0.0) for i, c in enumerate(integers)]
    facts = df.sparkSession.createDataFrame(table, "column string, dtype string, missing_count bigint, missing_rate_pct double")
    counted = facts.join(distinct_integers(df, integers), "column")
    others = [c for c in columns if c not in integers]
    if others:
        counted = counted.unionByName(column_profile(df.select(*[F.col(f"`{c}`") for c in others])))
    return counted.orderBy(F.desc("missing_rate_pct"), "column")


def distinct_integers(df: DataFrame, columns: Sequence[str], bytes_per_row: float = 1.0) -> DataFrame:
    """(column, unique_count) of integer columns; exact.

    Where the values of a column lie close together, each task sets a bit per value in
    bitmaps of 32,768 values, and bitmaps of one range are united: what is shuffled is bounded
    by the range of values / 8 bytes, not by the number of different values, and is combined
    on the map side. A column whose range / 8 exceeds ``bytes_per_row`` bytes per row is
    counted by its distinct values instead. The ranges are measured first, in one pass.
    """
    columns = list(columns)
    facts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.min(F.col(f"`{c}`").cast("long")).alias(f"low{i}") for i, c in enumerate(columns)],
        *[F.max(F.col(f"`{c}`").cast("long")).alias(f"high{i}") for i, c in enumerate(columns)],
    ).first()
    budget = facts["rows"] * bytes_per_row
    dense, sparse, low = [], [], {}
    for i, name in enumerate(columns):
        if facts[f"low{i}"] is None:
            sparse.append(name)
            continue
        low[name] = facts[f"low{i}"]
        (dense if (facts[f"high{i}"] - low[name] + 1) / 8 <= budget else sparse).append(name)
    # Places from 0, so that a range begins with a bitmap, wherever it lies.
    values = df.select(*[F.col(f"`{c}`").cast("long").alias(f"c{i}") for i, c in enumerate(columns)])
    place = {c: F.col(f"c{columns.index(c)}") for c in columns}
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    counts = every.limit(0).select("column", F.lit(0).cast("long").alias("unique_count"))
    if dense:
        long = values.select(*[(place[c] - F.lit(low[c])).alias(c) for c in dense]).unpivot([], [F.col(f"`{c}`") for c in dense], "column", "place")
        bitmaps = (
            long.where(F.col("place").isNotNull())
            .groupBy("column", F.bitmap_bucket_number(F.col("place")).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("place"))).alias("bits"))
        )
        counts = counts.unionByName(bitmaps.groupBy("column").agg(F.sum(F.bitmap_count("bits")).alias("unique_count")))
    if sparse:
        long = values.select(*[place[c].alias(c) for c in sparse]).unpivot([], [F.col(f"`{c}`") for c in sparse], "column", "value")
        pairs = long.where(F.col("value").isNotNull()).distinct()
        counts = counts.unionByName(pairs.groupBy("column").agg(F.count(F.lit(1)).alias("unique_count")))
    return every.join(counts, "column", "left").select("column", F.coalesce("unique_count", F.lit(0)).alias("unique_count"))


def _compact(text: Column) -> Column:
    return F.when(F.length(text) > 64, F.sha2(text, 256)).otherwise(text)


def describe_columns(
    df: DataFrame,
    columns: Sequence[str],
    shares: Sequence[float] = (0.25, 0.5, 0.75),
    rows_per_bucket: int = ROWS_PER_BUCKET,
    sketch: int | None = None,
) -> DataFrame:
    """One row per numeric column: count, mean, std (n-1), min, quantiles, max, median.

    A column without any value keeps its row, with a count of 0. ``sketch``, the size of a
    KLL sketch, makes the quantiles approximate and shuffles no values.
    """
    columns = list(columns)
    values = df.select(*[number(df, name).alias(name) for name in columns])
    long = values.unpivot([], columns, "column", "x").where(F.col("x").isNotNull())
    names = {_share_name(share): share for share in [*shares, *([] if 0.5 in shares else [0.5])]}
    body = grouped_quantiles(
        long,
        ["column"],
        "x",
        names,
        [
            F.count(F.lit(1)).alias("count"),
            F.avg("x").alias("mean"),
            F.stddev_samp("x").alias("std"),
            F.min("x").alias("min"),
            F.max("x").alias("max"),
        ],
        rows_per_bucket=rows_per_bucket,
        sketch=sketch,
    )
    every = df.sparkSession.createDataFrame([(name,) for name in columns], "column string")
    return every.join(body, "column", "left").select(
        "column",
        F.coalesce("count", F.lit(0)).alias("count"),
        "mean",
        "std",
        "min",
        *[_share_name(share) for share in shares],
        "max",
        F.col(_share_name(0.5)).alias("median"),
    )


def _share_name(share: float) -> str:
    return "p" + f"{share * 100:g}".replace(".", "_").zfill(2)


def target_summary(
    df: DataFrame,
    target: str,
    shares: Sequence[float] = (0.01, 0.25, 0.5, 0.75, 0.99),
    rows_per_bucket: int = ROWS_PER_BUCKET,
    sketch: int | None = None,
) -> DataFrame:
    """(statistic, value) of the valid (known and positive) targets; ``sketch`` as above."""
    valid = df.select(number(df, target).alias("x")).where(F.col("x") > 0)
    wide = describe_columns(valid, ["x"], shares, rows_per_bucket, sketch)
    statistics = ["count", "mean", "std", "min", *[_share_name(s) for s in shares], "max"]
    return wide.select(*[F.col(name).cast("double").alias(name) for name in statistics]).unpivot(
        [], statistics, "statistic", "value"
    )
