"""Distributions of a numeric target over categories, ordered levels and options."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from censusloom.errors import check
from censusloom.functions.scalars import score_label
from censusloom.functions.tokens import options, tokens
from censusloom.operators.layout import ROWS_PER_BUCKET, fit_layout, hot_keys, lookup_by_key
from censusloom.operators.quantiles import grouped_quantiles
from censusloom.operators.ranks import running_counts
from censusloom.sources.contracts import require_population

QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def long_categories(df: DataFrame, features: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Stack categorical columns: (values..., feature, category), complete rows only.

    One scan and one later shuffle serve all features, instead of a loop over them.
    """
    texts = df.select(*values, *[F.col(name).cast("string").alias(name) for name in features])
    return texts.unpivot(list(values), list(features), "feature", "category").dropna()


def category_distribution(
    df: DataFrame,
    features: Sequence[str],
    value: str,
    min_group_size: int = 20,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    sketch: int | None = None,
) -> DataFrame:
    """Size, mean and exact quartiles of ``value`` per category of each feature.

    Groups below ``min_group_size`` are left out. Sorted by feature, then by falling
    median. ``sketch``, the size of a KLL sketch, makes the quartiles approximate and
    shuffles no values.
    """
    check(min_group_size >= 1, "min_group_size must be at least 1")
    long = long_categories(df, features, [value])
    grouped = grouped_quantiles(
        long,
        ["feature", "category"],
        value,
        QUARTILES,
        [F.count(F.lit(1)).alias("respondents"), F.avg(value).alias("mean")],
        rows_per_bucket=rows_per_bucket,
        sketch=sketch,
    )
    return (
        grouped.where(F.col("respondents") >= min_group_size)
        .select("feature", "category", "respondents", "median", "mean", "q25", "q75")
        .orderBy("feature", F.desc("median"), "category")
    )


def ordinal_trend(
    df: DataFrame,
    levels: Mapping[str, tuple[str, Mapping[int, str]]],
    value: str,
    min_group_size: int = 20,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    sketch: int | None = None,
) -> DataFrame:
    """Size and exact quartiles of ``value`` per level of each ordered score column.

    ``levels`` maps a score column to its display name and its level labels. ``sketch``,
    the size of a KLL sketch, makes the quartiles approximate and shuffles no values.
    """
    check(min_group_size >= 2, "min_group_size must be at least 2")
    scores = df.select(value, *[F.col(name).cast("double").alias(name) for name in levels])
    long = scores.unpivot([value], list(levels), "score_column", "level").dropna()
    grouped = grouped_quantiles(
        long,
        ["score_column", "level"],
        value,
        QUARTILES,
        [F.count(F.lit(1)).alias("respondents")],
        rows_per_bucket=rows_per_bucket,
        sketch=sketch,
    ).where(F.col("respondents") >= min_group_size)
    feature = category = F.lit(None).cast("string")
    for column, (name, labels) in levels.items():
        feature = F.when(F.col("score_column") == column, F.lit(name)).otherwise(feature)
        category = F.when(F.col("score_column") == column, score_label(F.col("level"), labels)).otherwise(
            category
        )
    return grouped.select(
        feature.alias("feature"),
        F.col("level").cast("int").alias("order"),
        category.alias("category"),
        "respondents",
        "median",
        "q25",
        "q75",
    ).orderBy("feature", "order")


def token_frequency(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows holding each trimmed token of multi-select columns: (column, token, rows)."""
    lists = df.select(*[tokens(F.col(name).cast("string")).alias(name) for name in columns])
    long = lists.unpivot([], list(columns), "column", "_tokens")
    return (
        long.select("column", F.explode("_tokens").alias("token"))
        .groupBy("column", "token")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def distinct_options(df: DataFrame, answer: str) -> DataFrame:
    """Sorted distinct options of a multi-select column, texts as written."""
    return (
        df.where(F.col(answer).isNotNull())
        .select(F.explode(options(F.col(answer))).alias("option"))
        .distinct()
        .orderBy("option")
    )


def multiselect_effects(
    df: DataFrame,
    answer: str,
    value: str,
    log_value: str,
    min_group_size: int = 20,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Compare ``value`` between rows with and without each option of ``answer``.

    Rows are exploded to their own options only. The other side is the complement: its
    size, mean and point-biserial r follow from the totals. Its exact median follows
    from two running counts, that of all rows and that of the option's own rows: the
    row at place p without the option is the row at place p + (own rows before it) of
    the whole order.
    """
    check(min_group_size >= 1, "min_group_size must be at least 1")
    source = df.select(answer, value, log_value).dropna()
    layout = fit_layout(source, value, rows_per_bucket)
    require_population(layout.rows, 2 * min_group_size, "the multi-select comparison")
    whole = source.agg(
        F.avg(log_value).alias("mean"), F.stddev_pop(log_value).alias("spread")
    ).first()
    rows = layout.rows

    own = (
        source.select(F.explode(options(F.col(answer))).alias("option"), value, log_value)
        .groupBy("option", value)
        .agg(F.count(F.lit(1)).alias("_count"), F.sum(F.col(log_value) - F.lit(whole["mean"])).alias("_lift"))
    )
    own = running_counts(own, ["option"], value, layout).withColumnsRenamed(
        {"_count": "_own", "_start": "_own_start", "_rows": "_own_rows"}
    )
    counts = source.groupBy(value).agg(F.count(F.lit(1)).alias("_count"))
    everyone = running_counts(counts, [], value, layout).drop("_rows")
    both = lookup_by_key(own, everyone, [value], hot_keys(counts, [value], F.col("_count"), layout))

    selected, unselected = F.col("_own_rows"), F.lit(rows) - F.col("_own_rows")
    below = F.col("_start") - F.col("_own_start")  # rows without the option below the value
    own_end = F.col("_own_start") + F.col("_own")
    known = F.struct(
        F.col(value).cast("double").alias("value"),
        own_end.alias("own_end"),
        (F.col("_start") + F.col("_count") - own_end).alias("end"),
    )
    ends = {"low": F.floor, "high": F.ceil}
    picks = []
    for name, towards in ends.items():
        place = towards((selected - 1) / 2)
        at = (F.col("_own_start") <= place) & (place < own_end)
        picks.append(F.max(F.when(at, F.col(value).cast("double"))).alias(f"_selected_{name}"))
        picks.append(F.max(F.when(below <= towards((unselected - 1) / 2), known)).alias(f"_near_{name}"))
    effects = (
        both.groupBy("option")
        .agg(F.max("_own_rows").alias("_own_rows"), F.sum("_lift").alias("_lift"), *picks)
        .where((selected >= min_group_size) & (unselected >= min_group_size))
    )
    # The wanted place in the order of all rows; the option's own value, where that is it.
    wanted = []
    for name, towards in ends.items():
        place, near = towards((unselected - 1) / 2), F.col(f"_near_{name}")
        wanted.append(
            F.struct(
                F.lit(name).alias("_end"),
                F.when(place < near["end"], near["value"]).alias("_value"),
                (place + F.coalesce(near["own_end"], F.lit(0))).alias("_place"),
            )
        )
    r = F.try_divide(F.col("_lift") / selected, F.lit(whole["spread"])) * F.sqrt(selected / unselected)
    effects = effects.select(
        "option",
        selected.alias("selected_rows"),
        unselected.alias("unselected_rows"),
        ((F.col("_selected_low") + F.col("_selected_high")) / 2).alias("selected_median"),
        r.alias("point_biserial_r"),
        F.inline(F.array(*wanted)),
    )
    return (
        _value_at_place(effects, everyone, value, rows)
        .groupBy("option", "selected_rows", "unselected_rows", "selected_median", "point_biserial_r")
        .agg(F.avg(F.coalesce("_value", "_found")).alias("unselected_median"))
        .select(
            "option",
            "selected_rows",
            "unselected_rows",
            "selected_median",
            "unselected_median",
            "point_biserial_r",
            F.abs("point_biserial_r").alias("absolute_r"),
        )
        .orderBy(F.desc("absolute_r"), "option")
    )


def _value_at_place(wanted: DataFrame, everyone: DataFrame, value: str, rows: int) -> DataFrame:
    """Add ``_found``, the value at ``_place`` (0-based) of the order of all rows.

    Places are cut into chunks, which makes this an equality join. A value covering
    several chunks is listed in each, at most a million times.
    """
    chunk = max(4_096, -(-rows // 1_000_000))
    end = F.col("_start") + F.col("_count")
    first, last = F.floor(F.col("_start") / chunk), F.floor((end - 1) / chunk)
    covering = everyone.select(
        F.col(value).cast("double").alias("_found"),
        F.col("_start").alias("_from"),
        end.alias("_to"),
        F.explode(F.sequence(first, last)).alias("_chunk"),
    )
    placed = wanted.withColumn("_chunk", F.floor(F.col("_place") / chunk))
    inside = (F.col("_from") <= F.col("_place")) & (F.col("_place") < F.col("_to"))
    return placed.join(covering, "_chunk").where(inside)


def top_categories(distribution: DataFrame, per_feature: int = 20) -> DataFrame:
    """The categories with the highest medians, at most ``per_feature`` each."""
    order = Window.partitionBy("feature").orderBy(F.desc("median"), "category")
    return (
        distribution.withColumn("_place", F.row_number().over(order))
        .where(F.col("_place") <= per_feature)
        .drop("_place")
    )
