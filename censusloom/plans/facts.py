"""Headline facts of an analysis, read off its result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COLUMNS = ("fact", "label", "value")


def _facts(table: DataFrame, values: Mapping[str, tuple[Column | None, Column]]) -> DataFrame:
    """(fact, label, value) rows from one aggregation of a result table.

    ``values`` maps a fact to its label (if any) and value, both aggregates.
    """
    names = list(values)
    columns = []
    for i, (label, value) in enumerate(values.values()):
        text = label if label is not None else F.lit(None)
        columns += [text.cast("string").alias(f"label{i}"), value.cast("double").alias(f"value{i}")]
    rows = [
        F.struct(
            F.lit(name).alias("fact"),
            F.col(f"label{i}").alias("label"),
            F.col(f"value{i}").alias("value"),
        )
        for i, name in enumerate(names)
    ]
    return table.agg(*columns).select(F.inline(F.array(*rows)))


def _largest(label: str, by: Column, *values: str) -> Column:
    """The row with the largest ``by``; the alphabetically first label on a tie."""
    return F.min(F.struct((-by).alias("by"), F.col(label).alias("label"), *values))


def item_value(name: str) -> Column:
    """Value of one item of an (item, value) table, as an aggregate."""
    return F.max(F.when(F.col("item") == name, F.col("value")))


def cleaning_facts(quality: DataFrame) -> DataFrame:
    """Share of rows with a valid target, and share of those cut as outliers, in percent."""
    unique = item_value("rows_before") - item_value("duplicate_keys")
    valid = unique - item_value("invalid_target_rows")
    return _facts(
        quality,
        {
            "valid_target_rate_pct": (None, 100 * F.try_divide(valid, item_value("rows_before"))),
            "outlier_rate_pct": (None, 100 * F.try_divide(item_value("outlier_rows"), valid)),
        },
    )


def level_facts(description: DataFrame, target: str) -> DataFrame:
    """Mean and median of the target."""
    mine = F.col("column") == target
    return _facts(
        description,
        {
            "target_mean": (None, F.max(F.when(mine, F.col("mean")))),
            "target_median": (None, F.max(F.when(mine, F.col("median")))),
        },
    )


def strongest_fact(tests: DataFrame, name: str, label: str, value: str) -> DataFrame:
    """The row of a test table whose ``value`` is farthest from 0."""
    best = _largest(label, F.abs(value), value)
    return _facts(tests, {name: (best["label"], best[value])})


def category_facts(distribution: DataFrame, features: Sequence[str]) -> DataFrame:
    """The category with the highest median of each feature, and its size."""
    best = (
        distribution.where(F.col("feature").isin(list(features)))
        .groupBy("feature")
        .agg(_largest("category", F.col("median"), "median", "respondents").alias("best"))
    )
    rows = [
        F.struct(
            F.concat(F.lit("top_"), F.col("feature"), F.lit(f"_{name}")).alias("fact"),
            F.col("best.label").alias("label"),
            F.col(f"best.{name}").cast("double").alias("value"),
        )
        for name in ("median", "respondents")
    ]
    return best.select(F.inline(F.array(*rows)))


def group_ratio_fact(welch: DataFrame) -> DataFrame:
    """Ratio of the two groups' geometric means of ``1 + target``."""
    ratio = F.exp(F.max("first_mean") - F.max("second_mean"))
    return _facts(welch, {"geometric_mean_ratio": (None, ratio)})


def model_facts(comparison: DataFrame, baseline: str = "Ridge") -> DataFrame:
    """The selected model, its log RMSE gap to the baseline and its MAE gain over it."""
    def best(value: str) -> Column:
        return F.min_by(value, F.struct("cv_mae_mean", "model"))

    def base(value: str) -> Column:
        return F.max(F.when(F.col("model") == baseline, F.col(value)))

    return _facts(
        comparison,
        {
            "selected_model_mae": (best("model"), best("cv_mae_mean")),
            "log_rmse_gap": (None, F.abs(best("cv_log_rmse_mean") - base("cv_log_rmse_mean"))),
            "mae_gain": (None, base("cv_mae_mean") - best("cv_mae_mean")),
        },
    )


def fact_table(parts: Sequence[DataFrame]) -> DataFrame:
    """All facts as one (fact, label, value) table."""
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table.select(*_COLUMNS)
