"""Regression metrics as aggregates, and their summaries over folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from censusloom.functions.scalars import non_negative

METRICS = ("mae", "rmse", "r2", "log_rmse", "log_r2")


def _squares(actual: Column, predicted: Column) -> Column:
    return (actual - predicted) * (actual - predicted)


def _explained(actual: Column, predicted: Column) -> Column:
    """1 - residual / total sum of squares; NULL when the target does not vary."""
    complete = F.when(predicted.isNotNull(), actual)
    total = F.var_pop(complete) * F.count(complete)
    return 1 - F.try_divide(F.sum(_squares(actual, predicted)), total)


def metric_columns(
    actual: Column, predicted: Column, among: Column | None = None, prefix: str = ""
) -> list[Column]:
    """The five metrics as aggregates, optionally only over rows where ``among`` holds.

    The log metrics clip both sides at 0 before ``log1p``.
    """
    if among is not None:
        actual, predicted = F.when(among, actual), F.when(among, predicted)
    log_actual, log_predicted = F.log1p(non_negative(actual)), F.log1p(non_negative(predicted))
    return [
        F.avg(F.abs(actual - predicted)).alias(f"{prefix}mae"),
        F.sqrt(F.avg(_squares(actual, predicted))).alias(f"{prefix}rmse"),
        _explained(actual, predicted).alias(f"{prefix}r2"),
        F.sqrt(F.avg(_squares(log_actual, log_predicted))).alias(f"{prefix}log_rmse"),
        _explained(log_actual, log_predicted).alias(f"{prefix}log_r2"),
    ]


def regression_metrics(df: DataFrame, actual: str, predicted: str, group: list[str] | None = None) -> DataFrame:
    """MAE, RMSE, R2, log RMSE and log R2, overall or per group, in one pass."""
    grouped = df.groupBy(*(group or []))
    return grouped.agg(F.count(F.lit(1)).alias("rows"), *metric_columns(F.col(actual), F.col(predicted)))


def population_metrics(df: DataFrame, actual: str, predicted: str, inlier: Column) -> DataFrame:
    """Metrics of the inlier rows and, prefixed ``full_test_``, of all rows; one pass.

    Predictions are clipped at 0.
    """
    floor = non_negative(F.col(predicted))
    return df.agg(
        *metric_columns(F.col(actual), floor, inlier),
        *metric_columns(F.col(actual), floor, prefix="full_test_"),
    )


def cv_summary(folds: DataFrame) -> DataFrame:
    """Mean and sample deviation over folds per (model, tuned), lowest MAE first."""
    return (
        folds.groupBy("model", "tuned")
        .agg(
            F.count(F.lit(1)).cast("int").alias("cv_folds"),
            F.avg("log_rmse").alias("cv_log_rmse_mean"),
            F.stddev_samp("log_rmse").alias("cv_log_rmse_std"),
            F.avg("log_r2").alias("cv_log_r2_mean"),
            F.stddev_samp("log_r2").alias("cv_log_r2_std"),
            F.avg("mae").alias("cv_mae_mean"),
            F.stddev_samp("mae").alias("cv_mae_std"),
            F.avg("rmse").alias("cv_rmse_mean"),
            F.avg("r2").alias("cv_r2_mean"),
        )
        .orderBy("cv_mae_mean", "model")
    )


def tuning_summary(folds: DataFrame) -> DataFrame:
    """One row per tried parameter set, ranked by mean MAE; deviations over n, not n-1."""
    place = Window.partitionBy(F.lit(1)).orderBy("mean_mae")  # one row per parameter set
    return (
        folds.groupBy("params")
        .agg(
            F.avg("log_rmse").alias("mean_log_rmse"),
            F.stddev_pop("log_rmse").alias("std_log_rmse"),
            F.avg("log_r2").alias("mean_log_r2"),
            F.avg("mae").alias("mean_mae"),
            F.avg("rmse").alias("mean_rmse"),
            F.avg("r2").alias("mean_r2"),
        )
        .withColumn("rank", F.rank().over(place))
        .select(
            "rank", "mean_log_rmse", "std_log_rmse", "mean_log_r2", "mean_mae", "mean_rmse", "mean_r2", "params"
        )
        .orderBy("rank", "params")
    )
