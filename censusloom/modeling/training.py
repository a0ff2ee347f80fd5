"""The training job: split, fence, select, evaluate, explain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from censusloom.errors import check
from censusloom.modeling.evaluation import population_metrics
from censusloom.modeling.importance import permutation_importance
from censusloom.modeling.selection import PREDICTION, select_model
from censusloom.modeling.spec import ModelSpec
from censusloom.operators.associations import pearson_with_target
from censusloom.operators.cleaning import iqr_fences, valid_target, within
from censusloom.operators.ranks import in_training_part
from censusloom.sources.contracts import require_columns, require_population


@dataclass(frozen=True)
class TrainingResult:
    """The fitted model and the tables that describe it."""

    model: PipelineModel
    metrics: DataFrame
    comparison: DataFrame
    tuning: DataFrame
    importance: DataFrame
    correlations: DataFrame


def split(df: DataFrame, spec: ModelSpec) -> tuple[DataFrame, DataFrame]:
    """Random holdout by key, the same rows in every run."""
    training = in_training_part(F.col(spec.key), spec.test_share, spec.seed)
    return df.where(training), df.where(~training)


def train_correlations(train: DataFrame, spec: ModelSpec) -> DataFrame:
    """Pearson r of the numeric inputs with the log target on the training rows."""
    logged = train.withColumn("_log", F.log1p(spec.target))
    return pearson_with_target(logged, spec.numeric, "_log").select(
        "feature", "pearson_r", "absolute_r", F.lit(True).alias("used_by_model")
    )


def train_and_select(df: DataFrame, spec: ModelSpec, model_path: str | None = None) -> TrainingResult:
    """Train on a fenced 80 % part and evaluate on the rest.

    Fences, medians, scales and vocabularies come from training rows only, inside
    each fold as well as in the final fit. The main metrics are those of test rows
    within the training fences; the whole test part is reported next to them.
    """
    check(bool(spec.numeric), "a model needs numeric input columns")
    require_columns(df, [*spec.features, spec.target, spec.key])
    rows = valid_target(df.select(spec.key, spec.target, *spec.features), spec.target)
    rows = rows.withColumn(spec.target, F.col(spec.target).cast("double"))
    train_full, test_full = split(rows.persist(StorageLevel.MEMORY_AND_DISK), spec)
    low, high = iqr_fences(train_full, spec.target, spec.fence_factor, spec.rows_per_bucket)
    train, test = within(train_full, spec.target, low, high), within(test_full, spec.target, low, high)
    inside = F.col(spec.target).between(low, high)
    sizes = {
        name: part.agg(F.count(F.lit(1)).alias("all"), F.count_if(inside).alias("inside")).first()
        for name, part in (("train", train_full), ("test", test_full))
    }
    require_population(sizes["train"]["all"] + sizes["test"]["all"], spec.min_rows, "model training")
    require_population(sizes["test"]["inside"], spec.min_rows, "the fenced holdout")

    correlations = train_correlations(train, spec)
    check(not correlations.isEmpty(), "no numeric input correlates with the target")
    model, comparison, tuning, selected, draws = select_model(train, spec)
    chosen = comparison.where(F.col("model") == selected).select(
        F.col("model").alias("selected_model"),
        "cv_folds",
        "cv_log_rmse_mean",
        "cv_log_rmse_std",
        "cv_log_r2_mean",
        "cv_log_r2_std",
        "cv_mae_mean",
        "cv_mae_std",
        "cv_r2_mean",
        F.lit(draws).alias("tuning_candidate_count"),
    )
    evaluated = population_metrics(model.transform(test_full), spec.target, PREDICTION, inside).select(
        "*",
        F.lit(sizes["train"]["all"]).alias("train_rows_before_outlier_filter"),
        F.lit(sizes["train"]["inside"]).alias("train_rows"),
        F.lit(sizes["test"]["all"]).alias("test_rows_before_outlier_filter"),
        F.lit(sizes["test"]["inside"]).alias("test_rows"),
        F.lit(low).alias("train_target_lower_bound"),
        F.lit(high).alias("train_target_upper_bound"),
    )
    # One row beside one row.
    metrics = chosen.withColumn("_row", F.lit(1)).join(evaluated.withColumn("_row", F.lit(1)), "_row").drop("_row")
    if model_path:
        model.write().overwrite().save(model_path)
    return TrainingResult(
        model, metrics, comparison, tuning, permutation_importance(model, test, spec), correlations
    )
