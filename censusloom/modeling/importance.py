"""Permutation importance of raw input columns."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from censusloom.encoding.categories import CategoryEncoderModel
from censusloom.encoding.multiselect import MultiSelectEncoderModel
from censusloom.encoding.numeric import NumericScalerModel
from censusloom.errors import check
from censusloom.modeling.evaluation import metric_columns
from censusloom.modeling.selection import PREDICTION
from censusloom.modeling.spec import ModelSpec
from censusloom.operators.charts import fixed_sample
from censusloom.operators.ranks import hash_order, hash_positions
from censusloom.sources.files import scratch_folder


def feature_owners(model: PipelineModel) -> list[str]:
    """The raw column behind each position of the feature vector."""
    owners: list[str] = []
    for stage in model.stages:
        if isinstance(stage, NumericScalerModel):
            owners += [*stage.getInputCols(), *stage.getOrDefault(stage.flagged)]
        elif isinstance(stage, CategoryEncoderModel):
            labels, bucketed = stage.getOrDefault(stage.labels), stage.getOrDefault(stage.bucketed)
            owners += [name for name in stage.getInputCols() for _ in range(len(labels[name]) + (name in bucketed))]
        elif isinstance(stage, MultiSelectEncoderModel):
            words = stage.getOrDefault(stage.vocabularies)
            owners += [name for name in stage.getInputCols() for _ in range(len(words[name]) + 2)]
    return owners


def _contributions(products: Column, owners: list[str], features: list[str]) -> Column:
    """What each raw column adds to a linear prediction, from the products of values and weights."""
    places = {name: [i for i, owner in enumerate(owners) if owner == name] for name in features}

    def added(name: str) -> Column:
        if not places[name]:
            return F.lit(0.0)
        at = F.array(*[F.lit(i) for i in places[name]])
        return F.aggregate(at, F.lit(0.0), lambda total, i: total + F.get(products, i))

    return F.array(*[added(name) for name in features])


def _whole(parts: str, intercept: float) -> Column:
    """A linear prediction from what the columns add to it."""
    return F.lit(float(intercept)) + F.aggregate(parts, F.lit(0.0), lambda total, x: total + x)


def permutation_importance(model: PipelineModel, test: DataFrame, spec: ModelSpec) -> DataFrame:
    """Mean and deviation of the drop in log R2 when one raw column is shuffled.

    One shuffle of the rows per repeat serves all columns: row i meets row p(i), and a
    scored variant takes a single column from it. Rows are encoded once. A raw column owns
    some positions of the feature vector, so a variant is the row's vector with the other
    row's values there, and nothing is encoded again. In a linear model it is even less: the
    row's prediction, less what its own column adds, plus what the other's adds, so only one
    number per column travels. ``importance_rows`` limits the scored rows as a parameter of
    the report; ``None`` scores every test row.
    """
    check(spec.importance_repeats >= 1, "at least one repeat is needed")
    features = spec.features
    base = test.select(spec.key, F.col(spec.target).alias("_actual"), *features)
    if spec.importance_rows is not None:
        base = fixed_sample(base, spec.key, spec.importance_rows, spec.seed)
    *encoders, fitted, _ = model.stages
    owners = feature_owners(model)
    encoded = PipelineModel(stages=encoders).transform(base).select(spec.key, "_actual", "features")
    linear = isinstance(fitted, LinearRegressionModel)
    if linear:
        weights = F.array(*[F.lit(float(w)) for w in fitted.coefficients.toArray()])
        products = F.zip_with(vector_to_array("features"), weights, lambda x, w: x * w)
        parts = _contributions(F.col("_products"), owners, features)
        encoded = encoded.withColumn("_products", products).select(spec.key, "_actual", parts.alias("_parts"))
    else:
        encoded = encoded.select(spec.key, "_actual", vector_to_array("features").alias("_parts"))
    folder = scratch_folder(test.sparkSession)
    encoded.write.parquet(folder)
    encoded = test.sparkSession.read.parquet(folder)
    rows = encoded.count()
    check(rows >= 2, "permutation importance needs at least two test rows")

    rows_in_order = encoded.select(spec.key, "_actual", F.col("_parts").alias("_own")).withColumn(
        "_order", hash_order(F.col(spec.key), f"{spec.seed}/rows")
    )
    repeats = F.explode(F.sequence(F.lit(0), F.lit(spec.importance_repeats - 1))).alias("repeat")
    donors = encoded.select(spec.key, F.col("_parts").alias("_donor"), repeats).withColumn(
        "_order",
        F.md5(F.concat(F.lit(f"{spec.seed}/donors/"), F.col("repeat"), F.lit(":"), F.col(spec.key))),
    )
    # The rows keep their places in all repeats, so they are placed once; only the donors change.
    placed = hash_positions(rows_in_order, [], "_order", spec.key, rows, "_place", spec.rows_per_bucket).select(
        "_place", "_actual", "_own"
    )
    given = hash_positions(
        donors, ["repeat"], "_order", spec.key, rows * spec.importance_repeats, "_place", spec.rows_per_bucket
    ).select("repeat", "_place", "_donor")
    met = placed.join(given, "_place")

    names = F.array(*[F.lit(name) for name in features])
    if linear:
        whole = _whole("_own", fitted.intercept)
        guesses = F.zip_with("_own", "_donor", lambda own, donor: F.col("_whole") - own + donor)
        variants = met.withColumn("_whole", whole).select("repeat", "_actual", F.posexplode(guesses).alias("_at", "_guess"))
        scored = variants.select("repeat", "_actual", names[F.col("_at")].alias("feature"), F.expm1("_guess").alias(PREDICTION))
        intact_guess = encoded.select("_actual", F.expm1(_whole("_parts", fitted.intercept)).alias(PREDICTION))
    else:
        owner_of = F.array(*[F.lit(features.index(owner)) for owner in owners])
        swapped = F.transform(
            "_own", lambda x, i: F.when(F.get(owner_of, i) == F.col("_at"), F.get(F.col("_donor"), i)).otherwise(x)
        )
        variants = met.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))))
        vectors = variants.select("repeat", "_actual", names[F.col("_at")].alias("feature"), array_to_vector(swapped).alias("features"))
        log_prediction = fitted.getPredictionCol()
        scored = fitted.transform(vectors).withColumn(PREDICTION, F.expm1(log_prediction))
        own = encoded.select("_actual", array_to_vector("_parts").alias("features"))
        intact_guess = fitted.transform(own).withColumn(PREDICTION, F.expm1(log_prediction))
    log_r2 = metric_columns(F.col("_actual"), F.col(PREDICTION))[-1]
    intact = intact_guess.agg(log_r2).first()["log_r2"]
    drop = F.lit(intact) - F.col("log_r2")
    return (
        scored.groupBy("feature", "repeat")
        .agg(log_r2)
        .groupBy("feature")
        .agg(F.avg(drop).alias("importance_mean"), F.stddev_pop(drop).alias("importance_std"))
        .withColumn("metric", F.lit("decrease_in_log_r2"))
        .orderBy(F.desc("importance_mean"), "feature")
    )
