"""Ridge regression with the usual penalty, alpha times the squared coefficients."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from censusloom.errors import check

# Beyond this width Spark's exact normal-equation solver is not available.
_NORMAL_LIMIT = 4096


class RidgeRegression(
    Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable
):
    """Fits a Spark linear regression whose penalty equals ``alpha * |w|^2``.

    Spark divides its penalty by the label's standard deviation and averages the
    squared error over rows, so ``regParam`` has to be ``alpha * std / rows``.
    """

    alpha = Param(Params._dummy(), "alpha", "weight of the squared coefficients", TypeConverters.toFloat)

    @keyword_only
    def __init__(
        self,
        *,
        featuresCol: str = "features",
        labelCol: str = "label",
        predictionCol: str = "prediction",
        alpha: float = 1.0,
    ):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", alpha=1.0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> LinearRegressionModel:
        label = self.getLabelCol()
        facts = dataset.agg(
            F.count(F.lit(1)).alias("n"),
            F.stddev_pop(label).alias("population"),
            F.stddev_samp(label).alias("sample"),
        ).first()
        check(facts["n"] >= 2, "ridge regression needs at least two rows")
        width = len(dataset.select(self.getFeaturesCol()).first()[0])
        normal = width <= _NORMAL_LIMIT
        spread = facts["population"] if normal else facts["sample"]
        return LinearRegression(
            featuresCol=self.getFeaturesCol(),
            labelCol=label,
            predictionCol=self.getPredictionCol(),
            regParam=self.getOrDefault(self.alpha) * (spread or 1.0) / facts["n"],
            elasticNetParam=0.0,
            standardization=False,
            solver="normal" if normal else "l-bfgs",
        ).fit(dataset)
