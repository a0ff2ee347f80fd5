"""Spark ML stages that learn their parameters from the training rows only."""

from censusloom.encoding.categories import CategoryEncoder, CategoryEncoderModel
from censusloom.encoding.multiselect import MultiSelectEncoder, MultiSelectEncoderModel
from censusloom.encoding.numeric import NumericScaler, NumericScalerModel
from censusloom.encoding.ridge import RidgeRegression

__all__ = [
    "CategoryEncoder",
    "CategoryEncoderModel",
    "MultiSelectEncoder",
    "MultiSelectEncoderModel",
    "NumericScaler",
    "NumericScalerModel",
    "RidgeRegression",
]
