"""Holdout evaluation, cross-validated model selection and permutation importance."""

from censusloom.modeling.spec import ModelSpec
from censusloom.modeling.training import TrainingResult, train_and_select

__all__ = ["ModelSpec", "TrainingResult", "train_and_select"]
