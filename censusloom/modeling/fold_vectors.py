"""Feature vectors of every fold from one coding of the rows.

The encoders of a fold differ from those of the others only in medians, scales and which labels
and tokens are common. So the rows are coded once for all folds: a number per numeric column, the
place of a label or token among those that may be common in some fold, 0 for all others. What a
fold has learned is known from the counts of :mod:`censusloom.modeling.ridge_path`, and its vector
is a short expression over the codes. Only the narrow codes are kept for the whole job; the vectors of
a fold are kept while several fits read them, and only up to ``KEPT_VALUES`` numbers at a time.

The vectors are dense, with one expression per position, so they are limited to ``MAX_POSITIONS``;
a wider job is left to the encoders, fitted fold by fold.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from censusloom.encoding.categories import _label
from censusloom.encoding.numeric import _usable_scale, filled_moments
from censusloom.functions.scalars import number
from censusloom.functions.tokens import MISSING, tokens
from censusloom.modeling.ridge_path import RawColumns, kept_labels
from censusloom.modeling.spec import ModelSpec

MAX_POSITIONS = 256
KEPT_VALUES = 750_000_000  # some 6 GB in all executors


def _texts(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def _places(found: Column, words: list[str]) -> Column:
    return F.transform(found, lambda token: F.array_position(_texts(words), token).cast("int"))


def coded_rows(train: DataFrame, spec: ModelSpec, raw: RawColumns) -> DataFrame:
    """Fold, target and the codes of all features; the rows stay in their order and partitions."""
    return train.select(
        F.col("fold").cast("int").alias("fold"),
        F.col(spec.target).cast("double").alias("target"),
        *[number(train, c).alias(f"n{i}") for i, c in enumerate(raw.numeric)],
        *[F.array_position(_texts(raw.labels[c]), _label(c)).cast("int").alias(f"l{i}") for i, c in enumerate(raw.nominal)],
        *[_places(tokens(F.col(c).cast("string")), raw.words[c]).alias(f"t{i}") for i, c in enumerate(raw.multiselect)],
    )


class FoldVectors:
    """What every fold has learned, as the expression of its feature vector over coded rows."""

    def __init__(self, coded: DataFrame, spec: ModelSpec, raw: RawColumns) -> None:
        self.spec, self.raw = spec, raw
        self.rows = {r["fold"]: r["count"] for r in coded.groupBy("fold").count().collect()}
        # Trees look at the last digit of a scaled value, so the moments are added up like the scaler's:
        # over the rows of a training part, not from those of its folds.
        others = F.array(*[F.lit(f) for f in range(raw.folds)])
        columns = [f"n{i}" for i in range(len(raw.numeric))]
        moments = [f(c).alias(f"{name}_{c}") for c in columns for name, f in (("n", F.count), ("mean", F.avg), ("var", F.var_pop))]
        inside = coded.select(F.explode(F.array_remove(others, F.col("fold"))).alias("out"), *columns)
        self.moments = {r["out"]: r.asDict() for r in inside.groupBy("out").agg(*moments).collect()} if moments else {}

    def _numeric(self, fold: int) -> list[Column]:
        total = sum(rows for f, rows in self.rows.items() if f != fold)
        values, flags = [], []
        for i, name in enumerate(self.raw.numeric):
            if name not in self.raw.medians[fold]:
                continue  # no value outside this fold
            median, row = self.raw.medians[fold][name], self.moments[fold]
            mean, variance, missing = filled_moments(row[f"n_n{i}"], row[f"mean_n{i}"], row[f"var_n{i}"], median, total)
            scale = _usable_scale(mean, variance, total)
            values.append((F.coalesce(F.col(f"n{i}"), F.lit(median)) - F.lit(mean)) / F.lit(scale))
            if missing:
                share = missing / total
                scale = _usable_scale(share, share * (1 - share), total)
                flags.append((F.col(f"n{i}").isNull().cast("double") - F.lit(share)) / F.lit(scale))
        return [*values, *flags]

    def _nominal(self, fold: int) -> list[Column]:
        positions = []
        for i, name in enumerate(self.raw.nominal):
            kept, bucketed = kept_labels(self.raw, self.spec, name, fold)
            others = self.raw.other_rows[name].sum() - self.raw.other_rows[name][fold]
            code = F.col(f"l{i}")
            positions += [(code == place + 1).cast("double") for place in kept]
            if bucketed or others > 0:
                positions.append((~code.isin([place + 1 for place in kept])).cast("double"))
        return positions

    def _multiselect(self, fold: int) -> list[Column]:
        positions = []
        for i, name in enumerate(self.raw.multiselect):
            common = self.raw.common_words(name, fold, self.spec.min_token_rows)
            codes = F.col(f"t{i}")
            positions += [F.array_contains(codes, int(place) + 1).cast("double") for place in np.flatnonzero(common)]
            rare = [0, *[int(place) + 1 for place in np.flatnonzero(~common)]]
            positions.append(F.arrays_overlap(codes, F.array(*[F.lit(code) for code in rare])).cast("double"))
        return positions

    def fit_in_memory(self, side_by_side: int) -> bool:
        """Whether the vectors of so many training parts together stay under ``KEPT_VALUES``."""
        largest = sum(self.rows.values()) - min(self.rows.values(), default=0)
        return side_by_side * largest * self.raw.width <= KEPT_VALUES

    def features(self, fold: int) -> Column:
        """The vector that the encoders would give when fitted on all other folds."""
        positions = [*self._numeric(fold), *self._nominal(fold), *self._multiselect(fold)]
        return array_to_vector(F.array(*positions) if positions else F.array().cast("array<double>"))
