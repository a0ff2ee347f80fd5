"""Ridge candidates of a cross-validation from one pass of sums.

Every fold learns its own medians, scales and vocabularies from the other folds. Still, all of
its features are linear in a few *raw* columns that no fold changes: the value and a missing
flag of each numeric column, one 0/1 column per label that may be common in some fold, and one
for all labels that are rare in each. The products of raw columns, summed per fold in one
pass, therefore hold all that a ridge regression needs: the sums of a training part are the
total less one fold, and a small matrix turns raw sums into those of the fold's own features.
So all penalties of all folds take one pass of sums, small solves on the driver, and one pass
that scores. Only a multi-select answer's position for rare tokens is no sum; it gets one raw
column per fold.

The raw columns are at most ``MAX_WIDTH``: the sums are folds x width x width numbers. A wider
job is left to the estimator that fits fold by fold.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from censusloom.encoding.categories import _label
from censusloom.encoding.numeric import _usable_scale
from censusloom.errors import check
from censusloom.functions.scalars import number
from censusloom.functions.tokens import MISSING, tokens
from censusloom.modeling.evaluation import metric_columns
from censusloom.modeling.spec import ModelSpec
from censusloom.operators.quantiles import counted_quantiles

MAX_WIDTH = 1024
_CHUNK_ROWS = 2048


@dataclass
class RawColumns:
    """What the raw columns mean, and what each fold's training part has learned."""

    numeric: list[str]
    nominal: list[str]
    multiselect: list[str]
    shift: np.ndarray
    unit: np.ndarray
    medians: list[dict[str, float]]  # by fold
    labels: dict[str, list[str]]
    label_rows: dict[str, np.ndarray]  # labels x folds
    other_rows: dict[str, np.ndarray]  # rows with labels that are rare everywhere, by fold
    words: dict[str, list[str]]
    word_rows: dict[str, np.ndarray]
    folds: int

    def __post_init__(self) -> None:
        self.at: dict[tuple[str, str], int] = {}
        position = 1  # 0 is the constant
        for name in self.numeric:
            self.at["value", name], self.at["missing", name] = position, position + 1
            position += 2
        for name in self.nominal:
            self.at["labels", name] = position
            position += len(self.labels[name])
            self.at["other", name] = position
            position += 1
        for name in self.multiselect:
            self.at["words", name] = position  # MISSING is the last of the words
            position += len(self.words[name])
            self.at["rare", name] = position
            position += self.folds
        self.width = position

    def common_words(self, name: str, fold: int, minimum: int) -> np.ndarray:
        rows = self.word_rows[name]
        common = rows.sum(1) - rows[:, fold] >= minimum
        return common | (np.array(self.words[name], object) == MISSING)


def _counts_by_fold(folds: int) -> list:
    return [F.sum(F.when(F.col("fold") == f, F.col("rows")).otherwise(0)).alias(f"f{f}") for f in range(folds)]


def learn(train: DataFrame, spec: ModelSpec, max_width: int = MAX_WIDTH) -> RawColumns | None:
    """Medians and counts by fold, each from one grouped pass; None where the width is too large."""
    folds = spec.folds
    numeric = list(spec.numeric)
    values = train.select("fold", *[number(train, c).alias(c) for c in numeric])
    statistics = [F.avg(c).alias(f"m{i}") for i, c in enumerate(numeric)]
    statistics += [F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(numeric)]
    facts = values.agg(*statistics).first() if statistics else {}
    numeric = [c for i, c in enumerate(numeric) if facts[f"m{i}"] is not None]
    place = {c: i for i, c in enumerate(spec.numeric)}
    shift = np.array([facts[f"m{place[c]}"] for c in numeric])
    unit = np.array([facts[f"s{place[c]}"] or 1.0 for c in numeric])
    medians: list[dict[str, float]] = [{} for _ in range(folds)]
    if numeric:
        # Equal values are counted by fold once; only the counts are repeated for the parts without one fold.
        long = values.unpivot(["fold"], numeric, "column", "x").where("x IS NOT NULL")
        by_fold = long.groupBy("column", "x").agg(*[F.count_if(F.col("fold") == f).alias(f"f{f}") for f in range(folds)])
        total = sum((F.col(f"f{f}") for f in range(folds)), F.lit(0))
        parts = F.array(*[F.struct(F.lit(f).alias("out"), (total - F.col(f"f{f}")).alias("_count")) for f in range(folds)])
        counts = by_fold.select("column", "x", F.inline(parts)).where("_count > 0").persist(StorageLevel.MEMORY_AND_DISK)
        found = counted_quantiles(counts, ["out", "column"], "x", {"median": 0.5}, spec.rows_per_bucket)
        for row in found.collect():  # folds x numeric columns
            medians[row["out"]][row["column"]] = row["median"]
        counts.unpersist()

    def vocabulary(long: DataFrame, minimum: int, columns: Sequence[str], always: str | None):
        """Entries with ``minimum`` rows overall, and the rows of all others, by column and fold."""
        counted = long.groupBy("column", "entry", "fold").agg(F.count(F.lit(1)).alias("rows"))
        # Read twice; the rows are counted once.
        wide = counted.groupBy("column", "entry").agg(*_counts_by_fold(folds)).persist(StorageLevel.MEMORY_AND_DISK)
        total = sum((F.col(f"f{f}") for f in range(folds)), F.lit(0))
        often = (total >= minimum) | F.col("entry").eqNullSafe(F.lit(always))
        kept = wide.where(often).limit(max_width + 1).collect()
        if len(kept) > max_width:
            wide.unpersist()
            return None
        rest = wide.where(~often).groupBy("column").agg(*[F.sum(f"f{f}").alias(f"f{f}") for f in range(folds)]).collect()
        wide.unpersist()
        entries: dict[str, list[str]] = {c: [] for c in columns}
        rows: dict[str, list[list[int]]] = {c: [] for c in columns}
        for r in sorted(kept, key=lambda r: (r["column"], r["entry"] == always, r["entry"])):
            entries[r["column"]].append(r["entry"])
            rows[r["column"]].append([r[f"f{f}"] for f in range(folds)])
        arrays = {c: np.array(rows[c], float).reshape(len(rows[c]), folds) for c in columns}
        rare = {c: np.zeros(folds) for c in columns}
        for r in rest:
            rare[r["column"]] = np.array([r[f"f{f}"] for f in range(folds)], float)
        return entries, arrays, rare

    labels, label_rows, other_rows, words, word_rows = {}, {}, {}, {}, {}
    if spec.nominal:
        named = train.select("fold", *[_label(c).alias(c) for c in spec.nominal])
        found = vocabulary(named.unpivot(["fold"], list(spec.nominal), "column", "entry"), spec.min_label_rows, spec.nominal, None)
        if found is None:
            return None
        labels, label_rows, other_rows = found
    if spec.multiselect:
        lists = train.select("fold", *[tokens(F.col(c).cast("string")).alias(c) for c in spec.multiselect])
        long = lists.unpivot(["fold"], list(spec.multiselect), "column", "list").select("fold", "column", F.explode("list").alias("entry"))
        found = vocabulary(long, spec.min_token_rows, spec.multiselect, MISSING)
        if found is None:
            return None
        words, word_rows, _ = found
        for name in spec.multiselect:
            if MISSING not in words[name]:
                words[name].append(MISSING)
                word_rows[name] = np.vstack([word_rows[name], np.zeros((1, folds))])
    raw = RawColumns(
        numeric, list(spec.nominal), list(spec.multiselect), shift, unit, medians,
        labels, label_rows, other_rows, words, word_rows, folds,
    )
    return raw if raw.width <= max_width else None


def _rows_for_tasks(train: DataFrame, spec: ModelSpec, raw: RawColumns) -> DataFrame:
    return train.select(
        F.col("fold").cast("int").alias("fold"),
        F.col(spec.target).cast("double").alias("target"),
        *[number(train, c).alias(f"n{i}") for i, c in enumerate(raw.numeric)],
        *[_label(c).alias(f"l{i}") for i, c in enumerate(raw.nominal)],
        *[tokens(F.col(c).cast("string")).alias(f"t{i}") for i, c in enumerate(raw.multiselect)],
    )


def _encoder(raw: RawColumns, minimum: int):
    """A function from Arrow batches to (chunk, dense raw columns), in chunks of bounded size.

    It is nested and holds plain values only, so that it travels to executors by value.
    """
    width, folds, at, chunk_rows = raw.width, raw.folds, dict(raw.at), _CHUNK_ROWS
    numeric, nominal, multiselect = list(raw.numeric), list(raw.nominal), list(raw.multiselect)
    shift, unit = raw.shift, raw.unit
    sets = {c: pa.array(raw.labels[c], pa.string()) for c in nominal}
    word_sets = {c: pa.array(raw.words[c], pa.string()) for c in multiselect}
    common = {(c, f): raw.common_words(c, f, minimum) for c in multiselect for f in range(folds)}

    def places(values: pa.Array, known: pa.Array, otherwise: int) -> np.ndarray:
        if pa.types.is_integer(values.type):  # coded already: the place plus 1, 0 for all others
            codes = values.to_numpy(zero_copy_only=False)
            return np.where(codes > 0, codes - 1, otherwise)
        return pc.fill_null(pc.index_in(values, known), otherwise).to_numpy(zero_copy_only=False)

    def encode(batch: pa.RecordBatch) -> np.ndarray:
        size = batch.num_rows
        block = np.zeros((size, width))
        block[:, 0] = 1.0
        for i, c in enumerate(numeric):
            x = batch.column(f"n{i}").to_numpy(zero_copy_only=False).astype(float)
            missing = np.isnan(x)
            block[:, at["value", c]] = np.where(missing, 0.0, (x - shift[i]) / unit[i])
            block[:, at["missing", c]] = missing
        for i, c in enumerate(nominal):
            # The column after the labels is that of all other labels.
            block[np.arange(size), at["labels", c] + places(batch.column(f"l{i}"), sets[c], len(sets[c]))] = 1.0
        for i, c in enumerate(multiselect):
            lists = batch.column(f"t{i}")
            owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            place = places(pc.list_flatten(lists), word_sets[c], -1)
            known = place >= 0
            block[owner[known], at["words", c] + place[known]] = 1.0
            for f in range(folds):
                rare = ~(known & common[c, f][np.maximum(place, 0)])
                block[owner[rare], at["rare", c] + f] = 1.0
        return block

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for batch in batches:
            for start in range(0, batch.num_rows, chunk_rows):
                part = batch.slice(start, chunk_rows)
                yield part, encode(part)

    return chunks


def _sums(rows: DataFrame, raw: RawColumns, minimum: int) -> tuple[np.ndarray, np.ndarray]:
    """Per fold: products of raw columns with each other and with the log target."""
    chunks, folds, width = _encoder(raw, minimum), raw.folds, raw.width

    def reduce_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((folds, width + 1, width))  # the last row holds the products with the target
        for batch, block in chunks(batches):
            y = np.log1p(batch.column("target").to_numpy(zero_copy_only=False))
            of = batch.column("fold").to_numpy(zero_copy_only=False)
            for f in np.unique(of):
                mine = block[of == f]
                sums[f, :width] += mine.T @ mine
                sums[f, width] += mine.T @ y[of == f]
        for f in range(folds):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(width + 1, f, np.int32)),
                    pa.array(np.arange(width + 1, dtype=np.int32)),
                    pa.FixedSizeListArray.from_arrays(pa.array(sums[f].ravel()), width).cast(pa.list_(pa.float64())),
                ],
                names=["fold", "line", "sums"],
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines of one (fold, row of the matrix) follow each other: add them up."""
        held, total = None, np.zeros(width)

        def out() -> pa.RecordBatch:
            line = pa.array([total.tolist()], pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int32()), pa.array([held[1]], pa.int32()), line], ["fold", "line", "sums"])

        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            lines = pc.list_flatten(batch.column(2)).to_numpy().reshape(-1, width)
            for key, line in zip(keys, lines, strict=True):
                if key != held:
                    if held is not None:
                        yield out()
                    held, total = key, np.zeros(width)
                total = total + line
        if held is not None:
            yield out()

    schema = "fold int, line int, sums array<double>"
    partial = rows.mapInArrow(reduce_task, schema)
    lines = partial.repartition("fold", "line").sortWithinPartitions("fold", "line").mapInArrow(add, schema)
    # folds x (width + 1) lines of ``width`` numbers.
    products, with_target = np.zeros((folds, width, width)), np.zeros((folds, width))
    for row in lines.collect():
        if row["line"] < width:
            products[row["fold"], row["line"]] = row["sums"]
        else:
            with_target[row["fold"]] = row["sums"]
    return products, with_target


def kept_labels(raw: RawColumns, spec: ModelSpec, name: str, fold: int) -> tuple[list[int], bool]:
    """Places of the labels that are common outside ``fold``, and whether others of these labels share a bucket."""
    counts = raw.label_rows[name].sum(1) - raw.label_rows[name][:, fold]
    found = [(n, label, i) for i, (n, label) in enumerate(zip(counts, raw.labels[name], strict=True)) if n >= spec.min_label_rows]
    crowded = len(found) > spec.max_labels - 1
    kept = sorted(i for _, _, i in sorted(found, key=lambda e: (e[0], e[1].encode()), reverse=True)[: spec.max_labels - 1])
    return kept, bool(crowded or any(0 < n < spec.min_label_rows for n in counts))


def _features(raw: RawColumns, spec: ModelSpec, fold: int, products: np.ndarray) -> np.ndarray:
    """The matrix that turns raw columns into the features this fold learns from the others."""
    inside = products.sum(0) - products[fold]
    rows = inside[0, 0]
    columns: list[np.ndarray] = []

    def column() -> np.ndarray:
        return np.zeros(raw.width)

    def scaled(made: np.ndarray) -> np.ndarray:
        mean = inside[0] @ made / rows
        made = made.copy()
        made[0] -= mean
        variance = max(float(made @ inside @ made) / rows, 0.0)
        return made / _usable_scale(mean, variance, rows)

    for i, name in enumerate(raw.numeric):
        if name not in raw.medians[fold]:
            continue  # no value outside this fold
        made = column()
        made[raw.at["value", name]] = raw.unit[i]
        made[raw.at["missing", name]] = raw.medians[fold][name] - raw.shift[i]
        columns.append(scaled(made))
        if inside[0, raw.at["missing", name]] > 0:
            flag = column()
            flag[raw.at["missing", name]] = 1.0
            columns.append(scaled(flag))
    for name in raw.nominal:
        kept, bucketed = kept_labels(raw, spec, name, fold)
        bucket = column()
        for i in range(len(raw.labels[name])):
            if i in kept:
                made = column()
                made[raw.at["labels", name] + i] = 1.0
                columns.append(made)
            else:
                bucket[raw.at["labels", name] + i] = 1.0
        bucket[raw.at["other", name]] = 1.0
        if bucketed:
            columns.append(bucket)
    for name in raw.multiselect:
        for i in np.flatnonzero(raw.common_words(name, fold, spec.min_token_rows)):
            made = column()
            made[raw.at["words", name] + i] = 1.0
            columns.append(made)
        made = column()
        made[raw.at["rare", name] + fold] = 1.0
        columns.append(made)
    return np.array(columns).T.reshape(raw.width, len(columns))


def _solve(products: np.ndarray, with_target: np.ndarray, turn: np.ndarray, alphas: Sequence[float]) -> np.ndarray:
    """Coefficients of the raw columns, one column per penalty; the intercept is that of column 0."""
    rows = products[0, 0]
    mean = products[0] @ turn / rows
    centred = turn.T @ products @ turn - rows * np.outer(mean, mean)
    mean_y = with_target[0] / rows
    target = turn.T @ with_target - rows * mean * mean_y
    out = np.zeros((len(products), len(alphas)))
    for i, alpha in enumerate(alphas):
        penalised = centred + alpha * np.eye(len(centred))
        w = np.linalg.solve(penalised, target) if alpha > 0 else np.linalg.lstsq(penalised, target, rcond=None)[0]
        out[:, i] = turn @ w
        out[0, i] += mean_y - mean @ w
    return out


def ridge_path(
    train: DataFrame, spec: ModelSpec, alphas: Sequence[float], raw: RawColumns, coded: DataFrame | None = None
) -> list[dict]:
    """Metrics of every penalty on every fold: dicts with fold, position of the penalty, metrics.

    ``train`` has the columns of ``spec`` and ``fold``. The result equals that of fitting the
    encoders and a ridge regression on each training part, up to rounding. ``raw`` is what
    :func:`learn` found in ``train``. Where the rows are coded already (``coded``, see
    :mod:`censusloom.modeling.fold_vectors`), both passes read the codes instead of the texts.
    """
    check(all(a >= 0 for a in alphas), "a penalty must not be negative")
    rows = coded if coded is not None else _rows_for_tasks(train, spec, raw)
    products, with_target = _sums(rows, raw, spec.min_token_rows)
    weights = []
    for fold in range(spec.folds):
        turn = _features(raw, spec, fold, products)
        inside, inside_target = products.sum(0) - products[fold], with_target.sum(0) - with_target[fold]
        check(inside[0, 0] >= 2, "ridge regression needs at least two rows")
        weights.append(_solve(inside, inside_target, turn, alphas))
    weights = np.array(weights)
    chunks, penalties = _encoder(raw, spec.min_token_rows), len(alphas)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in chunks(batches):
            of = batch.column("fold").to_numpy(zero_copy_only=False)
            found = np.zeros((batch.num_rows, penalties))
            for f in np.unique(of):
                found[of == f] = block[of == f] @ weights[f]
            yield pa.RecordBatch.from_arrays(
                [batch.column("fold"), batch.column("target"), *[pa.array(found[:, i]) for i in range(penalties)]],
                ["fold", "target", *[f"p{i}" for i in range(penalties)]],
            )

    scored = rows.mapInArrow(score, "fold int, target double, " + ", ".join(f"p{i} double" for i in range(len(alphas))))
    metrics = [m for i in range(len(alphas)) for m in metric_columns(F.col("target"), F.expm1(f"p{i}"), prefix=f"p{i}_")]
    return [row.asDict() for row in scored.groupBy("fold").agg(*metrics).collect()]
