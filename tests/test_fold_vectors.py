import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from censusloom.modeling import ModelSpec, fold_vectors, selection
from censusloom.modeling.ridge_path import learn
from censusloom.modeling.selection import cross_validate
from censusloom.modeling.spec import regressor
from censusloom.operators.quantiles import counted_quantiles, grouped_quantiles


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    n = 600
    frame = pd.DataFrame({
        "id": np.arange(n), "fold": np.arange(n) % 3, "country": rng.choice(["a", "b", "c", "d", "e"], n, p=[0.5, 0.3, 0.14, 0.04, 0.02]),
        "size": [None if i % 13 == 0 else str(i % 45) for i in range(n)],
        "years": rng.gamma(2.0, 5.0, n).round(), "flat": 3.0, "none": np.nan,
        "once": [float(i) if i % 3 == 1 else np.nan for i in range(n)],  # no value outside fold 1
        "tools": ["A;B", " A ; C", "", "D;E;F", ";;", "B"] * (n // 6),
        "langs": [f"x{i % 9};rare{i}" for i in range(n)],
        "pay": np.exp(rng.normal(10, 1, n)),
    })
    frame.loc[::7, "years"] = np.nan
    frame.loc[::11, "tools"] = None
    found = spark.createDataFrame(frame).replace(float("nan"), None)
    return found.unionByName(found.where("id % 50 = 0")).repartition(4, "id")  # keys may repeat


def spec(**changes):
    settings = dict(
        target="pay", key="id", numeric=["years", "flat", "none", "once"], nominal=["country", "size"],
        multiselect=["tools", "langs"], folds=3, min_label_rows=18, max_labels=20, min_token_rows=46,
    )
    return ModelSpec(**{**settings, **changes})


def forests():
    parameters = {"n_estimators": 3, "max_depth": 3, "max_features": 0.6, "min_samples_leaf": 4}
    return {"f": ("F", False, "RandomForest", parameters)}


@pytest.mark.parametrize("changes", [{}, {"max_labels": 4}, {"nominal": []}, {"multiselect": []}, {"min_label_rows": 1}, {"rows_per_bucket": 50}])
def test_vectors_are_those_of_encoders_fitted_on_the_other_folds(rows, changes):
    job = spec(**changes)
    raw = learn(rows, job)
    coded = fold_vectors.coded_rows(rows, job, raw).persist()
    vectors = fold_vectors.FoldVectors(coded, job, raw)
    for fold in range(3):
        encoder = selection.preprocessor(job).fit(rows.where(F.col("fold") != fold))
        expected = encoder.transform(rows).select("features", "pay").collect()
        found = coded.select(vectors.features(fold).alias("features"), "target").collect()
        assert [r["target"] for r in found] == [r["pay"] for r in expected]  # the same order too
        # To the last digit: cut points between close values, and so the trees, depend on it.
        assert np.array_equal([r["features"].toArray() for r in found], [r["features"].toArray() for r in expected])
    coded.unpersist()


def test_forests_fit_no_encoder_per_fold(rows, monkeypatch):
    job = spec(min_label_rows=1)
    with monkeypatch.context() as patched:
        patched.setattr(selection, "preprocessor", lambda spec: pytest.fail("an encoder was fitted"))
        one = {r["fold"]: r["mae"] for r in cross_validate(rows, job, forests()).collect()}
    monkeypatch.setattr(selection, "MAX_POSITIONS", 0)
    each = {r["fold"]: r["mae"] for r in cross_validate(rows, job, forests()).collect()}
    assert one == pytest.approx(each, rel=1e-9) and len(one) == 3


def test_large_folds_run_one_after_the_other(rows, monkeypatch):
    workers = []
    pool = selection.ThreadPoolExecutor
    monkeypatch.setattr(selection, "ThreadPoolExecutor", lambda max_workers: workers.append(max_workers) or pool(max_workers))
    for limit in (rows.count() * 2, 10):
        monkeypatch.setattr(selection, "SIDE_BY_SIDE_ROWS", limit)
        assert cross_validate(rows, spec(), forests()).count() == 3
    assert workers == [2, 1]


@pytest.mark.parametrize("depth, kept", [(5, False), (24, True)])
def test_only_deep_trees_keep_a_table_of_nodes(spark, depth, kept):
    forest = regressor("RandomForest", {"n_estimators": 2, "max_depth": depth, "max_features": 0.5, "min_samples_leaf": 1}, 1, "l", "p")
    assert forest.getCacheNodeIds() is kept


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 7])
def test_quantiles_of_counted_values(spark, rows_per_bucket):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"g": rng.integers(0, 3, 400), "x": rng.integers(0, 60, 400).astype(float)})
    plain = spark.createDataFrame(frame)
    counts = plain.groupBy("g", "x").agg(F.count(F.lit(1)).alias("_count"))
    shares = {"low": 0.25, "median": 0.5}
    found = counted_quantiles(counts, ["g"], "x", shares, rows_per_bucket)
    expected = grouped_quantiles(plain, ["g"], "x", shares)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
