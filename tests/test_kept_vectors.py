import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from censusloom.modeling import ModelSpec, fold_vectors, ridge_path, selection
from censusloom.modeling.selection import cross_validate


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    n = 300
    frame = pd.DataFrame({
        "id": np.arange(n), "fold": np.arange(n) % 3, "country": rng.choice(["a", "b", "c", None], n, p=[0.6, 0.3, 0.02, 0.08]),
        "years": rng.gamma(2.0, 5.0, n).round(), "tools": ["A;B", " A ; C", "", ";;", "B", f"x{n}"] * (n // 6),
        "pay": np.exp(rng.normal(10, 1, n)),
    })
    frame.loc[::7, "years"] = np.nan
    frame.loc[::11, "tools"] = None
    return spark.createDataFrame(frame).replace(float("nan"), None).repartition(3, "id")


SPEC = ModelSpec(
    target="pay", key="id", numeric=["years"], nominal=["country"], multiselect=["tools"], folds=3, min_label_rows=8, min_token_rows=40
)


def candidates(*depths):
    forests = {f"f{d}": (f"F{d}", False, "RandomForest", {"n_estimators": 2, "max_depth": d, "max_features": 0.6, "min_samples_leaf": 4}) for d in depths}
    return {"r": ("R", False, "Ridge", {"alpha": 1.0}), **forests}


def figures(found):
    return {(r["model"], r["fold"]): tuple(r[m] for m in selection.METRICS) for r in found.collect()}


@pytest.fixture
def kept(rows, monkeypatch):
    """The columns of every table that is persisted."""
    seen, persist = [], type(rows).persist

    def noted(self, *level):
        seen.append(self.columns)
        return persist(self, *level)

    monkeypatch.setattr(type(rows), "persist", noted)
    return seen


@pytest.mark.parametrize("depths, limit, expected", [((2, 3), None, 3), ((2, 3), 10, 0), ((2,), None, 0)])
def test_vectors_read_by_several_fits_are_kept_up_to_a_size(rows, kept, monkeypatch, depths, limit, expected):
    if limit:
        monkeypatch.setattr(fold_vectors, "KEPT_VALUES", limit)
    found = figures(cross_validate(rows, SPEC, candidates(*depths)))
    assert len(found) == 3 * (1 + len(depths))
    assert sum("features" in columns for columns in kept) == expected
    monkeypatch.setattr(fold_vectors, "KEPT_VALUES", 0)
    assert found == figures(cross_validate(rows, SPEC, candidates(*depths)))


def test_the_ridge_path_reads_the_codes(rows, monkeypatch):
    raw = ridge_path.learn(rows, SPEC)
    texts = ridge_path.ridge_path(rows, SPEC, [0.5, 1.0], raw)
    codes = ridge_path.ridge_path(rows, SPEC, [0.5, 1.0], raw, fold_vectors.coded_rows(rows, SPEC, raw))
    by_fold = lambda found: sorted(found, key=lambda r: r["fold"])
    assert by_fold(codes) == by_fold(texts)
    monkeypatch.setattr(ridge_path, "_rows_for_tasks", lambda *_: pytest.fail("the texts were read again"))
    found = figures(cross_validate(rows, SPEC, candidates()))
    assert len(found) == 3
    for r in texts:
        assert found["R", r["fold"]] == pytest.approx([r[f"p1_{m}"] for m in selection.METRICS], rel=1e-9)


def test_words_and_labels_are_counted_once(rows, kept):
    ridge_path.learn(rows.where(F.col("fold") >= 0), SPEC)
    assert sum(columns[:2] == ["column", "entry"] for columns in kept) == 2
