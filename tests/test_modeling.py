import json

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel

from censusloom.errors import SurveyError
from censusloom.modeling import ModelSpec, train_and_select
from censusloom.modeling.evaluation import cv_summary, regression_metrics, tuning_summary
from censusloom.modeling.importance import permutation_importance
from censusloom.modeling.spec import FOREST_GRID, regressor


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(9)
    n = 800
    country = rng.choice(["rich", "middle", "poor"], n)
    years = rng.integers(0, 30, n).astype(float)
    base = pd.Series(country).map({"rich": 11.0, "middle": 10.0, "poor": 9.0}).to_numpy()
    frame = pd.DataFrame({
        "id": np.arange(n), "country": country, "years": years, "noise": rng.normal(size=n),
        "tools": np.where(rng.random(n) < 0.5, "A;B", "A"),
        "pay": np.exp(base + 0.03 * years + rng.normal(0, 0.2, n)),
    })
    frame.loc[:5, "pay"] = -1.0
    frame.loc[::9, "years"] = np.nan
    return spark.createDataFrame(frame)


def spec(**changes):
    settings = dict(
        target="pay", key="id", numeric=["years", "noise"], nominal=["country"], multiselect=["tools"], folds=3,
        forest={"n_estimators": 5, "max_depth": 4, "max_features": 0.6, "min_samples_leaf": 4},
        grid={"max_depth": [3, 5], "max_samples": [0.8, None]}, tuning_draws=2, importance_rows=None,
    )
    return ModelSpec(**{**settings, **changes})


@pytest.fixture(scope="module")
def result(people, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("model") / "m")
    return train_and_select(people, spec(), path), path


def test_metrics_row(result, people):
    row = result[0].metrics.first()
    assert len(row) == 26 and result[0].metrics.count() == 1
    assert row["train_rows_before_outlier_filter"] + row["test_rows_before_outlier_filter"] == people.where("pay > 0").count()
    assert row["test_rows"] <= row["test_rows_before_outlier_filter"]
    assert row["log_r2"] > 0.7 and row["mae"] < row["rmse"]
    assert row["tuning_candidate_count"] == 2 and row["cv_folds"] == 3


def test_the_lowest_mae_is_selected(result):
    rows = result[0].comparison.collect()
    assert len(rows) == 3
    assert rows[0]["model"] == result[0].metrics.first()["selected_model"]
    assert [r["cv_mae_mean"] for r in rows] == sorted(r["cv_mae_mean"] for r in rows)
    tuning = result[0].tuning.collect()
    assert [r["rank"] for r in tuning] == [1, 2]
    assert set(json.loads(tuning[0]["params"])) >= {"max_depth", "max_samples"}


def test_importance_finds_the_driver(result):
    rows = {r["feature"]: r["importance_mean"] for r in result[0].importance.collect()}
    assert set(rows) == {"years", "noise", "country", "tools"}
    assert rows["country"] == max(rows.values()) and rows["country"] > 0.3
    assert abs(rows["noise"]) < 0.05


def test_saved_model_predicts_the_same(result, people):
    back = PipelineModel.load(result[1])
    first = people.where("id < 50").orderBy("id")
    mine = [r["prediction"] for r in result[0].model.transform(first).collect()]
    assert [r["prediction"] for r in back.transform(first).collect()] == pytest.approx(mine)
    assert np.median(mine) > 1000  # on the scale of the target


def test_importance_does_not_depend_on_buckets(result, people):
    test = people.where("id >= 600 and pay > 0")
    one = permutation_importance(result[0].model, test, spec()).toPandas().set_index("feature")
    many = permutation_importance(result[0].model, test, spec(rows_per_bucket=20)).toPandas().set_index("feature")
    assert np.allclose(one.importance_mean.sort_index(), many.importance_mean.sort_index())
    limited = permutation_importance(result[0].model, test, spec(importance_rows=50)).toPandas()
    assert len(limited) == 4


def test_guards(people):
    with pytest.raises(SurveyError, match="numeric"):
        train_and_select(people, spec(numeric=[]))
    with pytest.raises(SurveyError, match="absent"):
        train_and_select(people, spec(nominal=["absent"]))
    with pytest.raises(SurveyError, match="at least 100"):
        train_and_select(people.limit(60), spec())


def test_draws_are_distinct_and_fixed():
    default = ModelSpec(target="y", key="k", numeric=["x"])
    draws = default.draws()
    assert len(draws) == 8 == len({json.dumps(d, sort_keys=True) for d in draws})
    assert draws == ModelSpec(target="y", key="k", numeric=["x"]).draws()
    assert all(d[name] in values for d in draws for name, values in FOREST_GRID.items())


def test_deepest_tree_is_capped(spark):
    forest = regressor("RandomForest", {**dict(n_estimators=1, max_depth=32, max_features=0.5, min_samples_leaf=1)}, 1, "l", "p")
    assert forest.getMaxDepth() == 30
    with pytest.raises(SurveyError):
        regressor("Other", {}, 1, "l", "p")


def test_metrics_of_known_errors(spark):
    df = spark.createDataFrame([(10.0, 12.0), (20.0, 16.0), (30.0, -1.0)], "y double, p double")
    row = regression_metrics(df, "y", "p").first()
    y, p = np.array([10.0, 20, 30]), np.array([12.0, 16, -1])
    assert row["mae"] == pytest.approx(np.abs(y - p).mean())
    assert row["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    ly, lp = np.log1p(y), np.log1p(np.maximum(p, 0))
    assert row["log_rmse"] == pytest.approx(np.sqrt(((ly - lp) ** 2).mean()))
    flat = regression_metrics(spark.createDataFrame([(1.0, 1.0)] * 3, "y double, p double"), "y", "p").first()
    assert flat["r2"] is None and flat["mae"] == 0.0


def test_deviations_over_folds(spark):
    rows = [("m", True, "{}", fold, mae, 1.0, 1.0, float(fold), 1.0) for fold, mae in enumerate([1.0, 2.0, 6.0])]
    df = spark.createDataFrame(
        rows, "model string, tuned boolean, params string, fold int, mae double, rmse double, r2 double, "
        "log_rmse double, log_r2 double",
    )
    summary = cv_summary(df).first()
    assert summary["cv_mae_std"] == pytest.approx(np.std([1, 2, 6], ddof=1))
    assert summary["cv_folds"] == 3
    assert tuning_summary(df).first()["std_log_rmse"] == pytest.approx(np.std([0, 1, 2]))
