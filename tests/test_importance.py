import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from censusloom.modeling import ModelSpec
from censusloom.modeling.evaluation import metric_columns
from censusloom.modeling.importance import feature_owners, permutation_importance
from censusloom.modeling.selection import PREDICTION, fit_final
from censusloom.operators.ranks import hash_order


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    n = 500
    frame = pd.DataFrame({
        "id": np.arange(n), "place": rng.choice(["a", "b", "c", "d"], n, p=[0.4, 0.3, 0.27, 0.03]),
        "years": rng.integers(0, 30, n).astype(float), "none": np.nan, "tools": rng.choice(["A;B", "A", "C;D", ""], n),
    })
    frame["pay"] = np.exp(9 + 0.05 * frame.years + (frame.place == "a") + rng.normal(0, 0.2, n))
    frame.loc[::7, "years"] = np.nan
    return spark.createDataFrame(frame).replace(float("nan"), None)


def spec(**changes):
    settings = dict(
        target="pay", key="id", numeric=["years", "none"], nominal=["place"], multiselect=["tools"], min_label_rows=20,
        min_token_rows=30, importance_rows=None, importance_repeats=2,
    )
    return ModelSpec(**{**settings, **changes})


def plainly(model, test, job):
    """Every variant as a raw row of its own, encoded and scored as a whole."""
    rows = test.toPandas()
    log_r2 = metric_columns(F.col(job.target), F.col(PREDICTION))[-1]
    intact = model.transform(test).agg(log_r2).first()[0]
    drops = {}
    hashed = test.select("id", hash_order(F.col("id"), f"{job.seed}/rows").alias("h")).toPandas().sort_values(["h", "id"]).id
    for repeat in range(job.importance_repeats):
        donor = test.select("id", F.md5(F.concat(F.lit(f"{job.seed}/donors/{repeat}:"), F.col("id"))).alias("h")).toPandas()
        given = donor.sort_values(["h", "id"]).id
        partner = dict(zip(hashed, given, strict=True))
        for name in job.features:
            swapped = rows.copy().set_index("id")
            swapped[name] = [rows.set_index("id")[name][partner[i]] for i in swapped.index]
            frame = swapped.reset_index().astype(object).where(lambda f: f.notna(), None)
            variant = test.sparkSession.createDataFrame(frame, test.schema)
            drops.setdefault(name, []).append(intact - model.transform(variant).agg(log_r2).first()[0])
    return {name: (np.mean(d), np.std(d)) for name, d in drops.items()}


@pytest.mark.parametrize("kind", ["Ridge", "RandomForest"])
def test_partial_scoring_equals_whole_rows(rows, kind):
    job = spec()
    parameters = {"alpha": 1.0} if kind == "Ridge" else {"n_estimators": 4, "max_depth": 4, "max_features": 0.6, "min_samples_leaf": 4}
    train, test = rows.where("id % 4 <> 0"), rows.where("id % 4 = 0")
    model = fit_final(train, job, kind, parameters)
    found = {r["feature"]: (r["importance_mean"], r["importance_std"]) for r in permutation_importance(model, test, job).collect()}
    expected = plainly(model, test, job)
    assert found.keys() == expected.keys()
    for name in expected:
        assert found[name] == pytest.approx(expected[name], abs=1e-9), name
    assert found["none"] == pytest.approx((0.0, 0.0), abs=1e-12) and found["place"][0] > 0.1


def test_every_position_has_an_owner(rows):
    job = spec()
    model = fit_final(rows, job, "Ridge", {"alpha": 1.0})
    owners = feature_owners(model)
    assert len(owners) == model.stages[-2].numFeatures
    assert owners == ["years", "years", "place", "place", "place", "place", *["tools"] * (owners.count("tools"))]


def test_only_donors_are_repeated(rows):
    job = spec()
    found = permutation_importance(fit_final(rows, job, "Ridge", {"alpha": 1.0}), rows, job)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(") == 1
