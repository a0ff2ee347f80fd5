import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from censusloom.encoding import CategoryEncoder, MultiSelectEncoder, NumericScaler, RidgeRegression
from censusloom.errors import SurveyError
from censusloom.functions.tokens import INFREQUENT, MISSING, keep_common
from workloads import encoding


def vectors(df, column):
    return [row[0] for row in df.select(vector_to_array(column)).collect()]


def test_scaler_uses_median_flags_and_population_deviation(spark):
    df = spark.createDataFrame(
        [(1.0, 5.0, None), (2.0, 5.0, None), (None, 5.0, None), (9.0, 5.0, None)], "a double, flat double, none double"
    )
    model = NumericScaler(inputCols=["a", "flat", "none"], outputCol="v").fit(df)
    assert model.feature_names() == ["a", "flat", "a is missing"]
    filled = np.array([1.0, 2.0, 2.0, 9.0])
    flags = np.array([0.0, 0.0, 1.0, 0.0])
    expected = np.column_stack([(filled - filled.mean()) / filled.std(), np.zeros(4), (flags - 0.25) / flags.std()])
    assert np.allclose(vectors(model.transform(df), "v"), expected)
    # A column complete at fit time has no flag, but its gaps are filled.
    gap = spark.createDataFrame([(1.0, None, None)], "a double, flat double, none double")
    assert vectors(model.transform(gap), "v")[0][1] == 0.0


def test_categories_cap_ties_and_unknowns(spark):
    labels = ["a"] * 5 + ["b"] * 4 + ["c"] * 4 + ["d"] * 4 + ["e"]
    df = spark.createDataFrame([(x, "same") for x in labels], "g string, full string")
    model = CategoryEncoder(inputCols=["g", "full"], outputCol="v", minFrequency=4, maxCategories=4).fit(df)
    # Of four common labels three fit beside the bucket; on a tie the later label stays.
    assert model.feature_names() == ["g=a", "g=c", "g=d", f"g={INFREQUENT}", "full=same"]
    new = spark.createDataFrame([("a", "same"), ("b", "new"), ("zzz", None), (None, "same")], "g string, full string")
    assert vectors(model.transform(new), "v") == [
        [1, 0, 0, 0, 1], [0, 0, 0, 1, 0], [0, 0, 0, 1, 0], [0, 0, 0, 1, 1],
    ]


def test_missing_is_a_label(spark):
    df = spark.createDataFrame([(None,)] * 3 + [("x",)] * 3, "g string")
    model = CategoryEncoder(inputCols=["g"], outputCol="v", minFrequency=2).fit(df)
    assert model.feature_names() == ["g=Missing", "g=x"]
    assert vectors(model.transform(df), "v")[0] == [1.0, 0.0]


def test_multiselect_vocabulary_and_bits(spark):
    rows = ["A;A; B", "B;r1;r2", "", None, ";", "A"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    model = MultiSelectEncoder(inputCols=["t"], outputCol="v", minFrequency=2).fit(df)
    assert model.feature_names() == ["t=A", "t=B", f"t={MISSING}", f"t={INFREQUENT}"]
    assert vectors(model.transform(df), "v") == [
        [1, 1, 0, 0], [0, 1, 0, 1], [0, 0, 1, 0], [0, 0, 1, 0], [0, 0, 0, 0], [1, 0, 0, 0],
    ]
    unseen = spark.createDataFrame([("Z",), ("Z;A",)], "t string")
    assert vectors(model.transform(unseen), "v") == [[0, 0, 0, 1], [1, 0, 0, 1]]
    with pytest.raises(SurveyError):
        MultiSelectEncoder(inputCols=["t"], outputCol="v", minFrequency=0).fit(df)


def test_encoders_survive_saving(spark, tmp_path):
    df = spark.createDataFrame([(1.0, "x", "A;B"), (None, "y", None), (3.0, "x", "A")], "a double, g string, t string")
    stages = [
        NumericScaler(inputCols=["a"], outputCol="n"),
        CategoryEncoder(inputCols=["g"], outputCol="c", minFrequency=1),
        MultiSelectEncoder(inputCols=["t"], outputCol="m", minFrequency=1),
    ]
    model = Pipeline(stages=stages).fit(df)
    model.write().overwrite().save(str(tmp_path / "model"))
    back = PipelineModel.load(str(tmp_path / "model"))
    for column in ("n", "c", "m"):
        assert vectors(back.transform(df), column) == vectors(model.transform(df), column)


def test_ridge_has_the_textbook_penalty(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5] + 4 + rng.normal(size=200)
    df = spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], ["features", "label"])
    model = RidgeRegression(alpha=25.0).fit(df)
    centred = x - x.mean(axis=0)
    expected = np.linalg.solve(centred.T @ centred + 25 * np.eye(3), centred.T @ (y - y.mean()))
    assert np.allclose(model.coefficients.toArray(), expected, rtol=1e-6)
    assert model.intercept == pytest.approx(y.mean() - x.mean(axis=0) @ expected, rel=1e-6)


def test_only_the_numeric_block_is_rounded(spark):
    rows = spark.createDataFrame([(1, Vectors.sparse(6, [0, 1, 4], [1.123456789, -0.5, 1.0])), (2, Vectors.dense([0.0] * 6))], ["k", "v"])
    shown = rows.select("k", encoding._shown("v", 2, 6, 3).alias("v"))
    assert {r.k: r.v for r in shown.collect()} == {1: [1.123, -0.5, 0.0, 0.0, 1.0, 0.0], 2: [0.0] * 6}
    plan = encoding.assembled_features(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(slice(" in plan


def test_tasks_follow_the_size_of_the_arrays(spark, monkeypatch):
    monkeypatch.setattr(encoding, "_SHOWN_BYTES", 10_000)
    found = encoding.assembled_features(spark, "/root/testdata/sf0.001")
    width, rows = len(found.first().features), found.count()
    assert found.rdd.getNumPartitions() == -(-rows * width * 8 // 10_000) > 8


def test_the_wide_array_is_made_once(spark):
    plan = encoding.assembled_features(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    top = plan.splitlines()[0]
    assert "slice" not in top and "concat" not in top  # the assembled vector is shown as it is
    assert "Join" not in plan  # the encoders and the last pass read rows that were joined before


def test_words_are_kept_as_written(spark):
    words = ["it's", "a\\b", 'q"x', "two\nlines", "\\u0041", "\\'", "%_", "é", ""]
    rows = spark.createDataFrame([([*words, "other", None, MISSING],), (None,), ([],)], "t array<string>")
    kept = [r[0] for r in rows.select(keep_common(F.col("t"), words)).collect()]
    assert kept == [[*words, INFREQUENT, MISSING], None, []]
