"""Statistics against brute force, on skewed data and in both plans."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from censusloom.errors import SurveyError
from censusloom.operators import associations as A
from censusloom.operators import distributions as D

BUCKETS = pytest.mark.parametrize("rows_per_bucket", [1_000_000, 60])


@pytest.fixture(scope="module")
def answers():
    """A hot category, a hot value, rare groups and multi-select texts."""
    rng = np.random.default_rng(11)
    n = 900
    tools = np.array(["A", "B", "C", "D"])
    frame = pd.DataFrame({
        "id": np.arange(n),
        "g": np.where(rng.random(n) < 0.4, "hot", rng.choice(list("pqr"), n)),
        "level": rng.integers(0, 5, n).astype(float),
        "y": np.where(rng.random(n) < 0.35, 10.0, np.round(rng.lognormal(3, 1, n), 1)),
        "picks": [";".join(tools[rng.random(4) < [0.9, 0.3, 0.5, 0.04]]) for _ in range(n)],
    })
    frame.loc[:9, "g"] = "rare"
    frame["y"] += frame.level
    frame["logy"] = np.log1p(frame.y)
    return frame


@pytest.fixture(scope="module")
def table(spark, answers):
    return spark.createDataFrame(answers).repartition(6)


def test_undefined_correlations_are_left_out(spark):
    rows = [(1.0, 1.0, 1.0, math.nan, 1.0), (2.0, 1.0, None, 2.0, 2.0), (3.0, 1.0, None, 4.0, 3.5)]
    df = spark.createDataFrame(rows, "y double, constant double, single double, nan double, good double")
    got = A.pearson_with_target(df, ["constant", "single", "nan", "good"], "y").collect()
    assert [r["feature"] for r in got] == ["nan", "good"]
    assert [r["valid_rows"] for r in got] == [2, 3]
    with pytest.raises(SurveyError):
        A.pearson_with_target(df, ["good"], "y", top_n=0)


def test_matrix_is_pairwise_complete_and_symmetric(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame(rng.normal(1e6, 3, (300, 3)), columns=list("abc"))
    frame["b"] += frame["a"]
    frame.loc[::4, "a"] = np.nan
    frame.loc[::5, "c"] = np.nan
    frame["flat"] = 0.1
    df = spark.createDataFrame(frame).repartition(4)
    got = A.pearson_matrix(df, ["a", "b", "c", "flat"], {"a": "Alpha"}).toPandas()
    assert len(got) == 16
    wide = got.pivot(index="row_variable", columns="column_variable", values="pearson_r")
    expected = frame.rename(columns={"a": "Alpha"}).corr()
    for i in ("Alpha", "b", "c"):
        for j in ("Alpha", "b", "c"):
            assert wide.loc[i, j] == pytest.approx(expected.loc[i, j], abs=1e-9)
    assert wide["flat"].isna().all()
    n = got.set_index(["row_variable", "column_variable"]).valid_rows
    assert n["Alpha", "c"] == n["c", "Alpha"] == frame[["a", "c"]].dropna().shape[0]


def test_matrix_of_no_rows(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert A.pearson_matrix(df, ["a", "b"]).where("pearson_r is not null").count() == 0


@BUCKETS
def test_spearman(table, answers, rows_per_bucket):
    df = table.withColumn("flat", F.lit(1.0))
    got = A.spearman_with_target(
        df, {"level": "Level", "logy": "Self", "flat": "Flat"}, "y", rows_per_bucket
    ).toPandas().set_index("feature")
    assert list(got.index) == ["Self", "Level"]
    assert got.spearman_rho["Self"] == pytest.approx(1.0) and got.p_value["Self"] == 0.0
    expected = answers.level.rank().corr(answers.y.rank())
    assert got.spearman_rho["Level"] == pytest.approx(expected, rel=1e-10)
    assert got.p_value_bonferroni["Level"] == pytest.approx(min(1, got.p_value["Level"] * 2))


@BUCKETS
def test_nominal(table, answers, rows_per_bucket):
    df = table.withColumn("one", F.lit("only")).withColumn("parity", (F.col("id") % 2).cast("string"))
    got = A.nominal_associations(df, ["g", "one", "parity"], "logy", 20, rows_per_bucket)
    got = got.toPandas().set_index("feature")
    assert set(got.index) == {"g", "parity"}
    kept = answers[answers.groupby("g").id.transform("size") >= 20]
    assert got.group_count["g"] == kept.g.nunique() and got.valid_rows["g"] == len(kept)
    mean = kept.logy.mean()
    between = sum(len(p) * (p.logy.mean() - mean) ** 2 for _, p in kept.groupby("g"))
    assert got.eta_squared["g"] == pytest.approx(between / ((kept.logy - mean) ** 2).sum(), rel=1e-9)
    ranks, n = kept.logy.rank(), len(kept)
    h = 12 / (n * (n + 1)) * (ranks.groupby(kept.g).sum() ** 2 / kept.groupby("g").size()).sum() - 3 * (n + 1)
    ties = kept.logy.value_counts()
    h /= 1 - (ties**3 - ties).sum() / (n**3 - n)
    assert got.kruskal_h["g"] == pytest.approx(h, rel=1e-9)


def test_nominal_without_variation(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0)] * 30, "g string, y double")
    assert A.nominal_associations(df, ["g"], "y").count() == 0
    with pytest.raises(SurveyError):
        A.nominal_associations(df, ["g"], "y", min_group_size=1)


@BUCKETS
def test_multiselect(table, answers, rows_per_bucket):
    got = A.multiselect_tests(table, "picks", "y", "logy", 20, rows_per_bucket).toPandas().set_index("option")
    expected = {}
    for option in sorted({t for p in answers.picks for t in p.split(";")}):
        has = answers.picks.map(lambda p: option in p.split(";"))
        if has.sum() >= 20 and (~has).sum() >= 20:
            expected[option] = has
    assert set(got.index) == set(expected)
    for option, has in expected.items():
        row = got.loc[option]
        assert (row.selected_rows, row.unselected_rows) == (has.sum(), (~has).sum())
        assert row.selected_median == pytest.approx(answers.y[has].median())
        assert row.unselected_median == pytest.approx(answers.y[~has].median())
        assert row.point_biserial_r == pytest.approx(np.corrcoef(has, answers.logy)[0, 1], rel=1e-8)
    assert (got.p_value_bonferroni <= 1).all()


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 4])
def test_complement_median_with_one_value(spark, rows_per_bucket):
    """Everyone shares one value, and an option held by the lowest values only."""
    same = spark.createDataFrame([("A;B" if i % 2 else "A;C", 5.0, 1.0) for i in range(40)], "p string, y double, l double")
    got = D.multiselect_effects(same, "p", "y", "l", 5, rows_per_bucket).collect()
    assert {(r["option"], r["selected_median"], r["unselected_median"], r["point_biserial_r"]) for r in got} == {
        ("B", 5.0, 5.0, None), ("C", 5.0, 5.0, None),
    }
    low = spark.createDataFrame(
        [("L" if i < 10 else "H", float(i), float(i)) for i in range(31)], "p string, y double, l double"
    )
    got = {r["option"]: r for r in D.multiselect_effects(low, "p", "y", "l", 5, rows_per_bucket).collect()}
    assert (got["L"]["selected_median"], got["L"]["unselected_median"]) == (4.5, 20.0)
    assert (got["H"]["selected_median"], got["H"]["unselected_median"]) == (20.0, 4.5)


def test_multiselect_needs_rows(spark):
    df = spark.createDataFrame([("A", 1.0, 1.0)] * 39, "p string, y double, l double")
    with pytest.raises(SurveyError):
        D.multiselect_effects(df, "p", "y", "l")


def test_small_groups_are_left_out(table, answers):
    got = D.category_distribution(table, ["g"], "y").toPandas()
    assert "rare" not in set(got.category) and "hot" in set(got.category)
    assert list(got["median"]) == sorted(got["median"], reverse=True)
    trend = D.ordinal_trend(table, {"level": ("Level", {i: f"L{i}" for i in range(5)})}, "y").toPandas()
    assert list(trend.order) == [0, 1, 2, 3, 4] and list(trend.category) == [f"L{i}" for i in range(5)]
    assert trend["median"][2] == pytest.approx(answers.y[answers.level == 2].median())


def test_welch(spark):
    a, b = [1.0, 2.0, 3.0, 4.0], [2.0, 4.0, 9.0]
    rows = [("a", v) for v in a] + [("b", v) for v in b] + [("c", 100.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, y double")
    row = A.welch_test(df, "g", "a", "b", "y").first()
    va, vb = np.var(a, ddof=1) / 4, np.var(b, ddof=1) / 3
    assert row["t_statistic"] == pytest.approx((2.5 - 5) / math.sqrt(va + vb))
    assert row["degrees_of_freedom"] == pytest.approx((va + vb) ** 2 / (va**2 / 3 + vb**2 / 2))
    assert row["verdict"] == "no difference shown" and 0.2 < row["p_value"] < 0.5
    assert A.welch_test(df, "g", "a", "c", "y").count() == 0


def test_bonferroni_counts_the_rows_left(spark):
    df = spark.createDataFrame([(0.01,), (0.03,), (0.5,)], "p_value double")
    got = [tuple(r) for r in A.bonferroni(df).orderBy("p_value").collect()]
    assert got == [(0.01, True, 0.03, True), (0.03, True, 0.09, False), (0.5, False, 1.0, False)]
