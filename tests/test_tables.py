"""Contracts, CSV scans, cleaning and profiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from censusloom.errors import SurveyError
from censusloom.functions.scalars import rounded
from censusloom.operators import charts, cleaning, profiling
from censusloom.sources import contracts, files


def test_missing_columns_are_listed_sorted(spark):
    df = spark.createDataFrame([(1,)], "b int")
    with pytest.raises(SurveyError, match="a, c"):
        contracts.require_columns(df, ["c", "b", "a"])


def test_empty_and_small_tables(spark):
    with pytest.raises(SurveyError):
        contracts.require_rows(spark.createDataFrame([], "a int"))
    with pytest.raises(SurveyError, match="at least 100"):
        contracts.require_population(99, 100, "the trim")


def test_unknown_labels_are_named(spark):
    df = spark.createDataFrame([("Agree", "x"), ("Maybe", None), (None, "y")], "k string, o string")
    allowed = {"k": ["Agree"], "o": ["x", "y"]}
    with pytest.raises(SurveyError, match="Maybe"):
        contracts.require_domain(df, allowed)
    contracts.require_domain(df, {"k": ["Agree", "Maybe"], "o": ["x", "y"]})
    assert [tuple(r) for r in contracts.domain_violations(df, allowed).collect()] == [("k", "Maybe")]


def test_csv_keeps_quotes_breaks_and_null_texts(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('id,text,pay\n1,"a ""b""\nc",NA\n2,None,12.5\n3,,x\n')
    df = files.apply_types(files.scan_csv(spark, str(path)), {"id": "bigint", "pay": "double"})
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, 'a "b"\nc', None), (2, None, 12.5), (3, None, None)]
    strict = files.scan_csv(spark, str(path), files.STRICT_NULL_TEXTS)
    assert strict.where("id = 2").first()["text"] == "None"


def test_csv_sink_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", you', None), (2, "line\nbreak", 2.5)], "id bigint, t string, x double")
    files.write_table(df, str(tmp_path / "out"), ["id", "t", "x"])
    back = files.apply_types(files.scan_csv(spark, str(tmp_path / "out")), {"id": "bigint", "x": "double"})
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    files.write_table(df, str(tmp_path / "pq"), kind="parquet")
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 2


def test_first_rows_needs_a_positive_count(spark):
    df = spark.range(5)
    assert [r.id for r in files.first_rows(df, 2, ["id"]).collect()] == [0, 1]
    with pytest.raises(SurveyError):
        files.first_rows(df, 0, ["id"])


def test_reconcile_finds_a_difference(spark):
    left = spark.createDataFrame([(1, 5.0), (2, None)], "k bigint, x double")
    right = spark.createDataFrame([(1, 5.0), (1, None)], "k bigint, x double")
    contracts.require_match(contracts.reconcile(left, left, ["k"], "x"))
    with pytest.raises(SurveyError, match="duplicate_keys"):
        contracts.require_match(contracts.reconcile(left, right, ["k"], "x"))
    with pytest.raises(SurveyError, match="column_order"):
        contracts.require_match(contracts.reconcile(left, left.select("x", "k"), ["k"], "x"))


@pytest.mark.parametrize("broadcast_bytes", [1_000, 0])
def test_first_per_key_keeps_the_first_row(spark, broadcast_bytes):
    rows = [(1, 3, "c"), (1, 1, "a"), (2, 9, "z"), (None, 2, "n"), (None, 1, "m")] + [(7, i, "hot") for i in range(50)]
    df = spark.createDataFrame(rows, "k int, o int, t string").repartition(4)
    got = cleaning.first_per_key(df, ["k"], ["o"], broadcast_bytes)
    assert got.columns == ["k", "o", "t"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(1, 1, "a"), (2, 9, "z"), (None, 1, "m"), (7, 0, "hot")], key=str
    )
    assert contracts.duplicate_count(df, ["k"]).first()[0] == len(rows) - 4


def test_unique_keys_pass_through(spark):
    df = spark.range(10)
    assert cleaning.first_per_key(df, ["id"], ["id"]) is df


def test_trim_keeps_bounds_and_needs_rows(spark):
    df = spark.range(-5, 101).select(F.col("id").cast("double").alias("x"))
    trimmed, low, high = cleaning.quantile_trim(df, "x", 0.0, 1.0)
    assert (low, high, trimmed.count()) == (1.0, 100.0, 100)
    with pytest.raises(SurveyError):
        cleaning.quantile_trim(df.where("x < 50"), "x")


def test_fences_match_the_published_ones(spark):
    df = spark.createDataFrame([(32369.75,), (32369.75,), (108000.0,), (108000.0,)], "x double")
    # Quartiles of four such values are the values themselves.
    assert cleaning.iqr_fences(df, "x") == pytest.approx((-81075.625, 221445.375))


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 5])
def test_rows_of_large_groups(spark, rows_per_bucket):
    df = spark.createDataFrame([("a",)] * 19 + [("b",)] * 20 + [(None,)] * 30, "g string")
    assert cleaning.rows_of_large_groups(df, "g", 20, rows_per_bucket).count() == 20


def test_column_profile(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", None), (None, None), ("y" * 100, 2.0)], "a string, b double")
    got = [tuple(r) for r in profiling.column_profile(df).collect()]
    assert got == [("b", "double", 2, 50.0, 2), ("a", "string", 1, 25.0, 2)]
    sketch = [tuple(r) for r in profiling.column_profile(df, exact=False).collect()]
    assert sketch == got
    empty = profiling.column_profile(spark.createDataFrame([], "a string"))
    assert [tuple(r) for r in empty.collect()] == [("a", "string", 0, 0.0, 0)]


def test_describe_keeps_columns_without_values(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None)], "a double, b double")
    rows = {r["column"]: r for r in profiling.describe_columns(df, ["a", "b"]).collect()}
    assert (rows["a"]["mean"], rows["a"]["median"], rows["a"]["count"]) == (2.0, 2.0, 2)
    assert (rows["b"]["mean"], rows["b"]["count"]) == (None, 0)


def test_overview_counts_zero_as_neither(spark):
    df = spark.createDataFrame([(1, "5"), (1, "0"), (2, "x"), (3, None)], "k int, pay string")
    got = {r["item"]: r["value"] for r in profiling.dataset_overview(df, ["k"], "pay").collect()}
    assert got == {
        "rows": 4, "columns": 2, "valid_target_rows": 1, "missing_target_rows": 2, "duplicate_keys": 1,
    }


def test_rounding(spark):
    df = spark.createDataFrame([(1.23456, "a", 3)], "x double, t string, n int")
    assert tuple(rounded(df, 2).first()) == (1.23, "a", 3)


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(5)
    x = np.round(np.concatenate([rng.exponential(20, 999), [0.0, 100.0, 7.0, 7.0]]), 2)
    df = spark.createDataFrame([(float(v), 4.0) for v in x], "x double, c double")
    got = charts.histogram(df, ["x", "c"], 50).orderBy("column", "bin").toPandas()
    counts, edges = np.histogram(x, 50)
    mine = got[got["column"] == "x"]
    assert list(mine["count"]) == list(counts)
    assert list(mine["low"]) == pytest.approx(list(edges[:-1]))
    flat = got[got["column"] == "c"]
    assert flat["count"].sum() == len(x) and flat["low"].min() == 3.5


def test_density_integrates_and_needs_variation(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, 400)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    curve = charts.density_curve(df, "x", 60).orderBy("point").toPandas()
    h = x.std(ddof=1) * len(x) ** -0.2
    expected = [np.exp(-0.5 * ((g - x) / h) ** 2).sum() / (len(x) * h * np.sqrt(2 * np.pi)) for g in curve.x]
    assert list(curve.density) == pytest.approx(expected, rel=1e-9)
    with pytest.raises(SurveyError):
        charts.density_curve(df.withColumn("x", F.lit(1.0)), "x")


def test_regression_line(spark):
    x = np.arange(20.0)
    y = 3 * x + 1 + np.where(x % 2, 0.5, -0.5)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y double")
    line = charts.regression_line(df, "x", "y").first()
    slope, intercept = np.polyfit(x, y, 1)
    residual = np.sqrt(((y - slope * x - intercept) ** 2).sum() / 18)
    assert (line["slope"], line["intercept"], line["residual_sd"]) == pytest.approx((slope, intercept, residual))


def test_fixed_sample_is_stable(spark):
    df = spark.range(1000)
    first = {r.id for r in charts.fixed_sample(df, "id", 100).collect()}
    assert len(first) == 100
    assert first == {r.id for r in charts.fixed_sample(df.repartition(7), "id", 100).collect()}
