"""Quantiles, ranks, positions and folds, checked by brute force on skewed data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from censusloom.errors import SurveyError
from censusloom.operators.layout import Layout, fit_layout, hot_keys, lookup_by_key
from censusloom.operators.quantiles import grouped_quantiles, quantile_bounds
from censusloom.operators.ranks import (
    average_ranks, hash_positions, quantile_bin, ranked_rows, row_positions, stratified_folds, target_bins,
    with_group_rows,
)

BUCKETS = pytest.mark.parametrize("rows_per_bucket", [1_000_000, 100, 7])


@pytest.fixture(scope="module")
def skewed():
    """Half of the rows in one group, a third of them with one value."""
    rng = np.random.default_rng(3)
    n = 1_500
    group = np.where(rng.random(n) < 0.5, "hot", rng.integers(0, 9, n).astype(str))
    value = np.where(rng.random(n) < 0.33, 5.0, np.round(rng.lognormal(2, 1, n), 1))
    return pd.DataFrame({"id": np.arange(n), "g": group, "x": value})


@pytest.fixture(scope="module")
def table(spark, skewed):
    return spark.createDataFrame(skewed).repartition(5)


@BUCKETS
def test_grouped_quantiles(table, skewed, rows_per_bucket):
    shares = {"a": 0.01, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0, "f": 0.0}
    got = grouped_quantiles(
        table, ["g"], "x", shares, [F.count(F.lit(1)).alias("n")], rows_per_bucket=rows_per_bucket
    )
    rows = {row["g"]: row for row in got.collect()}
    assert set(rows) == set(skewed.g)
    for name, part in skewed.groupby("g"):
        assert rows[name]["n"] == len(part)
        for column, share in shares.items():
            assert rows[name][column] == pytest.approx(np.quantile(part.x, share), rel=1e-12)


@BUCKETS
def test_overall_quantiles(table, skewed, rows_per_bucket):
    got = quantile_bounds(table, "x", [0.01, 0.5, 0.99], rows_per_bucket=rows_per_bucket)
    assert got == pytest.approx(list(np.quantile(skewed.x, [0.01, 0.5, 0.99])), rel=1e-12)


def test_small_example(spark):
    df = spark.createDataFrame([(1,), (2,), (4,), (10,)], "x int")
    assert quantile_bounds(df, "x", [0.01, 0.25, 0.99]) == pytest.approx([1.03, 1.75, 9.82])
    assert quantile_bounds(df, "x", [0.01, 0.25, 0.99], rows_per_bucket=1) == pytest.approx([1.03, 1.75, 9.82])
    with pytest.raises(SurveyError):
        quantile_bounds(df.where("x > 99"), "x", [0.5])
    with pytest.raises(SurveyError):
        fit_layout(df.withColumn("t", F.lit("a")), "t")


@BUCKETS
def test_average_ranks(table, skewed, rows_per_bucket):
    layout = fit_layout(table, "x", rows_per_bucket)
    assert layout.single == (rows_per_bucket > len(skewed))
    counts = table.groupBy("g", "x").agg(F.count(F.lit(1)).alias("_count"))
    got = average_ranks(counts, ["g"], "x", layout).toPandas()
    expected = skewed.assign(r=skewed.groupby("g").x.rank()).groupby(["g", "x"]).r.first()
    assert len(got) == len(expected)
    for row in got.itertuples():
        assert row.avg_rank == expected[(row.g, row.x)]
    # All ranks of a group add up to n (n + 1) / 2.
    n = skewed.groupby("g").size()
    totals = (got["avg_rank"] * got["_count"]).groupby(got["g"]).sum()
    assert (totals == n * (n + 1) / 2).all()


@BUCKETS
def test_ranked_rows_and_group_rows(table, skewed, rows_per_bucket):
    layout = fit_layout(table, "x", rows_per_bucket)
    counted = table.withColumn("half", F.col("id") % 2).groupBy("g", "half", "x").agg(
        F.count(F.lit(1)).alias("_pairs")
    )
    kept = with_group_rows(counted, ["g", "half"], "_pairs", layout, "size", minimum=40)
    got = ranked_rows(kept, ["g"], "x", "_pairs", layout).toPandas()
    frame = skewed.assign(half=skewed.id % 2)
    sizes = frame.groupby(["g", "half"]).x.transform("size")
    frame = frame[sizes >= 40]
    frame = frame.assign(r=frame.groupby("g").x.rank(), n=frame.groupby("g").x.transform("size"))
    expected = frame.groupby(["g", "half", "x"]).agg(r=("r", "first"), n=("n", "first"), c=("id", "size"))
    assert len(got) == len(expected)
    for row in got.to_dict("records"):
        want = expected.loc[(row["g"], row["half"], row["x"])]
        assert (row["avg_rank"], row["_rows"], row["_pairs"]) == (want.r, want.n, want.c)


def test_all_ties(spark):
    counts = spark.createDataFrame([("a", 5.0, 3)], "g string, x double, _count bigint")
    assert average_ranks(counts, ["g"], "x", Layout(3)).first()["avg_rank"] == 2.0


@BUCKETS
def test_row_positions(table, skewed, rows_per_bucket):
    placed, rows = row_positions(table, "x", "id", rows_per_bucket=rows_per_bucket)
    got = placed.toPandas().set_index("id").position
    expected = skewed.sort_values(["x", "id"]).reset_index(drop=True)
    assert rows == len(skewed)
    assert [got[i] for i in expected.id] == list(range(1, rows + 1))


@BUCKETS
def test_hash_positions(table, skewed, rows_per_bucket):
    hashed = table.withColumn("h", F.md5(F.col("id").cast("string")))
    got = hash_positions(hashed, ["g"], "h", "id", len(skewed), rows_per_bucket=rows_per_bucket).toPandas()
    for _, part in got.groupby("g"):
        assert list(part.sort_values("h").position) == list(range(1, len(part) + 1))


@pytest.mark.parametrize("n", [10, 100, 103, 117, 1001])
def test_bins_follow_linear_quantile_edges(spark, n):
    df = spark.range(n).select((F.col("id") + 1).alias("p"))
    got = [row[0] for row in df.orderBy("p").select(quantile_bin(F.col("p"), n, 10)).collect()]
    assert got == list(pd.qcut(np.arange(1, n + 1), 10, labels=False))


def test_bins_need_two_rows(spark):
    with pytest.raises(SurveyError):
        target_bins(spark.createDataFrame([(1, 2.0)], "k bigint, y double"), "y", "k")


@BUCKETS
def test_folds_are_even_within_bins(table, rows_per_bucket):
    binned, _ = target_bins(table, "x", "id", rows_per_bucket=rows_per_bucket)
    folds = stratified_folds(binned, "x", "id", rows_per_bucket=rows_per_bucket).toPandas()
    assert len(folds) == 1_500 and folds.id.is_unique
    sizes = folds.groupby(["target_bin", "fold"]).size().unstack(fill_value=0)
    assert sizes.shape == (10, 5)
    assert (sizes.max(axis=1) - sizes.min(axis=1)).max() <= 1


def test_folds_do_not_depend_on_partitioning_or_buckets(table):
    key = lambda df: {row["id"]: row["fold"] for row in df.select("id", "fold").collect()}
    first = key(stratified_folds(table, "x", "id"))
    assert first == key(stratified_folds(table.repartition(3), "x", "id"))
    assert first == key(stratified_folds(table, "x", "id", rows_per_bucket=50))


def test_lookup_by_key_splits_hot_keys(table, skewed):
    sizes = table.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(sizes, ["g"], F.col("n"), Layout(len(skewed), (1.0,)), limit=5)
    assert hot == [("hot",)]
    assert hot_keys(sizes, ["g"], F.col("n"), Layout(len(skewed)), limit=5) == []
    joined = lookup_by_key(table, sizes, ["g"], hot)
    assert joined.count() == len(skewed)
    assert joined.where("g = 'hot'").first()["n"] == (skewed.g == "hot").sum()


def test_cut_points_of_many_rows_come_from_a_sample(spark):
    """More rows than are sampled for cut points; half of them share one value."""
    rows = 2_400_000
    value = F.when(F.col("id") < rows // 2, 0.0).otherwise(F.col("id").cast("double"))
    df = spark.range(rows).select(value.alias("x"))
    layout = fit_layout(df, "x")
    assert layout.rows == rows and len(layout.cuts) >= 2
    got = quantile_bounds(df, "x", [0.25, 0.5, 0.75, 1.0], layout)
    expected = np.quantile(np.where(np.arange(rows) < rows // 2, 0, np.arange(rows)), [0.25, 0.5, 0.75, 1.0])
    assert got == pytest.approx(list(expected), rel=1e-12)
