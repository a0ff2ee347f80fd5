import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from censusloom.errors import SurveyError
from censusloom.functions.scalars import sorted_json
from censusloom.operators import charts, profiling, sketches
from censusloom.operators.distributions import category_distribution, ordinal_trend


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(3)
    n = 40_000
    frame = pd.DataFrame({
        "id": np.arange(n), "group": rng.choice(["a", "b", "c"], n, p=[0.9, 0.0999, 0.0001]),
        "x": rng.lognormal(10, 1, n), "level": rng.integers(1, 4, n).astype(float),
    })
    frame["y"] = 3.0 * frame.x + rng.normal(0, 20_000, n)
    return spark.createDataFrame(frame).repartition(6).persist()


def test_sketched_quartiles_are_within_one_percent_of_rank(values):
    exact = values.toPandas()
    found = category_distribution(values, ["group"], "x", 1, sketch=800).collect()
    assert {r["category"]: r["respondents"] for r in found} == exact.groupby("group").size().to_dict()
    for r in found:
        x = exact.x[exact.group == r["category"]].to_numpy()
        for name, share in (("q25", 0.25), ("median", 0.5), ("q75", 0.75)):
            assert abs((x < r[name]).mean() - share) < 0.01 + 1 / len(x)
        assert r["mean"] == pytest.approx(x.mean())
    summary = {r["statistic"]: r["value"] for r in profiling.target_summary(values, "x", sketch=800).collect()}
    assert summary["count"] == len(exact) and abs((exact.x < summary["p99"]).mean() - 0.99) < 0.01
    trend = ordinal_trend(values, {"level": ("Level", {1: "one", 2: "two", 3: "three"})}, "x", sketch=800)
    assert [r["category"] for r in trend.collect()] == ["one", "two", "three"]
    plan = category_distribution(values, ["group"], "x", 1, sketch=800)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" in plan and "hashpartitioning(feature" in plan


def test_sketches_of_increments_merge(values):
    parts = [sketches.quantile_sketches(values.where(F.col("id") % 5 == i), ["group"], "x") for i in range(5)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    merged = sketches.merge_sketches(every, ["group"])
    found = {r["group"]: r for r in sketches.sketched_quantiles(merged, {"p90": 0.9}).collect()}
    exact = values.toPandas()
    for group, r in found.items():
        x = exact.x[exact.group == group]
        assert r["rows"] == len(x) and (r["low"], r["high"]) == (x.min(), x.max())
        assert r["mean"] == pytest.approx(x.mean()) and abs((x < r["p90"]).mean() - 0.9) < 0.01 + 1 / len(x)
    with pytest.raises(SurveyError):
        sketches.quantile_sketches(values, ["group"], "x", 4)


def test_sketches_leave_out_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None)], "g string, x double")
    found = sketches.sketched_quantiles(sketches.quantile_sketches(df, ["g"], "x"), {"median": 0.5}).collect()
    assert [(r["g"], r["rows"], r["median"]) for r in found] == [("a", 1, 1.0)]


@pytest.mark.parametrize("column", ["x", "level"])
def test_binned_density_is_within_a_millionth_of_the_peak(values, column):
    exact = {r["point"]: r["density"] for r in charts.density_curve(values.where("id < 4000"), column).collect()}
    binned = {r["point"]: r["density"] for r in charts.density_curve(values.where("id < 4000"), column, binned=True).collect()}
    assert exact.keys() == binned.keys() and len(exact) == 200
    peak = max(exact.values())
    assert max(abs(exact[p] - binned[p]) for p in exact) < 1e-6 * peak


def test_too_wide_ranges_are_not_binned(values, monkeypatch):
    monkeypatch.setattr(charts, "MAX_BINS", 10)
    few = values.where("id < 300")
    one = [r["density"] for r in charts.density_curve(few, "x", 20, binned=True).orderBy("point").collect()]
    assert one == pytest.approx([r["density"] for r in charts.density_curve(few, "x", 20).orderBy("point").collect()])


def test_t_quantiles():
    assert charts.t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-8)
    assert charts.t_quantile(0.025, 3) == pytest.approx(-3.182446305, abs=1e-8)
    assert charts.t_quantile(0.975, 1000) == pytest.approx(1.962339081, abs=1e-8)
    assert charts.t_quantile(0.975, 199) == pytest.approx(charts.t_quantile(0.975, 200), abs=1e-3)


def test_bootstrap_band_is_repeatable_and_near_the_analytic_one(values):
    few = values.where("id < 5000")
    band = charts.regression_band(few, "x", "y", "id", points=20, replicates=400).toPandas()
    again = charts.regression_band(few.repartition(11), "x", "y", "id", points=20, replicates=400).toPandas()
    assert np.allclose(band, again, rtol=1e-9)
    assert ((band.low <= band.fitted) & (band.fitted <= band.high)).all()
    ratio = (band.high - band.low) / (band.t_high - band.t_low)
    assert ratio.between(0.75, 1.3).all()
    other = charts.regression_band(few, "x", "y", "id", points=20, replicates=400, seed=1).toPandas()
    assert not np.allclose(band.low, other.low, rtol=1e-9)


def test_band_weights_are_poisson(values):
    """The bootstrap's spread of the slope equals that of drawing rows with replacement."""
    few = values.where("id < 2000")
    frame = few.toPandas()
    rng = np.random.default_rng(1)
    slopes = []
    for _ in range(400):
        drawn = frame.iloc[rng.integers(0, len(frame), len(frame))]
        slopes.append(np.polyfit(drawn.x, drawn.y, 1)[0])
    low, high = np.quantile(slopes, [0.025, 0.975])
    band = charts.regression_band(few, "x", "y", "id", points=2, replicates=1000).toPandas()
    span = band.x[1] - band.x[0]
    reach = (band.high[1] - band.low[1]) / span
    assert reach == pytest.approx(high - low, rel=0.25)
    with pytest.raises(SurveyError):
        charts.regression_band(few.withColumn("x", F.lit(1.0)), "x", "y", "id")


def test_distinct_integers_on_both_sides_of_the_switch(spark):
    rows = [(i % 700 - 350, i * 10**12, None if i % 2 else i, None, -(2**63) + i % 3) for i in range(2_000)]
    df = spark.createDataFrame(rows, "dense int, wide bigint, gaps bigint, none int, low bigint").repartition(4)
    expected = {"dense": 700, "wide": 2000, "gaps": 1000, "none": 0, "low": 3}
    for share in (0.0, 1.0):
        found = profiling.distinct_integers(df, list(expected), bytes_per_row=share)
        assert {r["column"]: r["unique_count"] for r in found.collect()} == expected
    plan = profiling.distinct_integers(df.select("dense"), ["dense"])._jdf.queryExecution().executedPlan().toString()
    assert "bitmap_construct_agg" in plan
    plan = profiling.distinct_integers(df.select("dense"), ["dense"], bytes_per_row=0)._jdf.queryExecution().executedPlan().toString()
    assert "bitmap_construct_agg" not in plan
    empty = profiling.distinct_integers(df.limit(0), ["dense"]).collect()
    assert [(r["column"], r["unique_count"]) for r in empty] == [("dense", 0)]


def test_profile_with_integers_equals_plain_counts(spark):
    df = spark.createDataFrame([(1, "a", None), (1, None, 2.0), (None, "b", 2.0)], "`i.d` bigint, t string, v double")
    found = {r["column"]: (r["dtype"], r["missing_count"], r["unique_count"]) for r in profiling.column_profile(df).collect()}
    assert found == {"i.d": ("bigint", 1, 1), "t": ("string", 1, 2), "v": ("double", 1, 1)}
    empty = {r["column"]: (r["missing_rate_pct"], r["unique_count"]) for r in profiling.column_profile(df.limit(0)).collect()}
    assert empty == {"i.d": (0.0, 0), "t": (0.0, 0), "v": (0.0, 0)}


def test_sorted_json(spark):
    df = spark.sql("""SELECT map('b', 1, 'a', CAST(NULL AS INT), 'c"d', 3) AS m, map('z', 'x"y', 'é', 'ü') AS t,
      map('n', '120', 'f', '0.5', 's', 'null') AS l, CAST(NULL AS MAP<STRING, INT>) AS n, CAST(map() AS MAP<STRING, INT>) AS e""")
    row = df.select(sorted_json(F.col("m")), sorted_json(F.col("t")), sorted_json(F.col("l"), literal=True), sorted_json(F.col("n")), sorted_json(F.col("e"))).first()
    assert row[0] == '{"a": null, "b": 1, "c\\"d": 3}'
    assert row[1] == '{"z": "x\\"y", "é": "ü"}'
    assert row[2] == '{"f": 0.5, "n": 120, "s": null}'
    assert row[3] is None and row[4] == "{}"
