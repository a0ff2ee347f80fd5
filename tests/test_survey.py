import pytest
from pyspark.sql import functions as F

from censusloom.errors import SurveyError
from censusloom.plans import survey as plan
from censusloom.plans import survey_schema as schema
from workloads.survey import _tables, survey_answers

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def raw(spark):
    return survey_answers(spark, SF).persist()


@pytest.fixture(scope="module")
def analysis(raw):
    plan.check_input(raw)
    return plan.SurveyAnalysis(raw, plan.derive(raw, ["ConvertedCompYearly"]).persist())


def test_the_answers_are_built_once(spark, tmp_path):
    k = F.col("id")
    tables = {
        "orders": spark.range(1, 400).select(
            k.alias("o_orderkey"), (k % 20).alias("o_custkey"), F.lit("F").alias("o_orderstatus"),
            F.lit("2-HIGH").alias("o_orderpriority"), (k * 7 % 101 + 10.5).alias("o_totalprice"),
        ),
        "customer": spark.range(20).select(
            k.alias("c_custkey"), F.when(k > 3, k % 3).alias("c_nationkey"), F.lit("BUILDING").alias("c_mktsegment")
        ),
        "nation": spark.range(3).select(k.alias("n_nationkey"), F.concat(F.lit("N"), k.cast("string")).alias("n_name")),
    }
    for name, rows in tables.items():
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    found, expected = _tables(spark, str(tmp_path)).raw, survey_answers(spark, str(tmp_path))
    assert not [f for f in found.inputFiles() if str(tmp_path) in f]
    assert found.columns == expected.columns and found.count() == 403
    assert found.exceptAll(expected).isEmpty()


def test_contract(raw):
    assert len(schema.REQUIRED_COLUMNS) == 34 == len(set(schema.REQUIRED_COLUMNS))
    with pytest.raises(SurveyError, match="Country, WorkExp"):
        plan.check_input(raw.drop("WorkExp", "Country"))
    with pytest.raises(SurveyError, match="Knowledge_2: Maybe"):
        plan.check_input(raw.withColumn("Knowledge_2", F.lit("Maybe")))


def test_declined_answers_have_no_score(raw):
    declined = plan.derive(raw, ["ConvertedCompYearly"]).where("Age = 'Prefer not to say'")
    assert declined.count() > 0 and declined.where("Age_order is not null").count() == 0


def test_shapes(analysis):
    assert len(schema.CLEANED_COLUMNS) == 39
    assert analysis.data_quality.count() == 8
    assert analysis.cleaned_descriptive_statistics.count() == 17
    assert analysis.cleaned_column_profile.count() == 21
    assert analysis.numeric_correlation_top.count() == 3
    assert analysis.numeric_correlation_matrix.count() == 23 * 23
    assert analysis.raw_salary_summary.count() == 10
    assert {r["feature"] for r in analysis.ordinal_income_trends.collect()} <= {
        "Age", "Education level", "Organization size",
    }
    assert analysis.remote_salary_test.count() == 1


def test_quality_numbers_add_up(analysis, raw):
    got = {r["item"]: r["value"] for r in analysis.data_quality.collect()}
    assert got["rows_before"] == raw.count()
    assert got["rows_before"] - got["duplicate_keys"] == (
        got["invalid_target_rows"] + got["outlier_rows"] + got["rows_after"]
    )
    assert got["rows_after"] == analysis.table.count()


def test_write(analysis, spark, tmp_path):
    names = ["data_quality", "headline_facts", "categorical_income_associations"]
    analysis.write(str(tmp_path), "parquet", names)
    for name in names:
        assert spark.read.parquet(str(tmp_path / name)).count() > 0
    assert all(hasattr(plan.SurveyAnalysis, n) or n == "data_quality" for n in plan.RESULT_TABLES)


def test_model_spec_lists_every_input(raw):
    spec = plan.model_spec(folds=3)
    assert len(spec.numeric) == 18 and len(spec.nominal) == 8 and len(spec.multiselect) == 6
    population = plan.model_population(plan.derive(raw, ["ConvertedCompYearly"]))
    assert population.where("ConvertedCompYearly <= 0").count() == 0
    assert set(spec.features) <= set(population.columns)
