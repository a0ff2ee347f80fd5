"""What the physical plans must, and must not, contain."""

import pytest
from pyspark.sql import functions as F

from censusloom.operators import charts, cleaning, distributions
from workloads import all_queries
from workloads.tables import table

SF = "/root/testdata/sf0.001"
# Model jobs return small result tables; their plans are Spark ML's own.
FITTED = {"ridge_cv", "forest_cv", "model_selection", "importance", "importance_ridge", "assembled_features"}
# The only Python in the plans: p-values of a few tests, and one matrix block per task.
WITH_PYTHON = {
    "spearman", "spearman_bucketed", "nominal_associations", "nominal_associations_bucketed", "welch_test",
    "multiselect_tests", "pearson_matrix", "survey_matrix", "survey_spearman", "survey_employment",
    "survey_strongest", "survey_headline_facts", "pearson_matrix_table",
}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(all_queries()) - FITTED))
def test_no_cross_joins_and_little_python(spark, name):
    plan = plan_of(all_queries()[name](spark, SF))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    if name not in WITH_PYTHON:
        assert "EvalPython" not in plan and "MapInArrow" not in plan


def test_only_needed_columns_are_read(spark):
    orders = table(spark, SF, "orders")
    plan = plan_of(distributions.category_distribution(orders, ["o_orderstatus"], "o_totalprice"))
    assert "ReadSchema: struct<o_orderstatus:string,o_totalprice:double>" in plan.replace(
        "struct<o_totalprice:double,o_orderstatus:string>", "struct<o_orderstatus:string,o_totalprice:double>"
    )


def test_trim_bounds_reach_the_scan(spark):
    trimmed = cleaning.quantile_trim(table(spark, SF, "orders"), "o_totalprice")[0]
    plan = plan_of(trimmed.select("o_totalprice"))
    assert "PushedFilters" in plan and "GreaterThanOrEqual(o_totalprice" in plan


def test_sample_is_a_top_k_without_a_shuffle(spark):
    plan = plan_of(charts.fixed_sample(table(spark, SF, "events"), "event_id", 10))
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_unique_rows_do_not_move_in_deduplication(spark):
    lines = table(spark, SF, "lineitem").withColumn("x", F.lit(1))
    order = [c for c in lines.columns if c not in ("l_orderkey", "l_linenumber")]
    plan = plan_of(cleaning.first_per_key(lines, ["l_orderkey", "l_linenumber"], order))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
