"""Overviews, profiles and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from censusloom.functions.scalars import rounded
from censusloom.operators import profiling as P
from workloads.registry import query
from workloads.tables import ANSWERS, answers, table

_LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "dataset_overview",
    f"""SELECT 'rows' AS item, count(*) AS value FROM {ANSWERS} UNION ALL SELECT 'columns', 5
    UNION ALL SELECT 'valid_target_rows', count(*) FILTER (value > 0) FROM {ANSWERS}
    UNION ALL SELECT 'missing_target_rows', count(*) FILTER (value IS NULL) FROM {ANSWERS}
    UNION ALL SELECT 'duplicate_keys', count(*) - count(DISTINCT user_id) FROM {ANSWERS}""",
)
def dataset_overview(spark, sf_dir):
    return P.dataset_overview(answers(spark, sf_dir), ["user_id"], "value")


def _profile_sql(columns: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS "column", '{kind}' AS dtype, count(*) - count({name}) AS missing_count,
        round((count(*) - count({name})) * 100::DOUBLE / count(*), 6) AS missing_rate_pct,
        count(DISTINCT {name}) AS unique_count FROM {source}"""
        for name, kind in columns.items()
    )


@query(
    "column_profile",
    _profile_sql(
        {"event_id": "bigint", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"},
        ANSWERS,
    ),
)
def column_profile(spark, sf_dir):
    return rounded(P.column_profile(answers(spark, sf_dir)), 6)


@query(
    "column_profile_texts",
    _profile_sql(
        {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"},
        "documents",
    ),
)
def column_profile_texts(spark, sf_dir):
    """Long texts are compared whole, by digest."""
    return rounded(P.column_profile(table(spark, sf_dir, "documents")), 6)


_SUMMARY = {
    "count": "count(x)", "mean": "avg(x)", "std": "stddev_samp(x)", "min": "min(x)",
    "p01": "quantile_cont(x, 0.01)", "p25": "quantile_cont(x, 0.25)", "p50": "quantile_cont(x, 0.5)",
    "p75": "quantile_cont(x, 0.75)", "p99": "quantile_cont(x, 0.99)", "max": "max(x)",
}


@query(
    "target_summary",
    " UNION ALL ".join(
        f"SELECT '{name}' AS statistic, round(CAST({code} AS DOUBLE), 5) AS value "
        "FROM (SELECT c_acctbal AS x FROM customer WHERE c_acctbal > 0)"
        for name, code in _SUMMARY.items()
    ),
)
def target_summary(spark, sf_dir):
    return rounded(P.target_summary(table(spark, sf_dir, "customer"), "c_acctbal"), 5)


_DESCRIBE = " UNION ALL ".join(
    f"""SELECT '{name}' AS "column", count({name}) AS count, round(avg({name}), 5) AS mean,
    round(stddev_samp({name}), 5) AS std, min({name}) AS min, round(quantile_cont({name}, 0.25), 5) AS p25,
    round(quantile_cont({name}, 0.5), 5) AS p50, round(quantile_cont({name}, 0.75), 5) AS p75,
    max({name}) AS max, round(quantile_cont({name}, 0.5), 5) AS median FROM lineitem"""
    for name in _LINE_NUMBERS
)


@query("describe_columns", _DESCRIBE)
def describe_columns(spark, sf_dir):
    return rounded(P.describe_columns(table(spark, sf_dir, "lineitem"), _LINE_NUMBERS), 5)


@query("describe_columns_bucketed", _DESCRIBE)
def describe_columns_bucketed(spark, sf_dir):
    """The plan used beyond what one task can order, forced by a small bucket size."""
    lines = table(spark, sf_dir, "lineitem")
    return rounded(P.describe_columns(lines, _LINE_NUMBERS, rows_per_bucket=5_000), 5)


_INTEGERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@query(
    "distinct_integers",
    " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS unique_count FROM lineitem""" for c in _INTEGERS)
    + " UNION ALL SELECT 'spread', count(DISTINCT l_orderkey * 1000003 - 7) FROM lineitem",
)
def distinct_integers(spark, sf_dir):
    """Bitmaps for dense keys, distinct values for a spread one."""
    lines = table(spark, sf_dir, "lineitem").withColumn("spread", F.col("l_orderkey") * 1000003 - 7)
    return P.distinct_integers(lines, [*_INTEGERS, "spread"])
