"""Coercion, scores, derived columns, filters, trims and deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from censusloom.functions import scalars as S
from censusloom.operators import cleaning as C
from censusloom.sources.contracts import duplicate_count
from workloads.registry import query
from workloads.tables import (
    ANSWERS, EXPERIENCE, PRIORITY_LABELS, SCORED_ORDERS, answers, experience,
    scored_orders, table,
)

_YEARS = """CASE WHEN years_text = 'Less than 1 year' THEN 0.5 WHEN years_text = 'More than 50 years'
  THEN 51.0 ELSE TRY_CAST(years_text AS DOUBLE) END"""
_SEGMENT_SCORES = {"AUTOMOBILE": -2, "BUILDING": -1, "FURNITURE": 0, "HOUSEHOLD": 1, "MACHINERY": 2}
_LINE_ORDER = [
    "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
    "l_linestatus", "l_shipdate",
]


@query("years_to_number", f"SELECT p_partkey, CAST({_YEARS} AS DOUBLE) AS years FROM {EXPERIENCE}")
def years_to_number(spark, sf_dir):
    text = F.col("years_text")
    years = S.years_to_number(text, {"Less than 1 year": 0.5, "More than 50 years": 51.0})
    return experience(spark, sf_dir).select("p_partkey", years.alias("years"))


@query(
    "experience_columns",
    f"""WITH t AS (SELECT p_partkey, CAST(professional_text AS DOUBLE) AS pro, work_years, total_years
      FROM {EXPERIENCE})
    SELECT p_partkey, round(CASE WHEN total_years > 0 THEN least(greatest(pro / total_years, 0), 1) END, 9) AS ratio,
      greatest(total_years - pro, 0) AS before_profession, work_years - pro AS gap,
      round(CASE WHEN pro > 0 AND total_years > 0
        THEN greatest(pro, total_years) / least(pro, total_years) END, 9) AS multiple FROM t""",
)
def experience_columns(spark, sf_dir):
    df = experience(spark, sf_dir)
    professional, total = S.number(df, "professional_text"), F.col("total_years")
    return df.select(
        "p_partkey",
        F.round(S.bounded_ratio(professional, total), 9).alias("ratio"),
        S.floored_difference(total, professional).alias("before_profession"),
        (F.col("work_years") - professional).alias("gap"),
        F.round(S.safe_multiple(professional, total), 9).alias("multiple"),
    )


@query(
    "likert_score",
    """SELECT c_custkey, CAST(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN -2 WHEN 'BUILDING' THEN -1
    WHEN 'FURNITURE' THEN 0 WHEN 'HOUSEHOLD' THEN 1 WHEN 'MACHINERY' THEN 2 END AS DOUBLE) AS score
    FROM customer""",
)
def likert_score(spark, sf_dir):
    score = S.label_score(F.col("c_mktsegment"), _SEGMENT_SCORES)
    return table(spark, sf_dir, "customer").select("c_custkey", score.alias("score"))


@query(
    "ordinal_score",
    f"""SELECT o_orderkey, priority_order, CASE WHEN priority_order IS NOT NULL THEN o_orderpriority END AS label
    FROM {SCORED_ORDERS}""",
)
def ordinal_score(spark, sf_dir):
    """Label to score, a declined label to NULL, and the score back to its label."""
    return scored_orders(spark, sf_dir).select(
        "o_orderkey", "priority_order", S.score_label(F.col("priority_order"), PRIORITY_LABELS).alias("label")
    )


@query(
    "log_scale",
    """SELECT c_custkey, round(ln(1 + greatest(c_acctbal, 0)), 9) AS logged,
    round(exp(ln(1 + greatest(c_acctbal, 0))) - 1, 4) AS back FROM customer""",
)
def log_scale(spark, sf_dir):
    logged = S.log_scale(S.non_negative(F.col("c_acctbal")))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.round(logged, 9).alias("logged"), F.round(S.linear_scale(logged), 4).alias("back")
    )


@query(
    "allocation_mask",
    """WITH t AS (SELECT p_partkey, p_size AS a, 100 - p_size AS b, CASE WHEN p_partkey % 3 = 0 THEN 5 ELSE 0 END
      AS c, p_partkey % 3 <> 0 AS ok FROM part)
    SELECT p_partkey, CASE WHEN ok THEN CAST(a AS DOUBLE) END AS first_points,
      CASE WHEN ok THEN CAST(b AS DOUBLE) END AS second_points,
      CASE WHEN ok THEN CAST(c AS DOUBLE) END AS third_points FROM t""",
)
def allocation_mask(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_size").cast("double").alias("first_points"),
        (100.0 - F.col("p_size")).alias("second_points"),
        F.when(F.col("p_partkey") % 3 == 0, 5.0).otherwise(0.0).alias("third_points"),
    )
    return S.mask_allocation(parts, ["first_points", "second_points", "third_points"])


@query("valid_target_filter", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def valid_target_filter(spark, sf_dir):
    return C.valid_target(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")


@query(
    "complete_cases",
    f"SELECT event_id, event_type, value FROM {ANSWERS} WHERE event_type IS NOT NULL AND value IS NOT NULL",
)
def complete_cases(spark, sf_dir):
    rows = answers(spark, sf_dir).select("event_id", "event_type", "value")
    return C.complete_cases(rows, ["event_type", "value"])


_TRIM = """WITH v AS (SELECT * FROM customer WHERE c_acctbal > 0),
  b AS (SELECT quantile_cont(c_acctbal, 0.01) AS lo, quantile_cont(c_acctbal, 0.99) AS hi FROM v)
  SELECT c_custkey, c_acctbal FROM v, b WHERE c_acctbal BETWEEN lo AND hi"""


@query("quantile_trim", _TRIM)
def quantile_trim(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return C.quantile_trim(rows, "c_acctbal")[0]


@query("quantile_trim_bucketed", _TRIM)
def quantile_trim_bucketed(spark, sf_dir):
    """The plan used beyond what one task can order, forced by a small bucket size."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return C.quantile_trim(rows, "c_acctbal", rows_per_bucket=100)[0]


@query(
    "iqr_fence",
    """WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b
      FROM orders WHERE o_orderstatus <> 'P'), f AS (SELECT a - 0.5 * (b - a) AS lo, b + 0.5 * (b - a) AS hi FROM q)
    SELECT o_orderkey, o_totalprice FROM orders, f WHERE o_totalprice BETWEEN lo AND hi""",
)
def iqr_fence(spark, sf_dir):
    """Fences learned on one part of the rows, applied to all of them."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    low, high = C.iqr_fences(orders.where("o_orderstatus <> 'P'"), "o_totalprice", factor=0.5)
    return C.within(orders, "o_totalprice", low, high).drop("o_orderstatus")


@query(
    "large_groups",
    """SELECT p_partkey, p_name FROM part WHERE p_name IN
    (SELECT p_name FROM part GROUP BY p_name HAVING count(*) >= 33)""",
)
def large_groups(spark, sf_dir):
    return C.rows_of_large_groups(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", 33)


_LINES = "l_orderkey, l_linenumber, " + ", ".join(_LINE_ORDER)


@query(
    "dedup_first",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {", ".join(_LINE_ORDER)}) AS rn
      FROM lineitem) WHERE rn = 1""",
)
def dedup_first(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return C.first_per_key(lines, ["l_orderkey", "l_linenumber"], _LINE_ORDER).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
    )


@query(
    "duplicate_count",
    """SELECT (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM
    (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS duplicates""",
)
def duplicates(spark, sf_dir):
    return duplicate_count(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "cleaning_quality",
    """WITH u2 AS (SELECT o_custkey, p FROM (SELECT o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL
        WHEN o_orderkey % 11 = 0 THEN -1.0 ELSE o_totalprice END AS p,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1),
      b AS (SELECT quantile_cont(p, 0.01) AS lo, quantile_cont(p, 0.99) AS hi FROM u2 WHERE p > 0),
      n AS (SELECT (SELECT count(*) FROM orders) AS rows_before, count(*) AS unique_rows,
        count(*) FILTER (p IS NULL OR p <= 0) AS invalid, count(*) FILTER (p > 0 AND (p < lo OR p > hi)) AS outliers,
        count(*) FILTER (p > 0 AND p BETWEEN lo AND hi) AS kept, max(lo) AS lo, max(hi) AS hi FROM u2, b)
    SELECT 'rows_before' AS item, CAST(rows_before AS DOUBLE) AS value FROM n
    UNION ALL SELECT 'duplicate_keys', rows_before - unique_rows FROM n
    UNION ALL SELECT 'invalid_target_rows', invalid FROM n
    UNION ALL SELECT 'lower_bound', round(lo, 4) FROM n UNION ALL SELECT 'upper_bound', round(hi, 4) FROM n
    UNION ALL SELECT 'outlier_rows', outliers FROM n UNION ALL SELECT 'rows_after', kept FROM n
    UNION ALL SELECT 'missing_cells_after', 0 FROM n""",
)
def cleaning_quality(spark, sf_dir):
    key = F.col("o_orderkey")
    price = F.when(key % 7 == 0, None).when(key % 11 == 0, -1.0).otherwise(F.col("o_totalprice"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", price.alias("price"))
    report = C.clean(orders, ["o_custkey"], ["o_orderkey"], "price")[1]
    return S.rounded(report, 4)
