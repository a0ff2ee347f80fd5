"""Correlations and hypothesis tests, p-values included.

DuckDB has no t or chi-square distribution. The SQL integrates the t density with
Simpson's rule, and uses the closed form of the chi-square tail for even degrees of
freedom.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from censusloom.operators import associations as A
from workloads.distributions import MULTISELECT
from workloads.registry import query
from workloads.tables import SCORED_ORDERS, scored_orders, table, user_days

_MATRIX = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _t_tail(t: str, df: str) -> str:
    """Two-sided p-value of |t| as SQL, 1 - 2 * integral of the density from 0 to |t|."""
    x = f"(abs({t}) * i / 1000)"
    weight = "CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"""abs((SELECT 1 - 2 * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt({df} * pi())
      * abs({t}) / 3000 * sum({weight} * pow(1 + {x} * {x} / {df}, -({df} + 1) / 2.0)) FROM range(1001) s(i)))"""


def _round(df, places: dict[str, int]):
    return df.select(*[F.round(n, places[n]).alias(n) if n in places else F.col(n) for n in df.columns])


_LINE_LONG = " UNION ALL ".join(
    f"SELECT '{n}' AS feature, {n} AS x, ln(1 + l_extendedprice) AS y FROM lineitem"
    for n in ("l_quantity", "l_discount", "l_tax")
)


@query(
    "pearson_top_n",
    f"""SELECT feature, count(*) AS valid_rows, round(corr(x, y), 9) AS pearson_r,
    round(abs(corr(x, y)), 9) AS absolute_r FROM ({_LINE_LONG}) GROUP BY feature
    ORDER BY abs(corr(x, y)) DESC LIMIT 2""",
)
def pearson_top_n(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("log_price", F.log1p("l_extendedprice"))
    best = A.pearson_with_target(lines, ["l_quantity", "l_discount", "l_tax"], "log_price", top_n=2)
    return _round(best, {"pearson_r": 9, "absolute_r": 9})


_CELLS = " UNION ALL ".join(
    f"""SELECT '{a}' AS row_variable, '{b}' AS column_variable,
    count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS valid_rows,
    round(corr({a}, {b}), 9) AS pearson_r FROM m"""
    for a in _MATRIX
    for b in _MATRIX
)


@query(
    "pearson_matrix",
    f"""WITH m AS (SELECT l_quantity, CASE WHEN l_orderkey % 7 <> 0 THEN l_extendedprice END AS l_extendedprice,
      l_discount, CASE WHEN l_orderkey % 5 <> 0 THEN l_tax END AS l_tax FROM lineitem) {_CELLS}""",
)
def pearson_matrix(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_quantity",
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_extendedprice")).alias("l_extendedprice"),
        "l_discount",
        F.when(F.col("l_orderkey") % 5 != 0, F.col("l_tax")).alias("l_tax"),
    )
    return _round(A.pearson_matrix(lines, _MATRIX), {"pearson_r": 9})


@query(
    "pearson_matrix_table",
    " UNION ALL ".join(
        f"SELECT '{a}' AS variable, " + ", ".join(f"round(corr({a}, {b}), 9) AS {b}" for b in _MATRIX) + " FROM lineitem" for a in _MATRIX
    ),
)
def pearson_matrix_table(spark, sf_dir):
    """The matrix in wide form, with its variables as rows and columns."""
    matrix = A.pearson_matrix(table(spark, sf_dir, "lineitem"), _MATRIX)
    return _round(A.matrix_table(matrix, _MATRIX), {name: 9 for name in _MATRIX})


_SPEARMAN = f"""WITH v AS (SELECT priority_order, CAST(o_custkey % 40 AS DOUBLE) AS band, o_totalprice AS y
    FROM {SCORED_ORDERS}),
  l AS (SELECT 'priority_order' AS score_column, 'Priority' AS feature, priority_order AS x, y FROM v
    WHERE priority_order IS NOT NULL UNION ALL SELECT 'band', 'Band', band, y FROM v),
  r AS (SELECT feature, score_column, rank() OVER (PARTITION BY score_column ORDER BY x)
      + (count(*) OVER (PARTITION BY score_column, x) - 1) / 2::DOUBLE AS rx,
    rank() OVER (PARTITION BY score_column ORDER BY y)
      + (count(*) OVER (PARTITION BY score_column, y) - 1) / 2::DOUBLE AS ry FROM l),
  c AS (SELECT feature, score_column, count(*) AS valid_rows, corr(rx, ry) AS rho FROM r GROUP BY ALL),
  t AS (SELECT *, rho * sqrt((valid_rows - 2) / (1 - rho * rho)) AS t, (valid_rows - 2)::DOUBLE AS d FROM c),
  p AS (SELECT feature, score_column, valid_rows, round(rho, 9) AS spearman_rho, round({_t_tail("t", "d")}, 6) AS p_value FROM t)
  SELECT * FROM p"""
_TEST_COLUMNS = ["significant_at_0_05", "p_value_bonferroni", "significant_bonferroni_0_05"]


def _spearman(spark, sf_dir, **settings):
    orders = scored_orders(spark, sf_dir).withColumn("band", F.col("o_custkey") % 40)
    tests = A.spearman_with_target(
        orders, {"priority_order": "Priority", "band": "Band"}, "o_totalprice", **settings
    )
    return _round(tests.drop(*_TEST_COLUMNS), {"spearman_rho": 9, "p_value": 6})


@query("spearman", _SPEARMAN)
def spearman(spark, sf_dir):
    return _spearman(spark, sf_dir)


@query("spearman_bucketed", _SPEARMAN)
def spearman_bucketed(spark, sf_dir):
    """The plan used beyond what one task can order, forced by a small bucket size."""
    return _spearman(spark, sf_dir, rows_per_bucket=1_000)


# Kruskal-Wallis as (N - 1) * SSB / SST of the average ranks; 3 and 5 groups.
_NOMINAL = """WITH l AS (SELECT 'o_orderpriority' AS feature, o_orderpriority AS category, ln(1 + o_totalprice) AS y
      FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus, ln(1 + o_totalprice) FROM orders),
  r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY y)
      + (count(*) OVER (PARTITION BY feature, y) - 1) / 2::DOUBLE AS rk FROM l),
  a AS (SELECT *, avg(y) OVER (PARTITION BY feature) AS my, avg(rk) OVER (PARTITION BY feature) AS mr,
      avg(y) OVER (PARTITION BY feature, category) AS gy, avg(rk) OVER (PARTITION BY feature, category) AS gr FROM r),
  s AS (SELECT feature, count(*) AS valid_rows, count(DISTINCT category) AS group_count,
      sum(pow(gy - my, 2)) / sum(pow(y - my, 2)) AS eta,
      (count(*) - 1) * sum(pow(gr - mr, 2)) / sum(pow(rk - mr, 2)) AS h FROM a GROUP BY feature),
  p AS (SELECT feature, valid_rows, group_count, round(eta, 9) AS eta_squared, round(h, 7) AS kruskal_h,
      exp(-h / 2) * CASE group_count WHEN 3 THEN 1 ELSE 1 + h / 2 END AS pv FROM s)
  SELECT feature, valid_rows, group_count, eta_squared, kruskal_h, round(pv, 9) AS p_value,
    pv < 0.05 AS significant_at_0_05, round(least(pv * 2, 1), 9) AS p_value_bonferroni,
    pv * 2 < 0.05 AS significant_bonferroni_0_05 FROM p"""


def _nominal(spark, sf_dir, **settings):
    orders = table(spark, sf_dir, "orders").withColumn("log_price", F.log1p("o_totalprice"))
    tests = A.nominal_associations(orders, ["o_orderpriority", "o_orderstatus"], "log_price", **settings)
    return _round(tests, {"eta_squared": 9, "kruskal_h": 7, "p_value": 9, "p_value_bonferroni": 9})


@query("nominal_associations", _NOMINAL)
def nominal_associations(spark, sf_dir):
    return _nominal(spark, sf_dir)


@query("nominal_associations_bucketed", _NOMINAL)
def nominal_associations_bucketed(spark, sf_dir):
    """The plan used beyond what one task can order, forced by a small bucket size."""
    return _nominal(spark, sf_dir, rows_per_bucket=1_000)


@query(
    "welch_test",
    f"""WITH g AS (SELECT event_type, count(*)::DOUBLE AS n, avg(ln(1 + value)) AS m, var_samp(ln(1 + value)) AS v
      FROM events WHERE event_type IN ('purchase', 'view') GROUP BY event_type),
    w AS (SELECT a.n AS n1, b.n AS n2, a.m AS m1, b.m AS m2, a.v / a.n AS s1, b.v / b.n AS s2
      FROM g a, g b WHERE a.event_type = 'purchase' AND b.event_type = 'view'),
    t AS (SELECT *, (m1 - m2) / sqrt(s1 + s2) AS t,
      pow(s1 + s2, 2) / (s1 * s1 / (n1 - 1) + s2 * s2 / (n2 - 1)) AS d FROM w),
    p AS (SELECT *, {_t_tail("t", "d")} AS p_value FROM t)
    SELECT CAST(n1 AS BIGINT) AS first_n, CAST(n2 AS BIGINT) AS second_n, round(m1, 9) AS first_mean,
      round(m2, 9) AS second_mean, round(t, 8) AS t_statistic, round(d, 5) AS degrees_of_freedom, round(p_value, 6) AS p_value,
      0.05::DOUBLE AS alpha, CASE WHEN p_value < 0.05 THEN 'means differ' ELSE 'no difference shown' END AS verdict
    FROM p""",
)
def welch_test(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("log_value", F.log1p("value"))
    test = A.welch_test(events, "event_type", "purchase", "view", "log_value")
    return _round(
        test,
        {"first_mean": 9, "second_mean": 9, "t_statistic": 8, "degrees_of_freedom": 5, "p_value": 6},
    )


@query(
    "multiselect_tests",
    f"""WITH e AS ({MULTISELECT}),
    t AS (SELECT *, point_biserial_r * sqrt((selected_rows + unselected_rows - 2)
        / (1 - point_biserial_r * point_biserial_r)) AS t, (selected_rows + unselected_rows - 2)::DOUBLE AS d FROM e),
    p AS (SELECT option, point_biserial_r, {_t_tail("t", "d")} AS p_value FROM t)
    SELECT option, point_biserial_r, round(p_value, 6) AS p_value, p_value < 0.05 AS significant_at_0_05,
      round(least(p_value * count(*) OVER (), 1), 5) AS p_value_bonferroni,
      p_value * count(*) OVER () < 0.05 AS significant_bonferroni_0_05 FROM p""",
)
def multiselect_tests(spark, sf_dir):
    """Point-biserial p-values with their Bonferroni correction."""
    rows = user_days(spark, sf_dir).where("total > 0")
    tests = A.multiselect_tests(rows, "types", "total", "log_total").select(
        "option", "point_biserial_r", "p_value", *_TEST_COLUMNS
    )
    return _round(tests, {"point_biserial_r": 8, "p_value": 6, "p_value_bonferroni": 5})


@query(
    "train_correlations",
    """WITH t AS (SELECT *, ln(1 + o_totalprice) AS y FROM orders
      WHERE ('0x' || substr(md5('42:' || o_orderkey), 1, 8))::BIGINT % 100 < 80),
    l AS (SELECT 'o_custkey' AS feature, CAST(o_custkey AS DOUBLE) AS x, y FROM t
      UNION ALL SELECT 'o_orderkey', CAST(o_orderkey AS DOUBLE), y FROM t)
    SELECT feature, round(corr(x, y), 9) AS pearson_r, round(abs(corr(x, y)), 9) AS absolute_r,
      true AS used_by_model FROM l GROUP BY feature""",
)
def train_correlations(spark, sf_dir):
    """Numeric inputs against the log target, on the training part only."""
    from censusloom.modeling import ModelSpec
    from censusloom.modeling.training import split, train_correlations as correlations

    # The constant has no correlation and is left out.
    spec = ModelSpec(target="o_totalprice", key="o_orderkey", numeric=["o_custkey", "o_orderkey", "constant"])
    orders = table(spark, sf_dir, "orders").withColumn("constant", F.lit(1.0))
    return _round(correlations(split(orders, spec)[0], spec), {"pearson_r": 9, "absolute_r": 9})
