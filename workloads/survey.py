"""The developer-survey analysis over orders dressed as survey answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from censusloom.functions.scalars import rounded
from censusloom.plans import survey as plan
from censusloom.plans import survey_schema as schema
from workloads.associations import _round, _t_tail
from workloads.registry import query
from workloads.tables import table


def _pick(index, texts):
    return F.array(*[F.lit(t) for t in texts])[index.cast("int")]


def survey_answers(spark, sf_dir):
    """One answer row per order, and a second one for every 97th order."""
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment"
    )
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    k = F.col("o_orderkey")
    source = (
        table(spark, sf_dir, "orders")
        .join(customers, "o_custkey", "left")
        .join(nations, "c_nationkey", "left")
        .withColumn("copy", F.explode(F.when(k % 97 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    )
    likert, names = list(schema.LIKERT_SCORES), schema.ORDINAL_QUESTIONS
    columns = {
        "ResponseId": k,
        "YearsCode": F.when(k % 17 == 0, None)
        .when(k % 53 == 0, "Less than 1 year")
        .when(k % 53 > 50, "More than 50 years")
        .otherwise((k % 53).cast("string")),
        "YearsCodePro": F.when(k % 41 == 0, "Less than 1 year").otherwise((k % 41).cast("string")),
        "WorkExp": F.when(k % 13 != 0, (k % 45).cast("double")),
        "ConvertedCompYearly": F.when(k % 3 != 0, F.col("o_totalprice") / F.col("copy")),
        "JobSat": (k % 11).cast("double"),
        "Country": F.col("n_name"),
        "DevType": F.col("o_orderpriority"),
        "RemoteWork": F.when(F.col("o_orderstatus") == "F", "Remote")
        .when(F.col("o_orderstatus") == "O", "In-person")
        .otherwise("Hybrid (some remote, some in-person)"),
        "Industry": F.col("c_mktsegment"),
        "ICorPM": F.when(k % 2 == 0, "Individual contributor").otherwise("People manager"),
        "Employment": F.concat_ws(
            ";",
            F.lit("Employed, full-time"),
            F.when(k % 4 == 0, "Student, part-time"),
            F.when(F.col("o_custkey") % 5 == 0, "Independent contractor, freelancer, or self-employed"),
        ),
        "CodingActivities": F.when(k % 6 != 0, F.concat_ws(";", F.lit("Hobby"), F.col("o_orderpriority"))),
        "LanguageHaveWorkedWith": F.concat_ws(
            ";", F.lit("SQL"), F.when(k % 2 == 0, "Python"), F.concat(F.lit("Language "), (k % 300).cast("string"))
        ),
        "DatabaseHaveWorkedWith": F.when(k % 5 != 0, F.col("o_orderstatus")),
        "PlatformHaveWorkedWith": F.col("c_mktsegment"),
        "ProfessionalTech": F.when(k % 7 != 0, F.lit("DevOps function;Automated testing")),
    }
    for place, name in enumerate(schema.POINT_COLUMNS):
        points = {0: k % 50, 1: 50 - k % 50, 2: F.lit(50), 8: F.when(k % 4 == 0, 5).otherwise(0)}
        columns[name] = points.get(place, F.lit(0)).cast("double")
    for place, name in enumerate(schema.KNOWLEDGE, start=1):
        columns[name] = F.get(F.array(*[F.lit(t) for t in likert]), (((k + place) * (place + 2)) % 6).cast("int"))
    for place, (name, (_, levels, declined)) in enumerate(names.items()):
        texts = [*levels, *declined]
        key = F.col("o_custkey") if place == 0 else k
        columns[name] = _pick(key % len(texts), texts)
    return source.select(*[column.alias(name) for name, column in columns.items()])


def _tables(spark, sf_dir):
    # Checks, the search for repeated answers and the derived columns each read the answers, some twice.
    raw = plan.settled(survey_answers(spark, sf_dir))
    plan.check_input(raw)
    derived = plan.derive(raw, ["ConvertedCompYearly"])
    return plan.SurveyAnalysis(raw, derived, settle=True)


_NUM = """CASE WHEN k % 17 = 0 THEN NULL WHEN k % 53 = 0 THEN 0.5 WHEN k % 53 > 50 THEN 51.0
  ELSE CAST(k % 53 AS DOUBLE) END"""


@query(
    "survey_derive",
    f"""WITH t AS (SELECT o_orderkey AS k, o_custkey AS c, CAST({_NUM} AS DOUBLE) AS y,
      CASE WHEN k % 41 = 0 THEN 0.5 ELSE CAST(k % 41 AS DOUBLE) END AS p,
      CASE WHEN k % 13 <> 0 THEN CAST(k % 45 AS DOUBLE) END AS w,
      CASE WHEN k % 3 <> 0 THEN o_totalprice / CASE WHEN k % 97 = 0 THEN 2 ELSE 1 END END AS pay FROM orders)
    SELECT k AS "ResponseId", y AS "YearsCode_num", CAST(p AS DOUBLE) AS "YearsCodePro_num", w AS "WorkExp_num",
      round(CASE WHEN y > 0 THEN least(p / y, 1) END, 9) AS "ProfessionalExperienceRatio",
      CAST(CASE WHEN y IS NOT NULL THEN greatest(y - p, 0) END AS DOUBLE) AS "PreProfessionalCodingYears",
      w - p AS "WorkProfessionalGapYears",
      CASE WHEN (k + 1) * 3 % 6 < 5 THEN CAST((k + 1) * 3 % 6 - 2 AS DOUBLE) END AS "Knowledge_1_score",
      CASE WHEN c % 8 < 7 THEN CAST(c % 8 AS DOUBLE) END AS "Age_order",
      CASE WHEN k % 8 < 7 THEN CAST(k % 8 AS DOUBLE) END AS "EdLevel_order",
      CASE WHEN k % 10 < 9 THEN CAST(k % 10 AS DOUBLE) END AS "OrgSize_order",
      round(pay, 4) AS "ConvertedCompYearly" FROM t""",
)
def survey_derive(spark, sf_dir):
    """All derived columns in one projection, repeated answers removed."""
    raw = survey_answers(spark, sf_dir)
    derived = plan.derive(raw, ["ConvertedCompYearly"]).select(
        schema.KEY, *schema.EXPERIENCE, *schema.EXPERIENCE_DERIVED, "Knowledge_1_score", *schema.ORDINAL_SCORES,
        schema.TARGET,
    )
    return derived.withColumns(
        {
            "ProfessionalExperienceRatio": F.round("ProfessionalExperienceRatio", 9),
            schema.TARGET: F.round(schema.TARGET, 4),
        }
    )


_PAY = """(SELECT o_orderkey AS k, o_orderpriority, o_orderstatus, n_name, c_mktsegment, pay FROM (
    SELECT *, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice / CASE WHEN o_orderkey % 97 = 0 THEN 2 ELSE 1 END END
    AS pay FROM orders) LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)"""
_CLEANED = f"""v AS (SELECT * FROM {_PAY} WHERE pay > 0),
  b AS (SELECT quantile_cont(pay, 0.01) AS lo, quantile_cont(pay, 0.99) AS hi FROM v),
  s AS (SELECT v.*, ln(1 + pay) AS lg FROM v, b WHERE pay BETWEEN lo AND hi)"""


@query(
    "survey_categories",
    f"""WITH {_CLEANED}, l AS (SELECT 'Country' AS feature, n_name AS category, pay FROM s
      UNION ALL SELECT 'DevType', o_orderpriority, pay FROM s
      UNION ALL SELECT 'RemoteWork', CASE o_orderstatus WHEN 'F' THEN 'Remote' WHEN 'O' THEN 'In-person'
        ELSE 'Hybrid (some remote, some in-person)' END, pay FROM s)
    SELECT feature, category, count(*) AS respondents, round(quantile_cont(pay, 0.5), 6) AS median,
      round(avg(pay), 6) AS mean, round(quantile_cont(pay, 0.25), 6) AS q25, round(quantile_cont(pay, 0.75), 6) AS q75
    FROM l WHERE category IS NOT NULL GROUP BY feature, category HAVING count(*) >= 20""",
)
def survey_categories(spark, sf_dir):
    summary = _tables(spark, sf_dir).categorical_salary_summary
    return rounded(summary.where("feature <> 'EdLevel'"), 6)


@query(
    "survey_headline_facts",
    f"""WITH {_CLEANED}, u AS (SELECT count(*) AS n, count(*) FILTER (pay > 0) AS valid,
        (SELECT count(*) FROM orders WHERE o_orderkey % 97 = 0) AS extra FROM {_PAY}),
      c AS (SELECT o_orderpriority AS category, count(*) AS n, quantile_cont(pay, 0.5) AS m FROM s GROUP BY 1),
      g AS (SELECT n_name AS category, count(*) AS n, quantile_cont(pay, 0.5) AS m FROM s
        WHERE n_name IS NOT NULL GROUP BY 1)
    SELECT 'valid_target_rate_pct' AS fact, NULL::VARCHAR AS label, round(100.0::DOUBLE * valid / (n + extra), 5) AS value FROM u
    UNION ALL SELECT 'outlier_rate_pct', NULL, round(100.0::DOUBLE * (valid - (SELECT count(*) FROM s)) / valid, 5) FROM u
    UNION ALL SELECT 'target_mean', NULL, round(avg(pay), 5) FROM s
    UNION ALL SELECT 'target_median', NULL, round(quantile_cont(pay, 0.5), 5) FROM s
    UNION ALL SELECT 'top_DevType_median', arg_max(category, m), round(max(m), 5) FROM c
    UNION ALL SELECT 'top_DevType_respondents', arg_max(category, m), arg_max(n, m)::DOUBLE FROM c
    UNION ALL SELECT 'top_Country_median', arg_max(category, m), round(max(m), 5) FROM g
    UNION ALL SELECT 'top_Country_respondents', arg_max(category, m), arg_max(n, m)::DOUBLE FROM g
    UNION ALL SELECT 'geometric_mean_ratio', NULL, round(exp(avg(lg) FILTER (o_orderstatus = 'F')
      - avg(lg) FILTER (o_orderstatus = 'O')), 5) FROM s""",
)
def survey_headline_facts(spark, sf_dir):
    return rounded(_tables(spark, sf_dir).level_facts, 5)


@query(
    "survey_matrix",
    """WITH t AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders)
    SELECT count(*) AS cells, count(DISTINCT row_variable) AS variables, 23 AS diagonal FROM (
      SELECT a AS row_variable, b FROM range(23) x(a), range(23) y(b))""",
)
def survey_matrix(spark, sf_dir):
    """Shape of the labelled 23-variable matrix, and its ones on the diagonal."""
    matrix = _tables(spark, sf_dir).numeric_correlation_matrix
    same = F.col("row_variable") == F.col("column_variable")
    # Constant point columns have no correlation, not even with themselves.
    diagonal = F.count_if(same & (F.coalesce(F.col("pearson_r"), F.lit(1.0)) > 0.999999))
    return matrix.agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_distinct("row_variable").alias("variables"),
        diagonal.cast("int").alias("diagonal"),
    )


_RANKED = f"""{_CLEANED}, o AS (SELECT k, lg, (SELECT o_custkey FROM orders WHERE o_orderkey = k) AS c FROM s),
    l AS (SELECT 'Age_order' AS score_column, 'Age' AS feature, c % 8 AS x, lg AS y FROM o WHERE c % 8 < 7
      UNION ALL SELECT 'EdLevel_order', 'Education level', k % 8, lg FROM o WHERE k % 8 < 7
      UNION ALL SELECT 'OrgSize_order', 'Organization size', k % 10, lg FROM o WHERE k % 10 < 9),
    r AS (SELECT feature, score_column, rank() OVER (PARTITION BY score_column ORDER BY x)
        + (count(*) OVER (PARTITION BY score_column, x) - 1) / 2::DOUBLE AS rx,
      rank() OVER (PARTITION BY score_column ORDER BY y)
        + (count(*) OVER (PARTITION BY score_column, y) - 1) / 2::DOUBLE AS ry FROM l),
    c AS (SELECT feature, score_column, count(*) AS valid_rows, corr(rx, ry) AS rho FROM r GROUP BY ALL)"""
_OPTIONS = f"""{_CLEANED}, x AS (SELECT option, CASE WHEN option = 'Student, part-time' THEN k % 4 = 0
        ELSE (SELECT o_custkey FROM orders WHERE o_orderkey = k) % 5 = 0 END AS has, pay, lg
      FROM s, (SELECT unnest(['Student, part-time', 'Independent contractor, freelancer, or self-employed']) AS option)),
    e AS (SELECT option, count(*) FILTER (has) AS selected_rows, count(*) FILTER (NOT has) AS unselected_rows,
      quantile_cont(pay, 0.5) FILTER (has) AS sm, quantile_cont(pay, 0.5) FILTER (NOT has) AS um, corr(has::INT, lg) AS r
      FROM x GROUP BY option HAVING count(*) FILTER (has) >= 20 AND count(*) FILTER (NOT has) >= 20)"""
_TESTS = """pv < 0.05 AS significant_at_0_05, round(least(pv * count(*) OVER (), 1), 5) AS p_value_bonferroni,
      pv * count(*) OVER () < 0.05 AS significant_bonferroni_0_05"""


@query(
    "survey_spearman",
    f"""WITH {_RANKED},
    t AS (SELECT *, rho * sqrt((valid_rows - 2) / (1 - rho * rho)) AS t, (valid_rows - 2)::DOUBLE AS d FROM c),
    p AS (SELECT *, {_t_tail("t", "d")} AS pv FROM t)
    SELECT feature, score_column, valid_rows, round(rho, 9) AS spearman_rho, round(pv, 6) AS p_value, {_TESTS} FROM p""",
)
def survey_spearman(spark, sf_dir):
    tests = _tables(spark, sf_dir).ordinal_income_spearman
    return _round(tests, {"spearman_rho": 9, "p_value": 6, "p_value_bonferroni": 5})


@query(
    "survey_employment",
    f"""WITH {_OPTIONS},
    t AS (SELECT *, r * sqrt((selected_rows + unselected_rows - 2) / (1 - r * r)) AS t, (selected_rows + unselected_rows - 2)::DOUBLE AS d FROM e),
    p AS (SELECT *, {_t_tail("t", "d")} AS pv FROM t)
    SELECT option, selected_rows, unselected_rows, round(sm, 4) AS selected_median, round(um, 4) AS unselected_median,
      round(r, 8) AS point_biserial_r, round(abs(r), 8) AS absolute_r, round(pv, 6) AS p_value, {_TESTS} FROM p""",
)
def survey_employment(spark, sf_dir):
    tests = _tables(spark, sf_dir).employment_income_effects
    places = {"selected_median": 4, "unselected_median": 4, "point_biserial_r": 8, "absolute_r": 8, "p_value": 6, "p_value_bonferroni": 5}
    return _round(tests, places)


@query(
    "survey_cleaned_rows",
    f"""WITH {_CLEANED} SELECT count(*) AS rows, 39 AS columns, round(sum(pay), 0) AS total, round(sum(lg), 3) AS log_total,
      count(DISTINCT k) AS keys, count(n_name) AS countries FROM s""",
)
def survey_cleaned_rows(spark, sf_dir):
    """The cleaned table in its fixed projection."""
    rows = _tables(spark, sf_dir).cleaned_salary_data
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(rows.columns)).alias("columns"),
        F.round(F.sum(schema.TARGET), 0).alias("total"),
        F.round(F.sum(schema.LOG_TARGET), 3).alias("log_total"),
        F.count_distinct(schema.KEY).alias("keys"),
        F.count("Country").alias("countries"),
    )


_NUMBERS = {
    "YearsCode_num": _NUM,
    "YearsCodePro_num": "CASE WHEN k % 41 = 0 THEN 0.5 ELSE k % 41 END",
    "WorkExp_num": "CASE WHEN k % 13 <> 0 THEN k % 45 END",
    **{f"Knowledge_{i}_score": f"CASE WHEN (k + {i}) * {i + 2} % 6 < 5 THEN (k + {i}) * {i + 2} % 6 - 2 END" for i in range(1, 10)},
}
_STRONGEST_NUMBERS = " UNION ALL ".join(f"SELECT '{name}' AS label, corr(CAST({code} AS DOUBLE), lg) AS value FROM s" for name, code in _NUMBERS.items())


@query(
    "survey_strongest",
    f"""WITH n AS (WITH {_CLEANED} {_STRONGEST_NUMBERS}),
    r AS (WITH {_RANKED} SELECT feature AS label, rho AS value FROM c),
    q AS (WITH {_OPTIONS} SELECT option AS label, r AS value FROM e),
    g AS (WITH {_CLEANED}, l AS (SELECT 'Country' AS label, n_name AS category, lg FROM s UNION ALL SELECT 'DevType', o_orderpriority, lg FROM s
        UNION ALL SELECT 'RemoteWork', o_orderstatus, lg FROM s UNION ALL SELECT 'Industry', c_mktsegment, lg FROM s
        UNION ALL SELECT 'ICorPM', (k % 2)::VARCHAR, lg FROM s),
      w AS (SELECT *, avg(lg) OVER (PARTITION BY label) AS m, avg(lg) OVER (PARTITION BY label, category) AS gm FROM (
        SELECT *, count(*) OVER (PARTITION BY label, category) AS n FROM l WHERE category IS NOT NULL) WHERE n >= 20)
      SELECT label, sum(pow(gm - m, 2)) / sum(pow(lg - m, 2)) AS value FROM w GROUP BY label)
    SELECT 'strongest_numeric' AS fact, arg_max(label, abs(value)) AS label, round(arg_max(value, abs(value)), 7) AS value FROM n WHERE isfinite(value)
    UNION ALL SELECT 'strongest_ordinal', arg_max(label, abs(value)), round(arg_max(value, abs(value)), 7) FROM r
    UNION ALL SELECT 'strongest_nominal', arg_max(label, value), round(max(value), 7) FROM g
    UNION ALL SELECT 'strongest_option', arg_max(label, abs(value)), round(arg_max(value, abs(value)), 7) FROM q""",
)
def survey_strongest(spark, sf_dir):
    """The strongest feature of each test table."""
    return rounded(_tables(spark, sf_dir).strongest_facts, 7)
