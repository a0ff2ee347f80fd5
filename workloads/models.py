"""Metrics, cross-validation, model selection and permutation importance."""

from __future__ import annotations

from pyspark.sql import functions as F

from censusloom.functions.scalars import rounded, sorted_json
from censusloom.modeling import ModelSpec, train_and_select
from censusloom.modeling.evaluation import (
    cv_summary, population_metrics, regression_metrics, tuning_summary,
)
from censusloom.modeling.importance import permutation_importance
from censusloom.modeling.selection import cross_validate, fit_final, with_folds
from censusloom.modeling.spec import RIDGE_GRID
from censusloom.modeling.training import split
from censusloom.plans.facts import model_facts
from workloads.registry import query
from workloads.tables import table
from workloads.windows import FOLDS_SQL

_E = "(y - p)"
_LE = "(ln(1 + greatest(y, 0)) - ln(1 + greatest(p, 0)))"


def _metrics_sql(prefix: str = "", where: str = "true") -> str:
    total = f"(var_pop(y) FILTER ({where}) * count(*) FILTER ({where}))"
    log_total = f"(var_pop(ln(1 + greatest(y, 0))) FILTER ({where}) * count(*) FILTER ({where}))"
    return f"""round(avg(abs{_E}) FILTER ({where}), 4) AS {prefix}mae,
      round(sqrt(avg({_E} * {_E}) FILTER ({where})), 4) AS {prefix}rmse,
      round(1 - sum({_E} * {_E}) FILTER ({where}) / {total}, 8) AS {prefix}r2,
      round(sqrt(avg({_LE} * {_LE}) FILTER ({where})), 8) AS {prefix}log_rmse,
      round(1 - sum({_LE} * {_LE}) FILTER ({where}) / {log_total}, 8) AS {prefix}log_r2"""


def _round_metrics(df):
    places = {n: 4 if n.endswith(("mae", "rmse")) and "log" not in n else 8 for n in df.columns}
    floating = {f.name for f in df.schema.fields if f.dataType.simpleString() == "double"}
    return df.select(*[F.round(n, places[n]).alias(n) if n in floating else F.col(n) for n in df.columns])


_GUESS = "l_quantity * 1000 + 25000 - 60000 * (l_linenumber // 7)"


def _guessed(spark, sf_dir):
    """Prices with a fixed guess, some of them below 0."""
    guess = F.col("l_quantity") * 1000 + 25000 - 60000 * F.floor(F.col("l_linenumber") / 7)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_returnflag", F.col("l_extendedprice").alias("y"), guess.alias("p")
    )


@query(
    "regression_metrics",
    f"""SELECT l_returnflag, count(*) AS rows, {_metrics_sql()} FROM
    (SELECT l_returnflag, l_extendedprice AS y, {_GUESS} AS p FROM lineitem) GROUP BY l_returnflag""",
)
def regression_metrics_query(spark, sf_dir):
    return _round_metrics(regression_metrics(_guessed(spark, sf_dir), "y", "p", ["l_returnflag"]))


@query(
    "population_metrics",
    f"""SELECT {_metrics_sql("", "y BETWEEN 20000 AND 80000")}, {_metrics_sql("full_test_")} FROM
    (SELECT l_extendedprice AS y, greatest({_GUESS}, 0) AS p FROM lineitem)""",
)
def population_metrics_query(spark, sf_dir):
    inlier = F.col("y").between(20000, 80000)
    return _round_metrics(population_metrics(_guessed(spark, sf_dir), "y", "p", inlier))


_FOLD_SCORES = """WITH g AS (SELECT 'model ' || m AS model, m > 1 AS tuned, '{"slope": ' || m || '}' AS params,
    l_orderkey % 5 AS fold, l_extendedprice AS y, l_quantity * 1000 * m + 1000 AS p FROM lineitem, range(1, 4) t(m)),
  f AS (SELECT model, tuned, params, fold, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse,
    1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2,
    sqrt(avg(pow(ln(1 + y) - ln(1 + p), 2))) AS log_rmse,
    1 - sum(pow(ln(1 + y) - ln(1 + p), 2)) / (var_pop(ln(1 + y)) * count(*)) AS log_r2
    FROM g GROUP BY model, tuned, params, fold)"""


def _fold_scores(spark, sf_dir):
    """Metrics of three fixed guesses on five folds."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("m"),
        (F.col("l_orderkey") % 5).alias("fold"),
        F.col("l_extendedprice").alias("y"),
        "l_quantity",
    )
    guesses = lines.select(
        F.concat(F.lit("model "), F.col("m").cast("string")).alias("model"),
        (F.col("m") > 1).alias("tuned"),
        sorted_json(F.create_map(F.lit("slope"), F.col("m"))).alias("params"),
        "fold",
        "y",
        (F.col("l_quantity") * 1000 * F.col("m") + 1000).alias("p"),
    )
    return regression_metrics(guesses, "y", "p", ["model", "tuned", "params", "fold"])


@query(
    "cv_summary",
    f"""{_FOLD_SCORES} SELECT model, tuned, CAST(count(*) AS INTEGER) AS cv_folds,
    round(avg(log_rmse), 6) AS cv_log_rmse_mean, round(stddev_samp(log_rmse), 6) AS cv_log_rmse_std,
    round(avg(log_r2), 6) AS cv_log_r2_mean, round(stddev_samp(log_r2), 6) AS cv_log_r2_std,
    round(avg(mae), 6) AS cv_mae_mean, round(stddev_samp(mae), 6) AS cv_mae_std,
    round(avg(rmse), 6) AS cv_rmse_mean, round(avg(r2), 6) AS cv_r2_mean FROM f GROUP BY model, tuned""",
)
def cv_summary_query(spark, sf_dir):
    return rounded(cv_summary(_fold_scores(spark, sf_dir)), 6)


@query(
    "tuning_summary",
    f"""{_FOLD_SCORES}, s AS (SELECT params, avg(log_rmse) AS a, stddev_pop(log_rmse) AS b, avg(log_r2) AS c,
      avg(mae) AS d, avg(rmse) AS e, avg(r2) AS g FROM f GROUP BY params)
    SELECT CAST(rank() OVER (ORDER BY d) AS INTEGER) AS rank, round(a, 6) AS mean_log_rmse,
      round(b, 6) AS std_log_rmse, round(c, 6) AS mean_log_r2, round(d, 6) AS mean_mae, round(e, 6) AS mean_rmse,
      round(g, 6) AS mean_r2, params FROM s""",
)
def tuning_summary_query(spark, sf_dir):
    return rounded(tuning_summary(_fold_scores(spark, sf_dir)), 6)


def orders_to_model(spark, sf_dir):
    """Orders with customer attributes and a summary of their lines."""
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            F.count(F.lit(1)).alias("line_count"),
            F.avg("l_discount").alias("mean_discount"),
            F.array_join(F.sort_array(F.collect_set("l_returnflag")), ";").alias("return_flags"),
        )
    )
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_mktsegment", "c_nationkey"
    )
    return (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
        .join(customers, "o_custkey", "left")
        .join(lines, "o_orderkey", "left")
    )


def order_spec(**changes) -> ModelSpec:
    settings = {
        "target": "o_totalprice",
        "key": "o_orderkey",
        "numeric": ["c_acctbal", "line_count", "mean_discount"],
        "nominal": ["o_orderstatus", "o_orderpriority", "c_mktsegment", "c_nationkey"],
        "multiselect": ["return_flags"],
        "forest": {"n_estimators": 8, "max_depth": 5, "max_features": 0.6, "min_samples_leaf": 4},
        "grid": {"n_estimators": [6, 10], "max_depth": [4, 6], "max_samples": [0.75, None]},
        "tuning_draws": 2,
    }
    return ModelSpec(**{**settings, **changes})


def _candidate_scores(spark, sf_dir, name):
    spec = order_spec()
    kind, values = spec.candidates()[name]
    folded = with_folds(orders_to_model(spark, sf_dir), spec)
    return cv_summary(cross_validate(folded, spec, {name: (name, False, kind, values)}))


@query("ridge_cv")
def ridge_cv(spark, sf_dir):
    return _candidate_scores(spark, sf_dir, "Ridge")


def _ridge_sql(alphas) -> str:
    """Closed form with two features: each fold's scales, its normal equations, Cramer's rule."""
    return f"""WITH base AS (SELECT o.*, f.fold, CAST(c_acctbal AS DOUBLE) AS x1, CAST(coalesce(n_lines, 0) AS DOUBLE) AS x2, ln(1 + o_totalprice) AS y
      FROM orders o JOIN ({FOLDS_SQL}) f USING (o_orderkey) JOIN customer ON c_custkey = o_custkey
      LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey),
    s AS (SELECT k.fold AS out, avg(x1) AS m1, avg(x2) AS m2, stddev_pop(x1) AS d1, stddev_pop(x2) AS d2, avg(y) AS my
      FROM base b, range(5) k(fold) WHERE b.fold <> k.fold GROUP BY k.fold),
    e AS (SELECT s.out, sum(((x1 - m1) / d1) ** 2) AS a, sum((x1 - m1) / d1 * (x2 - m2) / d2) AS b, sum(((x2 - m2) / d2) ** 2) AS c,
        sum((x1 - m1) / d1 * (y - my)) AS p, sum((x2 - m2) / d2 * (y - my)) AS q
      FROM base, s WHERE base.fold <> s.out GROUP BY s.out),
    w AS (SELECT out, alpha, (p * (c + alpha) - q * b) / ((a + alpha) * (c + alpha) - b * b) AS w1,
        (q * (a + alpha) - p * b) / ((a + alpha) * (c + alpha) - b * b) AS w2
      FROM e, (SELECT unnest({list(alphas)})::DOUBLE AS alpha)),
    g AS (SELECT fold, alpha, o_totalprice AS y, exp(my + w1 * (x1 - m1) / d1 + w2 * (x2 - m2) / d2) - 1 AS p
      FROM base JOIN s ON s.out = fold JOIN w ON w.out = fold),
    m AS (SELECT fold, alpha, avg(abs(y - p)) AS mae, sqrt(avg((y - p) ** 2)) AS rmse,
        1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) AS r2, sqrt(avg({_LE} ** 2)) AS log_rmse,
        1 - sum({_LE} ** 2) / (var_pop(ln(1 + y)) * count(*)) AS log_r2 FROM g GROUP BY fold, alpha)
    SELECT '{{"alpha": ' || alpha || '}}' AS params, round(avg(log_rmse), 6) AS mean_log_rmse, round(stddev_pop(log_rmse), 6) AS std_log_rmse,
      round(avg(log_r2), 6) AS mean_log_r2, round(avg(mae), 4) AS mean_mae, round(avg(rmse), 4) AS mean_rmse, round(avg(r2), 6) AS mean_r2
    FROM m GROUP BY alpha"""


@query("ridge_grid", _ridge_sql(RIDGE_GRID["alpha"]))
def ridge_grid(spark, sf_dir):
    """The whole ridge grid on all folds, from one pass of sums."""
    spec = order_spec(
        numeric=["c_acctbal", "line_count"], nominal=[], multiselect=[], tuned="Ridge", grid=RIDGE_GRID, tuning_draws=6
    )
    orders = orders_to_model(spark, sf_dir).select("o_orderkey", "o_totalprice", "c_acctbal", "line_count").na.fill(0, ["line_count"])
    draws = {f"draw {i}": ("Tuned Ridge", True, "Ridge", draw) for i, draw in enumerate(spec.draws())}
    table_of_draws = tuning_summary(cross_validate(with_folds(orders, spec), spec, draws)).drop("rank")
    places = {"mean_mae": 4, "mean_rmse": 4}
    return table_of_draws.select(
        "params", *[F.round(c, places.get(c, 6)).alias(c) for c in table_of_draws.columns if c != "params"]
    )


@query("forest_cv")
def forest_cv(spark, sf_dir):
    return _candidate_scores(spark, sf_dir, "RandomForest")


@query("model_selection")
def model_selection(spark, sf_dir):
    """The whole training job; its one row of final metrics."""
    return train_and_select(orders_to_model(spark, sf_dir), order_spec(importance_repeats=1)).metrics


@query("importance")
def importance(spark, sf_dir):
    """Permutation importance of a ridge model over the whole holdout."""
    spec = order_spec(importance_rows=None)
    train, test = split(orders_to_model(spark, sf_dir), spec)
    model = fit_final(train, spec, "Ridge", spec.ridge)
    return permutation_importance(model, test, spec)


def _importance_sql(alpha: float = 1.0, repeats: int = 2) -> str:
    """Ridge on two features in closed form, and every shuffled column's drop in log R2."""
    moments = "avg(x1) AS m1, avg(x2) AS m2, stddev_pop(x1) AS d1, stddev_pop(x2) AS d2, avg(y) AS my"
    return f"""WITH base AS (SELECT o_orderkey AS k, CAST(c_acctbal AS DOUBLE) AS x1, CAST(coalesce(n_lines, 0) AS DOUBLE) AS x2,
        ln(1 + o_totalprice) AS y, ('0x' || substr(md5('42:' || o_orderkey), 1, 8))::BIGINT % 100 < 80 AS training
      FROM orders JOIN customer ON c_custkey = o_custkey
      LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey),
    s AS (SELECT {moments} FROM base WHERE training),
    e AS (SELECT sum(((x1 - m1) / d1) ** 2) + {alpha} AS a, sum((x1 - m1) / d1 * (x2 - m2) / d2) AS b, sum(((x2 - m2) / d2) ** 2) + {alpha} AS c,
        sum((x1 - m1) / d1 * (y - my)) AS p, sum((x2 - m2) / d2 * (y - my)) AS q FROM base, s WHERE training),
    w AS (SELECT (p * c - q * b) / (a * c - b * b) AS w1, (q * a - p * b) / (a * c - b * b) AS w2 FROM e),
    t AS (SELECT k, y, w1 * (x1 - m1) / d1 AS c1, w2 * (x2 - m2) / d2 AS c2, my FROM base, s, w WHERE NOT training),
    r AS (SELECT rep, row_number() OVER (PARTITION BY rep ORDER BY md5('42/rows:' || k), k) AS place, y, my, c1, c2 FROM t, range({repeats}) u(rep)),
    g AS (SELECT rep, row_number() OVER (PARTITION BY rep ORDER BY md5('42/donors/' || rep || ':' || k), k) AS place, c1 AS g1, c2 AS g2
      FROM t, range({repeats}) u(rep)),
    v AS (SELECT 'c_acctbal' AS feature, rep, y, my + g1 + c2 AS p FROM r JOIN g USING (rep, place)
      UNION ALL SELECT 'line_count', rep, y, my + c1 + g2 FROM r JOIN g USING (rep, place)),
    f AS (SELECT feature, rep, 1 - sum((y - greatest(p, 0)) ** 2) / (var_pop(y) * count(*)) AS r2 FROM v GROUP BY feature, rep),
    i AS (SELECT 1 - sum((y - greatest(my + c1 + c2, 0)) ** 2) / (var_pop(y) * count(*)) AS whole FROM t)
    SELECT feature, round(avg(whole - r2), 7) AS importance_mean, round(stddev_pop(whole - r2), 7) AS importance_std,
      'decrease_in_log_r2' AS metric FROM f, i GROUP BY feature"""


@query("importance_ridge", _importance_sql())
def importance_ridge(spark, sf_dir):
    """Permutation importance of a ridge on two columns, in closed form in SQL."""
    spec = order_spec(numeric=["c_acctbal", "line_count"], nominal=[], multiselect=[], importance_rows=None, importance_repeats=2)
    orders = orders_to_model(spark, sf_dir).select("o_orderkey", "o_totalprice", "c_acctbal", "line_count").na.fill(0, ["line_count"])
    train, test = split(orders, spec)
    found = permutation_importance(fit_final(train, spec, "Ridge", spec.ridge), test, spec)
    return found.select("feature", *[F.round(c, 7).alias(c) for c in ("importance_mean", "importance_std")], "metric")


@query(
    "model_facts",
    f"""{_FOLD_SCORES}, s AS (SELECT model, avg(mae) AS mae, avg(log_rmse) AS lr FROM f GROUP BY model),
    b AS (SELECT arg_min(model, mae) AS model, min(mae) AS mae, arg_min(lr, mae) AS lr FROM s),
    r AS (SELECT mae, lr FROM s WHERE model = 'model 3')
    SELECT 'selected_model_mae' AS fact, b.model AS label, round(b.mae, 5) AS value FROM b
    UNION ALL SELECT 'log_rmse_gap', NULL, round(abs(b.lr - r.lr), 5) FROM b, r
    UNION ALL SELECT 'mae_gain', NULL, round(r.mae - b.mae, 5) FROM b, r""",
)
def model_facts_query(spark, sf_dir):
    """The best model against a baseline, read off the comparison table."""
    return rounded(model_facts(cv_summary(_fold_scores(spark, sf_dir)), "model 3"), 5)
