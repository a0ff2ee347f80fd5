"""Correlations, group-difference tests and their corrected p-values."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from censusloom.errors import check
from censusloom.functions.scalars import finite, number
from censusloom.functions.tails import chi_square_p, correlation_p, student_p
from censusloom.operators.distributions import long_categories, multiselect_effects
from censusloom.operators.layout import ROWS_PER_BUCKET, fit_layouts
from censusloom.operators.ranks import ranked_rows, with_group_rows

ALPHA = 0.05


def correlation_of(x: str, y: str) -> Column:
    """Pearson r as an aggregate; NULL when either side does not vary.

    The built-in ``corr`` raises a division error there. Rows must be complete.
    """
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def bonferroni(tests: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Add flags and the Bonferroni-adjusted p-value over all rows of a test table."""
    every = Window.partitionBy(F.lit(1))  # one row per test
    adjusted = F.least(F.col("p_value") * F.count(F.lit(1)).over(every), F.lit(1.0))
    return (
        tests.withColumn("significant_at_0_05", F.col("p_value") < alpha)
        .withColumn("p_value_bonferroni", adjusted)
        .withColumn("significant_bonferroni_0_05", F.col("p_value_bonferroni") < alpha)
    )


def pearson_with_target(
    df: DataFrame, features: Sequence[str], target: str, top_n: int | None = None
) -> DataFrame:
    """Pairwise-complete Pearson r of each feature with the target, strongest first.

    Features with fewer than two pairs, or without variation, are left out.
    """
    check(top_n is None or top_n >= 1, "top_n must be at least 1")
    values = df.select(
        number(df, target).alias("_y"), *[number(df, name).alias(name) for name in features]
    )
    pairs = values.unpivot(["_y"], list(features), "feature", "x").dropna()
    ranked = (
        pairs.groupBy("feature")
        .agg(F.count(F.lit(1)).alias("valid_rows"), finite(correlation_of("x", "_y")).alias("pearson_r"))
        .where((F.col("valid_rows") >= 2) & F.col("pearson_r").isNotNull())
        .withColumn("absolute_r", F.abs("pearson_r"))
        .orderBy(F.desc("absolute_r"), "feature")
    )
    return ranked if top_n is None else ranked.limit(top_n)


def pearson_matrix(df: DataFrame, columns: Sequence[str], labels: Mapping[str, str] | None = None) -> DataFrame:
    """Full pairwise-complete Pearson matrix in long form.

    (row_variable, column_variable, valid_rows, pearson_r); r is NULL where it is
    undefined. Every partition reduces its rows to one number block per pair with
    matrix products, so the shuffle carries columns^2 rows per task, not rows x pairs.
    """
    columns = list(columns)
    labels = dict(labels or {})
    values = df.select(*[number(df, name).alias(name) for name in columns])
    # Sums around the column means keep their digits. One number per column.
    means = values.agg(*[F.avg(name).alias(name) for name in columns]).first()
    shift = np.array([means[name] if means[name] is not None else 0.0 for name in columns])
    width = len(columns)

    def reduce_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, first, square, product = (np.zeros((width, width)) for _ in range(4))
        for batch in batches:
            block = np.column_stack(
                [c.to_numpy(zero_copy_only=False).astype("float64") for c in batch.columns]
            )
            known = ~np.isnan(block)
            centred = np.where(known, block - shift, 0.0)
            mask = known.astype("float64")
            count += mask.T @ mask
            first += centred.T @ mask  # sum of i over pairs with j known
            square += (centred * centred).T @ mask
            product += centred.T @ centred
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(i.astype("int32")),
                pa.array(j.astype("int32")),
                *[
                    pa.array(block)
                    for block in (
                        count[i, j], first[i, j], first[j, i], square[i, j], square[j, i], product[i, j]
                    )
                ],
            ],
            names=["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"],
        )

    partial = values.mapInArrow(
        reduce_block, "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"
    )
    sums = partial.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])

    def spread(total: str, squares: str) -> Column:
        mean_square = F.try_divide(F.col(total) * F.col(total), F.col("n"))
        left = F.col(squares) - mean_square
        # What is left of a constant column is rounding noise.
        return F.when(left > F.col(squares) * 1e-12, left)

    r = F.try_divide(
        F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), F.col("n")),
        F.sqrt(spread("sx", "sxx")) * F.sqrt(spread("sy", "syy")),
    )
    names = F.array(*[F.lit(labels.get(name, name)) for name in columns])
    upper = sums.select(
        names[F.col("i")].alias("row_variable"),
        names[F.col("j")].alias("column_variable"),
        F.col("n").cast("long").alias("valid_rows"),
        F.when(F.col("n") >= 2, F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)))
        .alias("_r"),
        r.isNotNull().alias("_defined"),
    ).select(
        "row_variable",
        "column_variable",
        "valid_rows",
        F.when(F.col("_defined"), F.col("_r")).alias("pearson_r"),
    )
    lower = upper.where(F.col("row_variable") != F.col("column_variable")).select(
        F.col("column_variable").alias("row_variable"),
        F.col("row_variable").alias("column_variable"),
        "valid_rows",
        "pearson_r",
    )
    return upper.unionByName(lower)


def matrix_table(matrix: DataFrame, variables: Sequence[str]) -> DataFrame:
    """A long matrix as a table: ``variable``, then one column per variable, in the given order.

    The long form has one row per pair of variables, so the pivot is as small as the matrix.
    """
    place = F.array_position(F.array(*[F.lit(v) for v in variables]), F.col("row_variable"))
    wide = matrix.groupBy("row_variable").pivot("column_variable", list(variables)).agg(F.first("pearson_r"))
    rows = wide.orderBy(place).withColumnRenamed("row_variable", "variable")
    return rows.select("variable", *[F.col("`" + v.replace("`", "``") + "`") for v in variables])


def spearman_with_target(
    df: DataFrame,
    features: Mapping[str, str],
    target: str,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Spearman rho of each score column with the target, with p-values.

    ``features`` maps a score column to its display name. Features with fewer than
    three pairs, or without variation, are left out.
    """
    columns = list(features)
    values = df.select(
        number(df, target).alias("y"), *[number(df, name).alias(name) for name in columns]
    )
    long = values.unpivot(["y"], columns, "score_column", "x").dropna()
    layouts = fit_layouts(long, ["x", "y"], rows_per_bucket)
    pairs = long.groupBy("score_column", "x", "y").agg(F.count(F.lit(1)).alias("_pairs"))
    ranked = pairs
    for side in ("x", "y"):
        ranked = ranked_rows(ranked, ["score_column"], side, "_pairs", layouts[side], f"_{side}", pairs)
    middle = (F.col("_rows_y") + 1) / 2.0
    dx, dy, weight = F.col("avg_rank_x") - middle, F.col("avg_rank_y") - middle, F.col("_pairs")
    rho = F.try_divide(F.sum(weight * dx * dy), F.sqrt(F.sum(weight * dx * dx)) * F.sqrt(F.sum(weight * dy * dy)))
    tests = (
        ranked.groupBy("score_column")
        .agg(F.sum(weight).alias("valid_rows"), finite(rho).alias("spearman_rho"))
        .where((F.col("valid_rows") >= 3) & F.col("spearman_rho").isNotNull())
    )
    feature = F.create_map(*[F.lit(text) for entry in features.items() for text in entry])
    labelled = tests.select(
        feature[F.col("score_column")].alias("feature"),
        "score_column",
        "valid_rows",
        "spearman_rho",
        correlation_p(F.col("spearman_rho"), F.col("valid_rows")).alias("p_value"),
    )
    return bonferroni(labelled).orderBy(F.desc(F.abs("spearman_rho")), "feature")


def nominal_associations(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    min_group_size: int = 20,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Eta squared and the Kruskal-Wallis test of the target over each feature's groups.

    Groups below ``min_group_size`` are left out, and so are features with fewer than
    two groups or without variation of the target.
    """
    check(min_group_size >= 2, "min_group_size must be at least 2")
    values = df.select(number(df, target).alias("y"), *features)
    long = long_categories(values, features, ["y"])
    layout = fit_layouts(long, ["y"], rows_per_bucket)["y"]
    # A mean near the features' own means keeps the digits of the sums below.
    centre = layout.mean

    # Counted values; a big group is many (group, y) rows.
    counted = long.groupBy("feature", "category", "y").agg(F.count(F.lit(1)).alias("_pairs"))
    kept = with_group_rows(counted, ["feature", "category"], "_pairs", layout, "_n", min_group_size)
    ranked = ranked_rows(kept, ["feature"], "y", "_pairs", layout)
    pairs, apart = F.col("_pairs"), F.col("y") - F.lit(centre)
    lifted = F.col("avg_rank") - (F.col("_rows") + 1) / 2.0
    per_group = ranked.groupBy("feature", "category").agg(
        F.sum(pairs).alias("_n"),
        F.max("_rows").cast("double").alias("_every"),
        F.sum(pairs * apart).alias("_sum"),
        F.sum(pairs * apart * apart).alias("_squares"),
        F.sum(pairs * lifted).alias("_lift"),
        # Over the rows of one value this adds up to ties^3 - ties.
        F.sum(pairs * (F.col("_ties").cast("double") * F.col("_ties") - 1)).alias("_ties"),
    )
    n, every = F.col("_n"), F.col("_every")
    level = F.sum("_sum") * F.sum("_sum") / F.sum(n)
    total = F.sum("_squares") - level
    between = F.sum(F.col("_sum") * F.col("_sum") / n) - level
    spread = F.sum(F.col("_lift") * F.col("_lift") / n)
    rows = F.max(every)
    untied = 1.0 - F.try_divide(F.sum("_ties"), rows * rows * rows - rows)
    tests = (
        per_group.groupBy("feature")
        .agg(
            F.sum(n).alias("valid_rows"),
            F.count(F.lit(1)).alias("group_count"),
            F.when(total > F.sum("_squares") * 1e-12, between / total).alias("eta_squared"),
            F.when(untied > 0, F.try_divide(12.0 * spread, rows * (rows + 1)) / untied).alias("kruskal_h"),
        )
        .where((F.col("group_count") >= 2) & F.col("eta_squared").isNotNull())
        .select(
            "feature",
            "valid_rows",
            "group_count",
            "eta_squared",
            "kruskal_h",
            chi_square_p(F.col("kruskal_h"), F.col("group_count") - 1).alias("p_value"),
        )
    )
    return bonferroni(tests).orderBy(F.desc("eta_squared"), "feature")


def multiselect_tests(
    df: DataFrame,
    answer: str,
    value: str,
    log_value: str,
    min_group_size: int = 20,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Multi-select effects with point-biserial p-values and their correction."""
    effects = multiselect_effects(df, answer, value, log_value, min_group_size, rows_per_bucket)
    rows = F.col("selected_rows") + F.col("unselected_rows")
    tests = effects.withColumn("p_value", correlation_p(F.col("point_biserial_r"), rows))
    return bonferroni(tests).orderBy(F.desc("absolute_r"), "option")


def welch_test(df: DataFrame, group: str, first: str, second: str, value: str, alpha: float = ALPHA) -> DataFrame:
    """Welch's t-test of ``value`` between two groups: one row.

    Groups of fewer than two rows, or without any variation, give no row.
    """
    long = df.where(F.col(group).isin(first, second) & F.col(value).isNotNull())
    sides = {}
    for side, label in (("first", first), ("second", second)):
        mine = F.when(F.col(group) == label, F.col(value))
        sides[side] = [
            F.count(mine).alias(f"{side}_n"),
            F.avg(mine).alias(f"{side}_mean"),
            F.var_samp(mine).alias(f"_{side}_var"),
        ]
    stats = long.agg(*sides["first"], *sides["second"])
    a, b = F.col("_first_var") / F.col("first_n"), F.col("_second_var") / F.col("second_n")
    tests = (
        stats.where((F.col("first_n") >= 2) & (F.col("second_n") >= 2))
        .withColumn("t_statistic", F.try_divide(F.col("first_mean") - F.col("second_mean"), F.sqrt(a + b)))
        .withColumn(
            "degrees_of_freedom",
            F.try_divide(
                (a + b) * (a + b),
                a * a / (F.col("first_n") - 1) + b * b / (F.col("second_n") - 1),
            ),
        )
        .where(finite(F.col("t_statistic")).isNotNull())
        .withColumn("p_value", student_p(F.col("t_statistic"), F.col("degrees_of_freedom")))
    )
    return tests.select(
        "first_n",
        "second_n",
        "first_mean",
        "second_mean",
        "t_statistic",
        "degrees_of_freedom",
        "p_value",
        F.lit(alpha).alias("alpha"),
        F.when(F.col("p_value") < alpha, "means differ").otherwise("no difference shown").alias("verdict"),
    )
