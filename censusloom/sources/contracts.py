"""Checks a table must pass before a job runs on it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from censusloom.errors import SurveyError, check
from censusloom.functions.scalars import number

_SHOWN_LABELS = 50


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    """Fail with the sorted names of all missing columns; reads no data."""
    missing = sorted(set(columns) - set(df.columns))
    check(not missing, "required columns are missing: " + ", ".join(missing))


def require_rows(df: DataFrame) -> None:
    """Fail on an empty table."""
    check(not df.isEmpty(), "the table has no rows")


def require_population(rows: int, minimum: int, what: str) -> None:
    """Fail when too few rows are left to give a sound result."""
    check(rows >= minimum, f"{what} needs at least {minimum} rows, got {rows}")


def contract_report(df: DataFrame, required: Sequence[str], target: str | None = None, minimum: int = 0) -> DataFrame:
    """What the three checks above look at, as rows: (check, detail, found, passed).

    One row per required column, one for the rows, and one for the rows with a valid (known
    and positive) ``target``, of which ``minimum`` are needed. One pass over the data; an
    absent target column has no valid rows.
    """
    present = set(df.columns)
    valid = F.count_if(number(df, target) > 0) if target in present else F.lit(0).cast("long")
    sizes = df.agg(F.count(F.lit(1)).alias("rows"), valid.alias("valid")).first()
    table = [("required_column", name, int(name in present), name in present) for name in sorted(set(required))]
    table.append(("rows", None, sizes["rows"], sizes["rows"] > 0))
    if target is not None:
        table.append(("population", target, sizes["valid"], sizes["valid"] >= minimum))
    return df.sparkSession.createDataFrame(table, "check string, detail string, found bigint, passed boolean")


def domain_violations(df: DataFrame, allowed: Mapping[str, Sequence[str]]) -> DataFrame:
    """Distinct (column, label) pairs outside the allowed labels, in one pass.

    The test runs before the shuffle, so only offending labels move.
    """
    known = F.lit(False)
    for name, labels in allowed.items():
        known = known | ((F.col("column") == name) & F.col("label").isin(list(labels)))
    texts = df.select(*[F.col(name).cast("string").alias(name) for name in allowed])
    observed = texts.unpivot([], list(allowed), "column", "label")
    return observed.where(F.col("label").isNotNull() & ~known).distinct()


def require_domain(df: DataFrame, allowed: Mapping[str, Sequence[str]]) -> None:
    """Fail when a column holds labels outside its allowed ones, naming them sorted."""
    bad = domain_violations(df, allowed).orderBy("column", "label").limit(_SHOWN_LABELS).collect()
    if bad:
        shown = "; ".join(f"{row['column']}: {row['label']}" for row in bad)
        raise SurveyError(f"unknown labels found: {shown}")


def _null_cells(df: DataFrame):
    names = ["`" + name.replace("`", "``") + "`" for name in df.columns]
    cells = " + ".join(f"CAST({name} IS NULL AS INT)" for name in names) or "0"
    return F.expr(f"coalesce(sum({cells}), 0)")


def missing_cells(df: DataFrame) -> DataFrame:
    """Total NULL cells over all columns: one row, one ``missing_cells`` column."""
    return df.agg(_null_cells(df).alias("missing_cells"))


def duplicate_count(df: DataFrame, keys: Sequence[str], name: str = "duplicates") -> DataFrame:
    """Rows beyond the first of each key; a NULL key counts as one key."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return per_key.agg(
        (F.coalesce(F.sum("_rows"), F.lit(0)) - F.count(F.lit(1))).cast("long").alias(name)
    )


def fingerprint(df: DataFrame, key: Sequence[str], target: str) -> DataFrame:
    """Shape and quality numbers of a table as (metric, value).

    The table is read once: rows are counted per key, and the totals come from these counts.
    """
    value = number(df, target)
    per_key = df.groupBy(*([key] if isinstance(key, str) else key)).agg(
        F.count(F.lit(1)).alias("rows"),
        _null_cells(df).cast("long").alias("missing_cells"),
        F.count_if(value > 0).alias("valid_target_rows"),
    )
    total = {name: F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in ("rows", "missing_cells", "valid_target_rows")}
    return per_key.agg(
        total["rows"],
        F.lit(len(df.columns)).cast("long").alias("columns"),
        total["missing_cells"],
        total["valid_target_rows"],
        (F.coalesce(F.sum("rows"), F.lit(0)) - F.count(F.lit(1))).cast("long").alias("duplicate_keys"),
    ).unpivot([], ["rows", "columns", "missing_cells", "valid_target_rows", "duplicate_keys"], "metric", "value")


def reconcile(left: DataFrame, right: DataFrame, key: Sequence[str], target: str) -> DataFrame:
    """Compare two reads of one table: (metric, left_value, right_value, matches)."""
    a = fingerprint(left, key, target).withColumnRenamed("value", "left_value")
    b = fingerprint(right, key, target).withColumnRenamed("value", "right_value")
    # Five rows on each side.
    numbers = a.join(F.broadcast(b), "metric")
    same_order = left.columns == right.columns
    order = left.sparkSession.range(1).select(
        F.lit("column_order").alias("metric"),
        F.lit(1).cast("long").alias("left_value"),
        F.lit(int(same_order)).cast("long").alias("right_value"),
    )
    return numbers.unionByName(order).withColumn("matches", F.col("left_value") == F.col("right_value"))


def require_match(report: DataFrame) -> None:
    """Fail when two reads of one table disagree on any metric."""
    wrong = [row["metric"] for row in report.where(~F.col("matches")).orderBy("metric").collect()]
    check(not wrong, "the two reads differ in: " + ", ".join(wrong))
