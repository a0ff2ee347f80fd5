"""Scans, checks and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from censusloom.sources.contracts import contract_report, domain_violations, fingerprint, missing_cells, reconcile
from censusloom.sources.files import (
    STRICT_NULL_TEXTS, apply_types, first_rows, scan_csv, scratch_folder, write_table,
)
from censusloom.sources.inference import BOOLEAN_TEXTS, infer_types, type_violations
from censusloom.sources.order import first_per_key_in_files, first_rows_of_files, with_input_order
from workloads.registry import query
from workloads.tables import ANSWERS, answers, table

_ANSWER_TYPES = {"event_id": "bigint", "user_id": "bigint", "value": "double"}


def _as_csv(spark: SparkSession, df: DataFrame) -> str:
    folder = scratch_folder(spark)
    write_table(df, folder)
    return folder


def _with_null_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NULLs spelled "NA" in one column and "None" in another."""
    rows = answers(spark, sf_dir)
    return rows.withColumn("event_type", F.coalesce("event_type", F.lit("NA"))).withColumn(
        "value", F.coalesce(F.col("value").cast("string"), F.lit("None"))
    )


def _typed_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("value").alias("known_values"),
        F.round(F.sum("value"), 2).alias("total"),
        F.sum("user_id").alias("users"),
        F.max("props").alias("last_props"),
    )


@query(
    "csv_scan",
    f"""SELECT event_type, count(*) AS rows, count(value) AS known_values, round(sum(value), 2) AS total,
    CAST(sum(user_id) AS BIGINT) AS users, max(props) AS last_props FROM {ANSWERS} GROUP BY event_type""",
)
def csv_scan(spark, sf_dir):
    """Write the table as CSV, read it with the default null texts, apply types."""
    folder = _as_csv(spark, _with_null_texts(spark, sf_dir))
    return _typed_summary(apply_types(scan_csv(spark, folder), _ANSWER_TYPES))


@query(
    "csv_scan_strict",
    f"""SELECT count(*) AS rows, count(event_type) AS known_types,
    sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END)::BIGINT AS none_texts FROM {ANSWERS}""",
)
def csv_scan_strict(spark, sf_dir):
    """Only "NA" is a null text; "None" stays a text."""
    folder = _as_csv(spark, _with_null_texts(spark, sf_dir))
    return scan_csv(spark, folder, STRICT_NULL_TEXTS).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("event_type").alias("known_types"),
        F.count_if(F.col("value") == "None").alias("none_texts"),
    )


@query("first_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000")
def first_rows_query(spark, sf_dir):
    return first_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 1000, ["o_orderkey"])


_FINGERPRINT = f"""SELECT 'rows' AS metric, count(*) AS v FROM {ANSWERS}
  UNION ALL SELECT 'columns', 5
  UNION ALL SELECT 'missing_cells', CAST(sum((event_type IS NULL)::INT + (value IS NULL)::INT) AS BIGINT)
    FROM {ANSWERS}
  UNION ALL SELECT 'valid_target_rows', count(*) FILTER (value > 0) FROM {ANSWERS}
  UNION ALL SELECT 'duplicate_keys', count(*) - count(DISTINCT user_id) FROM {ANSWERS}
  UNION ALL SELECT 'column_order', 1"""


@query(
    "reconcile",
    f"SELECT metric, v AS left_value, v AS right_value, true AS matches FROM ({_FINGERPRINT})",
)
def reconcile_query(spark, sf_dir):
    """A Parquet read against a CSV read of the same table."""
    rows = answers(spark, sf_dir)
    read = apply_types(scan_csv(spark, _as_csv(spark, rows)), _ANSWER_TYPES)
    return reconcile(rows, read, ["user_id"], "value")


@query(
    "missing_cells",
    f"""SELECT CAST(sum((event_type IS NULL)::INT + (value IS NULL)::INT) AS BIGINT) AS missing_cells
    FROM {ANSWERS}""",
)
def missing_cells_query(spark, sf_dir):
    return missing_cells(answers(spark, sf_dir))


@query(
    "domain_violations",
    """SELECT DISTINCT 'o_orderpriority' AS "column", o_orderpriority AS label FROM orders
    WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')
    UNION ALL SELECT DISTINCT 'o_orderstatus', o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('O', 'F')""",
)
def domain_violations_query(spark, sf_dir):
    allowed = {"o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"], "o_orderstatus": ["O", "F"]}
    return domain_violations(table(spark, sf_dir, "orders"), allowed)


def item(name: str):
    return F.max(F.when(F.col("metric") == name, F.col("value"))).alias(name)


# The width of the survey file: 114 columns.
WIDE_COLUMNS = 114


def wide_lines(spark, sf_dir):
    """Line items repeated sideways to 114 columns, with gaps spelled NA when written."""
    lines = table(spark, sf_dir, "lineitem")
    names = lines.columns
    # Each value is spelled once and used in all its places.
    texts = lines.selectExpr(
        *[f"CAST({name} AS STRING) AS t{i}" for i, name in enumerate(names)],
        *[f"(l_orderkey + {r}) % 3 = 0 AS gap{r}" for r in range(3)],
    )
    value, gap = "t{i}", "CASE WHEN gap{r} THEN 'NA' ELSE t{i} END"
    return texts.selectExpr(
        *[
            (gap if place else value).format(i=place % len(names), r=place % 3) + f" AS c{place:03d}"
            for place in range(WIDE_COLUMNS)
        ]
    )


def _as_wide_csv(spark, sf_dir) -> str:
    """The wide lines as CSV files; they take far more room than the tables, so they are compressed."""
    folder = scratch_folder(spark)
    write_table(wide_lines(spark, sf_dir), folder, compression="lz4", rows_per_file=200_000)
    return folder


@query(
    "csv_wide_scan",
    """SELECT count(*) AS rows, CAST(sum(n) AS BIGINT) AS missing_cells FROM (
    SELECT (SELECT count(*) FROM range(1, 114) p(i) WHERE (l_orderkey + i) % 3 = 0) AS n FROM lineitem)""",
)
def csv_wide_scan(spark, sf_dir):
    """A file as wide as the survey's: written, read as text, NULLs counted."""
    read = scan_csv(spark, _as_wide_csv(spark, sf_dir), multi_line=False)
    found = fingerprint(read, ["c000"], "c001")
    return found.agg(item("rows"), item("missing_cells"))


def _fits(kind: str, text: str) -> str:
    """DuckDB: whether a text fits a type."""
    if kind == "boolean":
        return f"{text} IN ({', '.join(repr(t) for t in BOOLEAN_TEXTS)})"
    if kind == "bigint":
        return f"(regexp_full_match({text}, '\\s*[+-]?[0-9]+\\s*') AND try_cast(trim({text}) AS BIGINT) IS NOT NULL)"
    if kind == "double":
        return (
            f"(regexp_full_match({text}, '\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*')"
            f" AND abs(try_cast(trim({text}) AS DOUBLE)) < 'Infinity'::DOUBLE)"
        )
    return f"(regexp_matches({text}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_cast({text} AS TIMESTAMP) IS NOT NULL)"


def _types_sql(columns: dict[str, str], table: str, first_rows: int | None = None) -> str:
    """DuckDB: the inferred type of each text expression; row numbers are in column ``row``."""
    sample = f"WHERE row < {first_rows}" if first_rows else ""
    parts = []
    for i, (name, text) in enumerate(columns.items()):
        kinds = " ".join(f"WHEN bool_and({_fits(k, 'v')}) THEN '{k}'" for k in ("boolean", "bigint", "double", "timestamp"))
        found = f"SELECT CASE WHEN count(v) = 0 THEN 'double' {kinds} ELSE 'string' END AS type FROM (SELECT {text} AS v FROM {table} {sample}) WHERE v IS NOT NULL"
        broken = "CAST(NULL AS BIGINT)"
        if first_rows:
            tests = " ".join(f"WHEN t.type = '{k}' THEN NOT {_fits(k, 'v')}" for k in ("boolean", "bigint", "double", "timestamp"))
            broken = f"(SELECT min(row) FROM (SELECT {text} AS v, row FROM {table}) WHERE row >= {first_rows} AND v IS NOT NULL AND CASE {tests} ELSE false END)"
        parts.append(f"""SELECT {i} AS position, '{name}' AS "column", t.type, {broken} AS first_violation FROM ({found}) t""")
    return " UNION ALL ".join(parts)


_EVENT_TEXTS = {c: f"CAST({c} AS VARCHAR)" for c in ("event_id", "ts", "user_id", "event_type", "value", "props")}


def _ordered_files(spark, df, key: str) -> DataFrame:
    """``df`` as several CSV files whose order, and that of their rows, is by ``key``."""
    folder = scratch_folder(spark)
    write_table(df.repartitionByRange(5, key).sortWithinPartitions(key), folder)
    return scan_csv(spark, folder, multi_line=False)


@query("csv_types", _types_sql(_EVENT_TEXTS, "events"))
def csv_types(spark, sf_dir):
    """Types by all rows of a CSV."""
    return infer_types(_ordered_files(spark, table(spark, sf_dir, "events"), "event_id"))


# Fixed: the columns of the line items in their order.
_LINE_COLUMNS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
)
_WIDE_TEXTS = {
    f"c{place:03d}": f"CASE WHEN {place} = 0 OR (l_orderkey + {place}) % 3 <> 0 "
    f"THEN CAST({_LINE_COLUMNS[place % len(_LINE_COLUMNS)]} AS VARCHAR) END"
    for place in range(WIDE_COLUMNS)
}


@query("csv_wide_types", _types_sql(_WIDE_TEXTS, "lineitem"))
def csv_wide_types(spark, sf_dir):
    """Types of 114 columns in one pass."""
    return infer_types(scan_csv(spark, _as_wide_csv(spark, sf_dir), multi_line=False))


def _trial_rows(spark, sf_dir) -> DataFrame:
    """Events whose later rows break the types that the first ones suggest."""
    late = F.col("event_id") >= 5000
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(late & (F.col("event_id") % 1000 == 7), "unknown").otherwise(F.col("user_id").cast("string")).alias("user"),
        F.when(late, F.col("value").cast("string")).otherwise(F.floor("value").cast("string")).alias("amount"),
        F.when(F.col("event_id") % 5 == 0, "true").otherwise("false").alias("flag"),
        F.when(F.col("event_id") == 9000, "2024-02-30").otherwise("2024-02-28").alias("day"),
    )


_TRIAL = """(SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS row,
  CASE WHEN event_id >= 5000 AND event_id % 1000 = 7 THEN 'unknown' ELSE CAST(user_id AS VARCHAR) END AS u,
  CASE WHEN event_id >= 5000 THEN CAST(value AS VARCHAR) ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS amount,
  CASE WHEN event_id % 5 = 0 THEN 'true' ELSE 'false' END AS flag,
  CASE WHEN event_id = 9000 THEN '2024-02-30' ELSE '2024-02-28' END AS day FROM events)"""
_TRIAL_TEXTS = {"event_id": "CAST(event_id AS VARCHAR)", "user": "u", "amount": "amount", "flag": "flag", "day": "day"}
_TRIAL_ROWS = 500


@query("csv_types_trial", _types_sql(_TRIAL_TEXTS, _TRIAL, _TRIAL_ROWS))
def csv_types_trial(spark, sf_dir):
    """Types by the first rows of a CSV, and the first row that breaks each of them."""
    return infer_types(with_input_order(_ordered_files(spark, _trial_rows(spark, sf_dir), "event_id")), _TRIAL_ROWS, "row")


@query(
    "csv_type_violations",
    f"""SELECT row, 'user' AS "column", 'bigint' AS type, u AS text FROM {_TRIAL} WHERE u = 'unknown'
    UNION ALL SELECT row, 'day', 'timestamp', day FROM {_TRIAL} WHERE day = '2024-02-30'
    UNION ALL SELECT row, 'amount', 'bigint', amount FROM {_TRIAL} WHERE contains(amount, '.')""",
)
def csv_type_violations(spark, sf_dir):
    """Every text that breaks the type of its column."""
    types = {"user": "bigint", "amount": "bigint", "flag": "boolean", "day": "timestamp"}
    return type_violations(with_input_order(_ordered_files(spark, _trial_rows(spark, sf_dir), "event_id")), types, "row")


@query(
    "csv_first_rows",
    "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority FROM orders ORDER BY orders.o_orderkey LIMIT 1000",
)
def csv_first_rows(spark, sf_dir):
    """The first rows in file order, without an order column."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return first_rows_of_files(_ordered_files(spark, orders, "o_orderkey"), 1000)


@query(
    "csv_input_order",
    "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, row_number() OVER (ORDER BY orders.o_orderkey) - 1 AS row FROM orders",
)
def csv_input_order(spark, sf_dir):
    """The number of each row in its files."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return with_input_order(_ordered_files(spark, orders, "o_orderkey")).select("o_orderkey", "row")


@query(
    "csv_dedup_first",
    """SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(event_id AS VARCHAR) AS event_id, event_type FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n = 1""",
)
def csv_dedup_first(spark, sf_dir):
    """The first row of each key in file order, without an order column."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return first_per_key_in_files(_ordered_files(spark, events, "event_id"), ["user_id"])


@query(
    "contract_report",
    f"""SELECT 'required_column' AS "check", name AS detail, (name <> 'absent')::BIGINT AS found, name <> 'absent' AS passed
      FROM (SELECT unnest(['absent', 'event_id', 'value']) AS name)
    UNION ALL SELECT 'rows', NULL, count(*), count(*) > 0 FROM {ANSWERS}
    UNION ALL SELECT 'population', 'value', count(*) FILTER (value > 0), count(*) FILTER (value > 0) >= 1000000000 FROM {ANSWERS}""",
)
def contract_report_query(spark, sf_dir):
    """Columns, rows and population of a table, as rows instead of errors."""
    return contract_report(answers(spark, sf_dir), ["event_id", "value", "absent"], "value", 10**9)
