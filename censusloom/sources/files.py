"""CSV scans and result sinks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from censusloom.errors import check
from censusloom.functions.scalars import finite, text_to_number

# The texts that mean "no answer" in a default CSV read.
DEFAULT_NULL_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)
# Fixed value: the only null text of the strict read.
STRICT_NULL_TEXTS = ("NA",)


def scan_csv(
    spark: SparkSession,
    path: str,
    null_texts: Sequence[str] = DEFAULT_NULL_TEXTS,
    multi_line: bool | None = True,
) -> DataFrame:
    """Read a CSV with a header, every column as text, ``null_texts`` as NULL.

    Types are applied afterwards by :func:`apply_types`, so no inference pass reads
    the data. Quoted line breaks need ``multi_line``, which makes one task per file;
    turn it off for files without them, so that large files are split. ``None`` looks
    for them first: see :func:`has_quoted_line_breaks`.
    """
    if multi_line is None:
        multi_line = has_quoted_line_breaks(spark, path)
    raw = (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .csv(path)
    )
    # One SQL text per column: building thousands of Column objects would take longer
    # than reading a small file.
    quoted = ", ".join("'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'" for text in null_texts)
    return raw.selectExpr(
        *[f"CASE WHEN {_name(n)} NOT IN ({quoted}) THEN {_name(n)} END AS {_name(n)}" for n in raw.columns]
    )


def has_quoted_line_breaks(spark: SparkSession, path: str) -> bool:
    """Whether a quoted field goes on in another line.

    The line where the first such field of a file begins has an odd number of quotes, and in
    a file without one all lines have an even number. The lines are read as plain text, in
    split files, up to the first odd one that a task finds.
    """
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def apply_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Coerce text columns; a text that does not fit its type becomes NULL."""
    def typed(name: str):
        kind = types.get(name, "string")
        if kind in ("double", "float"):
            return text_to_number(F.col(name)).cast(kind).alias(name)
        return F.col(name).try_cast(kind).alias(name)

    return df.select(*[typed(name) for name in df.columns])


def finite_columns(df: DataFrame) -> DataFrame:
    """Turn NaN and infinities of all floating-point columns into NULL."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[finite(F.col(n)).alias(n) if n in floating else F.col(n) for n in df.columns])


def first_rows(df: DataFrame, rows: int, order: Sequence[str]) -> DataFrame:
    """The first ``rows`` rows in the given order (a row-limited trial read)."""
    check(rows >= 1, "the number of rows must be at least 1")
    return df.orderBy(*order).limit(rows)


def write_table(
    df: DataFrame,
    path: str,
    columns: Sequence[str] | None = None,
    kind: str = "csv",
    compression: str | None = None,
    rows_per_file: int | None = None,
) -> None:
    """Write a result table, optionally only some of its columns, as CSV or Parquet.

    A compressed CSV file is read back by one task, so bound its ``rows_per_file``.
    """
    chosen = df.select(*columns) if columns else df
    writer = chosen.write.mode("overwrite")
    if compression:
        writer = writer.option("compression", compression)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if kind == "csv":
        writer.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        writer.format(kind).save(path)


def scratch_folder(spark: SparkSession) -> str:
    """A new path for intermediate tables in the folder all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. Only where it is unset,
    as in a local test session, a temporary folder of this machine is used.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        check(local, "set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="censusloom-")
    return f"{shared.rstrip('/')}/tables-{uuid.uuid4().hex}"
