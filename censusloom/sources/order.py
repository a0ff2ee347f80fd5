"""The order of rows in the files they were read from.

A row's place is (file, start of its block in the file, running number in its block). One task
reads a block from its start to its end, so the running number is the same whenever the block
is read again, on whichever executor. Blocks are counted once, and their offsets make the
running number a row number over all files, taken by path.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from censusloom.errors import check

_OFFSET_BYTES = 64 << 20


def _free(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def place_in_files() -> Column:
    """A struct that sorts rows of a file scan in their order in the files.

    Only for DataFrames that come from a scan by projections and filters.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("number"),
    )


def with_input_order(df: DataFrame, name: str = "row") -> DataFrame:
    """``df``, a file scan, with the number of each row from 0 in the column ``name``.

    Rows are numbered through all files, these taken by path; numbers have no gaps. The scan is
    read twice: once to count the blocks, which gives one small row per block, and once for
    the rows, which are not shuffled unless the blocks' table exceeds a broadcast.
    """
    check(name.lower() not in {c.lower() for c in df.columns}, f"there is already a column {name}")
    place, start, first = (_free(df, c) for c in ("_place", "_offset", "_first"))
    placed = df.withColumn(place, place_in_files())
    blocks = placed.groupBy(F.col(f"{place}.file").alias("file"), F.col(f"{place}.start").alias("start")).agg(
        F.count(F.lit(1)).alias("rows"), F.min(f"{place}.number").alias(first)
    )
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    offsets = blocks.select("file", "start", first, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias(start)).persist()
    size = offsets.agg(F.sum(F.length("file") + 48)).first()[0] or 0
    known = F.broadcast(offsets) if size <= _OFFSET_BYTES else offsets
    file, begin = _free(df, "_file"), _free(df, "_start")
    known = known.withColumnsRenamed({"file": file, "start": begin})
    same = (F.col(f"{place}.file") == F.col(file)) & (F.col(f"{place}.start") == F.col(begin))
    number = F.col(start) + F.col(f"{place}.number") - F.col(first)
    return placed.join(known, same).select(*[F.col(_name(c)) for c in df.columns], number.alias(name))


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def first_rows_of_files(df: DataFrame, rows: int) -> DataFrame:
    """The first ``rows`` rows of a file scan, in the order of the files, which are taken by path.

    Files are opened from the first on, twice as many each time, until they hold enough rows;
    the others are never read.
    """
    check(rows >= 1, "the number of rows must be at least 1")
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")
    files = sorted("file:/" + f[5:].lstrip("/") if f.startswith("file:/") else f for f in df.inputFiles())
    few, taken = df, 1
    while taken < len(files):
        few = df.where(path <= files[taken - 1])
        if few.limit(rows).count() >= rows:
            break
        few, taken = df, 2 * taken
    number = _free(df, "_row")
    return with_input_order(few, number).where(F.col(number) < rows).orderBy(number).drop(number)


def first_per_key_in_files(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The row of each key that comes first in the files; a NULL key is one key.

    The minimum of a struct that starts with the place combines on the map side, so neither a
    hot key nor a window gathers rows in one task.
    """
    keys = list(keys)
    others = [c for c in df.columns if c not in keys]
    kept = _free(df, "_kept")
    # The running number belongs to the scan's projection; an aggregate cannot hold it.
    place = _free(df, "_place")
    placed = df.withColumn(place, place_in_files())
    least = F.min(F.struct(F.col(place), *[F.col(_name(c)) for c in others]))
    found = placed.groupBy(*[F.col(_name(c)) for c in keys]).agg(least.alias(kept))
    return found.select(*[F.col(_name(c)) if c in keys else F.col(f"{kept}.{_name(c)}") for c in df.columns])

