"""Shards along a Hilbert curve over several metadata dimensions.

Each dimension is cut into at most 2^bits cells at its quantiles, texts by their whole length,
and fewer cells are spread over the axis. The cells of a row give its place on a Hilbert curve; neighbours on the curve are neighbours in all dimensions, so a
run of the curve covers a small box and a filter on any dimension skips most shards.
Rows are ordered along the curve by a range sort whose last keys are the text's crc32
and the id, so a cell with a third of all rows is still cut over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from censusloom.llm.common import free_name, stored

SHARDS = 24
BITS = 4


def hilbert_index(cells: Sequence[int], bits: int) -> int:
    """Place of a cell on the Hilbert curve through a cube of 2^bits cells a side.

    At each level the sub-cube is found by Gray code in the frame of its parent; the
    frame is then mirrored and turned as that sub-cube demands.
    """
    size = len(cells)
    mask, entry, turn, place = (1 << size) - 1, 0, 0, 0

    def rotated(value: int, by: int) -> int:
        by %= size
        return ((value >> by) | (value << (size - by))) & mask

    for level in reversed(range(bits)):
        corner = sum((cell >> level & 1) << axis for axis, cell in enumerate(cells))
        step = rotated(corner ^ entry, turn + 1)  # a Gray code, decoded below
        shift = 1
        while shift < size:
            step ^= step >> shift
            shift <<= 1
        place = place << size | step
        # Entry corner and direction of sub-cube ``step`` in the parent's frame.
        start, way = 0, 0
        if step:
            even = 2 * ((step - 1) // 2)
            start = even ^ (even >> 1)
            ones = step if step & 1 else step - 1
            while ones & 1:
                way, ones = way + 1, ones >> 1
            way %= size
        entry ^= rotated(start, -(turn + 1))
        turn = (turn + way + 1) % size
    return place


def text_cuts(df: DataFrame, column: str, cells: int, values_per_partition: int = 250_000) -> list[str]:
    """At most ``cells`` - 1 values that cut the rows into ``cells`` equal parts by whole texts, nulls first.

    Rows are counted by value, so a value with many rows is one row here; the counted
    values are sorted by range, and running counts per partition find the cuts.
    """
    counted = stored(df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")), "values")
    kinds, rows = counted.agg(F.count("*"), F.sum("n")).first()
    if not rows:
        return []
    ranged = counted.repartitionByRange(-(-kinds // values_per_partition), F.col("value").asc_nulls_first())
    ranged = stored(ranged.withColumn("_part", F.spark_partition_id()), "ranged-values")
    sizes = ranged.groupBy("_part").agg(F.sum("n").alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # One row per partition of the range sort.
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(F.col("value").asc_nulls_first())
    running = ranged.join(F.broadcast(starts), "_part").withColumn("_end", F.col("_start") + F.sum("n").over(inside))
    # Part k ends at row k * rows / cells; the value that holds this row is a cut.
    ends = [F.expr(f"CAST(_end * {cells} DIV {rows} AS INT)"), F.expr(f"CAST((_end - n) * {cells} DIV {rows} AS INT)")]
    last = F.lit(cells - 1)
    cuts = running.where(F.least(ends[0], last) > F.least(ends[1], last)).where("value IS NOT NULL")
    return sorted((r.value for r in cuts.select("value").collect()), key=lambda v: v.encode("utf-8", "surrogatepass"))


def curve_cells(df: DataFrame, dimensions: Sequence[str], bits: int = BITS, place: str = "place") -> DataFrame:
    """Add ``place``, the row's place on the curve over text ``dimensions`` and numeric ones without nulls.

    The table of places has 2^(bits * dimensions) rows, whatever the data: it is broadcast.
    """
    cells = 1 << bits
    assert bits * len(dimensions) <= 15, "the table of places would be too large to broadcast"
    shares = [i / cells for i in range(1, cells)]
    texts = [d for d in dimensions if df.schema[d].dataType.simpleString() == "string"]
    cuts = {d: text_cuts(df, d, cells) for d in texts}
    numbers = [d for d in dimensions if d not in texts]
    if numbers:
        quantiles = [F.percentile_approx(d, F.array(*map(F.lit, shares)), 10_000).alias(d) for d in numbers]
        cuts |= df.agg(*quantiles).first().asDict()

    def cell(dimension: str) -> Column:
        """Distinct cut points below or at the value, spread over all cells of the axis.

        Equal values share a cell. A dimension of few values has few cut points; spread out,
        they differ in the highest bits, which the curve follows first.
        """
        points = sorted(set(cuts[dimension] or ()))
        below = sum((F.when(F.col(dimension) >= F.lit(p), 1).otherwise(0) for p in points), F.lit(0))
        return F.floor(below * F.lit(cells) / F.lit(len(points) + 1)).cast("int")

    code = sum((cell(d) * F.lit(cells**i) for i, d in enumerate(dimensions)), F.lit(0))
    total = cells ** len(dimensions)
    lookup = df.sparkSession.createDataFrame(
        [(c, hilbert_index([c // cells**i % cells for i in range(len(dimensions))], bits)) for c in range(total)],
        f"_code int, {place} int",
    )
    return df.withColumn("_code", code.cast("int")).join(F.broadcast(lookup), "_code").drop("_code")


def positions(df: DataFrame, order: Sequence[Column], partitions: int, position: str = "position") -> DataFrame:
    """Number the rows from 0 in the given order; ties are numbered in any fixed way."""
    ranged = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    sorted_rows = stored(
        ranged.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "sorted"
    )
    sizes = sorted_rows.groupBy("_part").agg(F.count("*").alias("_size"), F.min("_row").alias("_first"))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    # One row per partition of the range sort.
    return (
        sorted_rows.join(F.broadcast(starts), "_part")
        .withColumn(position, F.col("_row") + F.col("_shift"))
        .drop("_part", "_row", "_shift")
    )


def _shard(rows: int, shards: int) -> Column:
    return F.expr(f"CAST(_position * {shards} DIV {max(rows, 1)} AS INT)")


def _slot(rows: int, shards: int, shard: str) -> Column:
    """The first position of shard s is ceil(s * rows / shards)."""
    return F.expr(f"_position - ((`{shard}` * CAST({rows} AS BIGINT) + {shards - 1}) DIV {shards})")


def _facts(docs: DataFrame, ident: str, text: str, dimensions: Sequence[str]) -> list[Column]:
    """What places a document: id, size, crc32 of the text, and the text dimensions."""
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    return [
        F.col(ident).alias("_id"),
        (F.octet_length(body).cast("bigint") + 8).alias("_size_bytes"),
        F.crc32(body).alias("_crc"),
        *[F.col(d).cast("string").alias(f"_d{i}") for i, d in enumerate(dimensions)],
    ]


def shard_documents(
    docs: DataFrame,
    ident: str = "doc_id",
    text: str = "text",
    dimensions: Sequence[str] = ("lang", "source"),
    shards: int = SHARDS,
    bits: int = BITS,
    rows_per_partition: int = 250_000,
) -> DataFrame:
    """Shard and slot of every document along the curve of ``dimensions`` and text size.

    (id, size, text_crc32, place, shard, slot): shard sizes in rows differ by at most
    one. ``size`` is the UTF-8 bytes of the text plus 8; a null text counts as empty.
    Null dimension values come first. Repeated or null ids are separate rows. An empty
    table gives no rows; fewer rows than shards leave shards empty.
    """
    slim = stored(docs.select(*_facts(docs, ident, text, dimensions)), "slim")
    axes = [f"_d{i}" for i in range(len(dimensions))] + ["_size_bytes"]
    placed = curve_cells(slim, axes, bits, "place")
    rows = slim.count()
    order = [F.col("place"), F.col("_crc"), F.col("_id")]
    numbered = positions(placed, order, max(1, -(-rows // rows_per_partition)), "_position")
    return numbered.withColumn("shard", _shard(rows, shards)).select(
        F.col("_id").alias(ident),
        F.col("_size_bytes").alias("size"),
        F.col("_crc").alias("text_crc32"),
        "place",
        "shard",
        _slot(rows, shards, "shard").alias("slot"),
    )


def write_shards(
    docs: DataFrame,
    path: str,
    ident: str = "doc_id",
    text: str = "text",
    dimensions: Sequence[str] = ("lang", "source"),
    shards: int = SHARDS,
    bits: int = BITS,
    bytes_per_file: int = 256 << 20,
) -> str:
    """Write all columns of ``docs`` as one folder per shard; the name of the shard column.

    Whole rows are sorted along the curve by one range shuffle, cut so that a task and a file
    have some ``bytes_per_file`` bytes of text; files of a shard follow each other in slot
    order, in the column ``slot``, so file statistics prune by every dimension. Nothing is
    joined by id: rows with null or repeated ids are written as often as they occur. Columns
    called ``shard`` or ``slot`` keep their names, and the new ones get underscores. An empty
    table writes an empty folder.
    """
    shard, slot = free_name(docs, "shard"), free_name(docs, "slot")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row_"), *_facts(docs, ident, text, dimensions))
    axes = [f"_d{i}" for i in range(len(dimensions))] + ["_size_bytes"]
    rows, size = held.agg(F.count("*"), F.coalesce(F.sum("_size_bytes"), F.lit(0))).first()
    placed = curve_cells(held, axes, bits, "place")
    order = [F.col("place"), F.col("_crc"), F.col("_id")]
    numbered = positions(placed, order, max(1, -(-size // bytes_per_file)), "_position").withColumn(shard, _shard(rows, shards))
    out = numbered.select("_row_.*", shard, _slot(rows, shards, shard).alias(slot))
    out.write.partitionBy(shard).parquet(path)
    return shard
