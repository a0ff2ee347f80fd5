"""Helpers shared by the operators of this package."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from censusloom.sources.files import scratch_folder

# Fixed value: a word is a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as decimal text, modulo ``modulus`` (a null id counts as '')."""
    return F.crc32(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "UTF-8")) % modulus


def rows_to_arrow(schema: T.StructType) -> pa.Schema:
    """The Arrow schema of the simple Spark types used here."""
    kinds = {
        "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(),
        "double": pa.float64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()),
        "array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()),
        "array<float>": pa.list_(pa.float32()), "array<string>": pa.list_(pa.string()),
    }
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema.fields])


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_STATE: dict = {}


def claim(owner: str) -> None:
    """Let go of what other operators remember in this Python worker: memory is for one at a time."""
    if _STATE.get("owner") != owner:
        _STATE.clear()
        _STATE["owner"] = owner
    pa.default_memory_pool().release_unused()


def remembered(name, make: Callable):
    """What :func:`make` gives, kept by this Python worker between tasks of the same operator."""
    if name not in _STATE:
        _STATE[name] = make()
    return _STATE[name]


def ship(spark: SparkSession) -> None:
    """Make this library importable on all executors, once per application.

    The driver serves the archive itself; where it is built matters to the driver only.
    Arrow batches are kept small unless the session says otherwise: long texts make large
    ones, of which the executor and each Python worker hold several copies.
    """
    if spark.conf.get(_BATCH_BYTES) == "67108864b":  # Spark's own default
        spark.conf.set(_BATCH_BYTES, "4m")
    context = spark.sparkContext
    name = "censusloom-shipped.zip"
    if name not in context._python_includes:
        package = Path(__file__).resolve().parent.parent
        folder = tempfile.mkdtemp(prefix="censusloom-")
        made = shutil.make_archive(f"{folder}/{name.removesuffix('.zip')}", "zip", package.parent, package.name)
        context.addPyFile(made)


def map_batches(df: DataFrame, function: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` over dicts of columns; ``function`` gets and yields dicts of Arrow arrays or lists."""
    ship(df.sparkSession)
    struct = T._parse_datatype_string(schema)
    arrow, owner = rows_to_arrow(struct), function.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(owner)
        inputs = ({n: b.column(i) for i, n in enumerate(b.schema.names)} for b in batches)
        for out in function(inputs):
            yield pa.RecordBatch.from_arrays(
                [
                    v.cast(f.type) if isinstance(v := out[f.name], pa.Array) else pa.array(v, type=f.type)
                    for f in arrow
                ],
                schema=arrow,
            )

    return df.mapInArrow(run, struct)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new folder that all executors share, and read it back.

    Cuts the lineage: what follows does not recompute ``df`` when executors are lost.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}-{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_key(docs: DataFrame, ident: str, text: str, key: str) -> tuple[DataFrame, bool]:
    """``docs`` with a unique long ``key`` in the order of the ids; whether keys differ from ids.

    The key is the id itself unless ids repeat or are null. Then the rows are sorted by
    (id, text), nulls first, and numbered, so repeated rows stay separate rows.
    """
    ids = docs.select(F.col(ident).alias("ident"))
    odd = ids.groupBy("ident").count().where((F.col("count") > 1) | F.col("ident").isNull()).limit(1).count()
    if not odd:
        return docs.withColumn(key, F.col(ident).cast("long")), False
    # A range sort gives ordered partitions, so these numbers follow the order.
    order = [F.col(ident).asc_nulls_first(), F.col(text).asc_nulls_first()]
    ranged = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(ranged.withColumn(key, F.monotonically_increasing_id()), "keyed"), True


def change_batches(
    docs: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType | None = None
) -> DataFrame:
    """``docs`` with each Arrow batch changed or filtered; all columns keep their types.

    A function that adds or drops columns needs the ``schema`` of its result.
    """

    ship(docs.sparkSession)
    owner = function.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(owner)
        return map(function, batches)

    return docs.mapInArrow(run, schema or docs.schema)


def replace_texts(batch: pa.RecordBatch, texts: list, changed: list[bool]) -> pa.RecordBatch:
    """A batch of documents with new texts; ``n_chars``, if there is one, is counted anew where they changed."""
    names = batch.schema.names
    columns = list(batch.columns)
    at = names.index("text")
    columns[at] = pa.array(texts, type=columns[at].type)
    if "n_chars" in names:
        at = names.index("n_chars")
        counts = [len(t) if new else n for t, new, n in zip(texts, changed, columns[at].to_pylist(), strict=True)]
        columns[at] = pa.array(counts, type=columns[at].type)
    return pa.RecordBatch.from_arrays(columns, schema=batch.schema)
