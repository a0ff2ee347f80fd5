"""Types of text columns, inferred from all rows or from the first ones.

Every text fits some types: ``12`` is a bigint and a double, ``12.5`` a double, ``true`` a
boolean, ``2024-01-31`` a timestamp. A column gets the narrowest type that all its texts fit,
in the order boolean, bigint, double, timestamp, string. Booleans and numbers have only string
in common, and so have numbers and timestamps.

Each text is turned into a small set of bits, the types it does *not* fit; a column is the
bitwise OR of its rows. The cells of a row are taken one after the other by the same small
code, and one integer per column, combined on the map side, reads all columns in one pass.
Code that names each column of a wide table would be too long for the JVM to compile.

Beyond ``WIDE`` columns Spark no longer compiles the steps from the scan to the cells into one
loop, and moving a cell costs more than typing it. There a row travels as one binary text with
marked ends of cells, and tasks type the cells of many rows at once with NumPy. What is neither
a plain number, a plain date or time nor certainly none of the types is left to the same SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from censusloom.errors import check

# Ordered from narrow to wide; the position of a type is its bit.
LATTICE = ("boolean", "bigint", "double", "timestamp")
_SEEN = 1 << len(LATTICE)
_ALL = _SEEN - 1
# The default of spark.sql.codegen.maxFields.
WIDE = 100
# Bytes that no UTF-8 text has: the end of a cell, and a cell that is NULL.
_END, _NULL = 0xFF, 0xFE

# Texts that are booleans.
BOOLEAN_TEXTS = ("true", "false", "True", "False", "TRUE", "FALSE")
_INTEGER = r"^\\s*[+-]?[0-9]+\\s*$"
_DECIMAL = r"^\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*$"
_TIMESTAMP = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\\.[0-9]{1,9})?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"
)


def _quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _bits(*fitting: str) -> int:
    return _SEEN | _ALL & ~sum(1 << LATTICE.index(kind) for kind in fitting)


def _misfits(column: str) -> str:
    """SQL for the bits of the types that a text does not fit; 0 for NULL.

    A pattern costs far more than a look at single characters, so these choose the one
    pattern that most texts need: what sorts from ``:`` on begins with no digit, sign, point
    or space, a time has a hyphen in place 5 after a digit, and an integer has no point. Only
    texts of the right shape are cast, to find integers beyond 64 bits, numbers beyond a
    double (which have an exponent or hundreds of digits), and dates such as 30 February.
    """
    name, bits = _quoted(column), _bits
    booleans = ", ".join(f"'{text}'" for text in BOOLEAN_TEXTS)
    short = f"length({name}) < 300 AND NOT contains({name}, 'e') AND NOT contains({name}, 'E')"
    finite = f"({short} OR abs(try_cast(trim({name}) AS double)) < double('Infinity'))"
    return (
        f"CASE WHEN {name} IS NULL THEN 0 "
        f"WHEN {name} >= ':' THEN CASE WHEN {name} IN ({booleans}) THEN {bits('boolean')} ELSE {bits()} END "
        f"WHEN {name} >= '0' AND substr({name}, 5, 1) = '-' AND {name} RLIKE '{_TIMESTAMP}' "
        f"THEN CASE WHEN try_cast({name} AS timestamp) IS NOT NULL THEN {bits('timestamp')} ELSE {bits()} END "
        f"WHEN NOT contains({name}, '.') AND {name} RLIKE '{_INTEGER}' "
        f"THEN CASE WHEN length({name}) < 19 OR try_cast(trim({name}) AS bigint) IS NOT NULL "
        f"THEN {bits('bigint', 'double')} WHEN {finite} THEN {bits('double')} ELSE {bits()} END "
        f"WHEN {name} RLIKE '{_DECIMAL}' THEN CASE WHEN {finite} THEN {bits('double')} ELSE {bits()} END "
        f"ELSE {bits()} END"
    )


def _narrowest(bits: int | None, all_null: str) -> str:
    if not bits:
        return all_null
    return next((kind for i, kind in enumerate(LATTICE) if not bits & 1 << i), "string")


def column_types(df: DataFrame, columns: Sequence[str] | None = None, all_null: str = "double") -> dict[str, str]:
    """The type of each text column by all rows of ``df``; columns of NULLs get ``all_null``."""
    columns = list(columns or df.columns)
    found = _wide_bits(df, columns) if len(columns) > WIDE else None
    if found is None:
        found = _column_bits(_cells(df, columns), _misfits("text"))
    return {c: _narrowest(found.get(i), all_null) for i, c in enumerate(columns)}


def _column_bits(cells: DataFrame, bits: str) -> dict[int, int]:
    # One row per column.
    return {row["place"]: row["bits"] for row in cells.groupBy("place").agg(F.expr(f"bit_or({bits})").alias("bits")).collect()}


def _wide_bits(df: DataFrame, columns: Sequence[str]) -> dict[int, int] | None:
    """The bits of each column by its place; None if a text has a byte that marks the end of a cell."""
    cells = ", ".join(f"coalesce(CAST({_quoted(c)} AS STRING), CAST(X'{_NULL:02X}' AS STRING))" for c in columns)
    lines = df.selectExpr(f"CAST(concat_ws(CAST(X'{_END:02X}' AS STRING), {cells}, '') AS BINARY) AS line")
    typed = lines.mapInArrow(_typing(len(columns)), "place int, bits int, text binary")
    left = typed.selectExpr("place", "bits", "CAST(text AS STRING) AS text")
    found = _column_bits(left, f"coalesce(bits, {_misfits('text')})")
    return None if -1 in found else found


def _typing(width: int) -> Callable:
    """A function from batches of lines to (place, bits, text).

    It gives one row per column with the bits of the cells that it typed, and each other text,
    once per block of lines, without bits; place -1 tells that the ends of cells are not certain.
    It is nested and holds plain values only, so that it travels to executors by value.
    """
    end, null, block, longest = _END, _NULL, 1 << 19, 1 << 20
    nothing, boolean, whole, decimal, time = (
        _bits(), _bits("boolean"), _bits("bigint", "double"), _bits("double"), _bits("timestamp")
    )
    words = [text.encode() for text in BOOLEAN_TEXTS]
    # White space, signs and letters of numbers and times, and the bytes of what a pattern's end takes for a line's end.
    possible = b"+-:eETZ \t\n\x0b\f\r\xc2\x85\xe2\x80\xa8\xa9"

    def typed(batches):
        import numpy as np
        import pyarrow as pa

        # Counts of points, of other bytes, and of bytes that no number or time has.
        weights = np.full(256, 1 << 20 | 1 << 40, np.int64)
        weights[list(possible)] = 1 << 20
        weights[list(b"0123456789") + [end]] = 0
        weights[ord(".")] = 1
        days = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])

        def rows(places, bits, texts):
            return pa.RecordBatch.from_arrays(
                [pa.array(places, pa.int32()), pa.array(bits, pa.int32()), pa.array(texts, pa.binary())], ["place", "bits", "text"]
            )

        def plain_times(cells):
            """Which rows of a matrix of bytes, with as many hyphens and colons as a time has, are a date or a time."""
            number = lambda i: cells[:, i].astype(np.int16) * 10 + cells[:, i + 1] - 11 * 48
            year, month, day = number(0) * 100 + number(2), number(5), number(8)
            leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
            right = (cells[:, 4] == ord("-")) & (cells[:, 7] == ord("-")) & (year >= 1) & (month >= 1) & (month <= 12)
            right &= (day >= 1) & (day <= days[np.where(right, month, 1)] + (leap & (month == 2)))
            if cells.shape[1] > 10:
                right &= ((cells[:, 10] == ord(" ")) | (cells[:, 10] == ord("T"))) & (cells[:, 13] == ord(":")) & (cells[:, 16] == ord(":"))
                right &= (number(11) <= 23) & (number(14) <= 59) & (number(17) <= 59)
            return right

        known = np.zeros(width, np.int32)
        for batch in batches:
            lines = batch.column(0)
            _, offsets, data = lines.buffers()
            kind = np.int64 if pa.types.is_large_binary(lines.type) else np.int32
            bounds = np.frombuffer(offsets, kind, len(lines) + 1, lines.offset * np.dtype(kind).itemsize)
            data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
            at = 0
            while at < len(lines):
                to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + block, "right")) - 1)
                chunk = data[bounds[at] : bounds[to]]
                ends = np.flatnonzero(chunk == end)
                if len(ends) != (to - at) * width or (ends[width - 1 :: width] + 1 != bounds[at + 1 : to + 1] - bounds[at]).any():
                    yield rows([-1], [0], [None])
                    return
                at = to
                starts = np.empty_like(ends)
                starts[0], starts[1:] = 0, ends[:-1] + 1
                length, first = ends - starts, chunk[starts]
                counts = np.diff(np.cumsum(weights[chunk])[ends], prepend=0)
                points, others = counts & (1 << 20) - 1, counts >> 20 & (1 << 20) - 1
                signed = (first == ord("+")) | (first == ord("-"))
                digits = length - points - signed
                number = (others == signed) & (digits >= 1) & (length < 300)
                bits = np.zeros(len(ends), np.int32)
                # The empty text, what sorts from ":" on (booleans come below), and what has a byte that does not fit.
                bits[(length == 0) | (first >= ord(":")) | (counts >> 40 > 0)] = nothing
                bits[number & (points == 0) & (digits <= 18)] = whole
                bits[number & (points == 1)] = decimal
                for size, marks in ((10, 2), (19, 5)):
                    places = np.flatnonzero((bits == 0) & (length == size) & (others == marks) & (points == 0))
                    if len(places):
                        right = plain_times(chunk[starts[places][:, None] + np.arange(size)])
                        bits[places[right]] = time
                for size in {len(word) for word in words}:
                    places = np.flatnonzero((length == size) & (first > ord(":")) & (first < end))
                    if len(places):
                        cells = chunk[starts[places][:, None] + np.arange(size)]
                        for word in words:
                            if len(word) == size:
                                bits[places[(cells == np.frombuffer(word, np.uint8)).all(axis=1)]] = boolean
                bits[length >= longest] = 0
                bits[(length == 1) & (first == null)] = -1
                left = np.flatnonzero(bits == 0)
                bits[bits == -1] = 0
                known |= np.bitwise_or.reduce(bits.reshape(-1, width), axis=0)
                # A column that has no type left needs no further look.
                left = left[known[left % width] != nothing]
                if len(left):
                    texts = {(int(i) % width, chunk[starts[i] : ends[i]].tobytes()) for i in left}
                    yield rows([place for place, _ in texts], [None] * len(texts), [text for _, text in texts])
        yield rows(np.arange(width), known, [None] * width)

    return typed


def _cells(df: DataFrame, columns: Sequence[str], *kept: str) -> DataFrame:
    """(the ``kept`` columns, place, text) of each cell of some text columns."""
    texts = ", ".join(f"CAST({_quoted(c)} AS STRING)" for c in columns)
    return df.selectExpr(*kept, f"posexplode(array({texts})) AS (place, text)")


def _fits(column: str, kind: str) -> str:
    return "true" if kind == "string" else f"(({_misfits(column)}) & {1 << LATTICE.index(kind)}) = 0"


def infer_types(
    df: DataFrame,
    rows: int | None = None,
    order: str | None = None,
    columns: Sequence[str] | None = None,
    all_null: str = "double",
) -> DataFrame:
    """(position, column, type, first_violation) of each text column.

    With ``rows``, the types follow from the rows whose ``order`` (a number from 0, such as
    :func:`~censusloom.sources.order.with_input_order` gives) is below it, and
    ``first_violation`` is the least ``order`` of a row whose text does not fit; it is NULL
    where none is, which includes all columns when all rows decide. An empty table has
    ``all_null`` everywhere.
    """
    columns = [c for c in columns or df.columns if c != order]
    check(rows is None or (rows >= 1 and order is not None), "a trial read needs a number of rows and an order")
    sample = df if rows is None else df.where(F.col(order) < rows)
    types = column_types(sample, columns, all_null)
    first: dict[str, int | None] = dict.fromkeys(columns)
    if rows is not None:
        typed = [c for c in columns if types[c] != "string"]
        if typed:
            tested = ", ".join(str(1 << LATTICE.index(types[c])) for c in typed)
            cells = _cells(df.where(F.col(order) >= rows), typed, f"{_quoted(order)} AS number")
            broken = cells.where(f"({_misfits('text')}) & element_at(array({tested}), place + 1) <> 0")
            least = broken.groupBy("place").agg(F.min("number").alias("first")).collect()
            first |= {typed[row["place"]]: row["first"] for row in least}
    table = [(i, c, types[c], first[c]) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(table, "position int, column string, type string, first_violation bigint")


def type_violations(df: DataFrame, types: Mapping[str, str], order: str) -> DataFrame:
    """(row, column, type, text) of every text that does not fit the type of its column.

    A row is looked at once for all columns, and only texts that do not fit leave the scan.
    """
    typed = [c for c in df.columns if types.get(c, "string") != "string"]
    if not typed:
        return df.limit(0).selectExpr(f"{_quoted(order)} AS row", "'' AS column", "'' AS type", "'' AS text")
    cells = ", ".join(
        f"CASE WHEN NOT ({_fits(c, types[c])}) THEN named_struct('column', '{_escaped(c)}', 'type', '{types[c]}', 'text', {_quoted(c)}) END"
        for c in typed
    )
    bad = df.selectExpr(f"{_quoted(order)} AS row", f"explode(array_compact(array({cells}))) AS cell")
    return bad.select("row", "cell.column", "cell.type", "cell.text")


def _escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")
