import pytest

from censusloom.errors import SurveyError
from censusloom.sources import inference
from censusloom.sources.contracts import fingerprint
from censusloom.sources.files import apply_types, has_quoted_line_breaks, scan_csv, write_table
from censusloom.sources.inference import column_types, infer_types, type_violations
from censusloom.sources.order import first_per_key_in_files, first_rows_of_files, with_input_order


@pytest.fixture
def files(spark, tmp_path):
    """Five files of different sizes, some larger than a block; the order is their content."""
    number = 0
    for i, rows in enumerate([3000, 1, 8000, 0, 500]):
        with open(tmp_path / f"part-{i:02d}.csv", "w") as out:
            out.write("n,key,text\n")
            for _ in range(rows):
                out.write(f"{number},{number * 7919 % 1000},{'x' * (number % 40)}\n")
                number += 1
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    yield str(tmp_path), number
    for k, v in before.items():
        spark.conf.set(k, v)


def test_row_numbers_follow_files_and_blocks(spark, files):
    folder, n = files
    df = scan_csv(spark, folder, multi_line=False)
    assert df.rdd.getNumPartitions() > 8
    found = with_input_order(df).select("n", "row").collect()
    assert sorted((int(r["n"]), r["row"]) for r in found) == [(i, i) for i in range(n)]


def test_row_numbers_of_files_in_one_piece(spark, files):
    folder, n = files
    found = with_input_order(scan_csv(spark, folder), "at").select("n", "at").collect()
    assert sorted((int(r["n"]), r["at"]) for r in found) == [(i, i) for i in range(n)]


def test_row_numbers_survive_names_and_filters(spark, files):
    folder, _ = files
    df = scan_csv(spark, folder, multi_line=False)
    odd = df.selectExpr("n", "key AS _file", "text AS _place", "key AS _start", "key AS _offset", "key AS _first")
    assert with_input_order(odd).where("row != n").count() == 0
    some = with_input_order(df.where("n % 2 = 0")).where("row * 2 != n")
    assert some.count() == 0
    with pytest.raises(SurveyError):
        with_input_order(df, "KEY")


@pytest.mark.parametrize("rows", [1, 2999, 3001, 9000, 10**6])
def test_first_rows_without_an_order_column(spark, files, rows):
    folder, n = files
    found = first_rows_of_files(scan_csv(spark, folder, multi_line=False), rows).collect()
    assert [int(r["n"]) for r in found] == list(range(min(n, rows)))


def test_first_duplicate_without_an_order_column(spark, files):
    folder, n = files
    found = first_per_key_in_files(scan_csv(spark, folder, multi_line=False), ["key"])
    expected = {}
    for i in range(n):
        expected.setdefault(i * 7919 % 1000, i)
    assert {int(r["key"]): int(r["n"]) for r in found.collect()} == expected
    assert found.columns == ["n", "key", "text"]


def test_null_keys_are_one_key(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\nNA,1\nx,2\nNA,3\nx,4\n")
    found = first_per_key_in_files(scan_csv(spark, str(tmp_path)), ["k"]).collect()
    assert sorted((r["k"], r["v"]) for r in found if r["k"]) == [("x", "2")]
    assert [r["v"] for r in found if r["k"] is None] == ["1"]


TEXTS = {
    "whole": (["1", "-2", " 3 ", "+4", None], "bigint"),
    "large": (["1", "9223372036854775807"], "bigint"),
    "beyond": (["1", "9223372036854775808"], "double"),
    "decimal": (["1", "2.5", "1e3", ".5"], "double"),
    "infinite": (["1", "1e999"], "string"),
    "nan": (["1", "NaN"], "string"),
    "suffix": (["1d", "2"], "string"),
    "flag": (["true", "False", "TRUE"], "boolean"),
    "flag_number": (["true", "1"], "string"),
    "day": (["2024-01-31", "2024-02-29"], "timestamp"),
    "no_day": (["2024-01-31", "2023-02-29"], "string"),
    "moment": (["2024-01-31 10:11", "2024-01-31T10:11:12.123Z", "2024-01-31"], "timestamp"),
    "year": (["2024", "2024-01-31"], "string"),
    "words": (["a", "", "1"], "string"),
    "nothing": ([None, None], "double"),
}


def test_types_of_columns(spark):
    size = max(len(v) for v, _ in TEXTS.values())
    rows = [tuple(v[i] if i < len(v) else None for v, _ in TEXTS.values()) for i in range(size)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in TEXTS)).repartition(3)
    assert column_types(df) == {c: kind for c, (_, kind) in TEXTS.items()}
    assert column_types(df, ["nothing"], all_null="string") == {"nothing": "string"}
    assert set(column_types(df.limit(0)).values()) == {"double"}
    typed = apply_types(df, column_types(df))
    assert typed.where("beyond IS NOT NULL").count() == 2 and dict(typed.dtypes)["day"] == "timestamp"


def test_types_of_the_first_rows_and_what_breaks_them(spark):
    rows = [(i, "1" if i != 70 else "x", "true" if i < 90 else "no", "a", None if i < 60 else "z") for i in range(100)]
    df = spark.createDataFrame(rows, "row bigint, a string, b string, c string, `d.e` string").repartition(4)
    found = {r["column"]: (r["type"], r["first_violation"]) for r in infer_types(df, 50, "row").collect()}
    assert found == {"a": ("bigint", 70), "b": ("boolean", 90), "c": ("string", None), "d.e": ("double", 60)}
    every = {r["column"]: (r["type"], r["first_violation"]) for r in infer_types(df, order="row").collect()}
    assert every == {c: ("string", None) for c in found}
    bad = type_violations(df, {c: t for c, (t, _) in found.items()}, "row").collect()
    assert sorted((r["row"], r["column"], r["text"]) for r in bad)[:2] == [(60, "d.e", "z"), (61, "d.e", "z")]
    assert len(bad) == 1 + 10 + 40
    assert type_violations(df, {}, "row").collect() == []
    with pytest.raises(SurveyError):
        infer_types(df, 50)


def test_one_pass_over_many_columns(spark):
    wide = spark.range(50).selectExpr(*[f"CAST(id + {i} AS STRING) AS c{i}" for i in range(114)])
    assert set(column_types(wide).values()) == {"bigint"}


def test_line_breaks_in_quotes_are_looked_for(spark, tmp_path):
    (tmp_path / "plain.csv").write_text('a,b\n1,"x ""y"" z"\n2,"u,v"\n')
    (tmp_path / "broken.csv").write_text('a,b\n1,"x\ny"\n2,"u"\n3,"p""q\n""r"\n')
    plain, broken = str(tmp_path / "plain.csv"), str(tmp_path / "broken.csv")
    assert not has_quoted_line_breaks(spark, plain) and has_quoted_line_breaks(spark, broken)
    assert [tuple(r) for r in scan_csv(spark, plain, multi_line=None).collect()] == [("1", 'x "y" z'), ("2", "u,v")]
    found = [tuple(r) for r in scan_csv(spark, broken, multi_line=None).collect()]
    assert found == [("1", "x\ny"), ("2", "u"), ("3", 'p"q\n"r')]


def test_the_code_of_type_inference_does_not_grow_with_the_columns(spark, monkeypatch):
    calls = []
    built = inference._misfits
    monkeypatch.setattr(inference, "_misfits", lambda column: calls.append(column) or built(column))
    wide = spark.range(3).selectExpr("id AS row", *[f"CAST(id * {i} AS STRING) AS c{i}" for i in range(120)])
    for columns in (["c0"], [f"c{i}" for i in range(120)]):
        calls.clear()
        types = {r["type"] for r in infer_types(wide.select("row", *columns), 1, "row").collect()}
        assert types == {"bigint"} and len(calls) == 2


def test_types_of_texts_that_look_like_others(spark):
    texts = {
        "    -1e-5": "double", "123e-5": "double", "1e400": "string", "9" * 400: "string", "9" * 30: "double", "+7": "bigint",
        " 7 ": "bigint", ".5": "double", "5.": "double", "1234-5": "string", "2024-01-31": "timestamp", "2024-02-30": "string",
        "2024-01-31 25:00": "string", "true": "boolean", "tRUE": "string", ":": "string", "": "string", "-": "string", "1.2.3": "string",
        "9223372036854775807": "bigint", "9223372036854775808": "double",
    }
    one_row = spark.createDataFrame([list(texts)], ", ".join(f"c{i} string" for i in range(len(texts))))
    assert list(inference.column_types(one_row).values()) == list(texts.values())


def test_a_fingerprint_reads_the_table_once(spark, tmp_path):
    rows = [(1, 2.0), (1, None), (None, -1.0), (None, 3.0)]
    spark.createDataFrame(rows, "k int, v double").write.parquet(str(tmp_path / "t"))
    found = fingerprint(spark.read.parquet(str(tmp_path / "t")), ["k"], "v")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    numbers = {"rows": 4, "columns": 2, "missing_cells": 3, "valid_target_rows": 2, "duplicate_keys": 2}
    assert {r["metric"]: r["value"] for r in found.collect()} == numbers
    empty = fingerprint(spark.read.parquet(str(tmp_path / "t")).where("k > 9"), ["k"], "v")
    assert {r["metric"]: r["value"] for r in empty.collect()} == dict.fromkeys(numbers, 0) | {"columns": 2}


def test_compressed_files_hold_a_bounded_number_of_rows(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = spark.range(1000).selectExpr("CAST(id AS STRING) AS n", "CASE WHEN id % 3 = 0 THEN 'a,\"b' ELSE 'NA' END AS text")
    write_table(rows.coalesce(1), folder, compression="lz4", rows_per_file=300)
    read = scan_csv(spark, folder, multi_line=False)
    assert len(read.inputFiles()) == 4 and read.count() == 1000
    assert read.where("text = 'a,\"b'").count() == 334 and read.where("text IS NULL").count() == 666


ODD_TEXTS = [
    "", " ", "1", " 12 ", "+5", "-7", "+", ".", "1.", ".5", "1..2", "1e5", "1e400", "1e", "9" * 18, "9" * 19, "-" + "9" * 19,
    "0" * 25, "1" * 310, "." + "1" * 299, "true", "tRue", "FALSE", "2024-02-29", "2023-02-29", "1900-02-29", "0000-01-01",
    "2024-01-00", "2024-01-31 23:59:59", "2024-01-31T24:00:00", "2024-01-31 23:59:59.123", "2024-01-31T23:59:59+01:00",
    "2024-01-31 00-00-00", "12\n", "12\u0085", "12 Main", "é", "5€", "NaN", "1d", "0x10", ":", "3-4", "5\x00", None,
]


def test_wide_tables_are_typed_without_a_row_per_cell(spark, monkeypatch):
    """Each odd text alone in a column, and next to others; the same types as cell by cell."""
    texts = ODD_TEXTS * 3
    rows = [texts, [*texts[5:], *texts[:5]], [None] * len(texts)]
    names = [f"c{i}" for i in range(len(texts))]
    for some in (rows[:1], rows, []):
        table = spark.createDataFrame(some, ", ".join(f"{n} string" for n in names)).repartition(2)
        cells = inference._column_bits(inference._cells(table, names), inference._misfits("text"))
        expected = {n: inference._narrowest(cells.get(i), "double") for i, n in enumerate(names)}
        with monkeypatch.context() as patch:
            patch.setattr(inference, "_cells", None)
            assert column_types(table) == expected


def test_bytes_outside_utf8_are_typed_cell_by_cell(spark):
    table = spark.range(5).selectExpr(*[f"CAST(id + {i} AS STRING) AS c{i}" for i in range(110)], "CAST(X'31FF32' AS STRING) AS odd")
    assert inference._wide_bits(table, table.columns) is None
    assert column_types(table) == {f"c{i}": "bigint" for i in range(110)} | {"odd": "string"}
