"""Tables and rules shared by the tests of the training-data operators."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
_SYLLABLES = ("the", "on", "er", "an", "ing", "st", "ou", "re", "ha", "ed", "ly", "tion")


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    made = ["".join(draw.choices(_SYLLABLES, k=draw.randint(1, 4))) for _ in range(words)]
    return " ".join(w + (".\n" if i % 17 == 16 else "." if i % 9 == 8 else "") for i, w in enumerate(made))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows and ids."""
    long_text = prose(7, 30_000)
    base = prose(1, 120)
    return [
        (1, base, "en", "a", 10),
        (1, base, "en", "a", 10),  # a repeated row
        (2, base, "en", "b", 10),  # a copy
        (3, None, "en", "a", None),
        (4, "", None, None, 0),
        (None, base + " one more word", None, "a", 5),
        (None, None, None, None, None),
        (5, long_text, "de", "c", len(long_text)),
        (5, prose(9, 60), "de", "c", 1),  # an id with another text
        (6, " \n\t\r\n ", "en", "a", 6),
        (7, "Ünïcode 中文 mit Émojis 😀😀 und \x00 Null", "de", None, 1),
        (8, "4 word text only", "en", "a", 1),
        (9, "4 word text only", "fr", "a", 1),
    ]


def documents(spark: SparkSession, rows: list[tuple], schema: str = DOCS) -> DataFrame:
    return spark.createDataFrame(rows, schema).repartition(3)


def clashing(docs: DataFrame) -> DataFrame:
    """Extra columns with names that the operators use inside."""
    names = ("key", "_key", "ident", "rows", "band", "values", "gram", "size", "shard", "place", "_id", "_fresh", "score")
    return docs.selectExpr("*", *[f"'x' AS {n}" for n in names])


def rows_of(df: DataFrame, *columns: str) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def parquet_rows(name: str, columns: str) -> list[tuple]:
    import duckdb

    return duckdb.sql(f"SELECT {columns} FROM '{SF}/{name}.parquet'").fetchall()
