import math

import pytest
from pyspark.sql import functions as F

from censusloom.functions import scalars as S
from censusloom.functions.tokens import INFREQUENT, MISSING, keep_common, options, tokens


def values(df, column):
    return [row[0] for row in df.select(column.alias("v")).collect()]


def test_text_to_number_takes_plain_numbers_only(spark):
    texts = ["12", " 3.5 ", "-1e2", "+.5", "7.", "1d", "NaN", "inf", "", "abc", None, "1e999"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert values(df, S.text_to_number(F.col("t"))) == [12.0, 3.5, -100.0, 0.5, 7.0] + [None] * 7


def test_number_drops_nan_and_infinity(spark):
    df = spark.createDataFrame([(1.0,), (math.nan,), (math.inf,), (-math.inf,), (None,)], "x double")
    assert values(df, S.number(df, "x")) == [1.0, None, None, None, None]


def test_years_boundaries(spark):
    df = spark.createDataFrame([("Less than 1 year",), ("More than 50 years",), ("9",), ("x",), (None,)], "t string")
    got = values(df, S.years_to_number(F.col("t"), {"Less than 1 year": 0.5, "More than 50 years": 51.0}))
    assert got == [0.5, 51.0, 9.0, None, None]


def test_ratio_difference_and_floor_keep_nulls(spark):
    rows = [(1.0, 0.0), (5.0, 4.0), (1.0, 4.0), (None, 4.0), (1.0, None)]
    df = spark.createDataFrame(rows, "part double, whole double")
    part, whole = F.col("part"), F.col("whole")
    assert values(df, S.bounded_ratio(part, whole)) == [None, 1.0, 0.25, None, None]
    assert values(df, S.floored_difference(whole, part)) == [0.0, 0.0, 3.0, None, None]
    assert values(df, S.non_negative(whole - part)) == [0.0, 0.0, 3.0, None, None]
    assert values(df, S.safe_multiple(part, whole)) == [None, 1.25, 4.0, None, None]


def test_labels_and_back(spark):
    df = spark.createDataFrame([("Agree",), ("Maybe",), (None,)], "t string")
    assert values(df, S.label_score(F.col("t"), {"Agree": 1, "Disagree": -1})) == [1.0, None, None]
    scores = spark.createDataFrame([(1.0,), (9.0,), (None,)], "s double")
    assert values(scores, S.score_label(F.col("s"), {1: "one"})) == ["one", None, None]


@pytest.mark.parametrize(
    "row, kept",
    [((60.0, 40.0), True), ((60.0, 40.005), True), ((60.0, 45.0), False), ((60.0, None), False), ((0.0, 0.0), False)],
)
def test_allocation_mask(spark, row, kept):
    df = spark.createDataFrame([(1, *row)], "k int, a double, b double")
    got = S.mask_allocation(df, ["a", "b"]).first()
    assert (got["a"], got["b"]) == (row if kept else (None, None))
    assert got["k"] == 1


def test_logs_invert(spark):
    df = spark.createDataFrame([(0.0,), (99.0,), (None,)], "x double")
    assert values(df, F.round(S.linear_scale(S.log_scale(F.col("x"))), 9)) == [0.0, 99.0, None]


def test_tokens(spark):
    rows = ["A;A; B", "", None, ";", "  ", " C ;D"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = values(df, tokens(F.col("t")))
    assert got == [["A", "B"], [MISSING], [MISSING], [], [MISSING], ["C", "D"]]
    assert values(df, options(F.col("t")))[0] == ["A", " B"]


def test_rare_tokens_share_one_bit(spark):
    df = spark.createDataFrame([(["r1", "r2", "A"],), (["Z"],), ([],)], "t array<string>")
    assert values(df, keep_common(F.col("t"), ["A"])) == [[INFREQUENT, "A"], [INFREQUENT], []]
