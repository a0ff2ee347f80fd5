import math

import pytest

from censusloom.functions.tails import chi_square_p, chi_square_upper, correlation_p, student_two_sided


def r_p_value(r, n):
    return student_two_sided(r * math.sqrt((n - 2) / ((1 - r) * (1 + r))), n - 2)


@pytest.mark.parametrize(
    "r, n, expected",
    [
        (0.19577614584645708, 22622, 2.923923192037924e-194),
        (0.1007126636674959, 22759, 2.185087666359763e-52),
        (-0.019702626290711907, 22965, 0.002827412702917251),
        (0.0002966828030409153, 22965, 0.9641412000417496),
        (-0.18956769829023784, 22965, 9.017842585383545e-185),
    ],
)
def test_correlation_goldens(r, n, expected):
    assert r_p_value(r, n) == pytest.approx(expected, rel=1e-9)


@pytest.mark.parametrize(
    "h, groups, expected",
    [
        (1158.0153399152873, 33, 7.5042622064937e-223),
        (80.97987036297798, 2, 2.280286356841515e-19),
        (826.7539141415651, 3, 2.9693992752939314e-180),
        (363.4213247516655, 15, 6.273514120329272e-69),
        (11350.958601959888, 77, 0.0),
    ],
)
def test_chi_square_goldens(h, groups, expected):
    assert chi_square_upper(h, groups - 1) == pytest.approx(expected, rel=1e-10)


def test_closed_forms():
    assert student_two_sided(1.0, 1) == pytest.approx(0.5, abs=1e-14)
    assert student_two_sided(0.0, 7) == 1.0
    assert student_two_sided(math.inf, 7) == 0.0
    assert chi_square_upper(3.0, 4) == pytest.approx(math.exp(-1.5) * 2.5, rel=1e-13)
    assert chi_square_upper(0.2, 2) == pytest.approx(math.exp(-0.1), rel=1e-13)
    # Many degrees of freedom: the normal tail.
    assert student_two_sided(5.0, 1e12) == pytest.approx(math.erfc(5 / math.sqrt(2)), rel=1e-9)
    assert student_two_sided(4.0, 0.99e7) == pytest.approx(student_two_sided(4.0, 1.01e7), rel=1e-5)


def test_columns_pass_nulls(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0.5, 30), (None, 30), (1.0, 30), (0.5, 2)], "r double, n bigint")
    got = [row[0] for row in df.select(correlation_p(F.col("r"), F.col("n"))).collect()]
    assert got[0] == pytest.approx(r_p_value(0.5, 30))
    assert got[1:] == [None, 0.0, None]
    assert df.select(chi_square_p(F.lit(3.0), F.lit(4))).first()[0] == pytest.approx(math.exp(-1.5) * 2.5)
