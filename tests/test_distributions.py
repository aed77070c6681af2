import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from armlens.functions.distributions import (
    chi2_sf, f_sf, log10_two_sided_p, normal_sf, two_sided_p,
)


def test_normal_tails(spark):
    zs = [-3.0, 0.0, 0.5, 1.959963984540054, 8.0]
    rows = spark.createDataFrame([(z,) for z in zs], "z double").select(
        "z", normal_sf("z").alias("sf"), two_sided_p("z").alias("p"), log10_two_sided_p("z").alias("lp")
    ).collect()
    for r in rows:
        if r.z < 6:
            assert r.sf == pytest.approx(1.0 - NormalDist().cdf(r.z), rel=1e-9)
        assert r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), rel=1e-12)
        assert r.lp == pytest.approx(math.log10(r.p), abs=1e-12)


def test_log_p_stays_finite_and_continuous_where_p_underflows(spark):
    rows = spark.createDataFrame([(29.999999,), (30.000001,), (109.84,), (194.34,)], "z double").select(
        two_sided_p("z").alias("p"), log10_two_sided_p("z").alias("lp")
    ).collect()
    assert rows[0].lp == pytest.approx(rows[1].lp, abs=1e-3)
    assert rows[2].p == 0.0 and rows[2].lp == pytest.approx(-2622.1, abs=0.5)
    assert rows[3].lp < rows[2].lp


def test_null_in_null_out(spark):
    row = spark.createDataFrame([(None,)], "z double").select(
        two_sided_p("z").alias("p"), normal_sf("z").alias("s"),
        chi2_sf("z", F.lit(2)).alias("c"), f_sf("z", F.lit(1.0), F.lit(2.0)).alias("f"),
    ).first()
    assert list(row) == [None, None, None, None]


@pytest.mark.parametrize("x,df,p", [
    (3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (16.918977604620448, 9, 0.05),
    (18.307038053275146, 10, 0.05), (10.827566170662733, 1, 0.001), (0.0, 4, 1.0),
])
def test_chi_square_tail(spark, x, df, p):
    got = spark.range(1).select(chi2_sf(F.lit(x), F.lit(df))).first()[0]
    assert got == pytest.approx(p, rel=1e-9)


@pytest.mark.parametrize("f,d1,d2,p", [
    (4.964602743730711, 1, 10, 0.05), (2.978237016208434, 10, 10, 0.05),
    (3.8415, 1, 1e9, 0.05), (1.0, 7, 7, 0.5),
])
def test_f_tail(spark, f, d1, d2, p):
    got = spark.range(1).select(f_sf(F.lit(f), F.lit(float(d1)), F.lit(float(d2)))).first()[0]
    assert got == pytest.approx(p, rel=1e-4)


def test_f_tail_equals_chi_square_tail_for_many_rows(spark):
    f, c = spark.range(1).select(
        f_sf(F.lit(2.0), F.lit(12.0), F.lit(1.4e7)), chi2_sf(F.lit(24.0), F.lit(12))
    ).first()
    assert f == pytest.approx(c, rel=1e-4)
