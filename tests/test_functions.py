"""Special functions and text rules against known values and independent formulas."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventweave.functions import special as sp
from eventweave.functions import text as tx


def numbers(spark, xs):
    return spark.createDataFrame([(float(x),) for x in xs], "x double")


def test_digamma_and_lgamma(spark):
    xs = [0.01, 0.5, 1, 2, 3.7, 10, 123.4, 1e5]
    rows = numbers(spark, xs).select("x", sp.digamma(F.col("x")).alias("psi"), sp.lgamma(F.col("x")).alias("lg")).collect()
    for r in rows:
        h = 1e-5 * max(1, r.x)
        assert r.lg == pytest.approx(math.lgamma(r.x), abs=1e-9, rel=1e-12)
        if r.x >= 0.5:
            assert r.psi == pytest.approx((math.lgamma(r.x + h) - math.lgamma(r.x - h)) / (2 * h), rel=1e-4, abs=1e-5)
        assert r.psi == pytest.approx(sp.digamma_of(r.x), rel=1e-13)
    psi = {r.x: r.psi for r in rows}
    assert psi[1] == pytest.approx(-0.5772156649015329, abs=1e-12) and psi[0.5] == pytest.approx(-1.9635100260214235, abs=1e-12)


def test_gamma_kl_by_integration(spark):
    row = spark.range(1).select(sp.gamma_kl(F.lit(3.0), F.lit(2.0), F.lit(4.5), F.lit(1.2)).alias("kl"), sp.gamma_kl(F.lit(3.0), F.lit(2.0), F.lit(3.0), F.lit(2.0)).alias("none")).first()
    x = np.linspace(1e-6, 40, 400_001)
    log = lambda a, b: a * math.log(b) - math.lgamma(a) + (a - 1) * np.log(x) - b * x
    p, q = log(3.0, 2.0), log(4.5, 1.2)
    assert row.kl == pytest.approx(np.trapezoid(np.exp(p) * (p - q), x), abs=1e-6)
    assert row.none == pytest.approx(0, abs=1e-12)


def test_js_guards(spark):
    pairs = [(0.5, 0.5), (0.0, 0.4), (0.4, 0.0), (0.9, 0.1)]
    rows = spark.createDataFrame(pairs, "p double, q double").select(sp.js_term(F.col("p"), F.col("q")).alias("x")).collect()
    assert rows[0].x == 2e-300
    assert rows[1].x == pytest.approx(0.4 * math.log(2 * 0.4 / (0.4 + 1e-10)))
    assert rows[2].x == pytest.approx(rows[1].x)
    assert rows[3].x == pytest.approx(0.9 * math.log(1.8) + 0.1 * math.log(0.2))


@pytest.mark.parametrize("shape", [0.3, 1.0, 2.5, 40.0, 5000.0])
def test_gamma_quantiles(shape):
    for p in (0.025, 0.5, 0.975):
        assert sp.gamma_mass(np.array([shape]), sp.gamma_quantile([shape], p))[0] == pytest.approx(p, abs=1e-10)
    assert sp.gamma_quantile([1.0], 0.5)[0] == pytest.approx(math.log(2))
    assert np.isnan(sp.gamma_quantile([-1.0, math.nan, 2.0], 0.5)).tolist() == [True, True, False]


def test_station_names(spark):
    cases = {
        "Lansdown Road , Bow": "Lansdowne Road, Bow", "A   ,  B": "A, B", "X  Y   Z": "X Y  Z", "Old_OLD": "Old", "Mile End road, Bow": "Mile End Road, Bow",
        "Dove Row, Haggerston ": "Dove Row, Haggerston", "plain": "plain", None: None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "s string").select("s", tx.clean_station(F.col("s")).alias("c")).collect()
    assert {r.s: r.c for r in rows} == cases


def test_times(spark):
    rows = spark.createDataFrame([("02/01/2019 00:00",), ("09/01/2019 01:30\r\n",), ("bad",), (None,)], "s string")
    out = [r.m for r in rows.select(tx.minutes_since(F.col("s"), "2019-01-02").alias("m")).collect()]
    assert out == [0.0, 7 * 1440 + 90, None, None]
    weeks = [r.w for r in rows.select(tx.week_of(tx.minutes_since(F.col("s"), "2019-01-02")).alias("w")).collect()]
    assert weeks == [0.5, 1.5, None, None]
    jitter = [r.m for r in rows.select(tx.minutes_since(F.col("s"), "2019-01-02", 5).alias("m")).collect()]
    assert 0 <= jitter[0] < 1
    assert spark.range(1).select(tx.seconds_since(F.lit("2019/01/03 00:00"), "2019-01-02", True).alias("s")).first().s == 86400


def test_haversine(spark):
    row = spark.range(1).select(tx.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)).alias("a"), tx.haversine(F.lit(51.5), F.lit(-0.1), F.lit(51.5), F.lit(-0.1)).alias("b")).first()
    assert row.a == pytest.approx(math.pi / 2 * 6365.079) and row.b == 0
