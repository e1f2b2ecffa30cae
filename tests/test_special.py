"""Distribution functions against closed forms, the standard library and round trips."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasonspark.functions import special


def test_normal_functions(spark):
    xs = [-38.0, -9.0, -7.1, -7.0, -1.5, -1e-9, 0.0, 0.3, 2.0, 6.9, 7.2, 40.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", special.normal_cdf(F.col("x")).alias("p")).collect()
    for x, p in rows:
        assert p == pytest.approx(0.5 * math.erfc(-x / math.sqrt(2)), rel=1e-8, abs=1e-300)
    ps = [1e-300, 1e-12, 0.02, 0.07, 0.0751, 0.5, 0.9, 0.999999]
    rows = spark.createDataFrame([(p,) for p in ps], "p double").select("p", special.normal_ppf(F.col("p")).alias("z")).collect()
    for p, z in rows:
        assert z == pytest.approx(NormalDist().inv_cdf(p), rel=1e-12, abs=1e-12)
    assert spark.range(1).select(special.normal_ppf(F.lit(1.0)), special.normal_cdf(F.lit(None).cast("double"))).first() == (None, None)


@pytest.mark.parametrize("dof", [1, 2, 3, 4, 7, 30])
def test_student(spark, dof):
    """Against the density, summed by Simpson's rule."""
    c = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(dof * math.pi)
    t = 1.7
    x = np.linspace(0, t, 2001)
    y = c * (1 + x * x / dof) ** (-(dof + 1) / 2)
    want = 0.5 + (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()) * (x[1] - x[0]) / 3
    got = spark.range(1).select(special.t_cdf(F.lit(t), dof), special.t_cdf(F.lit(-t), dof)).first()
    assert got[0] == pytest.approx(want, abs=1e-9)
    assert got[0] + got[1] == pytest.approx(1.0)


def test_gamma():
    for k in (1, 2, 5, 60):
        x = np.array([0.01, 0.5, 1.0, 4.0, 40.0, 90.0])
        tail = np.exp(-x) * sum(x**i / math.factorial(i) for i in range(k))
        assert special.gamma_p(k, x) == pytest.approx(1 - tail, abs=1e-12)
    p = np.array([1e-6, 0.1, 0.5, 0.9, 1 - 1e-6])
    for a in (0.3, 1.0, 7.5, 400.0):
        assert special.gamma_p(a, special.gamma_q(a, p)) == pytest.approx(p, abs=1e-10)
    assert special.gamma_p(2.0, [0.0, np.inf]).tolist() == [0.0, 1.0]
    assert np.isnan(special.gamma_p([-1.0, np.nan], 1.0)).all()


def test_gamma_round_trip(spark):
    from seasonspark.operators import methods

    d = spark.createDataFrame([(0.4, 2.0, 1.5), (9.0, 2.0, 1.5), (None, 2.0, 1.5)], "x double, a double, s double")
    z = d.withColumn("z", methods.gamma_to_normal(F.col("x"), F.col("a"), F.col("s")))
    rows = z.select("x", methods.normal_to_gamma(F.col("z"), F.col("a"), F.col("s"))).collect()
    assert rows[0][1] == pytest.approx(0.4, rel=1e-8) and rows[1][1] == pytest.approx(9.0, rel=1e-8)
    assert rows[2][1] is None or math.isnan(rows[2][1])
