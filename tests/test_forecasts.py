"""What SQL does not express: mixtures, permutations, gaps on grids."""

import numpy as np
import pytest

from seasonspark.operators import ensembles, metrics, regrid, validation


def test_bma_prefers_the_good_model(spark):
    rng = np.random.default_rng(1)
    obs = rng.normal(size=60)
    rows = [(i, "good", float(o + 0.1 * rng.normal())) for i, o in enumerate(obs)] + [(i, "poor", float(3 * rng.normal())) for i in range(60)]
    o = spark.createDataFrame([(i, float(x)) for i, x in enumerate(obs)], "k int, obs double")
    (a, wa, va), (b, wb, _) = ensembles.bma(spark.createDataFrame(rows, "k int, model string, value double"), o, ["k"])
    assert (a, b) == ("good", "poor") and wa > 0.9 and wa + wb == pytest.approx(1) and 0.003 < va < 0.03
    with pytest.raises(ValueError):
        ensembles.bma(spark.createDataFrame(rows[:60], "k int, model string, value double"), o.where("k > 99"), ["k"])


def test_permutation(spark):
    rng = np.random.default_rng(2)
    x = np.arange(20.0)
    rows = [("linked", float(v), float(2 * v + rng.normal())) for v in x] + [("flat", 1.0, float(v)) for v in x]
    got = {r["cell"]: r for r in metrics.permutation_test(spark.createDataFrame(rows, "cell string, x double, y double"), 199).collect()}
    assert got["linked"]["p"] == pytest.approx(1 / 200) and got["linked"]["statistic"] > 0.9
    assert got["flat"]["p"] is None or np.isnan(got["flat"]["p"])


def test_regrid_gaps(spark):
    rows = [(float(a), float(b), None if (a, b) == (1, 1) else float(10 * a + b)) for a in range(3) for b in range(3)]
    g = spark.createDataFrame(rows, "lat double, lon double, value double")
    got = {(r["lat"], r["lon"]): r["value"] for r in regrid.regrid(g, [], [0.0, 0.5, 9.0], [0.0, 1.5, 2.0]).collect()}
    assert got == {(0.0, 0.0): 0.0, (0.0, 1.5): 1.5, (0.0, 2.0): 2.0, (0.5, 0.0): 5.0, (0.5, 1.5): None, (0.5, 2.0): 7.0}


def test_folds_need_consecutive_years():
    with pytest.raises(ValueError):
        validation.loyo([2000, 2002])
    assert validation.lko([2000, 2001, 2002], 2) == [([2000, 2001], [2002]), ([2001, 2002], [2000])]
    assert validation.blocked([1, 2, 3, 4, 5], 2) == [([1, 2], [3, 4, 5]), ([3, 4], [1, 2, 5])]
    with pytest.raises(KeyError):
        validation.scheme("no such")
