"""Wind effect against a published table and across tilings; conservation of coarse amounts; gamma positions by hand."""

import math

import numpy as np
import pytest

from seasonspark.functions.special import gamma_p
from seasonspark.operators import climate, methods, terrain

# The middle row of the wind effect of a ridge, west wind, 5 km spacing, as given out by SAGA.
MIDDLE = (1.0, 1.0, 1.0, 1.3438957, 1.347912, 1.0392474, 0.77501667, 0.80637574, 0.8242363)
STEP = 5000 / 111_195.08
POINTS = "lat double, lon double, z double, u double, v double"


def ridge(i, j):
    side = min(i, 8 - i)
    return {3: 400.0 + 100 * side, 4: 900.0 + 200 * side, 5: 400.0 + 100 * side}.get(j, 0.0)


def effects(df):
    return {(round(r["lat"] / STEP), round(r["lon"] / STEP)): r["effect"] for r in df.collect()}


def test_ridge(spark):
    rows = spark.createDataFrame([(i * STEP, j * STEP, ridge(i, j), 1.0, 0.0) for i in range(9) for j in range(9)], POINTS)
    got = effects(terrain.wind_effect(rows, []))
    assert np.mean([abs(got[4, j] - w) for j, w in enumerate(MIDDLE)]) <= 0.005
    assert all(got[i, j] == pytest.approx(got[8 - i, j]) for i in range(9) for j in range(9))


def test_tiles_agree(spark):
    rng = np.random.default_rng(4)
    rows = [(i * STEP, j * STEP, float(rng.uniform(0, 2000)), float(rng.normal()), float(rng.normal())) for i in range(13) for j in range(11)]
    rows[20] = (*rows[20][:2], None, *rows[20][3:])
    rows[33] = (*rows[33][:3], 0.0, 0.0)
    df = spark.createDataFrame(rows, POINTS)
    whole, tiled = (effects(terrain.wind_effect(df, [], reach_km=20.0, side=s)) for s in (512, 4))
    assert len(tiled) == len(rows) and whole == pytest.approx({k: v for k, v in tiled.items()}, nan_ok=True)
    assert [k for k, v in whole.items() if v is None] and len([v for v in whole.values() if v is None]) == 2


def test_coarse_amounts_stay(spark):
    rng = np.random.default_rng(5)
    rows = [(k % 3, float(k), 0.0, float(rng.uniform(0.5, 2)), float(rng.uniform(0, 3000)), 10.0 * (k % 3)) for k in range(30)]
    df = spark.createDataFrame(rows, "parent int, lat double, lon double, effect double, z double, coarse double")
    df = df.selectExpr("*", "1.0D AS exposure", "800.0D AS pbl", "50.0D AS ground")
    out = {r["lat"]: r["value"] for r in terrain.orographic(terrain.lifted(df, []), []).collect()}
    for p in range(3):
        assert np.mean([out[float(k)] for k in range(30) if k % 3 == p]) == pytest.approx(10.0 * p)
    with pytest.raises(Exception, match="negative"):
        terrain.orographic(df.selectExpr("* EXCEPT (coarse)", "-1.0D AS coarse"), []).collect()


def test_gamma_positions(spark):
    values = [0.0, 0.0, 3.0, 5.0, 11.0, None]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 0.0), ("b", 2.0)], "cell string, value double")
    got = {(r["cell"], r["value"]): r["position"] for r in climate.percentile_position(df, ["cell"], "gamma").collect()}
    wet = np.array([3.0, 5.0, 11.0])
    k, s = wet.mean() ** 2 / wet.var(ddof=1), wet.var(ddof=1) / wet.mean()
    want = {("a", x): 0.4 + 0.6 * float(gamma_p(k, x / s)) for x in wet} | {("a", 0.0): 0.2, ("b", 0.0): None, ("b", 2.0): None}
    assert got == pytest.approx(want)


def test_composites_need_every_box(spark):
    df = spark.createDataFrame([(1, "wtio", 2.0), (1, "setio", 0.5), (2, "wtio", 2.0), (2, "setio", None)], "year int, box string, index double")
    assert dict(climate.composite(df, ["year"], "dmi").collect()) == {1: 1.5, 2: None}


def test_smoothed_terciles(spark):
    """Smoothing equal coefficients changes nothing, and shares add up to 1."""
    rng = np.random.default_rng(6)
    signal = rng.normal(size=12)
    m = [(0, s, y, k, float(signal[y] + e)) for s in range(4) for y in range(12) for k, e in enumerate((-0.5, 0.1, 0.4))]
    o = [(0, s, y, float(0.7 * signal[y] + 0.1 * math.sin(y))) for s in range(4) for y in range(12)]
    members = spark.createDataFrame(m, "cell int, season int, year int, member int, value double")
    obs = spark.createDataFrame(o, "cell int, season int, year int, value double")
    plain, smooth = (methods.smoothed_terciles(members, obs, members.where("year = 3").drop("year"), 4, s).orderBy("season").collect() for s in (None, 0.5))
    assert [r[2:] for r in plain] == [pytest.approx(r[2:]) for r in smooth]
    assert all(sum(r[2:]) == pytest.approx(1) for r in plain)
