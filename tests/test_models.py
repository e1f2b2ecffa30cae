"""Canonical correlation, logistic forecasts, completion, the store and the registry."""

import datetime as dt
import math

import numpy as np
import pytest

from seasonspark import registry
from seasonspark.operators import cca, completion, ensembles, logit
from seasonspark.sources import issuance


def test_cca_finds_a_shared_signal(spark):
    rng = np.random.default_rng(3)
    n = 25
    s = rng.normal(size=n)
    x = np.outer(s, np.sin(np.arange(12))) + 0.1 * rng.normal(size=(n, 12))
    y = np.outer(s, np.cos(np.arange(9))) * 4 + 0.2 * rng.normal(size=(n, 9)) + 50
    f = cca.fit(x, y, np.ones(12), np.ones(9), 4, 4, 1)
    assert f.correlations[0] > 0.97
    got = np.array([f.predict(v) for v in x])
    assert np.corrcoef(got.ravel(), y.ravel())[0, 1] > 0.98
    assert 1 / n <= f.leverage(x[0]) <= 100 and f.leverage(x[0] * 1e9) == 100
    assert cca.north_modes(x, np.ones(12)) == 1
    with pytest.raises(ValueError):
        cca.fit(np.ones((6, 3)), y[:6, :3], np.ones(3), np.ones(3))

    def table(a, width):
        return [("m", 2000 + i, float(j // width), float(j % width), float(a[i, j])) for i in range(n) for j in range(a.shape[1])]

    schema = "model string, year int, lat double, lon double, value double"
    rows = cca.cross_validated(spark.createDataFrame(table(x, 4), schema), spark.createDataFrame(table(y, 3), schema)).collect()
    assert len(rows) == n * 9
    want = np.array([y[r["year"] - 2000, int(r["lat"] * 3 + r["lon"])] for r in rows])
    assert np.corrcoef(want, [r["prediction"] for r in rows])[0, 1] > 0.95
    assert cca.cross_validated(spark.createDataFrame(table(x, 4), schema).where("year < 2003"), spark.createDataFrame(table(y, 3), schema)).count() == 0


def test_latitude_weights():
    assert cca.latitude_weights(np.array([5.0])).tolist() == [1.0]
    lats = np.array([-20.0, 0.0, 20.0])
    assert cca.latitude_weights(lats) == pytest.approx(np.sqrt(np.cos(np.deg2rad(lats)) * math.sin(math.radians(10)) / math.radians(10)))


def test_binomial_is_at_the_optimum():
    rng = np.random.default_rng(4)
    x = rng.normal(size=80)
    y = (rng.random(80) < 1 / (1 + np.exp(-(0.3 + 1.1 * x)))).astype(float)
    p, wald = logit.binomial(x, y, 0.5)
    q, _ = logit.binomial(x, y, -0.5)
    slope = math.log(p / (1 - p)) - math.log(q / (1 - q))
    start = math.log(p / (1 - p)) - 0.5 * slope
    fit = 1 / (1 + np.exp(-(start + slope * x)))
    assert abs((fit - y).sum()) < 1e-6 and abs(((fit - y) * x).sum()) < 1e-6 and wald < 0.01
    assert logit.binomial(x, np.zeros(80), 0.0)[0] == 0.0
    assert math.isnan(logit.binomial(x[:5], y[:5], 0.0)[0])
    assert logit.binomial(np.arange(12.0), (np.arange(12) > 5).astype(float), 11.0)[0] > 0.99
    two = logit.multinomial(x, y.astype(int), 0.5)
    assert two[1] == pytest.approx(p, abs=1e-5) and two[2] == 0


def test_logit_forecast(spark):
    rows = [("falls", float(x), float(-3 * x + 0.3 * math.sin(7 * i))) for i, x in enumerate(np.linspace(-2, 2, 30))] + [("gaps", float(i), None) for i in range(12)]
    df = spark.createDataFrame(rows, "cell string, x double, value double")
    for model in ("binomial", "multinomial"):
        got = {r["cell"]: r for r in logit.forecast(df, 1.9, model).collect()}
        assert got["falls"]["p_below"] > 0.7 and sum(got["falls"][1:]) == pytest.approx(1)
        assert got["gaps"]["p_below"] is None or math.isnan(got["gaps"]["p_below"])
    with pytest.raises(ValueError):
        logit.forecast(df, 0.0, significance=0.1, penalty=1.0)


def test_completion(spark):
    analog = spark.createDataFrame([(1, y, s, float(y - 1990)) for y in (1991, 1992, 1995) for s in range(4)], "cell int, year int, step int, value double")
    seen = spark.createDataFrame([(1, 0, 100.0), (1, 1, 100.0)], "cell int, step int, value double")
    ahead = spark.createDataFrame([(1, 1, 7.0), (1, 2, 7.0)], "cell int, step int, value double")
    rows = completion.scenarios(seen, analog, ahead)
    t = completion.totals(rows, 4)
    assert {r["scenario"]: r["total"] for r in t.collect()} == {1991: 208.0, 1992: 209.0, 1995: 212.0}
    assert completion.consensus(t).first()["consensus"] == 209.0
    even = spark.createDataFrame([(y, 1.0) for y in (1991, 1992, 1995)], "scenario int, weight double")
    assert completion.consensus(t, "median", even).first()["consensus"] == 209.0
    heavy = spark.createDataFrame([(1991, 1.0), (1992, 1.0), (1995, 8.0)], "scenario int, weight double")
    assert completion.consensus(t, "median", heavy).first()["consensus"] == pytest.approx(209 + 3 * (0.5 - 0.15) / 0.45)
    assert completion.consensus(t, "mean", heavy).first()["consensus"] == pytest.approx((208 + 209 + 8 * 212) / 10)
    assert completion.consensus(t, 0.01, heavy).first()["consensus"] == 208.0
    assert completion.totals(completion.scenarios(seen, analog, ahead, "forecast"), 4).where("scenario = 1991").first()["total"] == 115.0
    assert completion.totals(rows, 5).first()["total"] is None
    with pytest.raises(ValueError):
        completion.scenarios(seen, analog, ahead, "error")


def test_store(spark, tmp_path):
    root, path = str(tmp_path / "store"), str(tmp_path / "scores")
    day = dt.date(2024, 3, 1)
    rows = [("ke", day, m, dt.date(2024, 3, 11), c, float(c + k)) for k, m in enumerate(("raw", "bcsd")) for c in range(4)]
    f = spark.createDataFrame(rows, "country string, issuance date, method string, target_dekad date, cell int, mean double")
    issuance.write(f, root)
    issuance.write(f.where("method = 'raw'"), root)
    store = issuance.read(spark, root)
    assert store.count() == 8
    obs = spark.createDataFrame([("ke", dt.date(2024, 3, 11), c, float(c)) for c in range(4)], "country string, target_dekad date, cell int, obs double")
    clim = obs.select("country", "target_dekad", "cell", (obs["obs"] * 0).alias("clim"))
    done = issuance.scored(spark, path)
    assert issuance.pending(store, done).count() == 2
    s = issuance.score_pending(store, obs, clim, done)
    assert {r["method"]: (round(r["rmse"], 6), round(r["bias"], 6)) for r in s.collect()} == {"raw": (0.0, 0.0), "bcsd": (1.0, 1.0)}
    issuance.append(s, path)
    assert issuance.pending(store, issuance.scored(spark, path)).count() == 0


def test_registry():
    assert registry.lookup("metric", "hss") is registry.lookup("metric", "heidke")
    with pytest.raises(KeyError, match="qm"):
        registry.lookup("method", "no such")
    registry.register("method", "mine")(len)
    assert registry.lookup("method", "mine") is len
    del registry.KINDS["method"]["mine"]


def test_bma_raises_beyond_its_bound(spark, monkeypatch):
    monkeypatch.setattr(ensembles, "MOST_MODELS", 2)
    rows = [(m, y, float(y + i)) for i, m in enumerate("abc") for y in range(4)]
    forecasts = spark.createDataFrame(rows, "model string, year int, value double")
    obs = spark.createDataFrame([(y, float(y)) for y in range(4)], "year int, obs double")
    with pytest.raises(ValueError, match="more than 2 models"):
        ensembles.bma(forecasts, obs, ["year"])
