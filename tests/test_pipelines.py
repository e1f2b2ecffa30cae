"""Variance-ratio calibration, mixture weights, modes, folds and leads against loops over plain numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasonspark.functions import calendar as cal
from seasonspark.functions import special
from seasonspark import tools
from seasonspark.operators import alignment, analogs, calibrate, cca, cccma, diagrams, indices, leads, metrics, seasonal_mme, validation
from seasonspark.sources import products, verification


def test_inverse_gamma_undoes_the_distribution():
    rng = np.random.default_rng(3)
    shape = np.concatenate([10.0 ** rng.uniform(-1.5, 4, 4_000), [0.5, 1, 1, 2]])
    p = np.concatenate([rng.uniform(1e-6, 1 - 1e-6, 4_000), [0.5, 0.5, 1e-6, 1 - 1e-6]])
    x = special.gamma_q(shape, p)
    ok = x > 1e-290
    assert np.abs(special.gamma_p(shape, x) - p)[ok].max() < 1e-10 and ok.mean() > 0.99
    assert special.gamma_q([1.0], [0.5])[0] == pytest.approx(math.log(2), rel=1e-14)
    assert list(special.gamma_q([2, 2, -1], [0, 1, 0.5]))[:2] == [0, math.inf]


def test_running_sums_over_strips(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i % 3), float(x), int(rng.integers(1, 9))) for i, x in enumerate(rng.permutation(500))]
    got = {(r.k, r.p): r.under for r in metrics.running(spark.createDataFrame(rows, "k int, p double, v long"), "p", "v", ["k"]).collect()}
    assert all(got[k, p] == sum(c for a, b, c in rows if a == k and b < p) for k, p, _ in rows)
    ps = rng.uniform(0, 1, 300).round(2)
    q = {r.i: r.q for r in metrics.fdr_bh(spark.createDataFrame([(i, float(p)) for i, p in enumerate(ps)], "i int, p double")).collect()}
    for i, p in enumerate(ps):
        want = min(1.0, min(v * len(ps) / ((ps < v).sum() + 1) for v in ps if v >= p))
        assert q[i] == pytest.approx(want)


def cccma_by_hand(x, y, width):
    """x: season, year, model, member; y: season, year; one cell."""
    seasons, years, models, members = x.shape
    avg = x.mean((1, 3), keepdims=True)
    anomaly = (x - avg).mean(3).mean(2)
    n = models * members
    whole, rest = ((x - avg) ** 2).sum((1, 2, 3)), ((x - avg - anomaly[:, :, None, None]) ** 2).sum((1, 2, 3))
    noise = rest / (years * (n - 1) - models + 1)
    signal = (whole - rest) / ((years - 1) * n) - noise / n
    ya = y - y.mean(1, keepdims=True)
    var = (ya**2).sum(1) / (years - 1)
    w = [math.exp(-min(k, seasons - k) ** 2 / (2 * width**2)) for k in range(seasons)]
    w = np.array(w) / sum(w)

    def smooth(v):
        return np.array([sum(w[k] * v[(s + k) % seasons] for k in range(seasons)) for s in range(seasons)])

    return anomaly, ya, noise, signal, smooth(noise), smooth(signal), np.sqrt(var), np.sqrt(smooth(var))


def test_cccma_moments_and_coefficients(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(12, 8, 2, 3)) + rng.normal(size=(12, 8, 1, 1))
    y = x.mean((2, 3)) * 0.7 + rng.normal(size=(12, 8))
    hind = spark.createDataFrame([(1, s, t, m, e, float(x[s, t, m, e])) for s, t, m, e in np.ndindex(x.shape)], "cell int, season int, year int, model int, member int, value double")
    obs = spark.createDataFrame([(1, s, t, float(y[s, t])) for s, t in np.ndindex(y.shape)], "cell int, season int, year int, value double")
    # members are told apart by model and number
    anomaly, ya, noise, signal, noise_s, signal_s, sd, sdf = cccma_by_hand(x, y, 1)
    got = {r.season: r for r in cccma.fit(hind, obs).collect()}
    for s in range(12):
        g = got[s]
        assert [g.noise, g.signal, g.noise_s, g.signal_s, g.ysd, g.ysdf] == pytest.approx([noise[s], signal[s], noise_s[s], signal_s[s], sd[s], sdf[s]])
    total, total_s = noise + signal, noise_s + signal_s

    def score(f, seasons, t, v):
        out = []
        for s in seasons:
            spread = max(t[s] - v[s] * f * f, 0)
            spread = math.sqrt(spread / t[s]) or cccma.SMALL
            for k in range(8):
                z = (ya[s, k] / sdf[s] - f * anomaly[s, k] / math.sqrt(t[s])) / spread
                phi = 0.5 * (1 + math.erf(z / math.sqrt(2)))
                out.append(spread * (z * (2 * phi - 1) + 2 * math.exp(-z * z / 2) / math.sqrt(2 * math.pi) - 1 / math.sqrt(math.pi)))
        return sum(out) / len(out)

    most = min(min(2, max(1, math.sqrt(total_s[s] / signal_s[s]) - 1e-6)) if signal_s[s] > 0 else 1 for s in range(12))
    grid = np.linspace(-most, most, 801)
    constant = got[0].constant
    assert score(constant, range(12), total_s, signal_s) <= min(score(f, range(12), total_s, signal_s) for f in grid) + 1e-5
    for s in (0, 5):
        if signal[s] > 0:
            top = min(2, max(1, math.sqrt(total[s] / signal[s]) - 1e-6))
            near = [score(f, [s], total, signal) for f in np.linspace(-top, top, 401)]
            assert score(got[s].independent, [s], total, signal) <= min(near) + 1e-3
        else:
            assert got[s].independent == 0
    shares = cccma.hindcast_terciles(cccma.fit(hind, obs), cccma.moments(hind, obs, 12)[1], 8).collect()
    assert len(shares) == 96 and all(abs(r.p_below + r.p_normal + r.p_above - 1) < 1e-12 for r in shares)


def test_golden_section_and_filters():
    target = np.array([0.3, -0.7, 1.2])
    got = cccma.golden(lambda f: (f - target) ** 2, np.full(3, -2.0), np.full(3, 0.5), np.full(3, 2.0), 1e-6)
    assert got == pytest.approx(target, abs=1e-5)
    assert [cccma.c4(n) for n in (2, 5, 10)] == [0.7978846, 0.9399856, 0.9726593]
    assert cccma.weights(-1, 4) == [0.25] * 4 and cccma.weights(0, 3) == [1, 0, 0] and sum(cccma.weights(2, 12)) == pytest.approx(1)
    with pytest.raises(ValueError):
        cccma.weights([1, 2], 12)
    with pytest.raises(ValueError):
        cccma.coefficient("best")


def test_modes_and_folds():
    rng = np.random.default_rng(6)
    n = 16
    u, _ = np.linalg.qr(rng.normal(size=(n, n)) - 0)
    u, _ = np.linalg.qr(u - u.mean(0))
    lam = np.array([10, 5, 4.9, *[1.0] * 8])
    field = (u[:, : len(lam)] - u[:, : len(lam)].mean(0)) * np.sqrt(lam) @ np.linalg.qr(rng.normal(size=(40, len(lam))))[0].T
    assert cca.north_modes(field, np.ones(40)) in (2, 3)  # the second is not told from the third, and counts
    field[3, 0] = np.nan
    assert cca.north_modes(field, np.ones(40)) >= 1
    assert cca.capped_modes([(1, 10), (2, 3)], 10, 3) == [(1, 5), (2, 3)]
    years = list(range(2000, 2007))
    assert validation.loyo(years, 2) == validation.loyo(years, 1) and validation.loyo(years, 3)[0] == ([2000], [2002, 2003, 2004, 2005, 2006])
    assert validation.loyo_cyclic(years, 3)[0] == ([2000], [2002, 2003, 2004, 2005])
    for bad in (lambda: validation.loyo(years, 0), lambda: validation.lko(years, 8), lambda: validation.lko(years, 0), lambda: validation.blocked(years, 2, -1)):
        with pytest.raises(ValueError):
            bad()


def test_leads(spark):
    assert leads.rate_factor("mm/day") == (1.0, "mm") and leads.rate_factor("kg m-2 s-1") == (86400.0, "kg m-2") and leads.rate_factor("mm") == (None, "mm")
    hours = [3 * k for k in range(1, 17)] + [54, 60, 66, 72, 78]
    fc = spark.createDataFrame([(1, 7, h, float(h)) for h in hours], "cell int, init int, lead int, value double")
    assert leads.forecast_window(fc, (3, 3), ["cell"]).first().value == pytest.approx((54 + 60 + 66 + 72) / 4)
    mean = leads.reduced(fc.drop("init"), {"w": (2, 3)}, ["cell"]).first().value
    assert mean == pytest.approx((sum(3 * h for h in hours if 24 < h <= 48) + 6 * (54 + 60 + 66 + 72)) / 48)
    got = leads.increments(fc, "2020-01-30", ["cell"], units="mm/day").orderBy("d").collect()
    assert [str(r.d) for r in got] == ["2020-01-30", "2020-01-31", "2020-02-01"]  # the fourth day has one step
    assert got[2].value == pytest.approx((54 + 60 + 66 + 72) / 4)
    for bad in (lambda: leads.reduced(fc.drop("init"), {"w": (3, 9)}, ["cell"]), lambda: leads.reduced(fc.drop("init"), {"w": (1, 2)}, ["cell"], "sum"), lambda: leads.one_issuance(fc.union(fc.withColumn("init", F.lit(8)))), lambda: leads.forecast_window(fc, "week9", ["cell"])):
        with pytest.raises(ValueError):
            bad()


def test_alignment_refuses(spark):
    h = spark.createDataFrame([("a", y, 1, 1.0) for y in range(6)] + [("b", y, 1, 1.0) for y in range(2, 8)], "model string, year int, cell int, value double")
    o = h.where("model = 'a'").drop("model")
    with pytest.raises(ValueError, match="'b'"):
        alignment.native_years(h, o)
    assert sorted(r.year for r in alignment.native_years(h, o, 4).where("model = 'b'").collect()) == [2, 3, 4, 5]
    with pytest.raises(ValueError, match=r"\[0, 1\]"):
        alignment.covered_years(h.where("model = 'b'"), o)
    with pytest.raises(ValueError):
        alignment.same_models(h, h.where("model = 'a'"))
    assert alignment.forecast_year([], o) == 5 and alignment.forecast_year([o.where("year = 3")], o) == 3
    with pytest.raises(ValueError):
        alignment.forecast_year([o], o)
    with pytest.raises(ValueError):
        alignment.one_year(o, 44)
    assert alignment.canonical(spark.createDataFrame([(1, 2)], "Y int, longitude int")).columns == ["lat", "lon"]
    with pytest.raises(ValueError, match="lon"):
        alignment.canonical(spark.createDataFrame([(1,)], "latitude int"))
    s = alignment.on_seasons(spark.createDataFrame([(1, "DJF", 1.0)], "cell int, season string, value double"), spark.createDataFrame([("DJF",), ("MAM",)], "season string"), ["cell"])
    assert {(r.season, r.value) for r in s.collect()} == {("DJF", 1.0), ("MAM", None)}
    with pytest.raises(ValueError):
        analogs.exactly_one(target=None, target_year=None)
    with pytest.raises(ValueError):
        analogs.where(o, F.col("value") > 5)
    with pytest.raises(KeyError):
        diagrams.safeguards({"other": 1})


def test_seasonal_forecast_of_several_models(spark):
    rng = np.random.default_rng(7)
    rows, obs, now = [], [], []
    for cell in range(6):
        signal = rng.normal(size=13)
        obs += [(cell, 2000 + t, float(signal[t])) for t in range(12)]
        for m, noise in (("good", 0.2), ("poor", 3.0)):
            rows += [("t", m, cell, 2000 + t, float(signal[t] + noise * rng.normal())) for t in range(12) if m == "good" or t > 1]
            now.append(("t", m, cell, 2012, float(signal[12] + noise * rng.normal())))
    kind = "track string, model string, cell int, year int, value double"
    got = seasonal_mme.seasonal_mme(spark.createDataFrame(rows, kind), spark.createDataFrame(now, kind), spark.createDataFrame(obs, "cell int, year int, value double"), threshold=0.9)
    assert got.years.count() == 20 and got.ensemble.count() == 60
    assert {r.model for r in got.hindcasts.select("model").distinct().collect()} == {"t__good", "t__poor"}
    scores = {r.metric: r.score for r in got.skill.collect()}
    assert scores["pearson"] > 0.8 and {"rpss", "heidke", "msss"} <= set(scores)
    assert all(abs(r.p_below + r.p_normal + r.p_above - 1) < 1e-9 for r in [*got.terciles.collect(), *got.terciles_cv.collect()])
    # By hand: the regression of one cell and model without one year.
    held = [(r[4], o) for r in rows if r[1:3] == ("good", 3) and 2001 < r[3] != 2007 for c, y, o in obs if (c, y) == (3, r[3])]
    b, a = np.polyfit(*zip(*held, strict=True), 1)
    x = next(r[4] for r in rows if r[1:4] == ("good", 3, 2007))
    assert got.hindcasts.where("model = 't__good' AND cell = 3 AND year = 2007").first().prediction == pytest.approx(a + b * x)
    with pytest.raises(ValueError):
        seasonal_mme.tercile_method("regression", "cpt")
    one = calibrate.calibrate_cv(spark.createDataFrame(rows, kind).withColumn("member", F.lit(0)).drop("track"), spark.createDataFrame(obs, "cell int, year int, value double"))
    assert one.count() == 72 and all(abs(r.p_below + r.p_normal + r.p_above - 1) < 1e-9 for r in one.collect())


def test_products(spark, tmp_path):
    shares = spark.createDataFrame([(0.0, 0.0, 0.2, 0.2, 0.4), (0.0, 1.0, 0.0, 0.0, 0.0), (1.0, 0.0, None, 0.5, 0.5)], "lat double, lon double, p_below double, p_normal double, p_above double")
    path = str(tmp_path / "p")
    products.write_terciles(shares, path, "title", "ereg")
    back = {(r.lat, r.lon, r.tercile): r.value for r in products.read_terciles(spark, path).collect()}
    assert back[0.0, 0.0, 2] == 50.0 and back[0.0, 1.0, 0] is None and len(back) == 9
    long = products.read_terciles(spark, path)
    assert products.tercile_mae(long, long.withColumn("value", F.col("value") + 1)).first().mae == pytest.approx(1)
    assert products.output_path("d/", "A b", "x", params={"k": 1}) == products.output_path("d", "A b", "x", params={"k": 1}) != products.output_path("d", "A b", "x", params={"k": 2})
    out = products.write_result(shares, "shares", str(tmp_path), params={"m": "ereg"})
    assert out["summary"][0]["n"] == 3 and products.opened(spark, out["path"]).count() == 3
    with pytest.raises(FileNotFoundError):
        products.opened(spark, str(tmp_path / "none"))
    with pytest.raises(RuntimeError):
        products.save_state(None, path)
    report = products.skill_json(spark.createDataFrame([("rmse", 1.5), ("rpss", float("nan"))], "metric string, score double")).first().report
    assert report in ('{"rmse":1.5}', '{"rmse":1.5,"rpss":null}')
    assert products.region_tiles(-0.5, 1.2, 36.0, 37.0) == [(-1, 36), (0, 36), (1, 36)]
    with pytest.raises(ValueError):
        products.config('{"methods": ["x"]}', {"methods": list}, {"methods": {"ereg"}})
    with pytest.raises(KeyError):
        products.write_skill_map(spark.createDataFrame([], "metric string, lat double, lon double, value double"), "r", path)


def test_time_axis(spark):
    assert cal.season_bounds("NDJ", 1999)[1].isoformat() == "2000-01-31" and cal.season_bounds((2, 2), 2000)[1].day == 29
    with pytest.raises(ValueError):
        cal.season_times("JJA", 2000, "weekly")
    one = spark.range(1).select(cal.issuance_days(F.lit("2024-01-01").cast("date"), F.lit("2024-01-09").cast("date")).alias("d")).first().d
    assert [x.day for x in one] == [1, 4, 8]


def test_canonical_correlation_by_products_of_years(spark):
    """Against fits on whole matrices, one for each fold and number of modes."""
    rng = np.random.default_rng(8)
    z = rng.normal(size=(12, 1))
    x, y = z @ rng.normal(size=(1, 15)) + 0.5 * rng.normal(size=(12, 15)), z @ rng.normal(size=(1, 8)) + 0.5 * rng.normal(size=(12, 8))
    x[4, 2] = y[7, 3] = np.nan
    cells = [[(float(i // w), float(i % w)) for i in range(n)] for n, w in ((15, 3), (8, 2))]
    kind = "model int, year int, lat double, lon double, value double"
    px, py = (spark.createDataFrame([(1, 2000 + t, *c, None if np.isnan(f[t, i]) else float(f[t, i])) for t in range(12) for i, c in enumerate(cs)], kind) for f, cs in ((x, cells[0]), (y, cells[1])))
    got = {(r.year - 2000, r.lat, r.lon): (r.prediction, r.leverage) for r in cca.cross_validated(px, py, 3, 3, 1, 1).collect()}
    wx, wy = (cca.latitude_weights(np.unique([c[0] for c in cs]))[[int(c[0]) for c in cs]] for cs in cells)
    for t in range(12):
        train = [j for j in range(12) if abs(j - t) > 1]
        f = cca.fit(x[train], y[train], wx, wy, 3, 3, 1)
        want = f.predict(x[t])
        assert [got[t, *c][0] for c in cells[1]] == pytest.approx(list(want), rel=1e-6, abs=1e-8)
        assert got[t, *cells[1][0]][1] == pytest.approx(f.leverage(x[t]), rel=1e-6)
    best = cca.best_modes(px, py, (1, 2), (1, 2), (1, 2)).collect()
    assert len(best) == 5 and sum(r.best for r in best) == 1
    for r in best:
        p = np.array([cca.fit(x[tr := [j for j in range(12) if j != t]], y[tr], wx, wy, r.x, r.y, r.modes).predict(x[t]) for t in range(12)]).T
        assert r.goodness == pytest.approx(np.nanmean(cca.tau_b(p, y.T)), abs=1e-9)
    assert cca.tau_b(np.array([[1, 2, 3, 4.0]]), np.array([[1, 2, 3, 3.0]]))[0] == pytest.approx(5 / math.sqrt(6 * 5))


def test_indices_and_geometry(spark):
    assert len(indices.listing()) == 16 and indices.named("IOD").boxes == ("wtio", "setio") and indices.box_of({"south": 1, "north": 2, "west": 3, "east": 4}) == (1, 2, 3, 4)
    for bad in (lambda: indices.named("no such"), lambda: indices.box_of("nowhere")):
        with pytest.raises(KeyError):
            bad()
    rng = np.random.default_rng(9)
    rows = [(y, float(lat), float(lon), float(rng.normal())) for y in range(5) for lat in range(-40, 41, 5) for lon in range(0, 360, 10)]
    field = spark.createDataFrame(rows, "year int, lat double, lon double, value double")
    for name in indices.NAMED:
        got = {r.year: r.value for r in indices.reduce(field, indices.named(name)).collect()}
        index, parts = indices.NAMED[name], {}
        for box in index.boxes:
            s, n, w, e = indices.BOXES[box]
            v = []
            for y in range(5):
                own = [(x, math.cos(math.radians(lat)) if index.weighted else 1) for t, lat, lon, x in rows if t == y and s <= lat <= n and (w <= lon <= e or (w, e) == (0, 360))]
                v.append(sum(x * c for x, c in own) / sum(c for _, c in own))
            v = np.array(v)
            parts[box] = v if index.how == "raw" else v - v.mean() if index.how == "anomaly" else (v - v.mean()) / v.std()
        assert [got[y] for y in range(5)] == pytest.approx(list(index.combine(parts))), name


def test_tools_and_verification(spark, tmp_path):
    rng = np.random.default_rng(10)
    h = [(m, c, y, e, float(rng.normal())) for m in ("a", "b") for c in range(3) for y in range(2000, 2009) for e in range(3)]
    paths = {n: str(tmp_path / n) for n in ("h", "o", "f", "out")}
    hind = spark.createDataFrame(h, "model string, cell int, year int, member int, value double")
    hind.where("year < 2008").write.parquet(paths["h"])
    hind.where("year = 2008").drop("year").write.parquet(paths["f"])
    hind.where("model = 'a' AND member = 0 AND year < 2008").select("cell", "year", "value").write.parquet(paths["o"])
    made = tools.calibrate(spark, paths["o"], paths["h"], paths["out"], paths["f"])
    assert made == tools.calibrate(spark, paths["o"], paths["h"], paths["out"], paths["f"]) and spark.read.parquet(made["path"]).count() == 3
    assert spark.read.parquet(tools.calibrate(spark, paths["o"], paths["h"], paths["out"], cv=True)["path"]).count() == 24
    assert tools.optimize(spark, paths["h"], paths["o"], paths["out"])["best"] == "regression"
    assert "cell" in {r["name"] for r in tools.describe_dataset(spark, paths["o"]).collect()} and "ereg" in tools.list_registry()["calibrator"]
    flat = str(tmp_path / "flat")
    hind.groupBy("model", "cell", "year").agg(F.avg("value").alias("value")).write.parquet(flat)
    for strategy in ("uniform", "drop_worst", "skill_weighted"):
        assert spark.read.parquet(tools.ensemble(spark, flat, paths["out"], strategy, paths["o"])["path"]).count() >= 24
    members = str(tmp_path / "members")
    hind.where("model = 'a'").drop("model").write.parquet(members)
    assert spark.read.parquet(tools.to_tercile(spark, members, paths["o"], paths["out"])["path"]).count() == 27
    one = spark.createDataFrame([("x", 1)], "cell string, year int")
    with pytest.raises(RuntimeError):
        verification.common_or_raw(one, one.withColumn("year", F.lit(2)))
    assert verification.common_or_raw(None, one) is None
