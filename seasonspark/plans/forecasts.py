"""Registered queries on probabilities, regridding, downscaling, folds and ensembles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonspark.functions.special import normal_cdf_sql, normal_ppf_sql, t_cdf_sql
from seasonspark.operators import climate, ensembles, methods, metrics, rank_analog as ranks, regrid, terciles, terrain, validation
from seasonspark.plans.catalog import BOUNDED, LOO, PAIRS, bounded, pairs, query, r, rnd
from seasonspark.sources import cubes
from seasonspark.sources.cubes import GRID, HIND, OBS, SEASONS

T7 = "t7 AS (SELECT cell, quantile_cont(value, 1.0::DOUBLE / 3) AS lo, quantile_cont(value, 2.0::DOUBLE / 3) AS hi FROM obs GROUP BY 1)"


def split_sql(keys: str, source: str) -> str:
    """Shares from the columns zl and zh."""
    lo, hi = normal_cdf_sql("zl"), normal_cdf_sql("zh")
    return f"SELECT {keys}, {rnd(lo)} AS p_below, {rnd(f'{hi} - {lo}')} AS p_normal, {rnd(f'1 - {hi}')} AS p_above FROM {source}"


def cv(spark: SparkSession, d: str) -> DataFrame:
    return methods.leave_one_out(pairs(spark, d).withColumnsRenamed({"fc": "x", "obs": "y"}))


def training(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hindcast and observations before 2000, and the members of 2000."""
    h, o = cubes.hindcast(spark, d), cubes.observations(spark, d)
    return h.where("year < 2000"), o.where("year < 2000"), h.where("year = 2000")


@query(f"""WITH {OBS}, {HIND}, {T7}, m AS (SELECT cell, year, avg(value) AS m, greatest(stddev_pop(value), 1e-12) AS s FROM hind GROUP BY 1, 2),
z AS (SELECT cell, year, (lo - m) / s AS zl, (hi - m) / s AS zh FROM m JOIN t7 USING (cell)) {split_sql('cell, year', 'z')}""")
def tercile_gaussian(spark, d):
    bounds = terciles.type7_boundaries(cubes.observations(spark, d), ["cell"])
    return r(terciles.gaussian_probabilities(cubes.hindcast(spark, d), bounds, ["cell", "year"], ["cell"]))


ELSE = f"{LOO}, ot AS (SELECT a.cell, a.year, a.prediction, b.y AS oy, b.prediction - b.y AS e FROM loo a JOIN loo b ON a.cell = b.cell AND a.year <> b.year)"


@query(f"""WITH {ELSE}, k AS (SELECT cell, year, quantile_cont(oy, 1.0::DOUBLE / 3) AS lo, quantile_cont(oy, 2.0::DOUBLE / 3) AS hi FROM ot GROUP BY 1, 2),
c AS (SELECT cell, year, count(CASE WHEN prediction - e < lo THEN 1 END)::DOUBLE / count(*) AS b, count(CASE WHEN prediction - e > hi THEN 1 END)::DOUBLE / count(*) AS a FROM ot JOIN k USING (cell, year) GROUP BY 1, 2)
SELECT cell, year, {rnd('b')} AS p_below, {rnd('1 - b - a')} AS p_normal, {rnd('a')} AS p_above FROM c""")
def tercile_cv_bootstrap(spark, d):
    return r(terciles.cv_bootstrap(cv(spark, d)))


@query(f"""WITH {ELSE}, k AS (SELECT cell, year, max(prediction) AS f, quantile_cont(oy, 1.0::DOUBLE / 3) AS lo, quantile_cont(oy, 2.0::DOUBLE / 3) AS hi, sqrt(avg(e * e)) AS s FROM ot GROUP BY 1, 2),
z AS (SELECT cell, year, (lo - f) / s AS zl, (hi - f) / s AS zh FROM k) {split_sql('cell, year', 'z')}""")
def tercile_cv_gaussian(spark, d):
    return r(terciles.cv_gaussian(cv(spark, d)))


@query(f"""WITH {LOO}, k AS (SELECT cell, quantile_cont(y, 1.0::DOUBLE / 3) AS lo, quantile_cont(y, 2.0::DOUBLE / 3) AS hi, sqrt((count(*) - 2) / count(*)::DOUBLE * avg((prediction - y) ** 2)) AS s FROM loo GROUP BY 1),
z AS (SELECT cell, year, (lo - prediction) / s AS zl, (hi - prediction) / s AS zh FROM loo JOIN k USING (cell)) {split_sql('cell, year', 'z')}""")
def tercile_cv_pooled(spark, d):
    return r(terciles.cv_pooled(cv(spark, d)))


CPT_LOO = f"""{LOO}, ranked AS (SELECT cell, y AS value, row_number() OVER (PARTITION BY cell ORDER BY y) AS rn, count(*) OVER (PARTITION BY cell) AS n FROM loo),
pos AS (SELECT *, n / 3.0::DOUBLE + 0.5 AS x, 2 * n / 3.0::DOUBLE + 0.5 AS y FROM ranked),
bounds AS (SELECT cell, sum(CASE WHEN rn = floor(x) THEN value * (1 - (x - floor(x))) WHEN rn = floor(x) + 1 THEN value * (x - floor(x)) ELSE 0 END) AS lo,
  sum(CASE WHEN rn = floor(y) THEN value * (1 - (y - floor(y))) WHEN rn = floor(y) + 1 THEN value * (y - floor(y)) ELSE 0 END) AS hi FROM pos GROUP BY 1)"""


@query(f"""WITH {CPT_LOO}, k AS (SELECT cell, sum((prediction - y) ** 2) / 4 AS s2 FROM loo GROUP BY 1),
z AS (SELECT cell, year, (lo - prediction) / sqrt(s2) AS zl, (hi - prediction) / sqrt(s2) AS zh FROM loo JOIN k USING (cell) JOIN bounds USING (cell))
SELECT cell, year, {rnd(t_cdf_sql('zl', 4))} AS p_below, {rnd(t_cdf_sql('zh', 4) + ' - ' + t_cdf_sql('zl', 4))} AS p_normal, {rnd('1 - ' + t_cdf_sql('zh', 4))} AS p_above FROM z""")
def tercile_cv_student(spark, d):
    """Seven years and two modes."""
    return r(terciles.cv_student(cv(spark, d), 7, 2))


@query(f"""WITH {OBS}, k AS (SELECT cell, year, (rank() OVER (PARTITION BY cell ORDER BY value) + (count(*) OVER (PARTITION BY cell, value) - 1) / 2.0::DOUBLE + 0.5) / (count(*) OVER (PARTITION BY cell) + 1.0::DOUBLE) AS p FROM obs)
SELECT cell, year, {rnd(normal_ppf_sql('p'))} AS score FROM k""")
def normal_scores(spark, d):
    return r(terciles.normal_scores(cubes.observations(spark, d), ["cell"]).select("cell", "year", "score"))


@query(f"""WITH {LOO}, k AS (SELECT cell, avg((prediction - y) ** 2) AS pev, quantile_cont(y, 0.8) AS threshold FROM loo GROUP BY 1),
z AS (SELECT cell, year, (threshold - prediction) / sqrt(pev) AS z FROM loo JOIN k USING (cell)) SELECT cell, year, {rnd('1 - ' + normal_cdf_sql('z'))} AS p_exceed FROM z""")
def flex_exceedance(spark, d):
    rows = cv(spark, d)
    k = methods.prediction_error_variance(rows).join(rows.groupBy("cell").agg(F.percentile("y", F.lit(0.8)).alias("threshold")), "cell")
    return r(terciles.exceedance(rows.join(k, "cell").withColumnRenamed("prediction", "mu"), ["cell", "year"]))


@query(f"""WITH {BOUNDED} SELECT cell, year, CASE WHEN value < lo THEN 0 WHEN value > hi THEN 2 ELSE 1 END AS exclusive, CASE WHEN value <= lo THEN 0 WHEN value >= hi THEN 2 ELSE 1 END AS inclusive
FROM obs JOIN bounds USING (cell) WHERE lo <> hi""")
def tercile_labels(spark, d):
    o = cubes.observations(spark, d)
    j = o.join(terciles.cpt_boundaries(o, ["cell"]).where("lo IS NOT NULL"), "cell")
    v, lo, hi = F.col("value"), F.col("lo"), F.col("hi")
    return j.select("cell", "year", terciles.labels(v, lo, hi).alias("exclusive"), terciles.labels(v, lo, hi, True).alias("inclusive"))


@query(f"""WITH {BOUNDED}, k AS (SELECT cell, year, greatest(p_below, p_normal, p_above) * 100 AS m, p_below * 100 AS x, p_normal * 100 AS n, p_above * 100 AS a FROM b),
f AS (SELECT *, CASE WHEN x = m THEN 6 WHEN n = m THEN 3 ELSE 0 END AS o, CASE WHEN x = m THEN a WHEN n = m THEN greatest(x, a) ELSE x END AS rival FROM k)
SELECT cell, year, CASE WHEN m < 40 OR rival >= 35 THEN -1 ELSE o + (m >= 50)::INT + (m >= 60)::INT END AS code FROM f""")
def tercile_codes(spark, d):
    return terciles.class_codes(bounded(spark, d), [40, 50, 60], 35).select("cell", "year", "code")


@query(f"""WITH {BOUNDED} SELECT cell, year, {rnd('2 * p_below / (1 + p_below)')} AS p_below, {rnd('p_normal / (1 + p_below)')} AS p_normal, {rnd('p_above / (1 + p_below)')} AS p_above FROM b""")
def tercile_simplex(spark, d):
    """Of triples whose first is doubled."""
    t = bounded(spark, d).withColumn("p_below", 2 * F.col("p_below"))
    return r(terciles.simplex(t).select("cell", "year", "p_below", "p_normal", "p_above"))


ANOMALY = f"""{OBS}, {HIND}, e AS (SELECT cell, year, avg(value) AS m, stddev_pop(value) AS s FROM hind GROUP BY 1, 2),
an AS (SELECT cell, year, m - avg(m) OVER (PARTITION BY cell) AS mu, greatest(s, 1e-12) AS sigma, value - avg(value) OVER (PARTITION BY cell) AS obs FROM e JOIN obs USING (cell, year))"""


def crps_sql(sd: str, z: str) -> str:
    return f"{sd} * ({z} * (2 * {normal_cdf_sql(z)} - 1) + 2 * exp(-{z} * {z} / 2) / {math.sqrt(2 * math.pi)!r} - {1 / math.sqrt(math.pi)!r})"


@query(f"""WITH {ANOMALY}, z AS (SELECT sigma, (obs - mu) / sigma AS z, g, obs / g AS y FROM an, (SELECT stddev_pop(obs) AS g FROM an))
SELECT {rnd(f"1 - avg({crps_sql('sigma', 'z')}) / avg({crps_sql('g', 'y')})")} AS crpss FROM z""")
def crpss(spark, d):
    e = cubes.hindcast(spark, d).groupBy("cell", "year").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sigma"))
    j = e.join(cubes.observations(spark, d), ["cell", "year"])
    return r(metrics.crpss(j.select(metrics.anomaly("m").alias("mu"), "sigma", metrics.anomaly("value").alias("obs"))))


DIRECTED = " UNION ALL ".join(f"SELECT {3 * c + o} AS k, {p} AS p, (cat = {c})::INT AS hit FROM b WHERE cat IN ({c}, {o})" for c, p in enumerate(("p_below", "p_normal", "p_above")) for o in range(3) if c != o)


@query(f"""WITH {BOUNDED}, s AS ({DIRECTED}), k AS (SELECT k, hit, rank() OVER (PARTITION BY k ORDER BY p) + (count(*) OVER (PARTITION BY k, p) - 1) / 2.0::DOUBLE AS rk FROM s),
a AS (SELECT k, (sum(hit * rk) - sum(hit) * (sum(hit) + 1) / 2.0::DOUBLE) / (sum(hit) * sum(1 - hit)) AS a FROM k GROUP BY 1) SELECT {rnd('avg(a)')} AS groc FROM a""")
def groc(spark, d):
    return r(metrics.groc(bounded(spark, d)))


@query(f"""WITH {BOUNDED}, s AS (SELECT 0 AS c, p_below AS p, (cat = 0)::INT AS o FROM b UNION ALL SELECT 1, p_normal, (cat = 1)::INT FROM b UNION ALL SELECT 2, p_above, (cat = 2)::INT FROM b),
g AS (SELECT count(*) AS n, avg(p) - avg(o) AS d FROM s GROUP BY c, least(floor(p * 5), 4)) SELECT {rnd('sum(n * d * d) / sum(n)')} AS reliability FROM g""")
def reliability(spark, d):
    return r(metrics.reliability(bounded(spark, d)))


@query(f"""WITH {PAIRS} SELECT a.cell, {rnd('2 * avg(CASE WHEN a.fc = b.fc AND a.obs = b.obs THEN 0.5 WHEN (a.fc >= b.fc) = (a.obs >= b.obs) THEN 1.0 ELSE 0.0 END) - 1')} AS tau
FROM pairs a JOIN pairs b ON a.cell = b.cell AND a.year < b.year GROUP BY 1""")
def kendall_tau(spark, d):
    return r(metrics.kendall_tau(pairs(spark, d), ["cell"]))


@query(f"""WITH {PAIRS}, k AS (SELECT *, avg(obs) OVER (PARTITION BY cell) AS clim FROM pairs)
SELECT year, {rnd('corr(fc - clim, obs - clim)')} AS acc, {rnd('sqrt(avg((fc - obs) ** 2))')} AS rmse, {rnd('avg(fc - obs)')} AS bias FROM k GROUP BY 1""")
def score_pair(spark, d):
    clim = cubes.observations(spark, d).groupBy("cell").agg(F.avg("value").alias("clim"))
    return r(metrics.score_pair(pairs(spark, d).join(clim, "cell").withColumnRenamed("fc", "pred"), ["year"]))


@query(f"""WITH {PAIRS}, c AS (SELECT cell, corr(fc, obs) AS a, sqrt(avg((fc - obs) ** 2)) AS e FROM pairs GROUP BY 1)
SELECT 'pearson' AS metric, {rnd('avg(a)')} AS score FROM c UNION ALL SELECT 'rmse', {rnd('avg(e)')} FROM c""")
def skill_compare(spark, d):
    return r(metrics.skill(pairs(spark, d), ["pearson", "rmse"]))


def permutation_p(spark, d):
    """Leave-one-out correlation of each cell with its p value by 200 permutations."""
    return r(metrics.permutation_test(pairs(spark, d).withColumnsRenamed({"fc": "x", "obs": "y"}), 200))


query()(permutation_p)


@query(f"""WITH {GRID} SELECT a.year, a.lat + 0.5 AS lat, a.lon + 0.25 AS lon, {rnd('0.375 * a.value + 0.125 * b.value + 0.375 * c.value + 0.125 * e.value')} AS value
FROM grid a JOIN grid b ON a.year = b.year AND a.lat = b.lat AND a.lon + 1 = b.lon JOIN grid c ON a.year = c.year AND a.lat + 1 = c.lat AND a.lon = c.lon JOIN grid e ON a.year = e.year AND a.lat + 1 = e.lat AND a.lon + 1 = e.lon""")
def regrid_bilinear(spark, d):
    g = cubes.on_grid(cubes.observations(spark, d))
    lats, lons = regrid.axis(g, "lat"), regrid.axis(g, "lon")
    return r(regrid.regrid(g, ["year"], [x + 0.5 for x in lats[:-1]], [x + 0.25 for x in lons[:-1]]))


@query(f"WITH {GRID} SELECT year, lat + 0.3 AS lat, lon - 0.2 AS lon, {rnd('value')} AS value FROM grid")
def regrid_nearest(spark, d):
    g = cubes.on_grid(cubes.observations(spark, d))
    lats, lons = regrid.axis(g, "lat"), regrid.axis(g, "lon")
    return r(regrid.regrid(g, ["year"], [x + 0.3 for x in lats], [x - 0.2 for x in lons], regrid.nearest_weights))


@query(f"WITH {GRID} SELECT year, lat, lon + 357 AS lon, {rnd('value')} AS value FROM grid WHERE lat BETWEEN 0 AND 3 AND ((lon + 357) % 360 >= 358 OR (lon + 357) % 360 <= 0)")
def region_clip(spark, d):
    g = cubes.on_grid(cubes.observations(spark, d)).withColumn("lon", F.col("lon") + 357)
    return r(regrid.clip(g, 0, 3, -2, 360).select("year", "lat", "lon", "value"))


@query(f"WITH {GRID} SELECT year, floor(lat / 2) AS lat, floor(lon / 2) AS lon, {rnd('avg(value)')} AS value FROM grid GROUP BY 1, 2, 3")
def block_mean(spark, d):
    g = cubes.on_grid(cubes.observations(spark, d))
    return r(regrid.block_mean(g, ["year"], F.floor(F.col("lat") / 2).cast("double"), F.floor(F.col("lon") / 2).cast("double")))


@query(f"WITH {OBS} SELECT cell, year, {rnd('value / avg(value) OVER (PARTITION BY year, cell // 4)')} AS share FROM obs")
def parent_share(spark, d):
    o = cubes.observations(spark, d).withColumn("parent", F.floor(F.col("cell") / 4))
    return r(regrid.by_parent(o, ["year"]).select("cell", "year", "share"))


@query(f"WITH {PAIRS}, k AS (SELECT cell, corr(fc, obs) AS s FROM pairs GROUP BY 1) SELECT cell, year, {rnd('CASE WHEN s > 0.1 THEN fc END')} AS value FROM pairs JOIN k USING (cell)")
def mask_by_skill(spark, d):
    p = pairs(spark, d)
    skill = metrics.pearson(p, ["cell"]).withColumnRenamed("r", "skill")
    return r(regrid.mask_by_skill(p.select("cell", "year", F.col("fc").alias("value")), skill, ["cell"], 0.1))


@query(f"WITH {OBS} SELECT cell, avg(value) < 25.5 AS dry FROM obs GROUP BY 1")
def dry_mask(spark, d):
    return regrid.dry_mask(cubes.observations(spark, d).groupBy("cell").agg(F.avg("value").alias("value")), 25.5).select("cell", "dry")


TRAIN = f"""{OBS}, {HIND}, hm AS (SELECT cell, year, avg(value) AS value FROM hind WHERE year < 2000 GROUP BY 1, 2),
ot AS (SELECT * FROM obs WHERE year < 2000), fc AS (SELECT cell, member, value AS x FROM hind WHERE year = 2000)"""


def mapped_sql(source: str, target: str, forecast: str) -> str:
    place = "greatest(0, least(q * m - 0.5, m - 1))"
    return f"""pos AS (SELECT f.cell, f.member, f.x, count(CASE WHEN h.value <= f.x THEN 1 END) AS j, max(CASE WHEN h.value <= f.x THEN h.value END) AS a, min(CASE WHEN h.value > f.x THEN h.value END) AS b, count(*) AS n
  FROM {forecast} f JOIN {source} h USING (cell) GROUP BY 1, 2, 3),
pl AS (SELECT cell, member, x, (CASE WHEN j < 1 THEN 0.5 WHEN j >= n THEN n - 0.5 ELSE j - 0.5 + (x - a) / (b - a) END)::DOUBLE / n AS q FROM pos),
rk AS (SELECT cell, value, row_number() OVER (PARTITION BY cell ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY cell) AS m FROM {target}),
mp AS (SELECT pl.cell, member, x, sum(CASE WHEN i = floor({place}) THEN value * (1 - ({place} - floor({place}))) WHEN i = floor({place}) + 1 THEN value * ({place} - floor({place})) ELSE 0 END) AS y
  FROM pl JOIN rk ON pl.cell = rk.cell GROUP BY 1, 2, 3)"""


@query(f"WITH {TRAIN}, {mapped_sql('hm', 'ot', 'fc')} SELECT cell, member, {rnd('y')} AS value FROM mp")
def qm_empirical(spark, d):
    return r(methods.quantile_map_empirical(*training(spark, d)))


@query(f"""WITH {TRAIN}, {mapped_sql('hm', 'ot', 'fc')}, hs AS (SELECT cell, list_sort(list(value)) AS s FROM hm GROUP BY 1), os AS (SELECT cell, list_sort(list(value)) AS t FROM ot GROUP BY 1)
SELECT cell, member, {rnd('CASE WHEN x < s[1] THEN t[1] + (x - s[1]) * (t[2] - t[1]) / (s[2] - s[1]) WHEN x > s[-1] THEN t[-1] + (x - s[-1]) * (t[-1] - t[-2]) / (s[-1] - s[-2]) ELSE y END')} AS value FROM mp JOIN hs USING (cell) JOIN os USING (cell)""")
def qm_linear_tails(spark, d):
    return r(methods.quantile_map_empirical(*training(spark, d), linear=True))


def detrended_sql(name: str, source: str) -> str:
    return f"{name} AS (SELECT cell, year, value - regr_slope(value, year) OVER w * (year - avg(year) OVER w) AS value, regr_slope(value, year) OVER w * (max(year) OVER w - avg(year) OVER w) AS trend FROM {source} WINDOW w AS (PARTITION BY cell))"


@query(f"""WITH {TRAIN}, {detrended_sql('gd', 'hm')}, {detrended_sql('od', 'ot')}, tr AS (SELECT cell, max(trend) AS trend FROM gd GROUP BY 1), fd AS (SELECT cell, member, x - trend AS x FROM fc JOIN tr USING (cell)),
{mapped_sql('gd', 'od', 'fd')} SELECT cell, member, {rnd('y + trend')} AS value FROM mp JOIN tr USING (cell)""")
def dqm(spark, d):
    return r(methods.quantile_map_detrended(*training(spark, d)))


@query(f"""WITH {TRAIN}, pos AS (SELECT f.cell, f.member, f.x, greatest(least(count(CASE WHEN h.value < f.x THEN 1 END)::DOUBLE / count(*), 0.99), 0.01) AS q FROM fc f JOIN hm h USING (cell) GROUP BY 1, 2, 3),
rk AS (SELECT cell, value, row_number() OVER (PARTITION BY cell ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY cell) - 1 AS m FROM ot)
SELECT pos.cell, member, {rnd('sum(CASE WHEN i = floor(q * m) THEN value * (1 - (q * m - floor(q * m))) WHEN i = floor(q * m) + 1 THEN value * (q * m - floor(q * m)) ELSE 0 END)')} AS value
FROM pos JOIN rk ON pos.cell = rk.cell GROUP BY pos.cell, member, x""")
def bcsd_coarse(spark, d):
    return r(methods.bcsd_coarse(*training(spark, d)))


@query(f"""WITH {GRID}, c AS (SELECT lat, lon, avg(value) AS v FROM grid GROUP BY 1, 2)
SELECT c.lat, c.lon, {rnd('CASE WHEN c.lon % 2 = 0 THEN 0 ELSE c.v - (a.v + b.v) / 2 END')} AS detail FROM c LEFT JOIN c a ON a.lat = c.lat AND a.lon = c.lon - 1 LEFT JOIN c b ON b.lat = c.lat AND b.lon = c.lon + 1""")
def bcsd_detail(spark, d):
    """Every second longitude is coarse."""
    g = cubes.on_grid(cubes.observations(spark, d)).groupBy("lat", "lon").agg(F.avg("value").alias("value"))
    return r(methods.bcsd_detail(g, regrid.axis(g, "lat"), regrid.axis(g, "lon")[::2]))


@query(f"WITH {TRAIN} SELECT cell, member, {rnd('o')} AS value FROM fc JOIN (SELECT cell, avg(value) AS o FROM ot GROUP BY 1) USING (cell)")
def climatology(spark, d):
    _, o, f = training(spark, d)
    return r(methods.climatology_forecast(o, f))


@query(f"""WITH {TRAIN}, p AS (SELECT cell, hm.value AS x, ot.value AS y FROM hm JOIN ot USING (cell, year)),
k AS (SELECT cell, count(*) AS n, regr_slope(y, x) AS s, regr_intercept(y, x) AS i, avg(x) AS xm, regr_sxx(y, x) AS sxx, (regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x)) / greatest(count(*) - 2, 1) AS pev,
  quantile_cont(y, 1.0::DOUBLE / 3) AS lo, quantile_cont(y, 2.0::DOUBLE / 3) AS hi FROM p GROUP BY 1),
f AS (SELECT cell, avg(x) AS xf FROM fc GROUP BY 1), g AS (SELECT cell, lo, hi, i + s * xf AS mu, sqrt(greatest(pev * (1 + 1.0::DOUBLE / n + (xf - xm) ** 2 / sxx), 1e-12)) AS sd FROM k JOIN f USING (cell)),
z AS (SELECT cell, {rnd('mu')} AS mu, (lo - mu) / sd AS zl, (hi - mu) / sd AS zh FROM g) {split_sql('cell, mu', 'z')}""")
def ereg_terciles(spark, d):
    return r(methods.ereg_forecast(*training(spark, d)))


@query(f"WITH {LOO} SELECT cell, {rnd('avg(prediction - y) - 1.2815515655446004 * stddev_samp(prediction - y)')} AS low, {rnd('avg(prediction - y) + 1.2815515655446004 * stddev_samp(prediction - y)')} AS high FROM loo GROUP BY 1")
def error_bounds_normal(spark, d):
    return r(methods.normal_bounds(cv(spark, d)))


@query(f"WITH {SEASONS} SELECT cell, season, {rnd('regr_slope(y, x)')} AS a FROM sp GROUP BY 1, 2")
def seasonal_coefficients(spark, d):
    return r(methods.seasonal_coefficients(cubes.seasonal_pairs(spark, d)))


@query(f"""WITH {SEASONS}, k AS (SELECT cell, season, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y FROM sp WINDOW w AS (PARTITION BY cell, season)), s AS (SELECT cell, regr_slope(y, x) AS a FROM k GROUP BY 1)
SELECT DISTINCT cell, season, {rnd('a')} AS a FROM sp JOIN s USING (cell)""")
def pooled_coefficient(spark, d):
    return r(methods.seasonal_coefficients(cubes.seasonal_pairs(spark, d), pooled=True))


KERNEL = [math.exp(-0.5 * (i / 0.5) ** 2) for i in range(-2, 3)]
SMOOTH = f"""{SEASONS}, c AS (SELECT cell, season, regr_slope(y, x) AS a FROM sp GROUP BY 1, 2),
sm AS (SELECT cell, ((season + o + 4) % 4)::INT AS season, sum(w * a) AS a FROM c, (VALUES {', '.join(f'({i - 2}, {w / sum(KERNEL)!r})' for i, w in enumerate(KERNEL))}) v(o, w) GROUP BY 1, 2)"""


@query(f"WITH {SMOOTH} SELECT cell, season, {rnd('a')} AS a FROM sm")
def smoothed_coefficients(spark, d):
    return r(methods.smooth_seasons(methods.seasonal_coefficients(cubes.seasonal_pairs(spark, d)), 4, 0.5))


@query(f"""WITH {SMOOTH}, m AS (SELECT cell, season, avg(x) AS xm, avg(y) AS ym FROM sp WHERE year < 2000 GROUP BY 1, 2)
SELECT cell, season, {rnd('ym + a * (x - xm)')} AS value FROM sp JOIN m USING (cell, season) JOIN sm USING (cell, season) WHERE year = 2000""")
def smoothed_regression(spark, d):
    p = cubes.seasonal_pairs(spark, d)
    a = methods.smooth_seasons(methods.seasonal_coefficients(p), 4, 0.5)
    return r(methods.smoothed_forecast(p.where("year < 2000"), a, p.where("year = 2000").select("cell", "season", "x")))


@query(f"""WITH {OBS}, {HIND}, e AS (SELECT cell, avg(m) AS mm, covar_pop(m, value) / var_pop(m) AS a, var_pop(m) AS v, var_pop(value) AS vo, avg(s * s) AS s2 FROM (SELECT cell, year, avg(value) AS m, stddev_pop(value) AS s FROM hind GROUP BY 1, 2) JOIN obs USING (cell, year) GROUP BY 1)
SELECT cell, {rnd('a')} AS a, {rnd('sqrt(greatest(vo - a * a * v, 0) / s2)')} AS b FROM e""")
def spread_scaling(spark, d):
    e = cubes.hindcast(spark, d).groupBy("cell", "year").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sigma"))
    return r(methods.scale_fit(e.join(cubes.observations(spark, d).withColumnRenamed("value", "y"), ["cell", "year"]), ["cell"]))


@query(f"WITH {OBS} SELECT cell, {rnd('avg(value) ** 2 / var_pop(value)')} AS shape, {rnd('var_pop(value) / avg(value)')} AS scale FROM obs GROUP BY 1")
def gamma_fit(spark, d):
    return r(methods.gamma_fit(cubes.observations(spark, d), ["cell"]))


def gamma_scores(spark, d):
    """Normal scores of observations by a fitted gamma distribution, and back."""
    o = cubes.observations(spark, d)
    j = o.join(methods.gamma_fit(o, ["cell"]), "cell")
    z = j.withColumn("score", methods.gamma_to_normal(F.col("value"), F.col("shape"), F.col("scale")))
    return r(z.select("cell", "year", "value", "score", methods.normal_to_gamma(F.col("score"), F.col("shape"), F.col("scale")).alias("back")))


query()(gamma_scores)

YEARS = "ys AS (SELECT DISTINCT year(l_shipdate)::INT AS year FROM lineitem), n AS (SELECT min(year) AS a, max(year) AS b, count(*)::INT AS n FROM ys)"


def years(spark: SparkSession, d: str) -> list[int]:
    return [x[0] for x in cubes.observations(spark, d).select("year").distinct().collect()]


@query(f"WITH {YEARS} SELECT (h.year - a)::INT AS fold, y.year, y.year = h.year AS held FROM ys h, ys y, n WHERE y.year = h.year OR abs(y.year - h.year) > 1")
def folds_loyo(spark, d):
    return validation.fold_table(spark, validation.loyo(years(spark, d), 3))


@query(f"WITH {YEARS} SELECT (h.year - a)::INT AS fold, y.year, y.year = h.year AS held FROM ys h, ys y, n WHERE y.year = h.year OR abs(y.year - h.year) NOT IN (0, 1, n - 1)")
def folds_loyo_cyclic(spark, d):
    return validation.fold_table(spark, validation.loyo_cyclic(years(spark, d), 3))


@query(f"WITH {YEARS} SELECT (h.year - a)::INT AS fold, y.year, y.year BETWEEN h.year AND h.year + 2 AS held FROM ys h, ys y, n WHERE h.year <= b - 2")
def folds_lko(spark, d):
    return validation.fold_table(spark, validation.lko(years(spark, d), 3))


@query(f"""WITH {YEARS} SELECT ((h.year - a) // 2)::INT AS fold, y.year, y.year BETWEEN h.year AND h.year + 1 AS held FROM ys h, ys y, n
WHERE (h.year - a) % 2 = 0 AND h.year < b AND (y.year BETWEEN h.year AND h.year + 1 OR y.year < h.year - 1 OR y.year > h.year + 2)""")
def folds_blocked(spark, d):
    return validation.fold_table(spark, validation.blocked(years(spark, d), 2, 1))


@query(f"WITH {YEARS} SELECT (h.year - a - 3)::INT AS fold, y.year, y.year = h.year AS held FROM ys h, ys y, n WHERE h.year >= a + 3 AND y.year <= h.year")
def folds_expanding(spark, d):
    return validation.fold_table(spark, validation.expanding(years(spark, d), 3))


def models(spark: SparkSession, d: str) -> DataFrame:
    """cell, year, model, value: three models of the members by number."""
    h = cubes.hindcast(spark, d).withColumn("model", (F.col("member") % 3).cast("int"))
    return h.groupBy("cell", "year", "model").agg(F.avg("value").alias("value"))


def scores(spark: SparkSession, d: str) -> DataFrame:
    o = cubes.observations(spark, d).withColumnRenamed("value", "obs")
    return models(spark, d).join(o, ["cell", "year"]).groupBy("model").agg(F.corr("value", "obs").alias("score"))


MODELS = f"""{OBS}, {HIND}, mo AS (SELECT cell, year, (member % 3)::INT AS model, avg(value) AS value FROM hind GROUP BY 1, 2, 3),
sc AS (SELECT model, corr(m.value, o.value) AS score FROM mo m JOIN obs o USING (cell, year) GROUP BY 1),
we AS (SELECT model, CASE WHEN sum(greatest(score, 0)) OVER () > 0 THEN greatest(score, 0) / sum(greatest(score, 0)) OVER () ELSE 1.0 / count(*) OVER () END AS weight FROM sc)"""


@query(f"WITH {MODELS} SELECT cell, year, {rnd('CASE WHEN count(*) = count(value) THEN avg(value) END')} AS value FROM mo GROUP BY 1, 2")
def ensemble_uniform(spark, d):
    return r(ensembles.uniform(models(spark, d), ["cell", "year"]))


@query(f"WITH {MODELS} SELECT cell, year, {rnd('sum(weight * value)')} AS value FROM mo JOIN we USING (model) GROUP BY 1, 2")
def ensemble_skill_weighted(spark, d):
    return r(ensembles.weighted(models(spark, d), ensembles.skill_weights(scores(spark, d)), ["cell", "year"]))


@query(f"WITH {MODELS}, s AS (SELECT model, (0.5 * weight + 0.5 / count(*) OVER ())::DOUBLE AS weight FROM we) SELECT {rnd('1 / sum(weight * weight)')} AS n FROM s")
def effective_models(spark, d):
    """Of weights shrunk half way."""
    return r(ensembles.effective_models(ensembles.shrink(ensembles.skill_weights(scores(spark, d)), 0.5)))


@query(f"WITH {MODELS} SELECT cell, year, {rnd('avg(value)')} AS value FROM mo JOIN (SELECT model, row_number() OVER (ORDER BY score, model) AS k FROM sc) USING (model) WHERE k > 1 GROUP BY 1, 2")
def ensemble_drop_worst(spark, d):
    return r(ensembles.drop_worst(models(spark, d), scores(spark, d), ["cell", "year"]))


@query(f"""WITH {HIND}, t AS (SELECT *, (member % 3)::INT AS model FROM hind WHERE NOT (member % 3 = 0 AND year = 1997)), i AS (SELECT model, member, row_number() OVER (ORDER BY model, member)::INT AS k FROM (SELECT DISTINCT model, member FROM t))
SELECT cell, year, k AS member, {rnd('value')} AS value FROM t JOIN i USING (model, member) WHERE year <> 1997""")
def pool_ensembles(spark, d):
    """The first model lacks a year, which is left out."""
    h = cubes.hindcast(spark, d).withColumn("model", (F.col("member") % 3).cast("int"))
    return r(ensembles.pool(h.where("NOT (model = 0 AND year = 1997)")))


@query(f"""WITH {MODELS}, a AS (SELECT model, year, avg(value) AS a FROM mo GROUP BY 1, 2), b AS (SELECT year, avg(v) AS b FROM (SELECT cell, year, avg(value) AS v FROM mo GROUP BY 1, 2) GROUP BY 1)
SELECT model, {rnd('corr(a, b)')} AS r FROM a JOIN b USING (year) GROUP BY 1""")
def member_contributions(spark, d):
    m = models(spark, d)
    return r(ensembles.contributions(m, ensembles.uniform(m, ["cell", "year"])))


def bma_weights(spark, d):
    """Weights and variances of three models by expectation and maximisation."""
    o = cubes.observations(spark, d).withColumnRenamed("value", "obs")
    fit = ensembles.bma(models(spark, d), o, ["cell", "year"])
    return r(spark.createDataFrame(fit, "model int, weight double, variance double"))


query()(bma_weights)


@query(f"WITH {OBS}, k AS (SELECT cell, year, (value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w >= 1e-12 THEN stddev_pop(value) OVER w END AS z FROM obs WINDOW w AS (PARTITION BY cell)) SELECT cell, year, CASE WHEN z IS NOT NULL THEN {rnd(normal_cdf_sql('z'))} END AS position FROM k")
def percentile_gaussian(spark, d):
    return r(climate.percentile_position(cubes.observations(spark, d), ["cell"], "gaussian").select("cell", "year", "position"))


@query()
def percentile_gamma(spark, d):
    return r(climate.percentile_position(cubes.observations(spark, d), ["cell"], "gamma").select("cell", "year", "position"))


@query(f"""WITH {OBS}, {HIND}, c AS (SELECT cell, avg(value) AS m, stddev_samp(value) AS s FROM obs GROUP BY 1), f AS (SELECT cell, year, avg(value) AS v FROM hind GROUP BY 1, 2)
SELECT cell, year, {rnd('(v - m) / CASE WHEN s > 0 THEN s END')} AS z FROM f LEFT JOIN c USING (cell)""")
def pixel_standardize(spark, d):
    return r(climate.pixel_standardize(cubes.hindcast(spark, d), cubes.observations(spark, d)))


BOXES = ("nino34", "wnp", "wep", "wsp", "wtio", "setio", "tropics")


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """year, box, index: the mean of every seventh cell."""
    names = F.array(*map(F.lit, BOXES))
    o = cubes.observations(spark, d).withColumn("box", F.element_at(names, (F.col("cell") % len(BOXES) + 1).cast("int")))
    return o.groupBy("year", "box").agg(F.avg("value").alias("index"))


PIVOT = f"{OBS}, b AS (SELECT year, {', '.join(f'avg(CASE WHEN cell % {len(BOXES)} = {k} THEN value END) AS {n}' for k, n in enumerate(BOXES))} FROM obs GROUP BY 1)"


@query(f"""WITH {PIVOT} SELECT year, name, {rnd('i')} AS "index" FROM (
  SELECT year, 'wvg3' AS name, nino34 - (wnp + wep + wsp) / 3 AS i FROM b UNION ALL SELECT year, 'wvg2', nino34 - (wnp + wep) / 2 FROM b
  UNION ALL SELECT year, 'dmi', wtio - setio FROM b UNION ALL SELECT year, 'roni', nino34 - tropics FROM b)""")
def composite_indices(spark, d):
    b = boxes(spark, d)
    parts = [climate.composite(b, ["year"], n).withColumn("name", F.lit(n)) for n in climate.COMPOSITES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return r(out)


SEASON_MEMBERS = """sm AS (SELECT l_suppkey AS cell, (quarter(l_shipdate) - 1)::INT AS season, year(l_shipdate) AS year, l_linenumber AS member, avg(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3, 4),
so AS (SELECT l_suppkey AS cell, (quarter(l_shipdate) - 1)::INT AS season, year(l_shipdate) AS year, avg(l_quantity) AS y FROM lineitem WHERE year(l_shipdate) < 1998 GROUP BY 1, 2, 3)"""


@query(f"""WITH {SEASON_MEMBERS}, h AS (SELECT cell, season, year, avg(value) AS mu, stddev_pop(value) AS sigma FROM sm WHERE year <= 1998 GROUP BY 1, 2, 3),
fit AS (SELECT cell, season, count(*) AS n, covar_pop(mu, y) / var_pop(mu) AS a, var_pop(mu) AS v, var_pop(y) AS vo, avg(sigma * sigma) AS s2 FROM h JOIN so USING (cell, season, year) GROUP BY 1, 2),
c AS (SELECT cell, season, avg(mu) AS c FROM h WHERE year < 1998 GROUP BY 1, 2),
t AS (SELECT cell, season, quantile_cont(y, 1.0::DOUBLE / 3) - avg(y) AS lo, quantile_cont(y, 2.0::DOUBLE / 3) - avg(y) AS hi FROM so GROUP BY 1, 2),
j AS (SELECT cell, season, a * (mu - c) AS m, greatest(sqrt(greatest(vo - a * a * v, 0) / s2) * sigma, 1e-12) AS s, lo, CASE WHEN lo < hi THEN hi ELSE lo + 1e-6 END AS hi
  FROM (SELECT * FROM h WHERE year = 1998) JOIN fit USING (cell, season) JOIN c USING (cell, season) JOIN t USING (cell, season) WHERE n >= 3 AND v >= 1e-12 AND s2 >= 1e-12),
z AS (SELECT cell, season, (lo - m) / s AS zl, (hi - m) / s AS zh FROM j) {split_sql('cell, season', 'z')}""")
def smoothed_terciles(spark, d):
    """Fitted before 1998, for 1998."""
    m = cubes.seasonal_members(spark, d)
    o = cubes.seasonal_pairs(spark, d).where("year < 1998").select("cell", "season", "year", F.col("y").alias("value"))
    return r(methods.smoothed_terciles(m.where("year < 1998"), o, m.where("year = 1998")).where("p_below IS NOT NULL"))


def terrain_rows(spark: SparkSession, d: str) -> DataFrame:
    """year, lat, lon, z, u, v: a made-up relief on a grid of a hundredth of a degree."""
    g = cubes.on_grid(cubes.observations(spark, d).select("year", "cell", "value"))
    wind = [(F.cos("year") + 0.1).alias("u"), F.sin("year").alias("v")]
    return g.select("year", (F.col("lat") / 100).alias("lat"), (F.col("lon") / 100).alias("lon"), (F.col("value") * 20).alias("z"), *wind)


@query()
def wind_effect(spark, d):
    return r(terrain.wind_effect(terrain_rows(spark, d), ["year"]))


@query()
def chelsa_precipitation(spark, d):
    """Coarse amounts of 10 plus the year's last digit on blocks of two by two points."""
    h = terrain.wind_effect(terrain_rows(spark, d), ["year"])
    z = terrain_rows(spark, d).select("year", "lat", "lon", "z")
    parent = F.concat_ws(":", F.floor(F.round(F.col("lat") * 100) / 2), F.floor(F.round(F.col("lon") * 100) / 2))
    rows = h.join(z, ["year", "lat", "lon"]).withColumns({"parent": parent, "pbl": F.lit(900.0), "ground": F.lit(100.0), "exposure": F.lit(1.0), "coarse": 10.0 + F.col("year") % 10})
    return r(terrain.orographic(terrain.lifted(rows, ["year"]), ["year"]))


@query()
def rank_analog(spark, d):
    """Members of 2000 on blocks of two by two points, to the points."""
    half = [F.floor(F.col(c) / 2).cast("double").alias(c) for c in ("lat", "lon")]
    h = cubes.on_grid(cubes.hindcast(spark, d)).select("year", "member", *half, "value").groupBy("year", "member", "lat", "lon").agg(F.avg("value").alias("value"))
    o = cubes.on_grid(cubes.observations(spark, d))
    return r(ranks.rank_analog(h.where("year < 2000"), o.where("year < 2000"), h.where("year = 2000").drop("year"), closing=5))
