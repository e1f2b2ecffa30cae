"""Registered queries on calibration, the seasonal forecast of several models, variance-ratio calibration, canonical correlation and logistic forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from seasonspark.functions.special import normal_cdf_sql
from seasonspark.operators import calibrate as cb
from seasonspark.operators import cca, cccma, climate, diagrams, ensembles, logit, methods, metrics, seasonal_mme
from seasonspark.plans.axes import MH, model_hindcast
from seasonspark.plans.catalog import BOX, query, r, rnd
from seasonspark.plans.forecasts import MODELS, models, scores, split_sql
from seasonspark.registry import downscale
from seasonspark.sources import cubes, products
from seasonspark.sources.cubes import HIND, OBS

THIRDS = "quantile_cont({0}, 1.0::DOUBLE / 3) AS lo, quantile_cont({0}, 2.0::DOUBLE / 3) AS hi"


def member_models(spark, d):
    """model, cell, year, member, value."""
    return cubes.hindcast(spark, d).withColumn("model", (F.col("member") % 3).cast("int"))


def mean_sql(keys: str, source: str) -> str:
    """Shares of zl and zh averaged over models and made to add up to one."""
    return f"""SELECT {keys}, {rnd('b / (b + n + a)')} AS p_below, {rnd('n / (b + n + a)')} AS p_normal, {rnd('a / (b + n + a)')} AS p_above FROM (
  SELECT {keys}, avg(b) AS b, avg(n) AS n, avg(a) AS a FROM (SELECT {keys}, {normal_cdf_sql('zl')} AS b, {normal_cdf_sql('zh')} - {normal_cdf_sql('zl')} AS n, 1 - {normal_cdf_sql('zh')} AS a FROM {source}) WHERE b IS NOT NULL GROUP BY {keys})"""


FITTED = """count(*) AS n, regr_slope(y, x) AS s, regr_intercept(y, x) AS i, avg(x) AS xm, regr_sxx(y, x) AS sxx, (regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x)) / greatest(count(*) - 2, 1) AS pev"""
SPREAD_SD = "sqrt(greatest(pev * (1 + 1.0::DOUBLE / n + (xf - xm) ** 2 / sxx), 1e-12))"
ISSUED = f"""{OBS}, {HIND}, xm AS (SELECT (member % 3)::INT AS model, cell, year, avg(value) AS x FROM hind WHERE year < 2000 GROUP BY 1, 2, 3), ob AS (SELECT * FROM obs WHERE year < 2000), fx AS (SELECT (member % 3)::INT AS model, cell, avg(value) AS xf FROM hind WHERE year = 2000 GROUP BY 1, 2),
fi AS (SELECT model, cell, {FITTED} FROM (SELECT model, cell, x, value AS y FROM xm JOIN ob USING (cell, year)) GROUP BY 1, 2 HAVING count(*) >= 3 AND regr_sxx(y, x) >= 1e-12), bo AS (SELECT cell, {THIRDS.format('value')} FROM ob GROUP BY 1),
zz AS (SELECT model, cell, i + s * xf AS mu, (lo - i - s * xf) / {SPREAD_SD} AS zl, (hi - i - s * xf) / {SPREAD_SD} AS zh FROM fi JOIN fx USING (model, cell) JOIN bo USING (cell))"""


def issued(spark, d):
    """Predictor and observations before 2000, and the members of 2000."""
    h = member_models(spark, d)
    return h.where("year < 2000"), cubes.observations(spark, d).where("year < 2000"), h.where("year = 2000").drop("year")


@query(f"WITH {ISSUED} {mean_sql('cell', 'zz')}")
def calibrate_ereg(spark, d):
    return r(cb.calibrate(*issued(spark, d)))


@query(f"WITH {ISSUED}, k AS (SELECT model, cell, zl, zh FROM zz WHERE zl IS NOT NULL) {split_sql('model, cell', 'k')}")
def calibrate_components(spark, d):
    return r(cb.calibrate(*issued(spark, d), components=True).where("p_below IS NOT NULL"))


@query(f"WITH {ISSUED} SELECT cell, {rnd('avg(mu)')} AS value FROM (SELECT cell, i + s * xf AS mu FROM fi JOIN fx USING (model, cell)) GROUP BY 1")
def calibrate_deterministic(spark, d):
    return r(cb.calibrate(*issued(spark, d), output="deterministic"))


CV_FOLDS = f"""{OBS}, {HIND}, xm AS (SELECT (member % 3)::INT AS model, cell, year, avg(value) AS x FROM hind GROUP BY 1, 2, 3), ys AS (SELECT DISTINCT year AS fold FROM obs),
fi AS (SELECT model, fold, cell, {FITTED} FROM (SELECT model, fold, cell, x, value AS y FROM xm JOIN obs USING (cell, year), ys WHERE abs(year - fold) > 1) GROUP BY 1, 2, 3 HAVING count(*) >= 3 AND regr_sxx(y, x) >= 1e-12),
bo AS (SELECT fold, cell, {THIRDS.format('value')} FROM obs, ys WHERE abs(year - fold) > 1 GROUP BY 1, 2),
zz AS (SELECT model, fold AS year, cell, (lo - i - s * xf) / {SPREAD_SD} AS zl, (hi - i - s * xf) / {SPREAD_SD} AS zh FROM fi JOIN (SELECT model, cell, year AS fold, x AS xf FROM xm) USING (model, cell, fold) JOIN bo USING (fold, cell))"""


@query(f"WITH {CV_FOLDS} {mean_sql('year, cell', 'zz')}")
def calibrate_cv(spark, d):
    """Each year by fits on the years more than one away."""
    return r(cb.calibrate_cv(member_models(spark, d), cubes.observations(spark, d), 3))


@query(f"""WITH {OBS}, {HIND}, xm AS (SELECT cell, year, avg(value) AS x FROM hind GROUP BY 1, 2), fi AS (SELECT cell, {FITTED} FROM (SELECT cell, x, value AS y FROM xm JOIN obs USING (cell, year)) GROUP BY 1 HAVING count(*) >= 3 AND regr_sxx(y, x) >= 1e-12)
SELECT cell, year, {rnd('i + s * x')} AS value, {rnd('value')} AS obs FROM xm JOIN fi USING (cell) JOIN obs USING (cell, year)""")
def ereg_hindcast(spark, d):
    return r(cb.fitted_hindcast(cubes.hindcast(spark, d), cubes.observations(spark, d), True))


@query()
def calibrate_logit_index(spark, d):
    """Shares from a detrended box mean. No SQL: the fits are iterated."""
    o = cubes.observations(spark, d)
    h = cubes.hindcast(spark, d).groupBy("cell", "year").agg(F.avg("value").alias("value"))
    return r(cb.by_index(h.where("year < 2000"), o.where("year < 2000"), h.where("year = 2000"), F.col("cell") % 3 == 0, 2000, least=4, penalty=1.0))


@query()
def logit_terciles(spark, d):
    """Shares of each cell from a box index, by penalised logistic regression. No SQL: the fits are iterated."""
    o = cubes.observations(spark, d)
    index = climate.index_box(o, F.col("cell") % 3 == 0, "standardized").withColumnRenamed("index", "x")
    return r(logit.forecast(o.join(F.broadcast(index), "year"), 0.5, penalty=1.0, least=4))


@query()
def logit_multinomial(spark, d):
    o = cubes.observations(spark, d)
    index = climate.index_box(o, F.col("cell") % 3 == 0, "standardized").withColumnRenamed("index", "x")
    return r(logit.forecast(o.join(F.broadcast(index), "year"), 0.5, "multinomial", penalty=1.0, least=4))


COMMON = f"{OBS}, {HIND}, {MH}, cy AS (SELECT year FROM (SELECT DISTINCT model, year FROM mh) JOIN (SELECT DISTINCT year FROM obs) USING (year) GROUP BY 1 HAVING count(*) = 3)"


def mme_sql(years: str) -> str:
    return f"""{COMMON}, pr AS (SELECT model, cell, year, mh.value AS x, obs.value AS y FROM mh JOIN obs USING (cell, year){years}),
lo AS (SELECT model, cell, year, y, y - (y - regr_intercept(y, x) OVER w - regr_slope(y, x) OVER w * x) / (1 - (1.0::DOUBLE / count(*) OVER w + (x - avg(x) OVER w) ** 2 / regr_sxx(y, x) OVER w)) AS prediction FROM pr WINDOW w AS (PARTITION BY model, cell)),
al AS (SELECT year FROM (SELECT DISTINCT model, year FROM lo) GROUP BY 1 HAVING count(*) = 3), loo AS (SELECT cell, year, any_value(y) AS y, avg(prediction) AS prediction FROM lo JOIN al USING (year) GROUP BY 1, 2)"""


MME, NATIVE = mme_sql(" JOIN cy USING (year)"), mme_sql("")


def mme(spark, d, native=False):
    """(hindcast, observations, model hindcasts, pooled ones): a regression a cell and model."""
    h, o = model_hindcast(spark, d), cubes.observations(spark, d)
    each = seasonal_mme.model_hindcasts(h, o, seasonal_mme.model_years(h, o, native))
    return h, o, each, seasonal_mme.pooled(each)


@query(f"WITH {MME} SELECT model, cell, year, {rnd('y')} AS y, {rnd('prediction')} AS prediction FROM lo")
def mme_model_hindcasts(spark, d):
    return r(mme(spark, d)[2].select("model", "cell", "year", "y", "prediction"))


@query(f"WITH {NATIVE} SELECT model, cell, year, {rnd('y')} AS y, {rnd('prediction')} AS prediction FROM lo")
def mme_native_hindcasts(spark, d):
    """Each model over its own years."""
    return r(mme(spark, d, True)[2].select("model", "cell", "year", "y", "prediction"))


@query(f"WITH {MME} SELECT cell, year, {rnd('y')} AS y, {rnd('prediction')} AS prediction FROM loo")
def mme_ensemble(spark, d):
    return r(mme(spark, d)[3])


@query(f"WITH {MME} SELECT cell, {rnd('avg((prediction - y) ** 2)')} AS pev FROM loo GROUP BY 1")
def mme_pev(spark, d):
    return r(methods.prediction_error_variance(mme(spark, d)[3]))


@query(f"""WITH {MME}, ot AS (SELECT a.cell, a.year, a.prediction, b.y AS oy, b.prediction - b.y AS e FROM loo a JOIN loo b ON a.cell = b.cell AND a.year <> b.year),
k AS (SELECT cell, year, {THIRDS.format('oy')} FROM ot GROUP BY 1, 2), c AS (SELECT cell, year, count(CASE WHEN prediction - e < lo THEN 1 END)::DOUBLE / count(*) AS b, count(CASE WHEN prediction - e > hi THEN 1 END)::DOUBLE / count(*) AS a FROM ot JOIN k USING (cell, year) GROUP BY 1, 2)
SELECT cell, year, {rnd('b')} AS p_below, {rnd('1 - b - a')} AS p_normal, {rnd('a')} AS p_above FROM c""")
def mme_terciles_cv(spark, d):
    return r(seasonal_mme.cv_terciles(mme(spark, d)[3], "bootstrap"))


@query(f"WITH {MME}, a AS (SELECT model, year, avg(prediction) AS a FROM lo GROUP BY 1, 2), b AS (SELECT year, avg(prediction) AS b FROM loo GROUP BY 1) SELECT model, {rnd('corr(a, b)')} AS r FROM a JOIN b USING (year) GROUP BY 1")
def mme_contributions(spark, d):
    _, _, each, cv = mme(spark, d)
    return r(ensembles.contributions(each.withColumnRenamed("prediction", "value"), cv.withColumnRenamed("prediction", "value")))


MME_ISSUED = f"""{OBS}, {HIND}, {MH}, cy AS (SELECT year FROM (SELECT DISTINCT model, year FROM mh) JOIN (SELECT DISTINCT year FROM obs) USING (year) WHERE year < 2001 GROUP BY 1 HAVING count(*) = 3),
pr AS (SELECT model, cell, mh.value AS x, obs.value AS y FROM mh JOIN obs USING (cell, year) JOIN cy USING (year)), ff AS (SELECT model, cell, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM pr GROUP BY 1, 2),
fv AS (SELECT model, cell, a + b * value AS value FROM ff JOIN (SELECT * FROM mh WHERE year = 2001) USING (model, cell)), bo AS (SELECT cell, {THIRDS.format('value')} FROM obs JOIN cy USING (year) GROUP BY 1)"""


def mme_issued(spark, d):
    h, o = model_hindcast(spark, d), cubes.observations(spark, d).where("year < 2001")
    past = h.where("year < 2001")
    years = seasonal_mme.model_years(past, o)
    return seasonal_mme.model_forecasts(past, o, years, h.where("year = 2001")), o.join(F.broadcast(years.select("year").distinct()), "year", "left_semi")


@query(f"WITH {MME_ISSUED} SELECT model, cell, {rnd('value')} AS value FROM fv")
def mme_model_forecasts(spark, d):
    return r(mme_issued(spark, d)[0])


@query(f"WITH {MME_ISSUED}, m AS (SELECT cell, avg(value) AS m, greatest(stddev_pop(value), 1e-12) AS s FROM fv GROUP BY 1), z AS (SELECT cell, (lo - m) / s AS zl, (hi - m) / s AS zh FROM m JOIN bo USING (cell)) {split_sql('cell', 'z')}")
def mme_terciles(spark, d):
    """Three members: a normal distribution."""
    return r(seasonal_mme.issued_terciles(*mme_issued(spark, d)))


@query(f"""WITH {MME}, c AS (SELECT cell, corr(prediction, y) AS r, sqrt(avg((prediction - y) ** 2)) AS e, avg((prediction - y) ** 2) AS mse, var_pop(y) AS v FROM loo GROUP BY 1)
SELECT 'pearson' AS metric, {rnd('avg(r)')} AS score FROM c UNION ALL SELECT 'rmse', {rnd('avg(e)')} FROM c UNION ALL SELECT 'msss', {rnd('1 - avg(mse) / avg(v)')} FROM c WHERE v > 0""")
def mme_skill(spark, d):
    return r(metrics.skill(mme(spark, d)[3].withColumnsRenamed({"prediction": "fc", "y": "obs"}), ["pearson", "rmse", "msss"]))


@query(f"""WITH {MME}, lw AS (SELECT cell, corr(prediction, y) < 0.2 AS low, avg(y) AS m FROM loo GROUP BY 1) SELECT cell, {rnd('CASE WHEN low THEN m ELSE e END')} AS value FROM (SELECT cell, avg(prediction) AS e FROM loo GROUP BY 1) JOIN lw USING (cell)""")
def mme_skill_mask(spark, d):
    cv = mme(spark, d)[3]
    mean = cv.groupBy("cell").agg(F.avg("prediction").alias("value"))
    shares = mean.select("cell", *[F.lit(1 / 3).alias(c) for c in ("p_below", "p_normal", "p_above")])
    return r(seasonal_mme.skill_masked(shares, mean, cv, 0.2)[1])


@query(f"""WITH {MME}, a AS (SELECT 'regression' AS method, avg(r) AS score FROM (SELECT corr(prediction, y) AS r FROM loo GROUP BY cell)), cl AS (SELECT a.cell, a.year, any_value(a.y) AS y, avg(b.y) AS prediction FROM loo a JOIN loo b ON a.cell = b.cell AND a.year <> b.year GROUP BY 1, 2)
SELECT method, {rnd('score')} AS score FROM a UNION ALL SELECT 'climatology', {rnd('(SELECT avg(r) FROM (SELECT corr(prediction, y) AS r FROM cl GROUP BY cell))')}""")
def method_scores(spark, d):
    """The mean correlation of regression and of the other years' mean."""
    h, o, _, _ = mme(spark, d)

    def climatology(h, o):
        cv = mme(spark, d)[3]
        other = cv.select("cell", F.col("year").alias("_y"), F.col("y").alias("_o"))
        return cv.join(other, "cell").where("year <> _y").groupBy("cell", "year").agg(F.first("y").alias("y"), F.avg("_o").alias("prediction"))

    return r(seasonal_mme.best_method(h, o, {"regression": lambda h, o: mme(spark, d)[3], "climatology": climatology})[1])


@query(f"WITH {MODELS}, j AS (SELECT model, cell, mo.value AS fc, obs.value AS obs FROM mo JOIN obs USING (cell, year) WHERE year % 2 = 0) SELECT model, {rnd('avg(r)')} AS score FROM (SELECT model, cell, corr(fc, obs) AS r FROM j GROUP BY 1, 2) GROUP BY 1")
def member_skill(spark, d):
    """On even years."""
    o = cubes.observations(spark, d)
    return r(diagrams.member_skill(models(spark, d), o, o.where("year % 2 = 0").select("year").distinct()))


@query(f"WITH {MODELS}, k AS (SELECT m.cell, m.year, m.value - o.value AS e, m.model FROM mo m JOIN obs o USING (cell, year)), w AS (SELECT cell, year, max(-e * e) AS top FROM k GROUP BY 1, 2) SELECT cell, year, {rnd('any_value(top) + ln(sum(exp(-e * e - top)))')} AS lse FROM k JOIN w USING (cell, year) GROUP BY 1, 2 HAVING count(*) = 3")
def log_sum_exp(spark, d):
    o = cubes.observations(spark, d).withColumnRenamed("value", "o")
    wide = models(spark, d).groupBy("cell", "year").pivot("model", [0, 1, 2]).agg(F.first("value")).join(o, ["cell", "year"]).dropna()
    e = [-(F.col(f"`{i}`") - F.col("o")) ** 2 for i in range(3)]
    return r(wide.select("cell", "year", cccma.log_sum_exp(e).alias("lse")))


# Twelve seasons of three models: the months of ship dates.
SEASON_MEMBERS = """sx AS (SELECT l_suppkey AS cell, (month(l_shipdate) - 1)::INT AS season, year(l_shipdate) AS year, (l_linenumber % 3)::INT AS model, l_linenumber AS member, avg(l_quantity) AS value FROM lineitem WHERE year(l_shipdate) BETWEEN 1996 AND 2000 GROUP BY 1, 2, 3, 4, 5),
sy AS (SELECT l_suppkey AS cell, (month(l_shipdate) - 1)::INT AS season, year(l_shipdate) AS year, avg(l_quantity * (l_linenumber % 4 + 1)) AS value FROM lineitem WHERE year(l_shipdate) BETWEEN 1996 AND 2000 GROUP BY 1, 2, 3)"""


def season_models(spark, d):
    """(cell, season, year, model, member, value; cell, season, year, value)."""
    t = cubes.table(spark, d, "lineitem").where(F.year("l_shipdate").between(1996, 2000))
    keys = [F.col("l_suppkey").alias("cell"), (F.month("l_shipdate") - 1).alias("season"), F.year("l_shipdate").alias("year")]
    x = t.groupBy(*keys, (F.col("l_linenumber") % 3).cast("int").alias("model"), F.col("l_linenumber").alias("member")).agg(F.avg("l_quantity").alias("value"))
    return x, t.groupBy(*keys).agg(F.avg(F.col("l_quantity") * (F.col("l_linenumber") % 4 + 1)).alias("value"))


CCC = f"""{SEASON_MEMBERS}, sz AS (SELECT count(DISTINCT year) AS t, count(DISTINCT model) AS m, count(DISTINCT (model, member)) AS n FROM sx),
dx AS (SELECT *, value - avg(value) OVER (PARTITION BY cell, season, model) AS d FROM sx), aa AS (SELECT cell, season, model, year, avg(d) AS a FROM dx GROUP BY 1, 2, 3, 4), uu AS (SELECT cell, season, year, avg(a) AS x FROM aa GROUP BY 1, 2, 3),
ss AS (SELECT cell, season, sum(d * d) AS whole, sum((d - x) ** 2) AS rest FROM dx JOIN uu USING (cell, season, year) GROUP BY 1, 2),
vv AS (SELECT cell, season, rest / (t * (n - 1) - m + 1) AS noise, (whole - rest) / ((t - 1) * n) - rest / (t * (n - 1) - m + 1) / n AS signal FROM ss, sz)"""


@query(f"WITH {CCC} SELECT cell, season, {rnd('noise')} AS noise, {rnd('signal')} AS signal, {rnd('noise + signal')} AS total FROM vv")
def cccma_variances(spark, d):
    v, _ = cccma.moments(*season_models(spark, d), 12)
    return r(v.select("cell", "season", "noise", "signal", "total"))


@query(f"WITH {CCC}, ym AS (SELECT cell, season, year, value - avg(value) OVER (PARTITION BY cell, season) AS y FROM sy) SELECT cell, season, year, {rnd('x')} AS x, {rnd('y')} AS y FROM uu JOIN ym USING (cell, season, year)")
def cccma_anomalies(spark, d):
    return r(cccma.moments(*season_models(spark, d), 12)[1].select("cell", "season", "year", "x", "y"))


@query()
def cccma_coefficients(spark, d):
    """Constant, independent and smoothed coefficients. No SQL: they are searched for."""
    return r(cccma.fit(*season_models(spark, d)).select("cell", "season", "constant", "independent", "smoothed"))


@query()
def cccma_terciles(spark, d):
    """Shares over the hindcast's years with the smoothed coefficient."""
    x, y = season_models(spark, d)
    return r(cccma.hindcast_terciles(cccma.fit(x, y), cccma.moments(x, y, 12)[1], 5))


@query()
def cccma_skill(spark, d):
    x, y = season_models(spark, d)
    return r(cccma.skill(cccma.fit(x, y), cccma.moments(x, y, 12)[1]))


@query()
def cccma_forecast(spark, d):
    """The last year of the hindcast as a forecast."""
    x, y = season_models(spark, d)
    return r(cccma.predict(cccma.fit(x, y), x.where("year = 2000").drop("year")))


@query(f"""WITH {OBS}, k AS (SELECT cell, value, row_number() OVER (PARTITION BY cell ORDER BY value) AS i, count(*) OVER (PARTITION BY cell) AS n FROM obs), l AS (SELECT cell, max(n) AS n, avg(value) AS l1, sum((2 * i - n - 1) * value) / (max(n) * (max(n) - 1)) AS l2, count(DISTINCT value) AS own FROM k GROUP BY 1),
s AS (SELECT cell, l1, CASE WHEN n > 3 AND own > 1 AND l1 > l2 AND l2 > 0 THEN CASE WHEN l2 / l1 >= 0.5 THEN (1 - l2 / l1) * (0.7213e0 - 0.5947e0 * (1 - l2 / l1)) / (1 + (1 - l2 / l1) * (-2.1817e0 + 1.2113e0 * (1 - l2 / l1)))
  ELSE (1 - 0.3080e0 * pi() * (l2 / l1) ** 2) / (pi() * (l2 / l1) ** 2 * (1 + pi() * (l2 / l1) ** 2 * (-0.05812e0 + 0.01765e0 * pi() * (l2 / l1) ** 2))) END END AS shape FROM l)
SELECT cell, {rnd('shape')} AS shape, {rnd('l1 / shape')} AS scale FROM s""")
def gamma_lmoments(spark, d):
    return r(cccma.gamma_lmoments(cubes.observations(spark, d), ["cell"]))


@query()
def gamma_normal_scores(spark, d):
    """Normal scores by gamma distributions that L-moments fit, and back."""
    o = cubes.observations(spark, d).withColumn("mean", F.lit(1.0))
    fitted = cccma.gamma_lmoments(o, ["cell"]).where("shape IS NOT NULL")
    z = cccma.to_normal(o, fitted, ["cell"], 7)
    back = cccma.from_normal(z, fitted, ["cell"], "mean").withColumnRenamed("value", "back").drop("mean")
    return r(z.drop("mean").join(back, ["cell", "year"]))


@query("SELECT n::INT AS n, round(0.4307273e0 / CASE n WHEN 5 THEN 0.9399856e0 WHEN 10 THEN 0.9726593e0 WHEN 30 THEN 0.9914180e0 ELSE 1e0 END, 6) AS tercile FROM (VALUES (5), (10), (30), (101)) v(n)")
def adjusted_terciles(spark, d):
    """Published factors: 0.9399856, 0.9726593 and 0.9914180 of 5, 10 and 30 values."""
    return spark.createDataFrame([(n, round(cccma.adjusted_tercile(n), 6)) for n in (5, 10, 30, 101)], "n int, tercile double")


def grid_models(spark, d):
    o = cubes.on_grid(cubes.observations(spark, d))
    h = cubes.on_grid(models(spark, d))
    m = spark.createDataFrame([(i,) for i in range(3)], "model int")
    return h, o.crossJoin(F.broadcast(m))  # three models


@query()
def cca_hindcast(spark, d):
    """Cross-validated predictions and leverages of three models. No SQL: singular vectors."""
    h, o = grid_models(spark, d)
    return r(cca.cross_validated(h, o, 2, 2, 1).withColumn("prediction", F.round("prediction", 3)).withColumn("leverage", F.round("leverage", 3)))


@query()
def cca_best_modes(spark, d):
    """Numbers of modes by the mean of Kendall's tau."""
    h, o = grid_models(spark, d)
    return cca.best_modes(h, o, (1, 2), (1, 2), (1, 2)).withColumn("goodness", F.round("goodness", 4))


@query()
def cca_leverages(spark, d):
    h, o = grid_models(spark, d)
    return r(seasonal_mme.average_leverages(cca.cross_validated(h, o, 2, 2, 1)).withColumn("leverage", F.round("leverage", 3)))


@query(f"""WITH {OBS}, {HIND}, o AS (SELECT cell, avg(value) AS o FROM obs WHERE year < (SELECT max(year) FROM hind) GROUP BY 1), m AS (SELECT cell, avg(value) AS m FROM hind WHERE year < (SELECT max(year) FROM hind) GROUP BY 1)
SELECT cell, member, {rnd('o + value - m')} AS value FROM hind JOIN o USING (cell) JOIN m USING (cell) WHERE year = (SELECT max(year) FROM hind)""")
def downscale_by_name(spark, d):
    """The last year held out, by a method's name."""
    return r(downscale("delta", cubes.hindcast(spark, d), cubes.observations(spark, d)))


@query(f"WITH {BOX}, s AS (SELECT year, (v - avg(v) OVER ()) / stddev_pop(v) OVER () AS v FROM box) SELECT year, {rnd('v * 2 - 1')} AS value FROM s")
def custom_index(spark, d):
    """A combination of the caller's own."""
    o = cubes.observations(spark, d)
    return r(climate.custom_index(o, {"box": F.col("cell") % 3 == 0}, lambda b: b["box"] * 2 - 1, "standardized"))


RUN = f"{HIND}, ex AS (SELECT DISTINCT cell % 7 AS country, make_date(year::INT, 1, 1) AS init FROM hind), ar AS (SELECT cell % 7 AS country, make_date(year::INT, 1, 1) AS init, count(*) AS n FROM hind WHERE year <> 1995 GROUP BY 1, 2)"


@query(f"WITH {RUN} SELECT country, init, CASE WHEN n IS NULL THEN 'failed' ELSE 'ok' END AS status, n::VARCHAR AS metrics FROM ex LEFT JOIN ar USING (country, init)")
def published_metrics(spark, d):
    """A row for each expected forecast; those of 1995 have none."""
    h = cubes.hindcast(spark, d).select((F.col("cell") % 7).alias("country"), F.lit("ann").alias("season"), F.make_date("year", F.lit(1), F.lit(1)).alias("init"))
    a = h.where("year(init) <> 1995").groupBy("country", "season", "init").agg(F.count(F.lit(1)).cast("string").alias("metrics"))
    empty = a.where("false").withColumns({"run_date": F.lit("2000-01-01").cast("date"), "status": F.lit("ok")}).select("country", "season", "init", "run_date", "status", "metrics")
    return products.publish(h.distinct(), a, empty, "2000-01-01").select("country", "init", "status", "metrics")
