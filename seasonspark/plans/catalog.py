"""The registered queries and the SQL that they are checked against.

Each query runs over its whole tables. Results are rounded, as the two engines
add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonspark.functions import calendar as cal
from seasonspark.operators import analogs, climate, methods, metrics, terciles, timing
from seasonspark.sources import cubes
from seasonspark.sources.cubes import HIND, OBS, WET, rain_sql
from seasonspark.streaming.rain import windowed_totals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "rpss_pooled"
#: Decimal places of results.
PLACES = 6
FIRST, LAST = "1996-01-01", "2000-12-31"
MONTHS = cal.season_months("OND")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rounded(c: str, places: int = PLACES) -> Column:
    """As SQL's round() of doubles, halves away from zero after scaling; Spark's own rounds the decimal digits, so that it parts from it at ties."""
    x, scale = F.col(c).cast("double"), float(10**places)
    near = F.round(x * scale, 0) / scale
    return F.when(F.abs(near) == float("inf"), x).otherwise(near) + 0.0


def r(df: DataFrame) -> DataFrame:
    """Doubles rounded; a negative zero becomes zero."""
    return df.select(*[rounded(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rnd(x: str) -> str:
    return f"round({x}, {PLACES}) + 0.0"


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """cell, year, fc (mean of members), obs."""
    fc = cubes.hindcast(spark, d).groupBy("cell", "year").agg(F.avg("value").alias("fc"))
    return fc.join(cubes.observations(spark, d).withColumnRenamed("value", "obs"), ["cell", "year"])


PAIRS = f"{OBS}, {HIND}, pairs AS (SELECT cell, year, f.fc, o.value AS obs FROM (SELECT cell, year, avg(value) AS fc FROM hind GROUP BY 1, 2) f JOIN obs o USING (cell, year))"


def bounded(spark: SparkSession, d: str) -> DataFrame:
    """cell, year, cat and the members' shares."""
    obs = cubes.observations(spark, d)
    b = terciles.cpt_boundaries(obs, ["cell"]).where("lo IS NOT NULL")
    p = terciles.counting_probabilities(cubes.hindcast(spark, d), b, ["cell", "year"], ["cell"])
    cats = obs.join(b, "cell").select("cell", "year", terciles.category(F.col("value"), F.col("lo"), F.col("hi")).alias("cat"))
    return p.join(cats, ["cell", "year"])


CPT = """ranked AS (SELECT cell, value, row_number() OVER (PARTITION BY cell ORDER BY value) AS rn, count(*) OVER (PARTITION BY cell) AS n FROM obs),
pos AS (SELECT *, n * (1.0::DOUBLE / 3) + 0.5 AS x, n * (2.0::DOUBLE / 3) + 0.5 AS y FROM ranked),
bounds AS (SELECT cell, max(n) AS n,
  sum(CASE WHEN rn = floor(x) THEN value * (1 - (x - floor(x))) WHEN rn = floor(x) + 1 THEN value * (x - floor(x)) ELSE 0 END) AS lo,
  sum(CASE WHEN rn = floor(y) THEN value * (1 - (y - floor(y))) WHEN rn = floor(y) + 1 THEN value * (y - floor(y)) ELSE 0 END) AS hi
  FROM pos GROUP BY 1 HAVING max(n) >= 3)"""
BOUNDED = f"""{OBS}, {HIND}, {CPT}, p AS (
  SELECT cell, year, count(CASE WHEN value < lo THEN 1 END)::DOUBLE / count(*) AS p_below, count(CASE WHEN value > hi THEN 1 END)::DOUBLE / count(*) AS p_above
  FROM hind JOIN bounds USING (cell) WHERE lo <> hi GROUP BY 1, 2),
b AS (SELECT cell, year, p_below, 1 - p_below - p_above AS p_normal, p_above, CASE WHEN lo > value THEN 0 WHEN hi > value THEN 1 ELSE 2 END AS cat
  FROM p JOIN obs USING (cell, year) JOIN bounds USING (cell)),
t AS (SELECT *, ((p_below - (cat <= 0)::INT) ** 2 + (p_below + p_normal - (cat <= 1)::INT) ** 2) / 2 AS rps,
  ((1.0::DOUBLE / 3 - (cat <= 0)::INT) ** 2 + (2.0::DOUBLE / 3 - (cat <= 1)::INT) ** 2) / 2 AS clim FROM b)"""


def season(spark: SparkSession, d: str) -> DataFrame:
    """Daily rain of the season by season year and step."""
    rain = cubes.spined(cubes.daily_rain(spark, d), FIRST, LAST)
    rows = rain.select("cell", cal.season_year(F.col("d"), MONTHS).alias("year"), cal.season_step(F.col("d"), MONTHS).alias("step"), "value")
    return rows.where("year IS NOT NULL")


SEASON = f"""{rain_sql(FIRST, LAST)}, season AS (
  SELECT cell, year(d) AS year, date_diff('day', make_date(year(d), 10, 1), d) AS step, value FROM rain WHERE month(d) IN (10, 11, 12))"""
RUNS = f"""{SEASON}, runs AS (SELECT *, step - coalesce(max(CASE WHEN value > 1 THEN step END) OVER (PARTITION BY cell, year ORDER BY step ROWS UNBOUNDED PRECEDING), -1) AS run FROM season)"""
ONSET = f"""{RUNS}, scan AS (SELECT *,
  sum(value) OVER (w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS total, count(*) OVER (w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS n,
  count(*) OVER (w ROWS BETWEEN 3 FOLLOWING AND 23 FOLLOWING) AS g, coalesce(max(run) OVER (w ROWS BETWEEN 9 FOLLOWING AND 23 FOLLOWING), 0) AS worst
  FROM runs WINDOW w AS (PARTITION BY cell, year ORDER BY step)),
onsets AS (SELECT cell, year, min(CASE WHEN n = 3 AND total >= 20 AND g = 21 AND worst < 7 THEN step END) AS onset FROM scan GROUP BY 1, 2)"""


@query(f"WITH {BOUNDED} SELECT {rnd('1 - avg(rps) / avg(clim)')} AS rpss FROM t")
def rpss_pooled(spark, d):
    return r(metrics.rpss(bounded(spark, d)))


@query(f"WITH {BOUNDED} SELECT cell, {rnd('1 - avg(rps) / avg(clim)')} AS rpss FROM t GROUP BY 1")
def rpss_spatial(spark, d):
    return r(metrics.rpss(bounded(spark, d), ["cell"]))


@query(f"WITH {OBS}, {CPT} SELECT cell, {rnd('CASE WHEN lo <> hi THEN lo END')} AS lo, {rnd('CASE WHEN lo <> hi THEN hi END')} AS hi FROM bounds")
def quantile_cpt(spark, d):
    return r(terciles.cpt_boundaries(cubes.observations(spark, d), ["cell"]))


@query(f"WITH {OBS} SELECT cell, {rnd('quantile_cont(value, 1.0::DOUBLE / 3)')} AS lo, {rnd('quantile_cont(value, 2.0::DOUBLE / 3)')} AS hi FROM obs GROUP BY 1")
def quantile_type7(spark, d):
    return r(terciles.type7_boundaries(cubes.observations(spark, d), ["cell"]))


@query(f"WITH {BOUNDED} SELECT cell, year, {rnd('p_below')} AS p_below, {rnd('p_normal')} AS p_normal, {rnd('p_above')} AS p_above, cat FROM b")
def tercile_counting(spark, d):
    return r(bounded(spark, d))


@query(f"""WITH {BOUNDED}, k AS (SELECT cell, year, m, p_below, p_normal, p_above, m + 1 AS weight FROM b, (VALUES (0), (1)) v(m) WHERE m = 0 OR year % 2 = 0)
SELECT cell, year, {rnd('sum(weight * p_below) / sum(weight)')} AS p_below, {rnd('sum(weight * p_normal) / sum(weight)')} AS p_normal, {rnd('sum(weight * p_above) / sum(weight)')} AS p_above FROM k GROUP BY 1, 2""")
def combine_terciles(spark, d):
    """Two models of weights 1 and 2, the second without odd years."""
    b = bounded(spark, d)
    second = b.withColumns({p: F.when(F.col("year") % 2 == 0, F.col(p)) for p in ("p_below", "p_normal", "p_above")})
    return r(terciles.combine(b.withColumn("weight", F.lit(1.0)).unionByName(second.withColumn("weight", F.lit(2.0))), ["cell", "year"]))


@query(f"""WITH {BOUNDED}, h AS (SELECT p_below AS p, sum((cat = 0)::INT) AS hit, sum((cat <> 0)::INT) AS miss FROM b GROUP BY 1),
u AS (SELECT *, coalesce(sum(miss) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under FROM h)
SELECT {rnd('(sum(hit * (under + miss / 2.0::DOUBLE)) / (sum(hit) * sum(miss)))::DOUBLE')} AS area FROM u""")
def roc_area_below(spark, d):
    return r(metrics.roc_area(bounded(spark, d), F.col("cat") == 0, "p_below"))


@query(f"""WITH {BOUNDED}, h AS (SELECT p_above AS p, sum((cat = 2)::INT) AS hit, sum((cat <> 2)::INT) AS miss FROM b GROUP BY 1),
u AS (SELECT *, coalesce(sum(miss) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under FROM h)
SELECT {rnd('(sum(hit * (under + miss / 2.0::DOUBLE)) / (sum(hit) * sum(miss)))::DOUBLE')} AS area FROM u""")
def roc_area_above(spark, d):
    return r(metrics.roc_area(bounded(spark, d), F.col("cat") == 2, "p_above"))


@query(f"""WITH {BOUNDED} SELECT least(floor(p_below * 5), 4)::BIGINT AS bin, count(*) AS n, {rnd('avg(p_below)')} AS mean_p, {rnd('avg((cat = 0)::INT)')} AS freq FROM b GROUP BY 1""")
def reliability_bins(spark, d):
    return r(metrics.reliability_bins(bounded(spark, d), F.col("cat") == 0, "p_below"))


@query(f"""WITH {BOUNDED}, f AS (SELECT cat AS o, CASE WHEN p_below >= p_normal AND p_below >= p_above THEN 0 WHEN p_normal >= p_above THEN 1 ELSE 2 END AS f FROM b),
x AS (SELECT count(*)::DOUBLE AS n, sum((f = o)::INT)::DOUBLE AS c, sum((f = 0)::INT)::DOUBLE * sum((o = 0)::INT) + sum((f = 1)::INT)::DOUBLE * sum((o = 1)::INT) + sum((f = 2)::INT)::DOUBLE * sum((o = 2)::INT) AS e FROM f)
SELECT {rnd('(c - e / n) / (n - e / n)')} AS hss FROM x""")
def heidke(spark, d):
    return r(metrics.heidke(bounded(spark, d)))


@query(f"WITH {PAIRS} SELECT cell, {rnd('corr(fc, obs)')} AS r FROM pairs GROUP BY 1")
def pearson_r(spark, d):
    return r(metrics.pearson(pairs(spark, d), ["cell"]))


@query(f"""WITH {PAIRS}, k AS (SELECT cell, rank() OVER (PARTITION BY cell ORDER BY fc) + (count(*) OVER (PARTITION BY cell, fc) - 1) / 2.0::DOUBLE AS a,
  rank() OVER (PARTITION BY cell ORDER BY obs) + (count(*) OVER (PARTITION BY cell, obs) - 1) / 2.0::DOUBLE AS b FROM pairs)
SELECT cell, {rnd('corr(a, b)')} AS rho FROM k GROUP BY 1""")
def spearman(spark, d):
    return r(metrics.spearman(pairs(spark, d), ["cell"]))


@query(f"WITH {PAIRS} SELECT cell, {rnd('sqrt(avg((fc - obs) * (fc - obs)))')} AS rmse FROM pairs GROUP BY 1")
def rmse(spark, d):
    return r(metrics.rmse(pairs(spark, d), ["cell"]))


@query(f"WITH {PAIRS}, k AS (SELECT cell, avg((fc - obs) * (fc - obs)) AS mse, var_pop(obs) AS v FROM pairs GROUP BY 1) SELECT {rnd('1 - avg(mse) / avg(v)')} AS msss FROM k WHERE v > 0")
def msss(spark, d):
    return r(metrics.msss(pairs(spark, d), ["cell"]))


@query(f"""WITH {PAIRS} SELECT a.cell, {rnd('avg(CASE WHEN a.fc > b.fc THEN 1.0 WHEN a.fc = b.fc THEN 0.5 ELSE 0.0 END)')} AS score
FROM pairs a JOIN pairs b ON a.cell = b.cell AND a.obs > b.obs GROUP BY 1""")
def two_afc(spark, d):
    return r(metrics.two_afc(pairs(spark, d), ["cell"]))


SPREAD = f"{OBS}, {HIND}, se AS (SELECT cell, year, spread, abs(m - value) AS error FROM (SELECT cell, year, stddev_pop(value) AS spread, avg(value) AS m FROM hind GROUP BY 1, 2) JOIN obs USING (cell, year))"


@query(f"WITH {SPREAD} SELECT {rnd('avg(spread) / avg(error)')} AS ratio FROM se")
def spread_error_ratio(spark, d):
    s = metrics.spread_error(cubes.hindcast(spark, d), cubes.observations(spark, d))
    return r(s.agg((F.avg("spread") / F.avg("error")).alias("ratio")))


@query(f"WITH {SPREAD} SELECT cell, {rnd('corr(spread, error)')} AS r FROM se GROUP BY 1 HAVING count(*) >= 3")
def spread_error_corr(spark, d):
    s = metrics.spread_error(cubes.hindcast(spark, d), cubes.observations(spark, d))
    return r(s.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.corr("spread", "error").alias("r")).where("n >= 3").drop("n"))


LOO = f"""{PAIRS}, loo AS (SELECT cell, year, obs AS y, obs - (obs - regr_intercept(obs, fc) OVER w - regr_slope(obs, fc) OVER w * fc)
  / (1 - (1.0::DOUBLE / count(*) OVER w + (fc - avg(fc) OVER w) ** 2 / regr_sxx(obs, fc) OVER w)) AS prediction FROM pairs WINDOW w AS (PARTITION BY cell))"""


@query(f"WITH {LOO} SELECT cell, {rnd('CASE WHEN count(*) >= 5 THEN corr(prediction, y) END')} AS r FROM loo GROUP BY 1")
def loo_corr(spark, d):
    return r(metrics.loo_correlation(pairs(spark, d).withColumnsRenamed({"fc": "x", "obs": "y"}), ["cell"]))


@query(f"WITH {LOO} SELECT cell, year, {rnd('prediction')} AS prediction FROM loo")
def cv_loyo(spark, d):
    return r(methods.leave_one_out(pairs(spark, d).withColumnsRenamed({"fc": "x", "obs": "y"})).drop("y"))


@query(f"WITH {LOO} SELECT cell, {rnd('avg((prediction - y) * (prediction - y))')} AS pev FROM loo GROUP BY 1")
def pev(spark, d):
    return r(methods.prediction_error_variance(methods.leave_one_out(pairs(spark, d).withColumnsRenamed({"fc": "x", "obs": "y"}))))


@query(f"WITH {LOO} SELECT cell, {rnd('quantile_cont(prediction - y, 0.1)')} AS low, {rnd('quantile_cont(prediction - y, 0.9)')} AS high FROM loo GROUP BY 1")
def error_bounds(spark, d):
    return r(methods.error_bounds(methods.leave_one_out(pairs(spark, d).withColumnsRenamed({"fc": "x", "obs": "y"})), 0.8))


@query(f"""WITH {PAIRS} SELECT cell, count(*) AS n, {rnd('regr_slope(obs, fc)')} AS slope, {rnd('regr_intercept(obs, fc)')} AS intercept,
{rnd('(regr_syy(obs, fc) - regr_sxy(obs, fc) ** 2 / regr_sxx(obs, fc)) / greatest(count(*) - 2, 1)')} AS pev FROM pairs GROUP BY 1 HAVING count(*) >= 3 AND regr_sxx(obs, fc) >= 1e-12""")
def ereg_fit(spark, d):
    return r(methods.ereg_fit(cubes.hindcast(spark, d), cubes.observations(spark, d)))


@query(f"""WITH {OBS}, {HIND}, o AS (SELECT cell, avg(value) AS o FROM obs WHERE year < 2000 GROUP BY 1), m AS (SELECT cell, avg(value) AS m FROM hind WHERE year < 2000 GROUP BY 1)
SELECT cell, member, {rnd('o + value - m')} AS value FROM hind JOIN o USING (cell) JOIN m USING (cell) WHERE year = 2000""")
def delta(spark, d):
    h, o = cubes.hindcast(spark, d), cubes.observations(spark, d)
    return r(methods.delta(h.where("year < 2000"), o.where("year < 2000"), h.where("year = 2000")))


@query(f"""WITH {OBS}, {HIND}, o AS (SELECT cell, avg(value) AS om, stddev_samp(value) AS os FROM obs WHERE year < 2000 GROUP BY 1),
y AS (SELECT cell, year, avg(value) AS value FROM hind WHERE year < 2000 GROUP BY 1, 2), m AS (SELECT cell, avg(value) AS gm, stddev_samp(value) AS gs FROM y GROUP BY 1)
SELECT cell, member, {rnd('om + (value - gm) / CASE WHEN gs < 1e-12 THEN 1 ELSE gs END * os')} AS value FROM hind JOIN o USING (cell) JOIN m USING (cell) WHERE year = 2000""")
def qm_parametric(spark, d):
    h, o = cubes.hindcast(spark, d), cubes.observations(spark, d)
    return r(methods.quantile_map_parametric(h.where("year < 2000"), o.where("year < 2000"), h.where("year = 2000")))


@query(f"WITH {OBS} SELECT cell, {rnd('regr_slope(value, year)')} AS slope FROM obs GROUP BY 1")
def dqm_trend(spark, d):
    return r(methods.qm_detrended_slope(cubes.observations(spark, d)))


@query(f"""WITH {PAIRS}, k AS (SELECT cell, corr(fc, obs) AS c FROM pairs GROUP BY 1), t AS (SELECT cell, 1 - abs(c) AS p FROM k WHERE c IS NOT NULL),
q AS (SELECT cell, p, p * count(*) OVER () / rank() OVER (ORDER BY p) AS x FROM t)
SELECT cell, {rnd('p')} AS p, {rnd('least(1.0, min(x) OVER (ORDER BY p DESC))')} AS q FROM q""")
def fdr_bh(spark, d):
    """Over a stand-in for p values, 1 - |r|, added up in a fixed order: ranks part what differs in the last bit."""
    fc = metrics.mean_in_order(cubes.hindcast(spark, d), ["cell", "year"], "member").withColumnRenamed("value", "fc")
    held = fc.join(cubes.observations(spark, d).withColumnRenamed("value", "obs"), ["cell", "year"])
    t = metrics.pearson_in_order(held, ["cell"], "year").where("r IS NOT NULL").select("cell", (1 - F.abs("r")).alias("p"))
    return r(metrics.fdr_bh(t))


@query(f"WITH {WET} SELECT cell, d, make_date(year(d), month(d), CASE WHEN day(d) <= 10 THEN 1 WHEN day(d) <= 20 THEN 11 ELSE 21 END) AS start, ((month(d) - 1) * 3 + CASE WHEN day(d) <= 10 THEN 1 WHEN day(d) <= 20 THEN 2 ELSE 3 END)::INT AS dekad FROM wet")
def dekad_of_year(spark, d):
    return cubes.daily_rain(spark, d).select("cell", "d", cal.dekad_start(F.col("d")).alias("start"), cal.dekad_of_year(F.col("d")).cast("int").alias("dekad"))


@query(f"""WITH {WET} SELECT DISTINCT d, make_date(year(d), month(d), least((day(d) - 1) // 5, 5) * 5 + 1) AS start,
CAST(CASE WHEN day(d) >= 26 THEN date_trunc('month', d) + INTERVAL 1 MONTH ELSE make_date(year(d), month(d), least((day(d) - 1) // 5, 5) * 5 + 1) + INTERVAL 5 DAY END AS DATE) AS stop FROM wet""")
def pentad_windows(spark, d):
    s = cal.pentad_start(F.col("d"))
    return cubes.daily_rain(spark, d).select("d", s.alias("start"), cal.pentad_end(s).alias("stop")).distinct()


@query(f"""WITH {WET} SELECT cell, make_date(year(d), month(d), CASE WHEN day(d) <= 10 THEN 1 WHEN day(d) <= 20 THEN 11 ELSE 21 END) AS start, sum(value) AS value FROM wet GROUP BY 1, 2""")
def dekad_totals(spark, d):
    return cubes.daily_rain(spark, d).groupBy("cell", cal.dekad_start(F.col("d")).alias("start")).agg(F.sum("value").alias("value"))


@query(f"WITH {WET} SELECT cell, year(d) AS year, sum(value) AS value FROM wet WHERE month(d) IN (3, 4, 5) GROUP BY 1, 2")
def seasonal_reduce(spark, d):
    return climate.seasonal_reduce(cubes.daily_rain(spark, d), cal.season_months("MAM"))


@query(f"""WITH {WET}, s AS (SELECT cell, d, CASE WHEN month(d) >= 11 THEN year(d) WHEN month(d) = 1 THEN year(d) - 1 END AS year, value FROM wet)
SELECT cell, year, date_diff('day', make_date(year, 11, 1), d)::INT AS step, value FROM s WHERE year IS NOT NULL""")
def seasonal_stack(spark, d):
    """Wraps the year's end: NDJ."""
    m = cal.season_months("NDJ")
    rain = cubes.daily_rain(spark, d)
    return rain.select("cell", cal.season_year(F.col("d"), m).alias("year"), cal.season_step(F.col("d"), m).alias("step"), "value").where("year IS NOT NULL")


@query(f"""WITH {OBS}, k AS (SELECT cell, year, value, count(*) OVER w AS n, sum(value) OVER w AS s FROM obs WINDOW w AS (PARTITION BY cell ORDER BY year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT cell, year, {rnd('CASE WHEN n = 3 THEN s END')} AS acc FROM k""")
def accumulate_rolling(spark, d):
    return r(climate.accumulate_rolling(cubes.observations(spark, d), ["cell"], "year", 3).select("cell", "year", "acc"))


PLACE = f"{OBS}, k AS (SELECT cell, year, rank() OVER (PARTITION BY cell ORDER BY value) - 1 AS below, count(*) OVER (PARTITION BY cell, value) AS tied, count(*) OVER (PARTITION BY cell) AS n FROM obs)"


@query(f"WITH {PLACE} SELECT cell, year, {rnd('(below + 0.5::DOUBLE * tied) / n')} AS position FROM k")
def percentile_empirical(spark, d):
    return r(climate.percentile_position(cubes.observations(spark, d), ["cell"]).select("cell", "year", "position"))


@query(f"WITH {PLACE} SELECT cell, year, {rnd('(below + 0.5::DOUBLE * tied + 0.5) / (n + 1)')} AS position FROM k")
def percentile_weibull(spark, d):
    return r(climate.percentile_position(cubes.observations(spark, d), ["cell"], "weibull").select("cell", "year", "position"))


@query(f"WITH {OBS} SELECT cell, year, {rnd('100 * value / avg(value) OVER (PARTITION BY cell)')} AS percent FROM obs")
def percent_of_normal(spark, d):
    return r(climate.percent_of_normal(cubes.observations(spark, d), ["cell"]).select("cell", "year", "percent"))


@query(f"WITH {OBS} SELECT cell, year, rank() OVER (PARTITION BY cell ORDER BY value DESC)::INT AS rank FROM obs")
def rank_of_record(spark, d):
    return climate.rank_of_record(cubes.observations(spark, d), ["cell"]).select("cell", "year", "rank")


@query(f"""WITH {OBS}, {HIND}, k AS (SELECT cell, quantile_cont(value, 0.2) AS t FROM obs GROUP BY 1) SELECT cell, {rnd('avg((value < t)::INT)')} AS frequency FROM hind JOIN k USING (cell) GROUP BY 1""")
def frequency_below(spark, d):
    return r(climate.frequency_below(cubes.hindcast(spark, d), cubes.observations(spark, d), ["cell"], 0.2))


DOY = f"{WET}, k AS (SELECT cell, dayofyear(d)::INT AS doy, avg(value) AS m FROM wet GROUP BY 1, 2)"


@query(f"""WITH {DOY}, s AS (SELECT cell, ((doy + o - 1 + 366) % 366 + 1)::INT AS doy, m FROM k, (VALUES (-1), (0), (1)) v(o))
SELECT cell, doy, {rnd('avg(m)')} AS clim FROM s GROUP BY 1, 2""")
def doy_climatology(spark, d):
    return r(climate.doy_climatology(cubes.daily_rain(spark, d), 3))


@query(f"WITH {DOY} SELECT cell, d, {rnd('value - m')} AS anomaly FROM (SELECT *, dayofyear(d)::INT AS doy FROM wet) JOIN k USING (cell, doy)")
def doy_anomaly(spark, d):
    rain = cubes.daily_rain(spark, d)
    return r(climate.doy_anomaly(rain, climate.doy_climatology(rain)))


@query(f"""WITH e AS (SELECT event_type AS cell, greatest(ceil(floor((epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '2024-01-01')) / 3600) / 24), 1) AS day, value FROM events),
w AS (SELECT cell, value, name AS window FROM e JOIN (VALUES ('week1', 1, 7), ('week2', 8, 14), ('month', 1, 30)) v(name, a, b) ON day BETWEEN a AND b)
SELECT cell, "window", {rnd('avg(value)')} AS value FROM w GROUP BY 1, 2""")
def lead_window_reduce(spark, d):
    return r(climate.lead_window_reduce(cubes.lead_forecast(spark, d), {"week1": (1, 7), "week2": (8, 14), "month": (1, 30)}))


BOX = f"{OBS}, box AS (SELECT year, avg(value) AS v FROM obs WHERE cell % 3 = 0 GROUP BY 1)"


@query(f'WITH {BOX} SELECT year, {rnd("v")} AS "index" FROM box')
def index_box_mean(spark, d):
    return r(climate.index_box(cubes.observations(spark, d), F.col("cell") % 3 == 0))


@query(f'WITH {BOX} SELECT year, {rnd("(v - avg(v) OVER ()) / stddev_pop(v) OVER ()")} AS "index" FROM box')
def index_standardized(spark, d):
    return r(climate.index_box(cubes.observations(spark, d), F.col("cell") % 3 == 0, "standardized"))


@query(f"""WITH {BOX}, s AS (SELECT year, abs(v - (SELECT v FROM box WHERE year = 1998)) AS score FROM box WHERE year <> 1998)
SELECT year, {rnd('score')} AS score, row_number() OVER (ORDER BY score, year)::INT AS rank FROM s""")
def analogs_index(spark, d):
    return r(analogs.by_index(climate.index_box(cubes.observations(spark, d), F.col("cell") % 3 == 0), 1998))


FIELD = f"{OBS}, f AS (SELECT o.year, o.value, t.value AS t FROM obs o JOIN obs t ON o.cell = t.cell AND t.year = 1998 WHERE o.year <> 1998)"


@query(f"""WITH {FIELD}, s AS (SELECT year, sqrt(avg((value - t) * (value - t))) AS score FROM f GROUP BY 1) SELECT year, {rnd('score')} AS score, row_number() OVER (ORDER BY score, year)::INT AS rank FROM s""")
def analogs_field_rmse(spark, d):
    return r(analogs.by_field(cubes.observations(spark, d), 1998))


@query(f"""WITH {FIELD}, s AS (SELECT year, 1 - corr(value, t) AS score FROM f GROUP BY 1) SELECT year, {rnd('score')} AS score, row_number() OVER (ORDER BY score, year)::INT AS rank FROM s""")
def analogs_field_corr(spark, d):
    return r(analogs.by_field(cubes.observations(spark, d), 1998, "correlation"))


@query(f"""WITH {FIELD}, {BOX[len(OBS) + 2:]}, a AS (SELECT year, abs(v - (SELECT v FROM box WHERE year = 1998)) AS score FROM box WHERE year <> 1998),
s AS (SELECT year, (a.score + b.score) / 2 AS score FROM a JOIN (SELECT year, sqrt(avg((value - t) * (value - t))) AS score FROM f GROUP BY 1) b USING (year))
SELECT year, {rnd('score')} AS score, row_number() OVER (ORDER BY score, year)::INT AS rank FROM s""")
def analog_and(spark, d):
    o = cubes.observations(spark, d)
    return r(analogs.both(analogs.by_index(climate.index_box(o, F.col("cell") % 3 == 0), 1998), analogs.by_field(o, 1998)))


@query(f"""WITH {FIELD}, s AS (SELECT year, 1 / (sqrt(avg((value - t) * (value - t))) + 1) AS w FROM f GROUP BY 1) SELECT year, {rnd('w / sum(w) OVER ()')} AS weight FROM s""")
def analog_weights(spark, d):
    return r(analogs.weights(analogs.by_field(cubes.observations(spark, d), 1998), 1.0))


@query(f"WITH {SEASON}, k AS (SELECT *, count(*) OVER w AS n, sum(value) OVER w AS s FROM season WINDOW w AS (PARTITION BY cell, year ORDER BY step ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)) SELECT cell, year, step::INT AS step, CASE WHEN n = 10 THEN s END AS total FROM k")
def rolling_total_forward(spark, d):
    return timing.rolling_total(season(spark, d), 10).select("cell", "year", "step", "total")


@query(f"WITH {RUNS} SELECT cell, year, step::INT AS step, run::INT AS run FROM runs")
def dry_run_lengths(spark, d):
    return timing.dry_runs(season(spark, d), 1.0).select("cell", "year", "step", F.col("run").cast("int").alias("run"))


@query(f"WITH {RUNS} SELECT cell, year, max(run)::INT AS longest, count(CASE WHEN run = 7 THEN 1 END) AS spells FROM runs GROUP BY 1, 2")
def dry_spell(spark, d):
    return timing.dry_spells(season(spark, d)).withColumn("longest", F.col("longest").cast("int"))


@query(f"WITH {ONSET} SELECT cell, year, onset::INT AS onset FROM onsets")
def onset(spark, d):
    return timing.onset(season(spark, d))


@query(f"""WITH {ONSET}, k AS (SELECT *, lead(run, 6) OVER (PARTITION BY cell, year ORDER BY step) AS ends FROM runs)
SELECT cell, year, onset::INT AS onset, min(CASE WHEN run = 1 AND ends = 7 AND step >= onset THEN step END)::INT AS cessation,
(min(CASE WHEN run = 1 AND ends = 7 AND step >= onset THEN step END) - onset)::INT AS length FROM k JOIN onsets USING (cell, year) GROUP BY cell, year, onset""")
def season_length(spark, d):
    rows = season(spark, d)
    return timing.cessation(rows, timing.onset(rows)).withColumn("length", F.col("cessation") - F.col("onset"))


@query("SELECT date_trunc('day', ts) AS start, event_type AS cell, round(sum(value), 6) AS total, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_totals(spark, d):
    t = windowed_totals(cubes.table(spark, d, "events"))
    return t.withColumn("total", rounded("total"))
