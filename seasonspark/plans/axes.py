"""Registered queries on time axes, leads, alignment, analog selections, diagrams and products."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from seasonspark.functions import calendar as cal
from seasonspark.operators import alignment, analogs, climate, completion, diagrams, indices, leads, methods, regrid, terciles, timing
from seasonspark.plans.catalog import BOUNDED, BOX, FIELD, FIRST, LAST, ONSET, PAIRS, SEASON, bounded, pairs, query, r, rnd, rounded, season
from seasonspark.plans.forecasts import MODELS, models
from seasonspark.sources import cubes, issuance, products, verification
from seasonspark.sources.cubes import GRID, HIND, OBS, WET, rain_sql

DEKAD = "make_date(year({0}), month({0}), CASE WHEN day({0}) <= 10 THEN 1 WHEN day({0}) <= 20 THEN 11 ELSE 21 END)"
PENTAD = "make_date(year({0}), month({0}), least((day({0}) - 1) // 5, 5) * 5 + 1)"


def days(spark, d):
    return cubes.daily_rain(spark, d).select("d").distinct()


@query(f"""WITH {WET}, k AS (SELECT DISTINCT d, CAST({DEKAD.format('d')} AS DATE) AS start FROM wet)
SELECT d, start, CAST(CASE WHEN day(start) < 21 THEN start + INTERVAL 10 DAY ELSE date_trunc('month', start) + INTERVAL 1 MONTH END AS DATE) AS stop FROM k""")
def dekad_windows(spark, d):
    start = cal.dekad_start(F.col("d"))
    return days(spark, d).select("d", start.alias("start"), cal.dekad_end(start).alias("stop"))


@query(f"""WITH {WET}, k AS (SELECT DISTINCT d, CAST({DEKAD.format('CAST(d + INTERVAL 1 DAY AS DATE)')} AS DATE) AS a, CAST(d + INTERVAL 46 DAY AS DATE) AS z FROM wet),
e AS (SELECT d, CAST(g AS DATE) AS g FROM k, generate_series(a, z, INTERVAL 1 DAY) s(g)) SELECT DISTINCT d AS issuance, CAST({DEKAD.format('g')} AS DATE) AS dekad FROM e""")
def issuance_dekads(spark, d):
    """Dekads of leads of 1 to 46 days."""
    return days(spark, d).select(F.col("d").alias("issuance"), F.explode(cal.issuance_dekads(F.col("d"), 1, 46)).alias("dekad"))


@query(f"""WITH {WET}, t AS (SELECT DISTINCT 'daily' AS axis, d AS t FROM wet UNION SELECT DISTINCT 'dekad', CAST({DEKAD.format('d')} AS DATE) FROM wet
  UNION SELECT DISTINCT 'pentad', CAST({PENTAD.format('d')} AS DATE) FROM wet UNION SELECT DISTINCT 'monthly', CAST(date_trunc('month', d) AS DATE) FROM wet UNION SELECT DISTINCT 'yearly', CAST(date_trunc('year', d) AS DATE) FROM wet),
g AS (SELECT axis, date_diff('day', lag(t) OVER (PARTITION BY axis ORDER BY t), t) AS g FROM t), m AS (SELECT axis, CAST(median(g) AS DOUBLE) AS s FROM g GROUP BY 1)
SELECT axis, {rnd('s')} AS spacing, CASE WHEN s < 1.5 THEN 'daily' WHEN s < 6.5 THEN 'pentad' WHEN s < 12 THEN 'dekad' WHEN s < 45 THEN 'monthly' END AS cadence FROM m""")
def cadences(spark, d):
    one, t = days(spark, d), F.col("d")
    axes = {"daily": t, "dekad": cal.dekad_start(t), "pentad": cal.pentad_start(t), "monthly": F.trunc(t, "MM"), "yearly": F.trunc(t, "YY")}
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("axis"), v.alias("t")) for k, v in axes.items()])).alias("_x")).select("_x.*")
    return r(cal.cadence(rows, "t", ["axis"]))


@query(f"""WITH {WET}, k AS (SELECT DISTINCT d FROM wet), s AS (SELECT d, d BETWEEN DATE '1997-10-15' AND DATE '1998-02-28' AS inside, d BETWEEN DATE '1997-10-15' AND DATE '1998-03-05' AS tail,
  ((month(d) - 1) * 3 + CASE WHEN day(d) <= 10 THEN 0 WHEN day(d) <= 20 THEN 1 ELSE 2 END) - 28 + (year(d) - 1997) * 36 AS dekad, ((month(d) - 1) * 6 + least((day(d) - 1) // 5, 5)) - 56 + (year(d) - 1997) * 72 AS pentad FROM k)
SELECT d, CASE WHEN inside THEN date_diff('day', DATE '1997-10-15', d) ELSE -1 END::INT AS daily, CASE WHEN inside THEN dekad ELSE -1 END::INT AS dekad, CASE WHEN tail THEN pentad ELSE -1 END::INT AS pentad,
CASE WHEN d BETWEEN DATE '1997-10-01' AND DATE '1998-02-28' THEN month(d) - 10 + (year(d) - 1997) * 12 ELSE -1 END::INT AS month FROM s""")
def season_steps(spark, d):
    """A season over the year's end, by dates and by months, with a tail of five days for pentads."""
    dates, t = ("1997-10-15", "1998-02-28"), F.col("d")
    return days(spark, d).select("d", cal.step_in_season(t, dates, 1997, "daily").alias("daily"), cal.step_in_season(t, dates, 1997, "dekad").alias("dekad"), cal.step_in_season(t, dates, 1997, "pentad", 5).alias("pentad"), cal.step_in_season(t, (10, 2), 1997, "monthly").alias("month"))


@query(f"""WITH g AS (SELECT CAST(g AS DATE) AS d FROM generate_series(DATE '1997-06-15', DATE '1997-09-30', INTERVAL 1 DAY) s(g))
SELECT 'daily' AS cadence, d AS t FROM g UNION ALL SELECT DISTINCT 'dekad', CAST({DEKAD.format('d')} AS DATE) FROM g UNION ALL SELECT DISTINCT 'pentad', CAST({PENTAD.format('d')} AS DATE) FROM g UNION ALL SELECT DISTINCT 'monthly', CAST(date_trunc('month', d) AS DATE) FROM g""")
def season_axis(spark, d):
    """Steps of a season that begins within a dekad."""
    one, out = spark.range(1), None
    for name in ("daily", "dekad", "pentad", "monthly"):
        t = one.select(F.lit(name).alias("cadence"), F.explode(cal.season_times(("1997-06-15", "1997-09-30"), 1997, name)).alias("t"))
        out = t if out is None else out.unionByName(t)
    return out


@query(f"""WITH {WET}, ds AS (SELECT DISTINCT d FROM wet WHERE dayofweek(d) = 1), e AS (SELECT CAST(g AS DATE) AS issuance FROM generate_series(DATE '{FIRST}', DATE '{LAST}', INTERVAL 1 DAY) s(g) WHERE dayofweek(g) IN (1, 4))
SELECT issuance FROM e WHERE issuance NOT IN (SELECT d FROM ds)""")
def new_issuances(spark, d):
    """Mondays with rain are stored already."""
    stored = days(spark, d).where(F.dayofweek("d") == 2).select(F.col("d").alias("issuance"))
    return cal.new_issuances(F.lit(FIRST).cast("date"), F.lit(LAST).cast("date"), stored)


@query("""WITH s(season, m, inits) AS (VALUES ('OND', 10, [7, 8, 9]), ('MAM', 3, [1, 2, 12]), ('JJAS', 6, [4, 5])), t AS (SELECT *, CASE WHEN make_date(1997, m, 1) > DATE '1997-08-20' THEN make_date(1997, m, 1) ELSE make_date(1998, m, 1) END AS start FROM s),
i AS (SELECT season, start, make_date(year(start) - b, x, 1) AS init FROM (SELECT season, start, unnest(inits) AS x FROM t), (VALUES (0), (1)) v(b))
SELECT season, start AS season_start, max(CASE WHEN init <= DATE '1997-08-20' AND init < start THEN init END) AS init FROM i GROUP BY 1, 2""")
def next_targets(spark, d):
    s = spark.createDataFrame([("OND", 10, [7, 8, 9]), ("MAM", 3, [1, 2, 12]), ("JJAS", 6, [4, 5])], "season string, start_month int, init_months array<int>")
    return cal.next_targets(s, F.lit("1997-08-20").cast("date"))


EVENTS = """fc AS (SELECT event_type AS cell, floor((epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '2024-01-01')) / 3600) AS lead, value FROM events),
ax AS (SELECT lead, lead / 24.0 AS days, ceil(round(lead / 24.0, 9))::INT AS day, coalesce(lead / 24.0 - lag(lead / 24.0) OVER (ORDER BY lead), CASE WHEN lead > 0 THEN lead / 24.0 ELSE coalesce(lead(lead / 24.0) OVER (ORDER BY lead) - lead / 24.0, 1) END) AS w FROM (SELECT DISTINCT lead FROM fc))"""


def event_forecast(spark, d):
    return cubes.lead_forecast(spark, d).withColumnRenamed("lead_h", "lead")


@query(f"WITH {EVENTS} SELECT lead::BIGINT AS lead, {rnd('days::DOUBLE')} AS days, day, {rnd('w::DOUBLE')} AS length FROM ax")
def lead_axis(spark, d):
    return r(leads.lead_axis(event_forecast(spark, d)))


@query(f"WITH {EVENTS} SELECT cell, {rnd('(sum(value * w) / sum(w))::DOUBLE')} AS value FROM fc JOIN ax USING (lead) WHERE day BETWEEN 1 AND 7 GROUP BY 1")
def forecast_window_mean(spark, d):
    """Hours count by their length."""
    return r(leads.forecast_window(event_forecast(spark, d), "week1", ["cell"], complete=False))


@query(f"WITH {EVENTS} SELECT cell, {rnd('sum(value * w)::DOUBLE')} AS value FROM fc JOIN ax USING (lead) WHERE day BETWEEN 8 AND 14 GROUP BY 1")
def forecast_window_rate(spark, d):
    """The integral of a rate."""
    return r(leads.forecast_window(event_forecast(spark, d), (8, 14), ["cell"], how="sum", units="mm/day", complete=False))


@query(f"""WITH {EVENTS}, n AS (SELECT day, count(*) AS n FROM ax WHERE day >= 1 GROUP BY 1), k AS (SELECT day FROM n WHERE NOT (day = (SELECT max(day) FROM n) AND n < coalesce((SELECT n FROM n ORDER BY day DESC LIMIT 1 OFFSET 1), 0)))
SELECT cell, CAST(DATE '2024-01-01' + (day - 1) * INTERVAL 1 DAY AS DATE) AS d, {rnd('sum(value)')} AS value FROM fc JOIN ax USING (lead) JOIN k USING (day) GROUP BY 1, 2""")
def forecast_increments(spark, d):
    """Amounts by day; a last day with fewer hours is left out."""
    return r(leads.increments(event_forecast(spark, d), "2024-01-01", ["cell"], units="mm"))


MH = "mh AS (SELECT (member % 3)::INT AS model, cell, year, avg(value) AS value FROM hind WHERE NOT (member % 3 = 0 AND year = 1997) GROUP BY 1, 2, 3)"


def model_hindcast(spark, d):
    """model, cell, year, value; the first model lacks a year."""
    h = cubes.hindcast(spark, d).withColumn("model", (F.col("member") % 3).cast("int")).where("NOT (model = 0 AND year = 1997)")
    return h.groupBy("model", "cell", "year").agg(F.avg("value").alias("value"))


@query(f"WITH {OBS}, {HIND}, {MH} SELECT DISTINCT model, year FROM mh JOIN (SELECT DISTINCT year FROM obs) USING (year)")
def native_years(spark, d):
    return alignment.native_years(model_hindcast(spark, d), cubes.observations(spark, d))


@query(f"WITH {OBS}, {HIND}, {MH} SELECT year FROM (SELECT DISTINCT model, year FROM mh) JOIN (SELECT DISTINCT year FROM obs) USING (year) GROUP BY 1 HAVING count(*) = 3")
def common_years(spark, d):
    return alignment.common_years(model_hindcast(spark, d), cubes.observations(spark, d))


@query(f"WITH {OBS}, {HIND}, {MH} SELECT DISTINCT year FROM mh JOIN (SELECT DISTINCT year FROM obs) USING (year)")
def union_years(spark, d):
    return alignment.union_years(model_hindcast(spark, d), cubes.observations(spark, d))


@query(f"WITH {OBS}, {HIND} SELECT DISTINCT year FROM obs WHERE year IN (SELECT year FROM hind)")
def covered_years(spark, d):
    return alignment.covered_years(cubes.hindcast(spark, d), cubes.observations(spark, d))


@query(f"WITH {OBS}, i AS (SELECT year, avg(value) AS x FROM obs WHERE cell % 3 = 0 GROUP BY 1) SELECT cell, year, {rnd('value')} AS value, {rnd('x')} AS x FROM obs JOIN i USING (year)")
def index_years(spark, d):
    o = cubes.observations(spark, d)
    return r(alignment.same_years(climate.index_box(o, F.col("cell") % 3 == 0).withColumnRenamed("index", "value"), o)).select("cell", "year", "value", "x")


@query(f"WITH {OBS}, {HIND}, {MH} SELECT cell, year, model, {rnd('value')} AS value FROM mh WHERE year IN (SELECT year FROM (SELECT DISTINCT model, year FROM mh) GROUP BY 1 HAVING count(*) = 3)")
def super_ensemble(spark, d):
    """One member a model, over the years of all."""
    rows = model_hindcast(spark, d).withColumn("member", F.lit(0))
    return r(alignment.super_ensemble(rows).select("cell", "year", F.col("member.model").alias("model"), "value"))


@query(f"""WITH {GRID}, a AS (SELECT DISTINCT lat FROM grid), b AS (SELECT DISTINCT lat * 2 + 0.5 AS coarse FROM grid)
SELECT lat, arg_min(coarse, (abs(lat - coarse), coarse)) AS parent FROM a, b GROUP BY 1""")
def nearest_parent(spark, d):
    g = cubes.on_grid(cubes.observations(spark, d)).select("lat", "lon")
    return alignment.nearest_parent(g, g.select((F.col("lat") * 2 + 0.5).alias("lat")), "lat")


@query(f"""WITH {GRID}, g AS (SELECT DISTINCT lat, lon FROM grid), m AS (SELECT lat, lon FROM g WHERE lat <= 8 AND lat % 2 = 0), z AS (SELECT max(lat) AS z FROM m),
p AS (SELECT g.lat, g.lon, (SELECT arg_min(x, (abs(g.lat - x), x)) FROM (SELECT DISTINCT lat AS x FROM m)) AS p FROM g)
SELECT lat, lon, lat BETWEEN -1 AND z + 1 AND (p + lon) % 3 = 0 AND (p, lon) IN (SELECT (lat, lon) FROM m) AS dry, false AS outside FROM p, z""")
def region_masks(spark, d):
    """A mask on every second latitude up to 8."""
    g = cubes.on_grid(cubes.observations(spark, d)).select("lat", "lon").distinct()
    mask = g.where("lat <= 8 AND lat % 2 = 0").withColumn("masked", (F.col("lat") + F.col("lon")) % 3 == 0)
    return alignment.region_masks(g, dry=mask)


@query(f"WITH {GRID}, a AS (SELECT DISTINCT lon * lon AS lon FROM grid), n AS (SELECT lon, lag(lon) OVER (ORDER BY lon) AS a, lead(lon) OVER (ORDER BY lon) AS z FROM a) SELECT lon, {rnd('CASE WHEN a IS NULL THEN lon - (z - lon) / 2 ELSE (a + lon) / 2 END')} AS low, {rnd('CASE WHEN z IS NULL THEN lon + (lon - a) / 2 ELSE (z + lon) / 2 END')} AS high FROM n")
def grid_edges(spark, d):
    """Of an uneven axis."""
    g = cubes.on_grid(cubes.observations(spark, d))
    return r(alignment.grid_edges(g.select((F.col("lon") * F.col("lon")).alias("lon")), "lon"))


@query(f"WITH {HIND} SELECT cell, year, bool_or(CASE WHEN value > 20 THEN value END IS NOT NULL) AS has FROM hind GROUP BY 1, 2")
def has_data(spark, d):
    h = cubes.hindcast(spark, d).withColumn("value", F.when(F.col("value") > 20, F.col("value")))
    return alignment.has_data(h, ["cell", "year"])


@query(f"""WITH {WET}, h AS (SELECT DISTINCT d FROM wet), w AS (SELECT year, CAST(g AS DATE) AS d FROM (SELECT DISTINCT year(d) AS year FROM h) y, LATERAL (SELECT unnest(generate_series(make_date(year::INT, 10, 1), make_date(year::INT, 12, 31), INTERVAL 1 DAY)) AS g)),
j AS (SELECT w.*, h.d AS have FROM w LEFT JOIN h ON w.d = h.d), e AS (SELECT year, min(have) AS a, max(have) AS z FROM j GROUP BY 1)
SELECT year, count(CASE WHEN have IS NULL AND (a IS NULL OR d < a) THEN 1 END) AS late, count(CASE WHEN have IS NULL AND d > z THEN 1 END) AS early, count(CASE WHEN have IS NULL AND d BETWEEN a AND z THEN 1 END) AS inside FROM j JOIN e USING (year) GROUP BY 1""")
def record_gaps(spark, d):
    return alignment.record_gaps(days(spark, d), F.make_date("year", F.lit(10), F.lit(1)), F.make_date("year", F.lit(12), F.lit(31)))


@query(f"WITH {BOX} SELECT year, {rnd('v - (regr_intercept(v, year) OVER () + regr_slope(v, year) OVER () * year)')} AS value FROM box")
def index_detrended(spark, d):
    index = climate.index_box(cubes.observations(spark, d), F.col("cell") % 3 == 0).withColumnRenamed("index", "value")
    return r(alignment.detrended(index)[0])


@query(f"WITH {OBS} SELECT cell, {rnd('avg(value)')} AS value FROM obs WHERE year BETWEEN 1997 AND 1999 GROUP BY 1")
def baseline_mean(spark, d):
    return r(alignment.baseline(cubes.observations(spark, d), 1997, 1999).groupBy("cell").agg(F.avg("value").alias("value")))


def by_field(spark, d):
    return analogs.by_field(cubes.observations(spark, d), 1998)


RANKED = f"{FIELD}, s AS (SELECT year, sqrt(avg((value - t) * (value - t))) AS score FROM f GROUP BY 1), k AS (SELECT year, score, row_number() OVER (ORDER BY score, year)::INT AS rank FROM s)"


@query(f"WITH {RANKED} SELECT year, {rnd('score')} AS score, rank FROM k WHERE rank <= 3")
def analogs_top(spark, d):
    return r(analogs.top(by_field(spark, d), 3))


@query(f"WITH {OBS} SELECT DISTINCT year, CASE year WHEN 1998 THEN 0.0 WHEN 1996 THEN 0.0 END::DOUBLE AS score, CASE year WHEN 1998 THEN 1 WHEN 1996 THEN 2 END::INT AS rank FROM obs WHERE year IN (SELECT year FROM obs)")
def analogs_from_years(spark, d):
    return analogs.from_years(spark, [1998, 1996], cubes.observations(spark, d).select("year"))


@query(f"""WITH {RANKED}, {BOX[len(OBS) + 2:]}, w AS (SELECT year, score FROM k WHERE year IN (SELECT year FROM box WHERE v > (SELECT avg(v) FROM box)))
SELECT year, {rnd('score')} AS score, row_number() OVER (ORDER BY score, year)::INT AS rank FROM w""")
def analogs_where(spark, d):
    """Years with an index above its mean, by their field's distance."""
    index = climate.index_box(cubes.observations(spark, d), F.col("cell") % 3 == 0, "anomaly").where("year <> 1998")
    return r(analogs.where(index, F.col("index") > 0, by_field(spark, d)))


@query(f"WITH {RANKED} SELECT year, {rnd('CASE WHEN year % 2 = 0 THEN score END')} AS score FROM k")
def analogs_restricted(spark, d):
    s = by_field(spark, d)
    return r(analogs.restricted(s.select("year", "score"), s.where("year % 2 = 0").select("year")))


@query(f"""WITH {RANKED}, {BOX[len(OBS) + 2:]}, a AS (SELECT *, row_number() OVER (ORDER BY score, year)::INT AS rank FROM (SELECT year, abs(v - (SELECT v FROM box WHERE year = 1998)) AS score FROM box WHERE year <> 1998)),
u AS (SELECT year, score, 0 AS s, rank FROM a WHERE rank <= 2 UNION ALL SELECT year, score, 1, rank FROM k WHERE rank <= 3), g AS (SELECT year, avg(score) AS score, min(s * 1000 + rank) AS o FROM u GROUP BY 1)
SELECT year, {rnd('score')} AS score, row_number() OVER (ORDER BY o)::INT AS rank FROM g""")
def analogs_either(spark, d):
    index = analogs.by_index(climate.index_box(cubes.observations(spark, d), F.col("cell") % 3 == 0), 1998)
    return r(analogs.either(analogs.top(index, 2), analogs.top(by_field(spark, d), 3)))


@query(f"WITH {RANKED} SELECT year, {rnd('score')} AS score, row_number() OVER (ORDER BY rank)::INT AS rank FROM k WHERE year % 2 = 1")
def analogs_kept(spark, d):
    s = by_field(spark, d)
    return r(analogs.kept(s, s.select("year", (F.col("year") % 2 == 1).alias("keep"))))


CURVES = f"{WET}, cv AS (SELECT year(d) AS year, month(d) AS step, avg(value) AS value FROM wet GROUP BY 1, 2)"


@query(f"""WITH {CURVES}, t AS (SELECT step, value AS t FROM cv WHERE year = 1996), s AS (SELECT year, corr(value, t) AS r, avg(abs(value - t)) AS mad, count(*) AS n FROM cv JOIN t USING (step) WHERE year <> 1996 GROUP BY 1),
q AS (SELECT year, (row_number() OVER (ORDER BY r DESC, year) + row_number() OVER (ORDER BY mad, year))::INT AS score FROM s WHERE n >= 2) SELECT year, score, row_number() OVER (ORDER BY score, year)::INT AS rank FROM q""")
def analogs_evolution(spark, d):
    """By the course of the months."""
    curves = cubes.daily_rain(spark, d).groupBy(F.year("d").alias("year"), F.month("d").alias("step")).agg(F.avg("value").alias("value"))
    return analogs.by_evolution(curves, 1996).withColumn("score", F.col("score").cast("int"))


SCENES = f"{OBS}, {HIND}, a AS (SELECT cell, year AS scenario, member AS step, value FROM hind WHERE year BETWEEN 1996 AND 1999), o AS (SELECT cell, member AS step, value FROM hind WHERE year = 2000 AND member <= 2), sc AS (SELECT a.cell, a.scenario, a.step, coalesce(o.value, a.value) AS value, CASE WHEN o.value IS NULL THEN 'analog' ELSE 'observed' END AS segment FROM a LEFT JOIN o ON a.cell = o.cell AND a.step = o.step)"


def scenes(spark, d):
    h = cubes.hindcast(spark, d).withColumnRenamed("member", "step")
    return completion.scenarios(h.where("year = 2000 AND step <= 2").select("cell", "step", "value"), h.where("year BETWEEN 1996 AND 1999"))


@query(f"WITH {SCENES} SELECT cell, scenario, step, {rnd('value')} AS value, segment FROM sc")
def season_scenarios(spark, d):
    """Members stand in for steps."""
    return r(scenes(spark, d))


@query(f"WITH {SCENES} SELECT cell, scenario, step FROM sc WHERE segment = 'observed'")
def segment_steps(spark, d):
    return scenes(spark, d).where("segment = 'observed'").select("cell", "scenario", "step")


TOTALS = f"{SCENES}, tt AS (SELECT cell, scenario, CASE WHEN count(value) = 3 THEN sum(value) END AS total FROM sc WHERE step <= 3 GROUP BY 1, 2)"


@query(f"WITH {TOTALS} SELECT cell, {rnd('CASE WHEN count(total) = count(*) THEN quantile_cont(total, 0.5) END')} AS median, {rnd('CASE WHEN count(total) = count(*) THEN avg(total) END')} AS mean FROM tt GROUP BY 1")
def scenario_consensus(spark, d):
    t = completion.totals(scenes(spark, d).where("step <= 3"), 3)
    return r(completion.consensus(t).withColumnRenamed("consensus", "median").join(completion.consensus(t, "mean").withColumnRenamed("consensus", "mean"), "cell"))


@query(f"WITH {TOTALS} SELECT cell, {rnd('CASE WHEN count(total) = count(*) THEN sum(total * (scenario - 1995)) / sum(scenario - 1995) END')} AS consensus FROM tt GROUP BY 1")
def scenario_weighted_mean(spark, d):
    t = completion.totals(scenes(spark, d).where("step <= 3"), 3)
    return r(completion.consensus(t, "mean", t.select("scenario").distinct().withColumn("weight", F.col("scenario") - 1995.0)))


KEYED = f"{HIND}, ks AS (SELECT DISTINCT CASE WHEN cell % 2 = 0 THEN 'even' ELSE 'odd' END AS country, make_date(year::INT, 1, 1) AS issuance, member::VARCHAR AS method, make_date(year::INT, 2, 1) AS target_dekad FROM hind)"


@query(f"WITH {KEYED} SELECT * FROM ks WHERE NOT (country = 'even' AND year(issuance) <= 1996)")
def pending_work(spark, d):
    """Forecasts that have no score yet."""
    day = [F.make_date("year", F.lit(m), F.lit(1)) for m in (1, 2)]
    store = cubes.hindcast(spark, d).select(F.when(F.col("cell") % 2 == 0, "even").otherwise("odd").alias("country"), day[0].alias("issuance"), F.col("member").cast("string").alias("method"), day[1].alias("target_dekad"))
    return issuance.pending(store, store.where("country = 'even' AND year(issuance) <= 1996"))


CAT = "(VALUES (0), (1), (2)) c(category)"
CURVE = f"{BOUNDED}, x AS (SELECT category, CASE category WHEN 0 THEN p_below WHEN 1 THEN p_normal ELSE p_above END AS p, (cat = category)::INT AS e FROM b, {CAT}), h AS (SELECT category, p, sum(e) AS hit, sum(1 - e) AS miss FROM x GROUP BY 1, 2)"


@query(f"""WITH {CURVE} SELECT category, {rnd('p')} AS p, {rnd('sum(hit) OVER w / sum(hit) OVER (PARTITION BY category)')} AS tpr, {rnd('sum(miss) OVER w / sum(miss) OVER (PARTITION BY category)')} AS fpr FROM h WINDOW w AS (PARTITION BY category ORDER BY p DESC ROWS UNBOUNDED PRECEDING)""")
def roc_curve(spark, d):
    return r(diagrams.roc_curve(bounded(spark, d)))


@query(f"""WITH {CURVE}, u AS (SELECT *, coalesce(sum(miss) OVER (PARTITION BY category ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under FROM h)
SELECT category, {rnd('CASE WHEN sum(hit) * sum(miss) > 0 THEN (sum(hit * (under + miss / 2.0::DOUBLE)) / (sum(hit) * sum(miss)))::DOUBLE ELSE 0.5 END')} AS area FROM u GROUP BY 1""")
def roc_areas(spark, d):
    return r(diagrams.roc_areas(bounded(spark, d)))


@query(f"WITH {CURVE} SELECT category, least(floor(p * 5), 4)::BIGINT AS bin, count(*) AS n, {rnd('avg(p)')} AS mean_p, {rnd('avg(e)')} AS freq FROM x GROUP BY 1, 2")
def reliability_diagram(spark, d):
    return r(diagrams.reliability(bounded(spark, d)))


@query(f"""WITH {OBS}, {HIND}, t7 AS (SELECT cell, quantile_cont(value, 1.0::DOUBLE / 3) AS lo, quantile_cont(value, 2.0::DOUBLE / 3) AS hi FROM obs GROUP BY 1),
p AS (SELECT cell, year, avg((value < lo)::INT) AS b, avg((value > hi)::INT) AS a FROM hind JOIN t7 USING (cell) WHERE lo <> hi GROUP BY 1, 2), c AS (SELECT p.*, (value < lo)::INT AS ob, (value <= hi)::INT AS ou FROM p JOIN obs USING (cell, year) JOIN t7 USING (cell)),
s AS (SELECT year, avg((b - ob) ** 2 + (1 - a - ou) ** 2) AS f, avg((1.0::DOUBLE / 3 - ob) ** 2 + (2.0::DOUBLE / 3 - ou) ** 2) AS c FROM c GROUP BY 1) SELECT year, {rnd('CASE WHEN c <> 0 THEN 1 - f / c END')} AS rpss FROM s""")
def issuance_rpss(spark, d):
    return r(diagrams.issuance_rpss(cubes.hindcast(spark, d), cubes.observations(spark, d)))


@query(f"""WITH {MODELS}, j AS (SELECT model, cell, mo.value AS fc, obs.value AS obs FROM mo JOIN obs USING (cell, year)), a AS (SELECT model, cell, corr(fc, obs) AS r, sqrt(avg((fc - obs) ** 2)) AS e FROM j GROUP BY 1, 2)
SELECT model, {rnd('avg(r)')} AS pearson, {rnd('avg(e)')} AS rmse FROM a GROUP BY 1""")
def comparison_table(spark, d):
    return r(diagrams.comparison(models(spark, d), cubes.observations(spark, d), ["pearson", "rmse"]))


PROBS = f"{BOUNDED}, g AS (SELECT (cell // 5)::DOUBLE AS lat, (cell % 5)::DOUBLE AS lon, p_below, p_normal, p_above FROM b WHERE year = 1997)"


@query(f"WITH {PROBS}, q AS (SELECT lat, lon, unnest([0, 1, 2]) AS tercile, unnest([p_below, p_normal, p_above]) AS p FROM g) SELECT lat, lon, tercile::INT AS tercile, round((p * 100)::FLOAT::DOUBLE, 4) + 0.0 AS value FROM q")
def tercile_product(spark, d):
    """Shares as the product's percentages."""
    g = cubes.on_grid(bounded(spark, d).where("year = 1997").withColumn("value", F.lit(0.0))).drop("value")
    return products.long_terciles(products.tercile_product(g)).withColumn("value", rounded("value", 4))


@query(f"WITH {BOUNDED}, j AS (SELECT a.p_below AS x1, a.p_normal AS x2, a.p_above AS x3, z.p_below AS y1, z.p_normal AS y2, z.p_above AS y3 FROM b a JOIN b z ON a.cell = z.cell WHERE a.year = 1997 AND z.year = 1996) SELECT round(avg((abs(x1 - y1) + abs(x2 - y2) + abs(x3 - y3)) / 3 * 100), 4) + 0.0 AS mae FROM j")
def tercile_mae(spark, d):
    """In percentage points, of two years."""
    g = cubes.on_grid(bounded(spark, d).withColumn("value", F.lit(0.0)))
    a, b = (products.long_terciles(products.tercile_product(g.where(f"year = {y}"))) for y in (1997, 1996))
    return products.tercile_mae(a, b).withColumn("mae", rounded("mae", 4))


@query("""SELECT name, count(*) AS n, round(avg((v IS NULL)::INT), 6) + 0.0 AS missing, min(v) AS low, max(v) AS high
FROM (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_suppkey']) AS name, unnest([l_quantity::DOUBLE, l_extendedprice::DOUBLE, l_discount::DOUBLE, l_suppkey::DOUBLE]) AS v FROM lineitem) GROUP BY 1""")
def dataset_profile(spark, d):
    t = cubes.table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_suppkey")
    return products.profile(t).select("name", "n", rounded("missing").alias("missing"), "low", "high")


@query(f"WITH {WET}, c AS (SELECT DISTINCT epoch(d) / 86400 AS v FROM wet), g AS (SELECT v, v - lag(v) OVER (ORDER BY v) AS g FROM c) SELECT count(*) AS size, min(v)::DOUBLE AS first, max(v)::DOUBLE AS last, CASE WHEN min(g) = max(g) THEN min(g)::DOUBLE END AS step FROM g")
def coordinate_profile(spark, d):
    return products.coordinate(days(spark, d).select(F.unix_date("d").cast("double").alias("v")), "v")


@query(f"WITH {WET} SELECT DISTINCT d, ((month(d) - 1) * 3 + CASE WHEN day(d) <= 10 THEN 0 WHEN day(d) <= 20 THEN 1 ELSE 2 END)::INT AS dekad, (month(d) - 1)::INT AS month, ((month(d) - 1) * 6 + least((day(d) - 1) // 5, 5))::INT AS pentad FROM wet")
def year_steps(spark, d):
    t = F.col("d")
    return days(spark, d).select("d", *[cal.step_of_year(t, c).cast("int").alias(n) for c, n in (("dekad", "dekad"), ("monthly", "month"), ("pentad", "pentad"))])


@query(f"""WITH {rain_sql('1996-10-01', '1996-12-31')}, k AS (SELECT cell, d, value > 20 AS hot, row_number() OVER (PARTITION BY cell ORDER BY d) - row_number() OVER (PARTITION BY cell, value > 20 ORDER BY d) AS g FROM rain)
SELECT cell, min(d) AS first, max(d) AS last, count(*) AS n FROM k WHERE hot GROUP BY cell, g""")
def contiguous_runs(spark, d):
    rain = cubes.spined(cubes.daily_rain(spark, d), "1996-10-01", "1996-12-31")
    return diagrams.runs(rain, ["cell"], "d", F.col("value") > 20)


@query(f"WITH {GRID}, l AS (SELECT lat, lon, avg(value) AS v FROM grid GROUP BY 1, 2), w AS (SELECT *, greatest(cos(radians(lat)), 0) AS w FROM l) SELECT {rnd('sum(v * w) / sum(w)')} AS mean FROM w")
def weighted_mean(spark, d):
    """Cells weighed by the cosine of their latitude."""
    g = cubes.on_grid(cubes.observations(spark, d)).groupBy("lat", "lon").agg(F.avg("value").alias("value"))
    w = climate.cosine_weight(F.col("lat"))
    return r(g.agg((F.sum(F.col("value") * w) / F.sum(w)).alias("mean")))


@query(f"WITH {BOUNDED}, g AS (SELECT (cell // 5)::DOUBLE AS lat, (cell % 5)::DOUBLE AS lon, year FROM b) SELECT DISTINCT lat, lon, regexp_extract('ua850', '^[a-z]+') AS variable, 850 AS level FROM g WHERE lat BETWEEN 0.5 AND 8.5")
def grid_subset(spark, d):
    """Half a degree around latitudes 1 to 8, with a variable's name taken apart."""
    g = cubes.on_grid(bounded(spark, d).withColumn("value", F.lit(0.0))).select("lat", "lon").distinct()
    name = products.variable_name(F.lit("ua850"))
    return regrid.around(g, 1.0, 8.0, 0.0, 4.0).select("lat", "lon", name["name"].alias("variable"), name["level"].alias("level"))


@query(f"WITH {PAIRS} SELECT cell, year, row_number() OVER (PARTITION BY cell ORDER BY fc, year)::INT - 1 AS rank FROM pairs")
def skill_ranks(spark, d):
    return analogs.ordinal_rank(pairs(spark, d), ["cell"], "fc", "year").select("cell", "year", "rank")


WORLD = f"{OBS}, wf AS (SELECT year, (cell % 9) * 10 - 40.0::DOUBLE AS lat, (cell // 9 * 37 % 36) * 10 + 5.0::DOUBLE AS lon, value FROM obs)"


def world(spark, d):
    """Cells dealt over the globe: year, lat, lon, value."""
    c = F.col("cell")
    return cubes.observations(spark, d).select("year", ((c % 9) * 10 - 40.0).alias("lat"), (F.floor(c / 9) * 37 % 36 * 10 + 5.0).alias("lon"), "value")


def box_sql(name: str, west: float, east: float, south: float, north: float, w: str = "1") -> str:
    return f"{name} AS (SELECT year, sum(value * {w}) / sum({w}) AS v FROM wf WHERE lat BETWEEN {south} AND {north} AND lon BETWEEN {west} AND {east} GROUP BY 1)"


COSINE = "greatest(cos(radians(lat)), 0)"


@query(f"WITH {WORLD}, {box_sql('a', 0, 180, -30, 30, COSINE)}, {box_sql('b', 180, 360, -30, 30, COSINE)} SELECT year, {rnd('(a.v - avg(a.v) OVER ()) - (b.v - avg(b.v) OVER ())')} AS value FROM a JOIN b USING (year)")
def index_dipole(spark, d):
    """The difference of two boxes' anomalies, weighed by latitude."""
    own = indices.named("dmi", boxes={"wtio": (-30, 30, 0, 180), "setio": (-30, 30, 180, 359.9)})
    return r(indices.reduce(world(spark, d), own))


@query(f"WITH {WORLD}, {box_sql('a', 0, 360, -20, 20)} SELECT year, {rnd('(v - (SELECT avg(v) FROM a WHERE year BETWEEN 1996 AND 1999)) / (SELECT stddev_pop(v) FROM a WHERE year BETWEEN 1996 AND 1999)')} AS value FROM a")
def index_baseline(spark, d):
    """Standard scores by a baseline of four years."""
    own = indices.named("nino34", boxes={"nino34": indices.box_of("tropics")}, baseline=(1996, 1999))
    return r(indices.reduce(world(spark, d), own))


TRIANGLE = [[(-1.0, -1.0), (5.0, -1.0), (-1.0, 12.5)], [(0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5)]]
IN_TRIANGLE = "lat > -1 AND lon > -1 AND lon < 5 - 6 * (lat + 1) / 13.5 AND NOT (lat BETWEEN 0.5 AND 1.5 AND lon BETWEEN 0.5 AND 1.5)"


@query(f"WITH {GRID} SELECT year, lat, lon, CASE WHEN {IN_TRIANGLE} THEN {rnd('value')} END AS value FROM grid")
def geometry_mask(spark, d):
    """A triangle with a hole."""
    return r(indices.geometry_mask(cubes.on_grid(cubes.observations(spark, d)), TRIANGLE)).select("year", "lat", "lon", "value")


@query(f"WITH {GRID} SELECT year, lat, lon, {rnd('value')} AS value FROM grid WHERE {IN_TRIANGLE}")
def geometry_clip(spark, d):
    return r(indices.geometry_clip(cubes.on_grid(cubes.observations(spark, d)), TRIANGLE)).select("year", "lat", "lon", "value")


@query(f"WITH {GRID}, h AS (SELECT lat, lon + year / 10000 AS lon, value FROM grid) SELECT floor(lat / 2) * 2 + 0.5::DOUBLE AS lat, floor(lon / 2) * 2 + 1 AS lon, {rnd('avg(value)')} AS elevation, {rnd('stddev_pop(value)')} AS roughness FROM (SELECT lat, floor(lon) AS lon, value FROM h) WHERE lat < (SELECT floor(max(lat) / 2) * 2 + 2 FROM h) AND lon < 4 GROUP BY 1, 2")
def terrain_cells(spark, d):
    """Means and roughness of blocks of two by two."""
    g = cubes.on_grid(cubes.observations(spark, d))
    heights = g.select("lat", (F.col("lon") + F.col("year") / 10000).alias("lon"), "value")
    top = int(g.agg(F.max("lat")).first()[0])
    lat = spark.createDataFrame([(k + 0.5, float(k - 0.5), float(k + 1.5)) for k in range(0, top + 1, 2)], "lat double, low double, high double")
    lon = spark.createDataFrame([(k + 1.0, float(k), float(k + 2)) for k in (0, 2)], "lon double, low double, high double")
    return r(indices.terrain(heights, lat, lon))


DEKADS = f"{WET}, dk AS (SELECT cell, CAST({DEKAD.format('d')} AS DATE) AS d, sum(value) AS value FROM wet GROUP BY 1, 2)"


def dekads(spark, d):
    return cubes.daily_rain(spark, d).groupBy("cell", cal.dekad_start(F.col("d")).alias("d")).agg(F.sum("value").alias("value"))


@query(f"WITH {DEKADS} SELECT cell, year(d)::INT AS year, {rnd('value')} AS value FROM dk WHERE dayofyear(d) = dayofyear(DATE '1999-05-11') AND year(d) BETWEEN 1995 AND 1998")
def dekad_climatology(spark, d):
    return r(verification.dekad_climatology(dekads(spark, d), F.lit("1999-05-11").cast("date"), 1995, 1998))


@query(f"WITH {rain_sql('1997-03-01', '1997-03-31')}, g AS (SELECT * FROM rain WHERE NOT (cell % 2 = 0 AND d = DATE '1997-03-15')) SELECT cell, {rnd('avg(value)')} AS value FROM g WHERE d BETWEEN DATE '1997-03-11' AND DATE '1997-03-20' GROUP BY 1 HAVING count(DISTINCT d) = 10")
def live_dekad(spark, d):
    """Every second cell lacks a day."""
    rain = cubes.spined(cubes.daily_rain(spark, d), "1997-03-01", "1997-03-31")
    return r(verification.live_dekad(rain.where("NOT (cell % 2 = 0 AND d = DATE '1997-03-15')"), F.lit("1997-03-11").cast("date")))


@query(f"WITH {DEKADS} SELECT cell, d, {rnd('CASE WHEN month(d) <= 6 THEN value ELSE 2 * value END')} AS value, CASE WHEN month(d) <= 6 THEN 'final' ELSE 'live' END AS origin FROM dk WHERE month(d) <= 9")
def obs_with_fallback(spark, d):
    """Final to June, live to September."""
    k = dekads(spark, d)
    live = k.where("month(d) <= 9").withColumn("value", 2 * F.col("value"))
    return r(verification.obs_with_fallback(k, k.where("month(d) <= 6"), live))


@query(f"WITH {WET} SELECT cell, year(d)::INT AS year, {rnd('avg(value)')} AS value FROM wet WHERE month(d) IN (10, 11, 12) AND year(d) BETWEEN 1996 AND 1999 GROUP BY 1, 2")
def obs_seasons(spark, d):
    return r(verification.obs_seasons(cubes.daily_rain(spark, d), cal.season_months("OND"), 1996, 1999))


@query("SELECT l_suppkey AS cell, year(l_shipdate)::INT AS year, l_linenumber AS member, round(avg(l_quantity), 6) + 0.0 AS value FROM lineitem WHERE year(l_shipdate) BETWEEN 1996 AND 1999 GROUP BY 1, 2, 3")
def model_seasons(spark, d):
    t = cubes.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("cell"), F.to_date("l_shipdate").alias("d"), F.col("l_linenumber").alias("member"), F.col("l_quantity").alias("value"))
    return r(verification.model_seasons(t, 1996, 1999))


@query(f"WITH {ONSET} SELECT cell, year, onset::INT AS onset, CAST(make_date(year::INT, 10, 1) + onset * INTERVAL 1 DAY AS DATE) AS date FROM onsets")
def onset_dates(spark, d):
    return verification.event_dates(timing.onset(season(spark, d)), F.make_date("year", F.lit(10), F.lit(1)), "onset")


@query(f"WITH {SEASON} SELECT DISTINCT year::INT AS year, date_diff('day', make_date(year::INT, 10, 1), make_date(year::INT, 12, 31))::INT + 1 AS width FROM season")
def season_widths(spark, d):
    return verification.season_widths(season(spark, d), F.make_date("year", F.lit(10), F.lit(1)), F.make_date("year", F.lit(12), F.lit(31)))


@query(f"WITH {OBS}, k AS (SELECT cell, bool_or(value IS NOT NULL) AS has FROM obs GROUP BY 1) SELECT cell, {rnd(repr(NormalDist().inv_cdf(1 / 3)) + '::DOUBLE')} AS lo, {rnd(repr(NormalDist().inv_cdf(2 / 3)) + '::DOUBLE')} AS hi FROM k WHERE has")
def transformed_boundaries(spark, d):
    """Terciles of normal scores, of cells with data."""
    return r(terciles.transformed_boundaries(cubes.observations(spark, d), ["cell"]))


SERIES = f"{OBS}, src AS (SELECT value FROM obs WHERE cell % 2 = 0), tgt AS (SELECT value FROM obs WHERE cell % 2 = 1)"


@query(f"WITH {SERIES}, s AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM src), t AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM tgt) SELECT year, cell, {rnd('t.m + (value - s.m) / s.s * t.s')} AS value FROM obs, s, t WHERE cell % 2 = 0")
def series_quantile_map(spark, d):
    """One series onto another, by their moments."""
    o = cubes.observations(spark, d)
    return r(methods.map_series(o.where("cell % 2 = 0"), o.where("cell % 2 = 0"), o.where("cell % 2 = 1"))).select("year", "cell", "value")
