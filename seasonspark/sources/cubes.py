"""Long-form cubes over the sample star schema: observations, hindcasts, daily rain, leads.

One row per cell and coordinate tuple; null is missing. Scans read the columns
of the cube only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, year, value."""
    t = table(spark, sf_dir, "lineitem")
    return t.groupBy(F.col("l_suppkey").alias("cell"), F.year("l_shipdate").alias("year")).agg(F.avg("l_quantity").alias("value"))


def hindcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, year, member, value."""
    t = table(spark, sf_dir, "lineitem")
    return t.groupBy(F.col("l_suppkey").alias("cell"), F.year("l_shipdate").alias("year"), F.col("l_linenumber").alias("member")).agg(F.avg("l_quantity").alias("value"))


def daily_rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, d, value of wet days."""
    t = table(spark, sf_dir, "lineitem")
    return t.groupBy(F.col("l_suppkey").alias("cell"), F.to_date("l_shipdate").alias("d")).agg(F.sum("l_quantity").alias("value"))


def spined(rain: DataFrame, first: str, last: str) -> DataFrame:
    """A row for each cell and day; days without rain are 0. The spine has one row a cell and is exploded."""
    cells = rain.select("cell").distinct()
    days = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("d")
    spine = cells.select("cell", days)
    return spine.join(rain, ["cell", "d"], "left").select("cell", "d", F.coalesce("value", F.lit(0.0)).alias("value"))


def lead_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, lead_h, value of an event stream read as a forecast issued at its first midnight."""
    t = table(spark, sf_dir, "events")
    hours = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00"))) / 3600)
    return t.select(F.col("event_type").alias("cell"), hours.alias("lead_h"), "value")


def on_grid(rows: DataFrame, width: int = 5) -> DataFrame:
    """Cells laid out row by row: lat, lon instead of cell."""
    lat, lon = F.floor(F.col("cell") / width).cast("double"), (F.col("cell") % width).cast("double")
    return rows.select(*[c for c in rows.columns if c not in ("cell", "value")], lat.alias("lat"), lon.alias("lon"), "value")


def seasonal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, season (quarter from 0), year, x (mean of members), y."""
    t = table(spark, sf_dir, "lineitem")
    keys = [F.col("l_suppkey").alias("cell"), (F.quarter("l_shipdate") - 1).alias("season"), F.year("l_shipdate").alias("year")]
    m = t.groupBy(*keys, "l_linenumber").agg(F.sum("l_quantity").alias("s"), F.count("l_quantity").alias("n"))
    return m.groupBy("cell", "season", "year").agg(F.avg(F.col("s") / F.col("n")).alias("x"), (F.sum("s") / F.sum("n")).alias("y"))


def seasonal_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, season (quarter from 0), year, member, value."""
    t = table(spark, sf_dir, "lineitem")
    keys = [F.col("l_suppkey").alias("cell"), (F.quarter("l_shipdate") - 1).alias("season"), F.year("l_shipdate").alias("year"), F.col("l_linenumber").alias("member")]
    return t.groupBy(*keys).agg(F.avg("l_quantity").alias("value"))


# The same cubes in SQL, for the checks.
OBS = "obs AS (SELECT l_suppkey AS cell, year(l_shipdate) AS year, avg(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"
HIND = "hind AS (SELECT l_suppkey AS cell, year(l_shipdate) AS year, l_linenumber AS member, avg(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3)"
WET = "wet AS (SELECT l_suppkey AS cell, CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"


def rain_sql(first: str, last: str) -> str:
    return f"""{WET}, spine AS (
  SELECT cell, CAST(g AS DATE) AS d FROM (SELECT DISTINCT cell FROM wet) c,
  generate_series(DATE '{first}', DATE '{last}', INTERVAL 1 DAY) AS s(g)
), rain AS (SELECT s.cell, s.d, coalesce(w.value, 0) AS value FROM spine s LEFT JOIN wet w ON s.cell = w.cell AND s.d = w.d)"""


GRID = f"{OBS}, grid AS (SELECT year, (cell // 5)::DOUBLE AS lat, (cell % 5)::DOUBLE AS lon, value FROM obs)"
SEASONS = """sp AS (SELECT cell, season, year, avg(v) AS x, sum(s) / sum(n) AS y FROM (
  SELECT l_suppkey AS cell, (quarter(l_shipdate) - 1)::INT AS season, year(l_shipdate) AS year, l_linenumber, avg(l_quantity) AS v, sum(l_quantity) AS s, count(l_quantity) AS n
  FROM lineitem GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)"""
