"""Years, grids, models and seasons of several tables brought together, and the checks that must hold before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAT, LON = ("lat", "latitude", "Y", "y"), ("lon", "longitude", "X", "x")


def canonical(rows: DataFrame, context: str = "data") -> DataFrame:
    """Columns of latitude and longitude under the names lat and lon; ValueError where one is missing."""
    for name, aliases in (("lat", LAT), ("lon", LON)):
        found = next((a for a in aliases if a in rows.columns), None)
        if found is None:
            raise ValueError(f"{context} has no column for {name}: one of {aliases}")
        rows = rows.withColumnRenamed(found, name)
    return rows


def years_of(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.where("value IS NOT NULL").select(*keys, "year").distinct()


def native_years(hindcast: DataFrame, obs: DataFrame, least: int = 5) -> DataFrame:
    """model and year: years that a model and the observations share; ValueError for a model with fewer than least."""
    own = years_of(hindcast, "model").join(F.broadcast(years_of(obs)), "year").select("model", "year")
    counts = hindcast.select("model").distinct().join(own, "model", "left").groupBy("model").agg(F.count("year").alias("n"))
    few = counts.where(F.col("n") < least).orderBy("model").limit(3).collect()
    if few:
        raise ValueError(f"models with fewer than {least} years of observations: {[r.model for r in few]}")
    return own


def common_years(hindcast: DataFrame, obs: DataFrame) -> DataFrame:
    """year: years that all models and the observations have."""
    own = native_years(hindcast, obs, 0)
    models = hindcast.agg(F.count_distinct("model")).first()[0]
    return own.groupBy("year").agg(F.count_distinct("model").alias("n")).where(F.col("n") == models).select("year")


def union_years(hindcast: DataFrame, obs: DataFrame) -> DataFrame:
    """year: years that some model shares with the observations."""
    return native_years(hindcast, obs).select("year").distinct()


def covered_years(hindcast: DataFrame, obs: DataFrame) -> DataFrame:
    """year: the years of the observations; ValueError where the hindcast lacks one."""
    lacking = years_of(obs).join(years_of(hindcast), "year", "left_anti").orderBy("year").limit(5).collect()
    if lacking:
        raise ValueError(f"the hindcast lacks {[r.year for r in lacking]}")
    return years_of(obs)


def overlapping_years(hindcast: DataFrame, obs: DataFrame, least: int = 3) -> DataFrame:
    own = years_of(hindcast).join(years_of(obs), "year")
    if own.count() < least:
        raise ValueError(f"hindcast and observations share fewer than {least} years")
    return own


def same_years(index: DataFrame, obs: DataFrame) -> DataFrame:
    """year, x (index) and the observations' columns; ValueError for repeated years or other years on one side."""
    if index.groupBy("year").count().where("count > 1").limit(1).count():
        raise ValueError("the index repeats a year")
    a, b = index.select("year").distinct(), obs.select("year").distinct()
    if a.join(b, "year", "left_anti").union(b.join(a, "year", "left_anti")).limit(1).count():
        raise ValueError("index and observations are not of the same years")
    return obs.join(F.broadcast(index.select("year", F.col("value").alias("x"))), "year")  # a row a year


def same_models(hindcast: DataFrame, forecast: DataFrame) -> None:
    """ValueError unless both have the same models."""
    a, b = hindcast.select("model").distinct(), forecast.select("model").distinct()
    odd = a.join(b, "model", "left_anti").union(b.join(a, "model", "left_anti")).limit(3).collect()
    if odd:
        raise ValueError(f"models on one side only: {[r.model for r in odd]}")


def same_grid(a: DataFrame, b: DataFrame, places: int = 6) -> bool:
    """Whether both have the same cells, coordinates rounded."""
    g = [t.select(F.round("lat", places), F.round("lon", places)).distinct() for t in (a, b)]
    return not g[0].exceptAll(g[1]).union(g[1].exceptAll(g[0])).limit(1).count()


def forecast_year(tables: list[DataFrame], years: DataFrame, explicit: int | None = None) -> int:
    """The year to forecast: the explicit one, which every table must have; the only year of tables that have one, all the same; without tables the last of years."""
    own = [[r.year for r in t.select("year").distinct().orderBy("year").limit(2).collect()] for t in tables]
    if explicit is not None:
        if any(not t.where(F.col("year") == explicit).limit(1).count() for t in tables):
            raise ValueError(f"not every forecast has the year {explicit}")
        return explicit
    if not tables:
        return years.agg(F.max("year")).first()[0]
    if any(len(y) != 1 or y != own[0] for y in own):
        raise ValueError("forecasts are of several years: name one")
    return own[0][0]


def one_year(forecast: DataFrame, year: int | None = None) -> DataFrame:
    """The rows of a year, or of the only one; a table without years gets the year."""
    if "year" not in forecast.columns:
        return forecast.withColumn("year", F.lit(year))
    if year is not None:
        out = forecast.where(F.col("year") == year)
        if not out.limit(1).count():
            raise ValueError(f"the forecast has no year {year}")
        return out
    if len(forecast.select("year").distinct().limit(2).collect()) != 1:
        raise ValueError("the forecast has several years: name one")
    return forecast


def stacked(models: dict[str, DataFrame]) -> DataFrame:
    """Tables of models one under the other, with the model's name; columns that one lacks are null."""
    out = None
    for name, rows in models.items():
        rows = rows.withColumn("model", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def super_ensemble(hindcast: DataFrame) -> DataFrame:
    """The members of all models as members of one, over the years that every model has."""
    models = hindcast.agg(F.count_distinct("model")).first()[0]
    years = hindcast.groupBy("year").agg(F.count_distinct("model").alias("n")).where(F.col("n") == models).select("year")
    rows = hindcast.join(F.broadcast(years), "year", "left_semi")
    return rows.withColumn("member", F.struct("model", "member")).drop("model")


def model_mean(rows: DataFrame, keys: list[str], simplex: bool = True) -> DataFrame:
    """keys and the three shares: means over the models that have them, made to add up to one."""
    p = ["p_below", "p_normal", "p_above"]
    out = rows.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in p])
    total = sum((F.col(c) for c in p[1:]), F.col(p[0]))
    return out.select(*keys, *[F.when(total > 0, F.col(c) / total).alias(c) for c in p]) if simplex else out


def on_seasons(forecast: DataFrame, seasons: DataFrame, keys: list[str]) -> DataFrame:
    """The forecast on a season axis: seasons that it lacks are null; ValueError for a season that the axis lacks."""
    if forecast.join(F.broadcast(seasons), "season", "left_anti").limit(1).count():
        raise ValueError("the forecast has a season that the predictor lacks")
    spine = forecast.select(*keys).distinct().select(*keys, F.explode(F.lit([r.season for r in seasons.collect()])).alias("season"))  # a row a season
    return spine.join(forecast, [*keys, "season"], "left")


def nearest_parent(fine: DataFrame, coarse: DataFrame, axis: str) -> DataFrame:
    """axis and parent: of each fine coordinate the nearest coarse one, the first of equals. Both are single axes."""
    held = sorted(r[0] for r in coarse.select(F.col(axis).cast("double")).distinct().limit(100_001).collect())
    if len(held) > 100_000:
        raise ValueError("more than 100000 coordinates")
    of = F.transform(F.lit(held), lambda c: F.struct(F.abs(F.col(axis) - c).alias("far"), c.alias("at")))
    return fine.select(axis).distinct().select(axis, F.array_min(of)["at"].alias("parent"))


def masked_at(grid: DataFrame, mask: DataFrame) -> DataFrame:
    """lat, lon and masked: the mask's nearest cell on both axes; cells more than half a step outside it are not masked."""
    out = grid.select("lat", "lon").distinct()
    cells = mask.select(F.col("lat").alias("parent_lat"), F.col("lon").alias("parent_lon"), "masked")
    for axis in ("lat", "lon"):
        held = sorted(r[0] for r in mask.select(F.col(axis).cast("double")).distinct().limit(100_001).collect())
        half = (held[1] - held[0]) / 2 if len(held) > 1 else float("inf")
        near = nearest_parent(out, mask, axis).withColumnRenamed("parent", f"parent_{axis}")
        inside = F.col(axis).between(held[0] - half, held[-1] + half)
        out = out.join(near.withColumn(f"parent_{axis}", F.when(inside, F.col(f"parent_{axis}"))), axis, "left")
    return out.join(cells, ["parent_lat", "parent_lon"], "left").select("lat", "lon", F.coalesce("masked", F.lit(False)).alias("masked"))


def region_masks(grid: DataFrame, dry: DataFrame | None = None, outside: DataFrame | None = None) -> DataFrame:
    """lat, lon, dry and outside: false where a mask is not given."""
    out = grid.select("lat", "lon").distinct()
    for name, mask in (("dry", dry), ("outside", outside)):
        out = out.withColumn(name, F.lit(False)) if mask is None else out.join(masked_at(out, mask).withColumnRenamed("masked", name), ["lat", "lon"])
    return out


def baseline(rows: DataFrame, first: int, last: int) -> DataFrame:
    """Rows of the years from first to last; ValueError if there are none."""
    out = rows.where(F.col("year").between(first, last))
    if not out.limit(1).count():
        raise ValueError(f"no rows from {first} to {last}")
    return out


def has_data(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and has: whether any value of the group is a number."""
    v = F.col("value")
    return rows.groupBy(*keys).agg(F.bool_or(v.isNotNull() & ~F.isnan(v)).alias("has"))


def record_gaps(days: DataFrame, first: Column, last: Column) -> DataFrame:
    """year, late, early and inside: days that the season of each year lacks before its record, after it and within. days: d, of all cells.

    first and last: the season's bounds as expressions over year.
    """
    have = days.select("d").distinct()
    years = have.select(F.year("d").alias("year")).distinct()
    want = years.select("year", F.explode(F.sequence(first, last)).alias("d"))
    got = want.join(have.withColumn("_h", F.lit(1)), "d", "left")
    ends = got.groupBy("year").agg(F.min(F.when(F.col("_h") == 1, F.col("d"))).alias("_a"), F.max(F.when(F.col("_h") == 1, F.col("d"))).alias("_z"))
    j = got.where("_h IS NULL").join(ends, "year")
    none = F.col("_a").isNull()
    flags = {"late": none | (F.col("d") < F.col("_a")), "early": ~none & (F.col("d") > F.col("_z")), "inside": ~none & F.col("d").between(F.col("_a"), F.col("_z"))}
    counts = j.groupBy("year").agg(*[F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in flags.items()])
    return years.join(counts, "year", "left").select("year", *[F.coalesce(n, F.lit(0)).alias(n) for n in flags])


def grid_edges(axis: DataFrame, name: str) -> DataFrame:
    """name, low and high: midpoints to the neighbours, half a step beyond the ends. axis: at least two coordinates, one column."""
    if axis.select(name).distinct().limit(2).count() < 2:
        raise ValueError("an axis needs two coordinates")
    w = Window.orderBy(name)  # a single axis
    c = axis.select(name).distinct().select(name, F.lag(name).over(w).alias("_a"), F.lead(name).over(w).alias("_z"))
    x = F.col(name)
    low = F.when(F.col("_a").isNotNull(), (F.col("_a") + x) / 2).otherwise(x - (F.col("_z") - x) / 2)
    high = F.when(F.col("_z").isNotNull(), (F.col("_z") + x) / 2).otherwise(x + (x - F.col("_a")) / 2)
    return c.select(name, low.alias("low"), high.alias("high"))


def detrended(index: DataFrame, forecast: float | None = None, year: int | None = None) -> tuple[DataFrame, float | None]:
    """(year and value without the trend on the years, the forecast without the trend at its year; after the last one if none is given)."""
    t = index.agg(F.regr_slope("value", "year").alias("b"), F.regr_intercept("value", "year").alias("a"), F.max("year").alias("last")).first()
    out = index.select("year", (F.col("value") - (F.lit(t.a) + F.lit(t.b) * F.col("year"))).alias("value"))
    at = t.last + 1 if year is None else year
    return out, None if forecast is None else forecast - (t.a + t.b * at)
