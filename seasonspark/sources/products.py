"""Products and results as Parquet: tercile percentages, profiles, skill reports, fitted states, published metrics."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

P = ("p_below", "p_normal", "p_above")
NAMES = ("below", "normal", "above")


def output_path(destination: str, *parts: str, params: dict, suffix: str = ".parquet") -> str:
    """A name from the parts and the parameters' digest, the same for the same request."""
    slug = "_".join(re.sub(r"[^a-z0-9]+", "-", str(p).lower()).strip("-") for p in parts if p)
    mark = hashlib.sha1(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:8]
    return f"{destination.rstrip('/')}/{slug}_{mark}{suffix}"


def tercile_product(shares: DataFrame) -> DataFrame:
    """lat, lon, below, normal, above in percent, made to add up to 100; null where they add up to nothing."""
    total = F.col(P[0]) + F.col(P[1]) + F.col(P[2])
    ok = total.isNotNull() & ~F.isnan(total) & (total > 0) & (total < float("inf"))
    return shares.select("lat", "lon", *[F.when(ok, F.col(p) / total * 100).cast("float").alias(n) for p, n in zip(P, NAMES, strict=True)])


def write_terciles(shares: DataFrame, path: str, title: str, method: str = "") -> None:
    """Title and method go with each column as metadata."""
    out = tercile_product(shares)
    for n in NAMES:
        out = out.withMetadata(n, {"units": "%", "title": title, "method": method})
    out.write.mode("overwrite").parquet(path)


def long_terciles(product: DataFrame) -> DataFrame:
    """lat, lon, tercile (0 to 2) and value."""
    return product.select("lat", "lon", F.posexplode(F.array(*NAMES)).alias("tercile", "value"))


def read_terciles(spark: SparkSession, path: str) -> DataFrame:
    return long_terciles(spark.read.parquet(path))


def tercile_mae(a: DataFrame, b: DataFrame, tolerance: int = 6) -> DataFrame:
    """mae in percentage points over the cells that have all three categories on both sides; b is brought to a's grid bilinearly where that is another."""
    from seasonspark.operators import alignment, regrid

    if not alignment.same_grid(a, b, tolerance):
        lats, lons = regrid.axis(a, "lat"), regrid.axis(a, "lon")
        b = regrid.regrid(b, ["tercile"], lats, lons)
    near = [F.round(c, tolerance).alias(c) for c in ("lat", "lon")]
    x = a.select(*near, "tercile", F.col("value").cast("double").alias("x"))
    y = b.select(*near, "tercile", F.col("value").cast("double").alias("y"))
    d = x.join(y, ["lat", "lon", "tercile"]).groupBy("lat", "lon").agg(F.count(F.col("x") + F.col("y")).alias("n"), F.avg(F.abs(F.col("x") - F.col("y"))).alias("d"))
    return d.where("n = 3").agg(F.avg("d").alias("mae"))


def profile(rows: DataFrame) -> DataFrame:
    """name, type, n, missing (share of nulls and nans), low and high of each numeric column, in one pass."""
    names = [f.name for f in rows.schema.fields if isinstance(f.dataType, NumericType)]
    made = []
    for n in names:
        v = F.col(f"`{n}`").cast("double")
        v = F.when(~F.isnan(v), v)
        made.append(F.struct(F.lit(n).alias("name"), F.lit(rows.schema[n].dataType.simpleString()).alias("type"), F.count(F.lit(1)).alias("n"), F.avg(v.isNull().cast("double")).alias("missing"), F.min(v).alias("low"), F.max(v).alias("high")))
    return rows.agg(F.array(*made).alias("_p")).select(F.explode("_p").alias("_p")).select("_p.*")


def coordinate(rows: DataFrame, name: str) -> DataFrame:
    """size, first, last and step (null where steps differ) of a coordinate's distinct values."""
    from pyspark.sql import Window

    w = Window.orderBy(name)  # one axis
    c = rows.select(name).distinct().withColumn("_g", F.col(name) - F.lag(name).over(w))
    even = F.abs(F.max("_g") - F.min("_g")) <= 1e-9
    return c.agg(F.count(F.lit(1)).alias("size"), F.min(name).alias("first"), F.max(name).alias("last"), F.when(even, F.min("_g")).alias("step"))


def describe(spark: SparkSession, path: str) -> DataFrame:
    return profile(opened(spark, path))


def opened(spark: SparkSession, path: str, variable: str | None = None) -> DataFrame:
    """A table by its path; long-form tables of several variables need one's name. FileNotFoundError or ValueError, with the path, where it cannot be read."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise ValueError(f"{path} is no Parquet table") from e
    if "variable" not in rows.columns:
        return rows
    if variable is None and len(names := [r[0] for r in rows.select("variable").distinct().limit(2).collect()]) > 1:
        raise ValueError(f"{path} has several variables: name one, such as {names[0]}")
    return rows if variable is None else rows.where(F.col("variable") == variable)


def write_result(rows: DataFrame, name: str, destination: str, *parts: str, params: dict) -> dict:
    """Writes a result under its content's name; its path, profile and request."""
    path = output_path(destination, name, *parts, params=params)
    plain = [F.col(f"`{f.name}`").cast("string").alias(f.name) if f.dataType.typeName() in ("void", "variant") else F.col(f"`{f.name}`") for f in rows.schema.fields]
    rows.select(*plain).write.mode("overwrite").parquet(path)
    return {"path": path, "summary": [r.asDict() for r in profile(rows.sparkSession.read.parquet(path)).collect()], "request": params}


def save_state(state: DataFrame | None, path: str) -> None:
    """A fitted method's state is a table; without one it was not fitted."""
    if state is None:
        raise RuntimeError("not fitted")
    state.write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def skill_json(scores: DataFrame) -> DataFrame:
    """report: metric and score of each row as one JSON object, missing numbers null."""
    s = F.when(~F.isnan("score"), F.col("score"))
    return scores.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", s.alias("score")))))).alias("report"))


def rows_json(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and fields: the other columns of each row as JSON."""
    return rows.select(*keys, F.to_json(F.struct(*[c for c in rows.columns if c not in keys])).alias("fields"))


def write_skill_map(scores: DataFrame, metric: str, path: str) -> None:
    """lat, lon and value of one metric; KeyError for an unknown one, ValueError for one without a map. scores: metric, lat, lon, value."""
    own = scores.where(F.col("metric") == metric)
    if not own.limit(1).count():
        raise KeyError(metric)
    if not own.where("lat IS NOT NULL AND lon IS NOT NULL").limit(1).count():
        raise ValueError(f"{metric} has no map")
    own.select("lat", "lon", "value").write.mode("overwrite").parquet(path)


def publish(expected: DataFrame, artifacts: DataFrame, published: DataFrame, run_date: str) -> DataFrame:
    """The published rows and this run's, one a key and date: of each expected key its metrics, status failed where there is no artifact.

    expected: country, season, init; artifacts: these and metrics (JSON); published: these, run_date, status and metrics.
    """
    keys = ["country", "season", "init"]
    now = expected.join(artifacts, keys, "left").select(*keys, F.lit(run_date).cast("date").alias("run_date"), F.when(F.col("metrics").isNull(), "failed").otherwise("ok").alias("status"), "metrics")
    return published.join(now.select(*keys, "run_date"), [*keys, "run_date"], "left_anti").unionByName(now)


def variable_name(name: Column) -> Column:
    """name and level of a variable such as ua850; level null without digits."""
    return F.struct(F.regexp_extract(name, r"^([A-Za-z_]+?)(\d*)$", 1).alias("name"), F.when(F.regexp_extract(name, r"(\d+)$", 1) != "", F.regexp_extract(name, r"(\d+)$", 1).cast("int")).alias("level"))


def region_tiles(south: float, north: float, west: float, east: float) -> list[tuple[int, int]]:
    """Lower left corners of the tiles of one degree that touch a box."""
    import math

    lats, lons = range(math.floor(south), math.ceil(north) + (north == south)), range(math.floor(west), math.ceil(east) + (east == west))
    return [(a, o) for a in lats for o in lons]


def config(text: str, required: dict[str, type], known: dict[str, set] | None = None) -> dict:
    """A configuration in JSON: required fields by type, and names that must be known."""
    out = json.loads(text)
    for name, kind in required.items():
        if not isinstance(out.get(name), kind):
            raise ValueError(f"{name} must be a {kind.__name__}")
    for name, values in (known or {}).items():
        if odd := set(out.get(name, [])) - values:
            raise ValueError(f"unknown {name}: {sorted(odd)}")
    return out
