"""Grids: clips, regridding by axis weights, block means.

Rows: keys, lat, lon, value. An axis is the sorted list of its coordinates; axes are read to the driver and are bounded by LONGEST_AXIS, while fields
stay distributed. Regridding is separable: each target coordinate has one or two source coordinates with weights, so that a field is joined with two
small tables and summed.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST_AXIS = 100_000


def axis(rows: DataFrame, name: str) -> list[float]:
    found = sorted(r[0] for r in rows.where(F.col(name).isNotNull()).select(name).distinct().limit(LONGEST_AXIS + 1).collect())
    if len(found) > LONGEST_AXIS:
        raise ValueError(f"axis {name} has more than {LONGEST_AXIS} coordinates")
    return found


def linear_weights(source: list[float], target: list[float]) -> list[tuple[float, float, float]]:
    """(source, target, weight) of linear interpolation; targets outside the source have none."""
    out = []
    for t in target:
        i = bisect.bisect_left(source, t)
        if i < len(source) and source[i] == t:
            out.append((source[i], t, 1.0))
        elif 0 < i < len(source):
            w = (t - source[i - 1]) / (source[i] - source[i - 1])
            out += [(source[i - 1], t, 1 - w), (source[i], t, w)]
    return out


def nearest_weights(source: list[float], target: list[float]) -> list[tuple[float, float, float]]:
    """The nearest source coordinate of each target, the lower of two."""
    return [(min(source[max(0, i - 1) : i + 1], key=lambda s: abs(s - t)), t, 1.0) for t in target for i in [bisect.bisect_left(source, t)]]


def regrid(rows: DataFrame, keys: list[str], lats: list[float], lons: list[float], weights=linear_weights) -> DataFrame:
    """Values on the grid of lats and lons; null where a source value with weight is missing, absent outside the source grid."""
    spark = rows.sparkSession
    sides = []
    for name, target in (("lat", lats), ("lon", lons)):
        table = weights(axis(rows, name), sorted(target))
        need: dict[float, int] = {}
        for x in table:
            need[x[1]] = need.get(x[1], 0) + 1
        if len(table) > 2 * LONGEST_AXIS:
            raise ValueError(f"target axis {name} has more than {LONGEST_AXIS} coordinates")
        dealt = [(float(s), float(t), float(w), need[t]) for s, t, w in table]
        sides.append(spark.createDataFrame(dealt, f"{name} double, to_{name} double, w_{name} double, n_{name} int"))
    w = F.col("w_lat") * F.col("w_lon")
    # Broadcast: at most two rows for each of LONGEST_AXIS coordinates. Partial sums are made before the shuffle; no row is expanded to more targets than its neighbours.
    summed = rows.join(F.broadcast(sides[0]), "lat").join(F.broadcast(sides[1]), "lon").groupBy(*keys, F.col("to_lat").alias("lat"), F.col("to_lon").alias("lon"))
    there = F.count("value") == F.max(F.col("n_lat") * F.col("n_lon"))
    return summed.agg(F.when(there, F.sum(w * F.col("value"))).alias("value"))


def clip(rows: DataFrame, south: float, north: float, west: float, east: float) -> DataFrame:
    """Cells of a box, ends included; longitudes are taken modulo 360, west > east wraps, west = east is the whole circle."""
    lon, w, e = F.pmod(F.col("lon"), F.lit(360.0)), west % 360, east % 360
    rows = rows.where(F.col("lat").between(south, north))
    if w == e:
        return rows
    return rows.where(lon.between(w, e) if w < e else (lon >= w) | (lon <= e))


def block_mean(rows: DataFrame, keys: list[str], parent_lat: Column, parent_lon: Column) -> DataFrame:
    return rows.groupBy(*keys, parent_lat.alias("lat"), parent_lon.alias("lon")).agg(F.avg("value").alias("value"))


def by_parent(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Values over the mean of their parent cell, null where that is not positive. rows: keys, parent, value."""
    mean = rows.groupBy(*keys, "parent").agg(F.avg("value").alias("_m"))
    return rows.join(mean, [*keys, "parent"]).withColumn("share", F.when(F.col("_m") > 0, F.col("value") / F.col("_m"))).drop("_m")


def mask_by_skill(rows: DataFrame, skill: DataFrame, cell: list[str], threshold: float, above: bool = True) -> DataFrame:
    """Values where the skill is strictly above (or below) the threshold, else null; cells without skill are null."""
    kept = F.col("skill") > threshold if above else F.col("skill") < threshold
    return rows.join(skill, cell, "left").withColumn("value", F.when(kept, F.col("value"))).drop("skill")


def dry_mask(climatology: DataFrame, threshold: float) -> DataFrame:
    return climatology.withColumn("dry", F.col("value") < threshold)


def around(grid: DataFrame, south: float, north: float, west: float, east: float, margin: float = 0.5) -> DataFrame:
    """Cells within a box and a margin around it."""
    return grid.where(F.col("lat").between(south - margin, north + margin) & F.col("lon").between(west - margin, east + margin))
