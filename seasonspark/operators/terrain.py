"""Orographic precipitation: a windward-leeward index along wind rays, and the sharing out of coarse amounts by it.

Rays reach a bounded distance, so that fields are worked on in tiles with a halo of that reach: no task holds a whole field.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonspark.operators.regrid import axis, by_parent

#: Mean radius of the earth in metres.
RADIUS = 6_371_008.8


def spacing(lats: list[float], lons: list[float]) -> tuple[float, float]:
    """Metres between rows and between columns of a regular grid, the latter at its mean latitude."""
    if len(lats) < 2 or len(lons) < 2:
        raise ValueError("terrain needs two latitudes and two longitudes at least")
    dy = math.radians(float(np.median(np.diff(lats)))) * RADIUS
    dx = math.radians(float(np.median(np.diff(lons)))) * RADIUS * math.cos(math.radians(float(np.mean(lats))))
    if not min(dx, dy) > 0:
        raise ValueError("latitudes must lie between the poles")
    return dy, dx


def sample(fields: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear values of stacked fields; nan outside or beside a gap that has weight."""
    rows, cols = fields.shape[1:]
    inside = (y >= 0) & (y <= rows - 1) & (x >= 0) & (x <= cols - 1)
    y, x = np.where(inside, y, 0.0), np.where(inside, x, 0.0)
    i, j = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = y - i, x - j
    out = np.zeros((len(fields), *y.shape))
    for di, wy in ((0, 1 - fy), (1, fy)):
        for dj, wx in ((0, 1 - fx), (1, fx)):
            w = wy * wx
            corner = fields[:, np.minimum(i + di, rows - 1), np.minimum(j + dj, cols - 1)]
            out += np.where(w > 0, corner * w, 0.0)
    return np.where(inside, out, np.nan)


def shape(angle: np.ndarray) -> np.ndarray:
    """Logarithmic growth above zero and its reciprocal below."""
    size = 1 + np.log1p(np.abs(angle))
    return np.where(angle > 0, size, 1 / size)


def index_of(z: np.ndarray, u: np.ndarray, v: np.ndarray, at: tuple[np.ndarray, np.ndarray], dy: float, dx: float, reach: float, growth: float) -> np.ndarray:
    """The index at the given rows and columns. Rays go upwind in steps that grow; terrain angles are averaged with weights for near and for far terrain."""
    speed = np.hypot(u, v)
    with np.errstate(invalid="ignore", divide="ignore"):
        fields = np.stack([z, np.where(speed > 0, u / speed, 0.0), np.where(speed > 0, v / speed, 0.0)])
    own, still = z[at], ~(speed[at] > 0)
    y, x = (a.astype(float) for a in at)
    sums = np.zeros((2, 2, len(own)))  # near and far; weighted angles and weights
    step = far = min(dx, dy)
    while far <= reach:
        _, east, north = sample(fields, y, x)
        y, x = y - step * north / dy, x - step * east / dx
        angle = np.arctan2(own - sample(fields[:1], y, x)[0], math.sqrt(far))
        seen = np.isfinite(angle)
        for s, w in zip(sums, (step / far, step / math.log1p(far)), strict=True):
            s += np.where(seen, w * np.stack([angle, np.ones_like(angle)]), 0.0)
        step *= growth
        far += step
    near, distant = (np.where(s[1] > 0, s[0] / np.where(s[1] > 0, s[1], 1.0), 0.0) for s in sums)
    return np.where(still | ~np.isfinite(own), np.nan, shape(2 * near) ** 0.25 * shape(distant) ** 0.125)


def wind_effect(rows: DataFrame, keys: list[str], reach_km: float = 300.0, growth: float = 1.5, side: int = 512) -> DataFrame:
    """keys, lat, lon, effect: the windward-leeward index of each grid point; null without elevation or wind.

    rows: keys (null is no key), lat, lon of one regular grid, z (metres), u, v. A tile has
    side x side points, and each point goes to the tiles within reach of it.
    """
    if reach_km <= 0 or growth <= 1:
        raise ValueError("reach_km must be positive and growth above 1")
    lats, lons = axis(rows, "lat"), axis(rows, "lon")
    dy, dx = spacing(lats, lons)
    reach = 1000 * reach_km

    def place(name: str, values: list[float], metres: float):
        i = F.round((F.col(name) - values[0]) / float(np.median(np.diff(values)))).cast("long")
        halo = int(reach / metres) + 2
        first, last = F.greatest(F.floor((i - halo) / side), F.lit(0)), F.least(F.floor((i + halo) / side), F.lit((len(values) - 1) // side))
        return i, F.explode(F.sequence(first, last))

    (i, ti), (j, tj) = place("lat", lats, dy), place("lon", lons, dx)
    dealt = rows.select(*keys, "lat", "lon", "z", "u", "v", i.alias("_i"), j.alias("_j"), ti.alias("_ti"))
    dealt = dealt.select("*", tj.alias("_tj"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = [*keys, "lat", "lon"]

    def tile(t: pd.DataFrame) -> pd.DataFrame:
        a, b = t["_i"].to_numpy() - t["_i"].min(), t["_j"].to_numpy() - t["_j"].min()
        z, u, v = np.full((3, a.max() + 1, b.max() + 1), np.nan)
        for field, name in ((z, "z"), (u, "u"), (v, "v")):
            field[a, b] = t[name].to_numpy(dtype=float)
        own = ((t["_i"] // side == t["_ti"]) & (t["_j"] // side == t["_tj"])).to_numpy()
        effect = pd.Series(index_of(z, u, v, (a[own], b[own]), dy, dx, reach, growth))
        return t.loc[own, names].reset_index(drop=True).assign(effect=effect.astype(object).where(effect.notna(), None))

    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", effect double"
    return dealt.groupBy(*keys, "_ti", "_tj").applyInPandas(tile, schema)


def lifted(rows: DataFrame, keys: list[str], offset: float = 500.0, scale: float = 9000.0) -> DataFrame:
    """effect lowered by the distance to the boundary layer's top, against the largest one of the parent cell. rows: keys, parent, effect, z, pbl, ground (coarse orography)."""
    away = F.abs(F.col("z") - (F.col("pbl") + F.col("ground") + offset))
    most = rows.groupBy(*keys, "parent").agg(F.max(away).alias("_most"))
    return rows.join(most, [*keys, "parent"]).withColumn("effect", F.col("effect") / (1 - (away - F.col("_most")) / scale)).drop("_most")


def orographic(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Coarse amounts shared out by intensity: each parent's mean stays its own amount. rows: keys, parent, lat, lon, effect, exposure, coarse (the parent's amount, not negative)."""
    sound = F.when(F.col("coarse") < 0, F.raise_error(F.lit("precipitation must not be negative"))).otherwise(F.col("coarse"))
    shares = by_parent(rows.withColumn("value", F.col("effect") * F.col("exposure")), keys)
    return shares.select(*keys, "lat", "lon", (sound * F.col("share")).alias("value"))
