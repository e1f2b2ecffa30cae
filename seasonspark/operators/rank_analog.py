"""Rank analogs: a coarse forecast's rank in its own record, smoothed on the fine grid, picks from each fine cell's ordered observations.

Smoothing reaches a bounded number of points, so that fields are worked on in tiles with a halo of that reach.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seasonspark.operators.regrid import axis

#: Standard deviations at which the Gaussian kernel is cut.
CUT = 4.0


def along(field: np.ndarray, before: int, after: int, reduce) -> np.ndarray:
    """A reduction of windows along both axes in turn; edges are mirrored with the edge point repeated."""
    for k in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[k] = (before, after)
        windows = np.lib.stride_tricks.sliding_window_view(np.pad(field, pad, mode="symmetric"), before + after + 1, axis=k)
        field = reduce(windows)
    return field


def smooth(ranks: np.ndarray, closing: int, sigma: float) -> np.ndarray:
    """Grey closing (largest, then smallest of a square of the given side), a Gaussian mean in single precision, cut to whole ranks."""
    back = closing // 2
    ahead = closing - 1 - back
    closed = along(along(ranks, ahead, back, lambda w: w.max(-1)), back, ahead, lambda w: w.min(-1))
    radius = int(CUT * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2) if sigma > 0 else np.ones(1)
    kernel /= kernel.sum()
    return along(closed.astype(np.float32), radius if sigma > 0 else 0, radius if sigma > 0 else 0, lambda w: (w.astype(float) @ kernel).astype(np.float32)).astype(np.int64)


def numbered(rows: DataFrame, name: str, values: list[float], to: str) -> DataFrame:
    """The place of a coordinate on its axis; the broadcast table has at most regrid.LONGEST_AXIS rows."""
    table = rows.sparkSession.createDataFrame(list(zip(values, range(len(values)), strict=True)), f"{name} double, {to} long")
    return rows.join(F.broadcast(table), name)


def rank_analog(hindcast: DataFrame, obs: DataFrame, forecast: DataFrame, closing: int = 50, sigma: float = 1.5, factor: int | None = None, side: int = 512) -> DataFrame:
    """member, lat, lon, value on the grid of obs.

    hindcast: year, member, lat, lon, value; obs: year, lat, lon, value; forecast:
    member, lat, lon, value. Both grids start at their least coordinates; each coarse point
    covers factor x factor fine ones (null: as many as cover the grid). A missing
    forecast counts as the highest rank; missing observations come last in their order.
    """
    lats, lons, fine_lats, fine_lons = axis(hindcast, "lat"), axis(hindcast, "lon"), axis(obs, "lat"), axis(obs, "lon")
    if not lats or not lons:
        raise ValueError("the hindcast is empty")
    f = factor or max(math.ceil(len(fine_lats) / len(lats)), math.ceil(len(fine_lons) / len(lons)), 1)
    if f * len(lats) < len(fine_lats) or f * len(lons) < len(fine_lons):
        raise ValueError(f"{len(lats)} x {len(lons)} points times {f} do not cover {len(fine_lats)} x {len(fine_lons)}")
    record = hindcast.groupBy("lat", "lon", "year").agg(F.avg("value").alias("_h"))
    years = record.agg(F.count_distinct("year")).first()[0]
    new = forecast.select("member", "lat", "lon", F.coalesce("value", F.lit(float("nan"))).alias("_f"))
    ranks = new.join(record, ["lat", "lon"]).groupBy("member", "lat", "lon").agg(F.least(F.count(F.when(F.col("_h") < F.col("_f"), 1)), F.lit(years - 1)).alias("_rank"))
    coarse = numbered(numbered(ranks, "lat", lats, "_ci"), "lon", lons, "_cj")

    def fine(c: str, n: int):
        return F.explode(F.sequence(F.col(c) * f, F.least(F.col(c) * f + f, F.lit(n)) - 1))

    points = coarse.where((F.col("_ci") * f < len(fine_lats)) & (F.col("_cj") * f < len(fine_lons)))
    points = points.select("member", "_rank", "_cj", fine("_ci", len(fine_lats)).alias("_i")).select("member", "_rank", "_i", fine("_cj", len(fine_lons)).alias("_j"))
    halo = closing + int(CUT * sigma + 0.5) + 1

    def tiles(p: str, n: int):
        first, last = F.floor((F.col(p) - halo) / side), F.floor((F.col(p) + halo) / side)
        return F.explode(F.sequence(F.greatest(first, F.lit(0)), F.least(last, F.lit((n - 1) // side))))

    dealt = points.select("*", tiles("_i", len(fine_lats)).alias("_ti"))
    dealt = dealt.select("*", tiles("_j", len(fine_lons)).alias("_tj"))

    def tile(t: pd.DataFrame) -> pd.DataFrame:
        a, b = t["_i"].to_numpy() - t["_i"].min(), t["_j"].to_numpy() - t["_j"].min()
        field = np.full((a.max() + 1, b.max() + 1), years - 1, np.int64)
        field[a, b] = t["_rank"].to_numpy()
        own = ((t["_i"] // side == t["_ti"]) & (t["_j"] // side == t["_tj"])).to_numpy()
        picked = np.clip(smooth(field, closing, sigma)[a[own], b[own]], 0, years - 1)
        return t.loc[own, ["member", "_i", "_j"]].reset_index(drop=True).assign(_rank=picked)

    kind = forecast.schema["member"].dataType.simpleString()
    picks = dealt.groupBy("member", "_ti", "_tj").applyInPandas(tile, f"member {kind}, _i long, _j long, _rank long")
    order = Window.partitionBy("lat", "lon").orderBy(F.col("value").asc_nulls_last())
    ordered = numbered(numbered(obs.withColumn("_rank", F.row_number().over(order).cast("long") - 1), "lat", fine_lats, "_i"), "lon", fine_lons, "_j")
    return picks.join(ordered.select("lat", "lon", "_i", "_j", "_rank", "value"), ["_i", "_j", "_rank"]).select("member", "lat", "lon", "value")
