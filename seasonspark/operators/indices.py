"""Climate indices by name: boxes, how each is reduced, and how they are combined; and masks by polygons. Fields: lat, lon, year, value."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonspark.operators.climate import cosine_weight
from seasonspark.operators.regrid import clip

# South, north, west and east of the boxes, longitudes from 0 to 360.
BOXES = {
    "nino12": (-10, 0, 270, 280), "nino3": (-5, 5, 210, 270), "nino34": (-5, 5, 190, 240), "nino4": (-5, 5, 160, 210),
    "wep": (-15, 20, 120, 160), "wnp": (20, 35, 160, 210), "wsp": (-30, -15, 155, 210),
    "wtio": (-10, 10, 50, 70), "setio": (-10, 0, 90, 110), "tropics": (-20, 20, 0, 360),
    "saod_ne": (-15, 0, 10, 20), "saod_sw": (-40, -25, 330, 350), "swio": (-35, -20, 30, 50), "wpac": (-9, 4, 103, 140),
}
HOW = ("standardize", "anomaly", "raw")


@dataclass(frozen=True)
class Index:
    """boxes: names of BOXES, or boxes by name; combine: of a mapping from names to columns; how: of all boxes, or of each by name."""

    boxes: tuple[str, ...] | dict[str, tuple[float, float, float, float]]
    combine: Callable[[dict[str, Column]], Column]
    how: str | dict[str, str] = "standardize"
    weighted: bool = False
    baseline: tuple[int, int] | None = None
    text: str = ""


def single(name: str, text: str, how: str = "standardize") -> Index:
    return Index((name,), lambda b: b[name], how, how != "standardize", text=text)


def less(a: str, b: str, text: str) -> Index:
    return Index((a, b), lambda v: v[a] - v[b], "anomaly", True, text=text)


NAMED = {
    "wvg": Index(("nino34", "wnp", "wep", "wsp"), lambda b: b["nino34"] - (b["wnp"] + b["wep"] + b["wsp"]) / 3, text="western V gradient of three boxes"),
    "wvg2": Index(("nino34", "wnp", "wep"), lambda b: b["nino34"] - (b["wnp"] + b["wep"]) / 2, text="western V gradient of two boxes"),
    **{n: single(n, f"standard scores of {n}") for n in ("nino12", "nino3", "nino34", "nino4", "wpac")},
    "oni": single("nino34", "anomaly of nino34", "anomaly"),
    "roni": less("nino34", "tropics", "anomaly of nino34 less that of the tropics"),
    "dmi": less("wtio", "setio", "Indian Ocean dipole"),
    "saod": less("saod_ne", "saod_sw", "South Atlantic dipole"),
    **{n: single(n, f"anomaly of {n}", "anomaly") for n in ("swio", "wtio", "setio")},
    "wio": single("wtio", "western Indian Ocean in its units", "raw"),
    "eio": single("setio", "eastern Indian Ocean in its units", "raw"),
}
ALIASES = {"iod": "dmi"}


def named(name: str, **changes) -> Index:
    """An index by name, with fields changed; KeyError for an unknown one."""
    from dataclasses import replace

    found = NAMED.get(ALIASES.get(name.lower(), name.lower()))
    if found is None:
        raise KeyError(f"unknown index {name!r}; there are {sorted(NAMED)}")
    return replace(found, **changes)


def listing() -> dict[str, str]:
    return {n: i.text for n, i in NAMED.items()}


def box_of(region) -> tuple[float, float, float, float]:
    """South, north, west and east of a mapping, a sequence or a name."""
    if isinstance(region, str):
        if region not in BOXES:
            raise KeyError(f"unknown region {region!r}")
        return BOXES[region]
    if isinstance(region, dict):
        return tuple(region[k] for k in ("south", "north", "west", "east"))
    if len(region) != 4:
        raise ValueError("a box has four sides")
    return tuple(region)


def boxed(field: DataFrame, region, weighted: bool) -> DataFrame:
    """year and v, the mean over a box."""
    own = clip(field, *map(float, box_of(region))).where("value IS NOT NULL")
    w = cosine_weight(F.col("lat")) if weighted else F.lit(1.0)
    return own.groupBy("year").agg((F.sum(F.col("value") * w) / F.sum(w)).alias("v"))


def reduce(field: DataFrame, index: Index, climatology: DataFrame | None = None) -> DataFrame:
    """year and value. Means and deviations (ddof 0) are the climatology's, or the field's own, over the baseline's years."""
    boxes = index.boxes if isinstance(index.boxes, dict) else {b: b for b in index.boxes}
    out = None
    for name, region in boxes.items():
        how = index.how if isinstance(index.how, str) else index.how[name]
        if how not in HOW:
            raise ValueError(f"unknown transform {how!r}; there are {HOW}")
        own = boxed(field, region, index.weighted)
        if how != "raw":
            base = own if climatology is None else boxed(climatology, region, index.weighted)
            if index.baseline:
                base = base.where(F.col("year").between(*index.baseline))
            m = base.agg(F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s"))  # one row
            z = F.col("v") - F.col("_m")
            own = own.crossJoin(F.broadcast(m)).select("year", (z / F.when(F.col("_s") > 0, F.col("_s")) if how == "standardize" else z).alias("v"))
        own = own.withColumnRenamed("v", name)
        out = own if out is None else out.join(own, "year")
    return out.select("year", index.combine({n: F.col(n) for n in boxes}).alias("value"))


def inside(lat: Column, lon: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """Whether a point lies within rings of (lon, lat): a ray to the east crosses their edges an odd number of times, holes counted with them."""
    edges = [(*a, *b) for ring in rings for a, b in zip(ring, [*ring[1:], ring[0]], strict=True) if a[1] != b[1]]
    if not edges:
        return F.lit(False)
    crossed = F.lit(0)
    held = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), e, strict=True)]) for e in edges])

    def crosses(e):
        spans = (e["y1"] > lat) != (e["y2"] > lat)
        return spans & (lon < (e["x2"] - e["x1"]) * (lat - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])

    return F.aggregate(held, crossed, lambda n, e: n + F.when(crosses(e), 1).otherwise(0)) % 2 == 1


def geometry_mask(field: DataFrame, rings: list[list[tuple[float, float]]]) -> DataFrame:
    """Values of cells whose centre lies outside the rings are null."""
    return field.withColumn("value", F.when(inside(F.col("lat"), F.col("lon"), rings), F.col("value")))


def geometry_clip(field: DataFrame, rings: list[list[tuple[float, float]]]) -> DataFrame:
    """Cells whose centre lies within the rings; a box around them is pushed to the scan."""
    xs, ys = zip(*[p for ring in rings for p in ring], strict=True)
    near = field.where(F.col("lat").between(min(ys), max(ys)) & F.col("lon").between(min(xs), max(xs)))
    return near.where(inside(F.col("lat"), F.col("lon"), rings))


def terrain(heights: DataFrame, edges_lat: DataFrame, edges_lon: DataFrame) -> DataFrame:
    """lat, lon, elevation and roughness (deviation, ddof 0) of each cell from the heights that lie in it.

    heights: lat, lon, value on any grid; edges: lat or lon with low and high, an axis each (alignment.grid_edges).
    """
    a = edges_lat.select(F.col("lat").alias("_lat"), F.col("low").alias("_a"), F.col("high").alias("_b"))
    o = edges_lon.select(F.col("lon").alias("_lon"), F.col("low").alias("_c"), F.col("high").alias("_d"))
    j = heights.join(F.broadcast(a), (F.col("lat") >= F.col("_a")) & (F.col("lat") < F.col("_b"))).join(F.broadcast(o), (F.col("lon") >= F.col("_c")) & (F.col("lon") < F.col("_d")))
    return j.groupBy(F.col("_lat").alias("lat"), F.col("_lon").alias("lon")).agg(F.avg("value").alias("elevation"), F.stddev_pop("value").alias("roughness"))
