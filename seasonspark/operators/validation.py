"""Cross-validation folds as tables: fold, held (years to predict) and training years.

Years must be consecutive integers; a fold table has at most the square of a record's years.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Fold = tuple[list[int], list[int]]


def consecutive(years: list[int]) -> list[int]:
    ys = sorted(years)
    if not ys or ys != list(range(ys[0], ys[0] + len(ys))):
        raise ValueError("years must be consecutive and distinct")
    return ys


def at_least_one(n: int, what: str) -> int:
    if n < 1:
        raise ValueError(f"{what} must be at least 1")
    return n


def loyo(years: list[int], window: int = 1) -> list[Fold]:
    """One year held; the years up to (window - 1) // 2 away from it, cut at the ends, are kept from training."""
    ys, half = consecutive(years), (at_least_one(window, "window") - 1) // 2
    return [([y], [t for t in ys if abs(t - y) > half]) for y in ys]


def loyo_cyclic(years: list[int], window: int = 1) -> list[Fold]:
    """As loyo, on a ring of years."""
    ys, half = consecutive(years), (at_least_one(window, "window") - 1) // 2
    n = len(ys)
    return [([y], [t for t in ys if min((t - y) % n, (y - t) % n) > half]) for y in ys]


def lko(years: list[int], k: int = 3) -> list[Fold]:
    """Every run of k years is held."""
    ys = consecutive(years)
    if at_least_one(k, "k") > len(ys):
        raise ValueError(f"{k} years are more than the {len(ys)} there are")
    runs = [ys[i : i + k] for i in range(len(ys) - k + 1)]
    return [(run, [t for t in ys if t not in run]) for run in runs]


def blocked(years: list[int], block: int = 5, gap: int = 0) -> list[Fold]:
    """Whole blocks in turn, with a gap on both sides; an incomplete last block is left out."""
    ys = consecutive(years)
    if at_least_one(block, "block") and gap < 0:
        raise ValueError("gap must not be negative")
    starts = range(0, len(ys) - block + 1, block)
    return [(ys[s : s + block], [t for t in ys if t < ys[s] - gap or t > ys[s + block - 1] + gap]) for s in starts]


def expanding(years: list[int], least: int = 10) -> list[Fold]:
    """Each year after the first ones, from all years before it."""
    ys = consecutive(years)
    return [([ys[i]], ys[:i]) for i in range(least, len(ys))]


SCHEMES: dict[str, Callable[..., list[Fold]]] = {"loyo": loyo, "loyo_cyclic": loyo_cyclic, "lko": lko, "blocked": blocked, "expanding": expanding}


def scheme(name: str) -> Callable[..., list[Fold]]:
    if name not in SCHEMES:
        raise KeyError(f"unknown scheme {name!r}; there are {sorted(SCHEMES)}")
    return SCHEMES[name]


def fold_table(spark: SparkSession, folds: list[Fold]) -> DataFrame:
    """fold, year, held."""
    rows = [(i, y, h) for i, (held, train) in enumerate(folds) for y, h in [*((y, True) for y in held), *((y, False) for y in train)]]
    return spark.createDataFrame(rows, "fold int, year int, held boolean")
