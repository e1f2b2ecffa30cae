"""Rank analogs against loops over points, and across tilings."""

import bisect

import numpy as np
import pytest

from seasonspark.operators import rank_analog as ra


def mirrored(i, n):
    i %= 2 * n
    return i if i < n else 2 * n - 1 - i


def slow(ranks, closing, sigma):
    """The same smoothing, point by point."""
    h, w = ranks.shape

    def square(field, offsets, pick):
        return np.array([[pick([field[mirrored(i + a, h), mirrored(j + b, w)] for a in offsets for b in offsets]) for j in range(w)] for i in range(h)])

    wide = range(-(closing - 1 - closing // 2), closing // 2 + 1)
    closed = square(square(ranks, wide, max), [-a for a in wide], min).astype(float)
    radius = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    k /= k.sum()
    out = closed
    for turn in range(2):
        out = out.T if turn else out
        n = out.shape[0]
        out = np.array([[sum(k[a + radius] * out[mirrored(i + a, n), j] for a in range(-radius, radius + 1)) for j in range(out.shape[1])] for i in range(n)]).astype(np.float32)
        out = out.T if turn else out
    return out.astype(int)


@pytest.mark.parametrize("closing", [1, 3, 4])
def test_smoothing(closing):
    field = np.random.default_rng(1).integers(0, 30, (9, 13))
    assert (ra.smooth(field, closing, 0.8) == slow(field, closing, 0.8)).all()
    assert (ra.smooth(np.full((4, 5), 7), closing, 1.5) == 7).all()


def test_whole_method(spark):
    rng = np.random.default_rng(2)
    hind = rng.normal(size=(8, 2, 4, 3))
    obs = rng.normal(size=(8, 11, 7))
    new = rng.normal(size=(2, 4, 3))
    h = spark.createDataFrame([(y, m, float(i), float(j), float(hind[y, m, i, j])) for y in range(8) for m in range(2) for i in range(4) for j in range(3)], "year int, member int, lat double, lon double, value double")
    o = spark.createDataFrame([(y, i / 3, j / 3, float(obs[y, i, j])) for y in range(8) for i in range(11) for j in range(7)], "year int, lat double, lon double, value double")
    f = spark.createDataFrame([(m, float(i), float(j), float(new[m, i, j])) for m in range(2) for i in range(4) for j in range(3)], "member int, lat double, lon double, value double")
    got = [{(r["member"], round(r["lat"] * 3), round(r["lon"] * 3)): r["value"] for r in ra.rank_analog(h, o, f, closing=3, sigma=0.6, side=s).collect()} for s in (512, 4)]
    mean = hind.mean(1)
    want = {}
    for m in range(2):
        ranks = np.array([[min(bisect.bisect_left(sorted(mean[:, i, j]), new[m, i, j]), 7) for j in range(3)] for i in range(4)])
        picks = slow(ranks.repeat(3, 0).repeat(3, 1)[:11, :7], 3, 0.6)
        want |= {(m, i, j): sorted(obs[:, i, j])[picks[i, j]] for i in range(11) for j in range(7)}
    assert got[0] == pytest.approx(want) and got[1] == pytest.approx(want)
    with pytest.raises(ValueError, match="cover"):
        ra.rank_analog(h, o, f, factor=2)
