"""Bounded k-means gives the centres of the plain steps, with fewer distances."""

import numpy as np
import pytest

from vellum.operators import clustering as K


def clouds(seed, n, width, k, spread):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(k, width))[rng.integers(k, size=n)] + spread * rng.normal(size=(n, width))


def plain(x, centres, steps):
    now = np.array(centres, dtype=float)
    for _ in range(steps):
        own = ((x[:, None] - now[None]) ** 2).sum(2).argmin(1)
        now = np.stack([x[own == c].mean(0) if (own == c).any() else now[c] for c in range(len(now))])
    return now


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("seed,spread", [(1, 0.1), (2, 0.6), (3, 2.0)])
def test_centres_are_those_of_the_plain_steps(spark, seed, spread):
    x = clouds(seed, 900, 5, 7, spread)
    start, points = x[:7].tolist(), frame(spark, x).repartition(5)
    for steps in (1, 4):
        found, taken = K.elkan(points, start, steps)
        assert np.abs(np.array(found) - plain(x, start, steps)).max() < 1e-9
        assert taken[0] == len(x) * 7 and all(t < len(x) * 7 for t in taken[1:])
    assert np.abs(np.array(found) - np.array(K.lloyd(points, start, 4))).max() < 1e-9


def test_bounds_save_most_distances_and_steps_end(spark):
    x = clouds(5, 2000, 4, 8, 0.15)
    found, taken = K.elkan(frame(spark, x), x[:8].tolist(), 60)
    assert np.abs(np.array(found) - plain(x, x[:8], 60)).max() < 1e-9
    assert len(taken) < 60 and taken[-1] < 0.2 * taken[0]


def test_small_blocks_ties_and_centres_without_points(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_BYTES", 500)
    x = np.array([[float(a), float(b)] for a in range(6) for b in range(6)] * 3)
    start = [[0.0, 0.0], [0.0, 0.0], [5.0, 5.0], [2.5, 2.5], [90.0, 90.0]]
    for steps in range(1, 6):
        found, _ = K.elkan(frame(spark, x), start, steps)
        assert np.abs(np.array(found) - plain(x, start, steps)).max() < 1e-9
    assert found[4] == [90.0, 90.0]


def test_vectors_that_take_no_part(spark):
    odd = spark.createDataFrame([(-1, None), (-2, [1.0]), (-3, [None, 2.0]), (-4, [])], "vec_id long, embedding array<double>")
    x = clouds(7, 60, 2, 3, 0.5)
    found, _ = K.elkan(frame(spark, x).unionAll(odd), x[:3].tolist(), 3)
    assert np.abs(np.array(found) - plain(x, x[:3], 3)).max() < 1e-9
    assert K.elkan(odd, [[1.0, 2.0], [3.0, 4.0]], 3)[0] == [[1.0, 2.0], [3.0, 4.0]]
    assert K.assign(odd.limit(1), [[1.0, 2.0]]).first()["cluster"] is None
