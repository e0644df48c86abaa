"""Whole-number clustering against a plain loop over all centroids."""

import hashlib
import math
import random

import numpy as np
import pytest

from weirflow.llm import clusters

SCHEMA = "vec_id long, embedding array<float>"


def plain(data, k, rounds, dimension, scale=64):
    kept = []
    for vec_id, v in data:
        if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(scale * float(np.float32(x))) for x in v]))
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(x) for _, x in start[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        near = [nearest(x)[1] for _, x in kept]
        for j in range(len(centroids)):
            own = [x for (_, x), n in zip(kept, near, strict=True) if n == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    last = [(vec_id, *nearest(x)) for vec_id, x in kept]
    inertia = sum(d for _, d, _ in last)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(
        ((i, j, d, sum(e for _, e, n in last if n == j), inertia, digest[j]) for i, d, j in last), key=str
    )


def got(df):
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def vectors(seed, n, dimension, wide):
    r = random.Random(seed)
    return [(i, [r.choice((-wide, 0.0, wide)) if r.random() < 0.5 else r.uniform(-wide, wide) for _ in range(dimension)]) for i in range(n)]


@pytest.mark.parametrize(("k", "rounds", "dimension", "wide"), [(5, 3, 3, 0.05), (16, 3, 8, 1.0), (1, 2, 2, 1.0), (7, 0, 4, 100.0)])
def test_clusters_equal_a_plain_loop(rows, k, rounds, dimension, wide):
    data = vectors(k, 150, dimension, wide)
    found = clusters.cluster(rows(data, SCHEMA), k, rounds, dimension)
    assert got(found) == plain(data, k, rounds, dimension)


def test_odd_rows(rows):
    nan, inf = float("nan"), float("inf")
    data = [(None, [0.5, 0.5]), (None, None), (1, []), (2, [0.1]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0])]
    data += [(6, [0.25, -0.01]), (6, [0.25, -0.01]), (6, [0.9, 0.9]), (7, [1.0, 2.0, 3.0])] + [(100 + i, [0.0, 0.0]) for i in range(30)]
    assert got(clusters.cluster(rows(data, SCHEMA), 4, 3, 2)) == plain(data, 4, 3, 2)
    # More centroids than vectors, ties everywhere: equal centroids leave the later ones empty.
    assert got(clusters.cluster(rows(data, SCHEMA), 50, 3, 2)) == plain(data, 50, 3, 2)


def test_empty_and_clashing_names(rows):
    assert clusters.cluster(rows([], SCHEMA)).collect() == []
    assert clusters.cluster(rows([(1, [1.0])], SCHEMA)).collect() == []
    data = vectors(3, 40, 2, 1.0)
    names = SCHEMA + ", cluster string, whole int, n int, distance string, key string"
    clash = rows([(*d, "a", 1, 2, "b", "c") for d in data], names)
    assert got(clusters.cluster(clash, 3, 3, 2)) == plain(data, 3, 3, 2)


def test_values_beyond_a_long_are_left_out(rows):
    data = [(1, [3e38, 0.0]), (2, [-3e38, 0.0]), (3, [1.0, 2.0])]
    assert [r["vec_id"] for r in clusters.cluster(rows(data, SCHEMA), 2, 1, 2).collect()] == [3]


def test_tournament_keeps_the_smaller_number_on_ties():
    r = np.random.default_rng(1)
    centroids = r.integers(-2, 3, (9, 3))
    points = r.integers(-4, 5, (500, 3))
    far = ((points[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    bisectors = clusters.Bisectors(centroids)
    assert (bisectors.nearest(points) == far.argmin(axis=1)).all()
    assert (bisectors.distance(points, far.argmin(axis=1)) == far.min(axis=1)).all()
