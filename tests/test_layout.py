"""Maps by manifold layout: memberships against plain formulas, trustworthiness against components, one block or many, frozen places."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.operators import embed as E
from chronofold.operators import layout as L
from chronofold.operators.neighbours import nearest


def blobs(n=240, dims=12, seed=3):
    """Points along rings in groups, which two components cannot keep apart."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 4, (8, dims))
    turn = rng.uniform(0, 2 * np.pi, n)
    axes = rng.normal(0, 1, (8, 2, dims))
    g = np.arange(n) % 8
    return centre[g] + np.cos(turn)[:, None] * axes[g, 0] + np.sin(turn)[:, None] * axes[g, 1] + rng.normal(0, 0.05, (n, dims))


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")


def trust(x, flat, k=10):
    """Trustworthiness by brute force over all ranks."""
    n = len(x)
    far = lambda p: np.linalg.norm(p[:, None] - p[None], axis=2) + np.eye(n) * 1e9
    rank = far(x).argsort(1).argsort(1) + 1
    near = far(flat).argsort(1)[:, :k]
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * sum(max(0, rank[i, j] - k) for i in range(n) for j in near[i])


def coordinates(df, names=("x", "y")):
    rows = sorted(df.collect(), key=lambda r: r["id"])
    return np.array([[r[c] for c in names] for r in rows])


def test_memberships_and_graph(spark):
    x = blobs(60)
    x[5] = x[4]  # a distance of zero
    k = 8
    near = nearest(frame(spark, x), frame(spark, x), k - 1)
    got = {(r["query"], r["neighbour"]): r["weight"] for r in L.memberships(near, k).collect()}
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    for i in range(60):
        js = [j for q, j in got if q == i]
        rho = min(d[i, j] for j in js if d[i, j] > 0)
        assert all(got[i, j] == 1 for j in js if d[i, j] <= rho)
        assert sum(got[i, j] for j in js) == pytest.approx(math.log2(k), rel=1e-6)
        widths = [-(d[i, j] - rho) / math.log(got[i, j]) for j in js if d[i, j] > rho]
        assert max(widths) == pytest.approx(min(widths))
    graph = {(r["a"], r["b"]): r["weight"] for r in L.fuzzy_graph(near, k).collect()}
    assert set(graph) == set(got) | {(b, a) for a, b in got}
    for (a, b), w in graph.items():
        p, q = got.get((a, b), 0), got.get((b, a), 0)
        assert w == pytest.approx(p + q - p * q)


def test_curve():
    a, b = L.curve(0.1)
    assert a == pytest.approx(1.577, abs=2e-3) and b == pytest.approx(0.895, abs=2e-3)


@pytest.mark.parametrize("block", [20_000, 90])
def test_map_keeps_neighbours_better_than_components(spark, block):
    x = blobs()
    rows = frame(spark, x)
    flat = coordinates(L.manifold_map(rows, metric="euclidean", block=block, rounds=4))
    axes = coordinates(E.pca_map(rows)[0].select("id", F.col("components")[0].alias("x"), F.col("components")[1].alias("y")))
    assert np.isfinite(flat).all()
    if block > len(x):  # seeded
        assert (flat == coordinates(L.manifold_map(rows, metric="euclidean"))).all()
    assert trust(x, flat) > max(trust(x, axes), 0.9)


def test_frozen_places(spark):
    x = blobs(160)
    reference = frame(spark, x[:150])
    at = L.manifold_map(reference, metric="euclidean")
    saved = reference.join(at, "id").cache()
    got = {r["id"]: (r["x"], r["y"]) for r in L.placed(frame(spark, x), saved, metric="euclidean").collect()}
    old = {r["id"]: (r["x"], r["y"]) for r in saved.collect()}
    assert len(got) == 160 and {i: got[i] for i in range(150)} == old
    for i in range(150, 160):
        near = np.linalg.norm(x[:150] - x[i], axis=1).argsort()[: L.neighbour_count(150) - 1]
        spots = np.array([old[j] for j in near])
        assert (spots.min(0) - 1e-9 <= got[i]).all() and (got[i] <= spots.max(0) + 1e-9).all()


def test_few_rows(spark):
    assert [L.neighbour_count(n) for n in (3, 20, 100, 10_000)] == [2, 5, 10, 15]
    alike = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(6)], "id long, v array<double>")
    flat = coordinates(L.manifold_map(alike, metric="euclidean"))
    assert flat.shape == (6, 2) and np.isfinite(flat).all()
