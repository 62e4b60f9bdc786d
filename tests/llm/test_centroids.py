"""Centroid clustering against plain loops over Python integers, with odd vectors and exact arithmetic."""

import hashlib
import math

import numpy as np
import pytest

from chronofold.llm import centroids as C


def brute(rows, k, rounds, dims, scale):
    """(id, cluster, distance, own sum, all sum, digest) by plain loops."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [scale * (r := x.as_integer_ratio())[0] // r[1] for x in v]))
    named = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centres = [v for _, v in named[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for c in range(len(centres)):
            own = [v for (_, v), a in zip(kept, at) if a == c]
            if own:
                centres[c] = [sum(x) // len(own) for x in zip(*own)]
    last = [near(v) for _, v in kept]
    fit = lambda n: n if n < 1 << 63 else None
    total = lambda ds: fit(sum(ds)) if all(d < 1 << 63 for d in ds) else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(
        ((i, c, fit(d), total([x for x, y in last if y == c]), total([x for x, _ in last]), digest[c]) for (i, _), (d, c) in zip(kept, last)), key=repr
    )


def run(spark, rows, dims, kind="double", **more):
    df = spark.createDataFrame([(i, v, "c", "i") for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster string, id string").repartition(3)
    out = C.centroid_clusters(df, dims=dims, **more)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_against_loops(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 8) * (1 + i % 3)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 420)] + [(5, rows[7][1]), (5, rows[8][1])]  # a hot vector, a repeated id
    rows += [(None, rows[9][1]), (900, None), (901, []), (902, [1.0] * 7), (903, [1.0] * 9), (904, [None] + [1.0] * 7), (905, [float("nan")] + [1.0] * 7), (906, [float("inf")] * 8), (907, [0.0] * 8), (908, [-0.0] * 8)]
    assert run(spark, rows, 8) == brute(rows, 16, 3, 8, 64)
    assert run(spark, rows, 8, k=3, rounds=0) == brute(rows, 3, 0, 8, 64)


def test_ties_take_the_smaller_number(spark):
    rows = [(i, [float(i % 2), 0.5]) for i in range(40)]  # equal centroids, many equal distances
    assert run(spark, rows, 2, k=5) == brute(rows, 5, 3, 2, 64)


def test_integers_of_any_size(spark):
    rows = [(i, [x * (10.0 ** (i % 12 * 3)), -x]) for i, x in enumerate(np.random.default_rng(1).normal(0, 1, 60).tolist())] + [(99, [1.7e308, -1.7e308])]
    got = run(spark, rows, 2, k=4)
    assert got == brute(rows, 4, 3, 2, 64) and any(r[2] is None for r in got)


def test_few_and_no_vectors(spark):
    assert run(spark, [], 4) == [] and run(spark, [(1, None)], 4) == []
    rows = [(1, [0.1] * 4), (2, [0.9] * 4)]
    assert run(spark, rows, 4, "float") == brute([(i, [float(np.float32(x)) for x in v]) for i, v in rows], 16, 3, 4, 64)


@pytest.mark.parametrize("seed", [0, 1])
def test_partial_distances_do_less_work(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-60, 60, (16, 64))
    x = centres[rng.integers(0, 16, 500)] + rng.integers(-4, 5, (500, 64))
    c, d, taken = C.nearest(x, centres, np.argsort(-x.var(0)))
    full = ((x[:, None] - centres[None]) ** 2).sum(2)
    assert (c == full.argmin(1)).all() and (d == full.min(1)).all() and taken < full.size * 64 / 3
