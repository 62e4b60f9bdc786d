"""Neighbours by cells against all distances."""

import numpy as np
import pyarrow as pa
import pytest

from chronofold.operators import neighbours as N
from chronofold.operators.neighbours import nearest


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("block", [2048, 60])
def test_cells_match_all_distances(spark, metric, block):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.4, (90, 3)) for c in ((0, 0, 1), (6, 0, 0), (0, 7, 2), (9, 9, 9))] + [rng.uniform(-5, 15, (40, 3))])
    x[10:14] = x[10]  # equal rows: ties by id
    rows = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, v array<double>")
    got = {}
    for r in nearest(rows.where("id % 3 = 0"), rows, 4, metric=metric, block=block).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["neighbour"], r["distance"]))
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, len(x), 3):
        d = 1 - y @ y[i] if metric == "cosine" else np.sqrt(((x - x[i]) ** 2).sum(1))
        want = sorted((round(float(v), 9), j) for j, v in enumerate(d) if j != i)[:4]
        assert [j for _, j, _ in sorted(got[i])] == [j for _, j in want] and [v for *_, v in sorted(got[i])] == pytest.approx([v for v, _ in want], abs=1e-9)


def test_few_rows(spark):
    rows = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "id long, v array<double>")
    assert [tuple(r) for r in nearest(rows, rows, 5).orderBy("query").collect()] == [(1, 1, 2, 1.0), (2, 1, 1, 1.0)]
    assert nearest(rows, rows.where("false"), 3).count() == 0


def test_neighbours_are_found_once_and_few_rows_are_sent(spark, monkeypatch):
    """The first round was worked out again for each of its readers, and a row went to each block of 2,048 rows by itself."""
    from chronofold.operators import neighbours as N

    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 8))
    rows = spark.createDataFrame([(f"s{i}", [float(a) for a in v]) for i, v in enumerate(x)], "id string, v array<double>")
    sent = spark.sparkContext.accumulator(0)
    real = N._pair

    def counting(*a):
        one = real(*a)

        def go(left, right):
            sent.add(left.num_rows + right.num_rows)
            return one(left, right)

        return go

    monkeypatch.setattr(N, "_pair", counting)
    got = {}
    for r in N.nearest(rows, rows, 5, block=50).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["neighbour"]))
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert all([int(n[1:]) for _, n in sorted(got[f"s{i}"])] == np.argsort(d[i])[:5].tolist() for i in range(1500))
    assert sent.value < 1500 * 20


@pytest.mark.parametrize("shift, scale", [(0.0, 1.0), (1e6, 1.0), (0.0, 1e20), (0.0, 0.0)])
def test_rough_distances_lose_no_neighbour(shift, scale):
    """In single precision or not, far from the origin, with near ties and a row without numbers, a block's nearest are those of all distances."""
    r = np.random.default_rng(3)
    x = r.normal(0, 1, (900, 24))
    x[300:600] = x[:300] + r.normal(0, 1e-9, (300, 24))
    x = x * scale + shift
    x[7] = np.nan
    y, rows = x[:700], x[650:]
    table = lambda v, first, **more: pa.table({"i": np.arange(first, first + len(v)), "v": pa.array(v.tolist(), pa.list_(pa.float64())), **more})
    near, far, slack = N._rough(rows, y)
    assert (near.dtype == np.float32) == (0 < scale < 1e10)
    assert np.nanmax(np.abs((near @ far.T).astype(float) - ((rows[:, None] - y) ** 2).sum(2)) / slack[:, None]) <= 1
    got = N._pair(5, "euclidean", pa.int64())(table(rows, 650, reach=np.full(len(rows), np.inf), own=np.full(len(rows), -1)), table(y, 0, c=np.zeros(len(y), int)))
    d = np.sqrt(((y - rows[:, None]) ** 2).sum(2))
    d[np.arange(50), np.arange(650, 700)] = np.inf
    d[:, 7] = np.inf
    want = np.argsort(d, axis=1, kind="stable")[:, :5]
    assert got.column("neighbour").to_numpy().reshape(-1, 5).tolist() == want.tolist()
    values = r.uniform(0, 1, (40, 3000)).astype(np.float32)
    assert (N._kth(values, 5) >= np.sort(values, axis=1)[:, 5]).all() and len(N._kth(values[:0], 5)) == 0
    reach = d[:, 2] ** 2  # two or three are within it
    got = N._pair(5, "euclidean", pa.int64())(table(rows, 650, reach=reach, own=np.full(len(rows), -1)), table(y, 0, c=np.zeros(len(y), int)))
    assert set(zip(got.column("query").to_pylist(), got.column("neighbour").to_pylist())) >= {(650 + i, int(n)) for i in range(len(rows)) for n in want[i, :2]}
