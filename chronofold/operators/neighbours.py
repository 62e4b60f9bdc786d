"""Exact nearest neighbours by cells, with a bound that leaves most cells out.

Some reference rows, fewest by hash, are pivots; every reference row belongs to the
cell of its nearest pivot. A query first meets the rows of its own cell, which bounds
the distance of its k-th neighbour. By the triangle inequality a cell can only hold
nearer rows if the distance to its pivot, less the cell's radius, is within that
bound; only those cells, some together, are met in a second round, where rows past the bound go no further. The result is exact whatever the
data; how much is left out depends on how far the data lie in clusters. Cells are cut
into blocks by hash, on both sides, so no group grows with the data.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.operators.graph import cut_lineage

#: Rows of a block on either side, on average, and pivots at most (their vectors go to every task).
BLOCK, MOST_PIVOTS = 2048, 1024
#: Cells that the second round takes as one, so that a row is sent to fewer tasks, and distances held at once.
TOGETHER, CELLS = 8, 1 << 17


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T, 0)


def _rough(x: np.ndarray, y: np.ndarray) -> tuple:
    """Two matrices whose product is the squared distances, in single precision where that can hold them, and by how much each row's are off at most.

    Rows are taken about their middle. A sum of d + 2 products is off by (d + 5) u of their sizes' sum, which is 2 (x x + y y) at most; u is 2**-24.
    """
    known = np.isfinite(y).all(1)
    middle = y[known].mean(0) if known.any() else 0.0
    x, y = x - middle, y - middle
    xx, yy = (x**2).sum(1), (y**2).sum(1)
    long_, one = xx + yy[known].max(initial=0.0), lambda v: np.ones(len(v))
    single = 0 < np.fmax.reduce(long_) < 1e30
    pair = (np.column_stack(c).astype(np.float32 if single else float) for c in ([x, xx, one(x)], [-2 * y, one(y), yy]))
    return *pair, (2 * (x.shape[1] + 16) * 2.0**-24 * long_ + 1e-30 if single else 1e-9 * (1 + long_))


def _kth(rough: np.ndarray, k: int) -> np.ndarray:
    """At least the ``k``-th smallest of each row, from 0: that of the smallest of some columns each, where there are many."""
    length = rough.shape[1] // (16 * (k + 1))
    if length > 1:
        rough = rough[:, : rough.shape[1] // length * length].reshape(len(rough), length, rough.shape[1] // length).min(1)
    return np.partition(rough, k, axis=1)[:, k]


def _ids(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and their places in the order of ids, nulls last."""
    ids = np.array(column.to_pylist(), dtype=object)
    place = np.empty(len(ids), np.int64)
    place[sorted(range(len(ids)), key=lambda j: (ids[j] is None, ids[j]))] = np.arange(len(ids))
    return ids, place


def _pair(k: int, metric: str, kind: pa.DataType):
    """The ``k`` nearest of a block of reference rows to each of a block of queries, exact among those that rounding leaves open.

    Queries with a ``reach``, a squared distance, only take rows within it, and none of their ``own`` cell, which they met before.
    """
    names, types = ["query", "neighbour", "distance"], [kind, kind, pa.float64()]

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in types], names=names)
        (li, _), (ri, place) = _ids(left.column("i")), _ids(right.column("i"))
        x, y = _matrix(left.column("v")), _matrix(right.column("v"))
        reach, own, cell = left.column("reach").to_numpy(), left.column("own").to_numpy(), right.column("c").to_numpy()
        if metric == "cosine":
            x, y = _unit(x), _unit(y)
        out = ([], [], [])
        size = max(16, CELLS // len(y))
        near_x, near_y, slack = _rough(x, y)
        for s in range(0, len(x), size):
            part, off = x[s : s + size], slack[s : s + size]
            rough = near_x[s : s + size] @ near_y.T
            edge = reach[s : s + size] + off
            if len(y) > k + 1:
                many = np.flatnonzero(np.isinf(edge) if np.isinf(edge).all() else np.count_nonzero(rough <= edge[:, None], axis=1) > 4 * k)
                edge[many] = np.minimum(edge[many], _kth(rough if len(many) == len(rough) else rough[many], k) + 2 * off[many])
            edge += 1e-9 * (1 + edge)
            within = rough <= (edge * (1 + 2.0**-22)).astype(rough.dtype)[:, None]
            rows, near = np.divmod(np.flatnonzero(within), len(y))
            other = (ri[near] != li[s + rows]) & (cell[near] != own[s + rows])
            rows, near = rows[other], near[other]
            d = np.empty(len(rows))
            for f in range(0, len(rows), 65_536):
                u, v = part[rows[f : f + 65_536]], y[near[f : f + 65_536]]
                d[f : f + 65_536] = 1 - (u * v).sum(1) if metric == "cosine" else np.sqrt(((v - u) ** 2).sum(1))
            order = np.lexsort((place[near], d, rows))
            rows, near, d = rows[order], near[order], d[order]
            first = np.searchsorted(rows, rows)  # where each query's rows begin
            best = np.arange(len(rows)) - first < k
            out[0].extend(li[s + rows[best]]), out[1].extend(ri[near[best]]), out[2].append(d[best])
        return pa.table([pa.array(out[0], kind), pa.array(out[1], kind), pa.array(np.concatenate(out[2]))], names=names)

    return one


def _to_cells(pivots: np.ndarray, radii: np.ndarray | None, metric: str):
    """Adds to rows (i, v, reach) the cell of the nearest pivot and its distance, or with radii the groups of ``TOGETHER`` cells that may hold a row within ``reach``, its own cell aside."""

    def go(batches):
        for b in batches:
            for s in range(0, b.num_rows, 4096):
                part = b.slice(s, 4096)
                x = _matrix(part.column(1))
                d = np.sqrt(_squared(_unit(x) if metric == "cosine" else x, pivots))
                own = d.argmin(1)
                if radii is None:
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(d)), own])],
                        ["i", "v", "cell", "r"],
                    )
                    continue
                reach = part.column(2).to_numpy(zero_copy_only=False)[:, None]
                open_ = d - radii <= reach * (1 + 1e-9) + 1e-9
                open_[np.arange(len(d)), own] = False
                rows, cells = np.nonzero(open_)
                both = np.unique(rows.astype(np.int64) * len(pivots) + cells // TOGETHER)  # a query goes once to cells that lie together
                at = pa.array(both // len(pivots))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(at) for c in range(3)), pa.array(own.astype(np.int32)).take(at), pa.array((both % len(pivots)).astype(np.int32))],
                    ["i", "v", "reach", "own", "cell"],
                )

    return go


def nearest(
    queries: DataFrame,
    reference: DataFrame,
    k: int,
    id_col: str = "id",
    metric: str = "euclidean",
    block: int = BLOCK,
) -> DataFrame:
    """(query, rank, neighbour, distance): the ``k`` nearest reference rows (id, v) of each query, itself excluded, ties by id."""
    q, r = (df.select(F.col(id_col).alias("i"), F.col("v").cast("array<double>").alias("v")) for df in (queries, reference))
    n = r.count()
    kind = dict(q.dtypes)["i"]
    arrow = pa.string() if kind == "string" else {"bigint": pa.int64(), "int": pa.int32()}[kind]
    found = f"query {kind}, neighbour {kind}, distance double"
    w = W.partitionBy("query").orderBy("distance", "neighbour")
    top = lambda rows: rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    size = min(MOST_PIVOTS, math.ceil(n / block))

    def met(left: DataFrame, right: DataFrame, block: int) -> DataFrame:
        """The pairs of blocks of each cell; ``left`` has i, v, reach, own, cell and ``right`` i, v, c, cell."""
        rows = {s: {x["cell"]: x["count"] for x in df.groupBy("cell").count().collect()} for s, df in (("l", left), ("r", right))}  # a row a cell
        parts = {s: {c: max(1, math.ceil(m / block)) for c, m in d.items()} for s, d in rows.items()}

        def blocks(s: str, cell: Column) -> Column:
            table = [F.lit(v) for c, m in sorted(parts[s].items()) if m > 1 for v in (c, m)]
            return F.coalesce(F.try_element_at(F.create_map(*table), cell), F.lit(1)) if table else F.lit(1)

        def dealt(df: DataFrame, own: str, other: str, a: str, b: str) -> DataFrame:
            mine = F.pmod(F.xxhash64("i"), blocks(own, F.col("cell"))).cast("int")
            return df.select("*", mine.alias(a), F.explode(F.sequence(F.lit(0), blocks(other, F.col("cell")) - 1)).alias(b))

        keys = ["cell", "a", "b"]
        x = dealt(left.select("i", "v", "reach", "own", "cell"), "l", "r", "a", "b")
        y = dealt(right.select("i", "v", "c", "cell"), "r", "l", "b", "a").select("i", "v", "c", "cell", "a", "b")
        return x.groupBy(*keys).cogroup(y.groupBy(*keys)).applyInArrow(_pair(k, metric, arrow), found)

    anywhere = [F.lit(float("inf")).alias("reach"), F.lit(-1).alias("own")]
    alone = F.lit(0).alias("cell")
    if size <= 2:
        return top(met(q.select("*", *anywhere, alone), r.select("*", F.lit(0).alias("c"), alone), block)).select("query", "rank", "neighbour", "distance")
    pivots = np.array([x["v"] for x in r.orderBy(F.xxhash64("i"), "i").limit(size).collect()])
    pivots = _unit(pivots) if metric == "cosine" else pivots
    schema = f"i {kind}, v array<double>, cell int, r double"
    near = _to_cells(pivots, None, metric)
    # What more than one step reads is written once.
    own_r = cut_lineage(r.mapInArrow(near, schema))
    own_q = own_r if queries is reference else cut_lineage(q.mapInArrow(near, schema))
    radii = np.zeros(len(pivots))
    for x in own_r.groupBy("cell").agg(F.max("r").alias("r")).collect():  # a row a pivot
        radii[x["cell"]] = x["r"]
    first = cut_lineage(top(met(own_q.select("*", *anywhere), own_r.withColumn("c", F.col("cell")), block)))
    # Cosine distances are half the squared distances of unit vectors; the bound is on the latter's root.
    last = F.max(F.when(F.col("rank") == k, F.col("distance")))
    reach = first.groupBy("query").agg((F.sqrt(2 * F.greatest(last, F.lit(0.0))) if metric == "cosine" else last).alias("reach"))
    more = own_q.join(reach, F.col("i") == F.col("query"), "left").select("i", "v", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))
    more = cut_lineage(more.mapInArrow(_to_cells(pivots, radii, metric), f"i {kind}, v array<double>, reach double, own int, cell int"))
    groups = own_r.withColumn("c", F.col("cell")).withColumn("cell", F.floor(F.col("cell") / TOGETHER).cast("int"))
    second = met(more.withColumn("reach", F.col("reach") * F.col("reach")), groups, block * TOGETHER)
    return top(first.drop("rank").unionByName(second)).select("query", "rank", "neighbour", "distance")
