"""Two-dimensional maps by manifold layout over exact neighbours (E6; McInnes et al. 2018).

The graph is relational: each row's nearest rows give a bandwidth, found by bisection
in columns, so that its memberships add up to log2 of the number of neighbours; a
join of both directions makes them one weight a pair. The layout is stochastic
gradient descent over edges. Rows are dealt by range of their first coordinate into
blocks; a task gets a block's rows, the edges that start there and the present places
of the edges' other ends, runs some epochs, and moves its own rows alone. Rounds are
written between, so the driver never holds a coordinate, and a lost task repeats one
round of one block. Negative samples come from the block and, where there are several
blocks, from ``POOL`` rows of all, fewest by hash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.functions.columns import let
from chronofold.operators import embed as E
from chronofold.operators.graph import cut_lineage
from chronofold.operators.neighbours import nearest

#: Rows of a block, epochs of a layout, rounds where there are several blocks, and rows of all blocks that repel each block's.
BLOCK, EPOCHS, ROUNDS, POOL = 20_000, 200, 10, 2048
#: Closest places on a map, negative samples an edge, and steps of the bisection.
MIN_DIST, NEGATIVES, HALVINGS = 0.08, 5, 64


def neighbour_count(n: int) -> int:
    """Neighbours, the row itself counted, by the number of rows alone."""
    return int(min(15, max(5, round(math.sqrt(max(1, n)))), max(2, n - 1)))


def memberships(near: DataFrame, k: int) -> DataFrame:
    """(query, neighbour, weight) of the rows of ``nearest``: 1 up to the nearest positive distance, then falling so that a row's weights add up to log2(k)."""
    rows = near.groupBy("query").agg(F.collect_list("distance").alias("ds"))
    none = F.lit(None).cast("double")

    def bandwidth(s):
        ds, rho = s["ds"], s["rho"]
        total = lambda width: F.aggregate(ds, F.lit(0.0), lambda a, d: a + F.exp(-F.greatest(d - rho, F.lit(0.0)) / width))

        def halve(w, _):
            wide = total(w["at"]) > math.log2(k)
            low, high = F.when(wide, w["low"]).otherwise(w["at"]), F.when(wide, w["at"]).otherwise(w["high"])
            return F.struct(low.alias("low"), high.alias("high"), F.when(high.isNull(), w["at"] * 2).otherwise((low + high) / 2).alias("at"))

        found = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), F.struct(F.lit(0.0).alias("low"), none.alias("high"), F.lit(1.0).alias("at")), halve)["at"]
        mean = F.aggregate(ds, F.lit(0.0), lambda a, d: a + d) / F.size(ds)
        return F.struct(rho.alias("rho"), F.greatest(found, mean * 1e-3, F.lit(1e-12)).alias("width"))

    positive = F.coalesce(F.array_min(F.filter("ds", lambda d: d > 0)), F.lit(0.0))
    width = rows.select(F.col("query").alias("q"), let(F.struct("ds", positive.alias("rho")), bandwidth).alias("b"))
    weight = F.exp(-F.greatest(F.col("distance") - F.col("b.rho"), F.lit(0.0)) / F.col("b.width"))
    return near.join(width, F.col("query") == F.col("q")).select("query", "neighbour", weight.alias("weight"))


def fuzzy_graph(near: DataFrame, k: int) -> DataFrame:
    """(a, b, weight) of both directions: the chance that at least one of two memberships holds."""
    one = memberships(near, k).select(F.col("query").alias("a"), F.col("neighbour").alias("b"), "weight")
    both = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    w = F.sum("weight") - F.when(F.count(F.lit(1)) > 1, F.max("weight") * F.min("weight")).otherwise(0.0)
    return both.groupBy("a", "b").agg(w.alias("weight"))


def curve(min_dist: float = MIN_DIST) -> tuple[float, float]:
    """(a, b) of 1 / (1 + a d^(2b)) nearest to 1 up to ``min_dist`` and exp(min_dist - d) beyond, by Gauss-Newton."""
    d = np.linspace(0, 3, 300)[1:]
    want, x = np.where(d < min_dist, 1.0, np.exp(min_dist - d)), np.array([1.5, 0.9])
    for _ in range(100):
        p = d ** (2 * x[1])
        f = 1 / (1 + x[0] * p)
        slope = np.column_stack([-f * f * p, -f * f * x[0] * p * 2 * np.log(d)])
        x = x + np.linalg.lstsq(slope, want - f, rcond=None)[0]
    return float(x[0]), float(x[1])


def _descend(own: np.ndarray, head: np.ndarray, tail: np.ndarray, weight: np.ndarray, far: np.ndarray, pool: np.ndarray, top: float, epochs: range, every: int, seed: int) -> np.ndarray:
    """New places of a block's rows. An edge's head is a row of ``own``; its tail a row of ``own``, or past those of ``far``, whose places stand."""
    a, b = curve()
    rng = np.random.default_rng(seed)
    place = np.concatenate([own, far])
    n = len(own)
    share = weight / top  # how often an edge is taken
    for epoch in epochs:
        rate = 1 - epoch / every
        active = np.flatnonzero(np.floor((epoch + 1) * share) > np.floor(epoch * share))
        active = active[rng.permutation(len(active))]
        active = active[np.argsort(head[active], kind="stable")]
        h = head[active]
        turn = np.arange(len(h)) - np.searchsorted(h, h)  # a row takes one edge a turn, and sees where the one before led
        order = np.argsort(turn, kind="stable")
        for part in np.split(active[order], np.flatnonzero(np.diff(turn[order])) + 1):
            i, j = head[part], tail[part]
            gap = place[i] - place[j]
            d2 = (gap * gap).sum(1)
            pull = np.where(d2 > 0, -2 * a * b * np.maximum(d2, 1e-12) ** (b - 1) / (1 + a * d2**b), 0.0)
            step = np.clip(pull[:, None] * gap, -4, 4)
            pick = rng.integers(0, n + len(pool), (len(part), NEGATIVES))
            where = np.where((pick < n)[..., None], place[np.minimum(pick, n - 1)], pool[np.maximum(pick - n, 0)] if len(pool) else 0.0)
            gap = place[i][:, None] - where
            d2 = (gap * gap).sum(2)
            push = np.where(d2 > 0, 2 * b / ((0.001 + d2) * (1 + a * d2**b)), 0.0)
            step += np.clip(push[..., None] * gap, -4, 4).sum(1)
            place[i] += rate * step
    return place[:n]


def _mover(pool: np.ndarray, span: range, top: float, epochs: int, seed: int):
    """One round of one block: its rows (id, block, x, y) and the edges that start there (a, b, weight, and the place bx, by of b)."""

    def move(key, rows: pa.Table, links: pa.Table) -> pa.Table:
        rows, links = rows.sort_by("id"), links.sort_by([("a", "ascending"), ("b", "ascending")])
        at = {v: i for i, v in enumerate(rows.column("id").to_pylist())}
        own, ends = (np.column_stack([t.column(c).to_numpy() for c in names]) for t, names in ((rows, ("x", "y")), (links, ("bx", "by"))))
        head = np.array([at[v] for v in links.column("a").to_pylist()], int)
        tail = np.array([at.get(v, len(own) + i) for i, v in enumerate(links.column("b").to_pylist())], int)  # ends elsewhere have a place of their own, one an edge
        moved = _descend(own, head, tail, links.column("weight").to_numpy(), ends, pool, top, span, epochs, seed * 1_000_003 + key[0].as_py() * 1009 + span.start)
        return pa.table([rows.column("id"), rows.column("block"), pa.array(moved[:, 0]), pa.array(moved[:, 1])], names=["id", "block", "x", "y"])

    return move


def layout(graph: DataFrame, start: DataFrame, seed: int = 42, epochs: int = EPOCHS, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """(id, x, y): the rows of ``start`` (id, x, y), moved by ``graph`` (a, b, weight of both directions)."""
    n, top = start.count(), graph.agg(F.max("weight")).first()[0]
    if not top:
        return start
    blocks = math.ceil(n / block)
    rounds = rounds if blocks > 1 else 1  # one block sees all there is
    places = cut_lineage(start.repartitionByRange(blocks, "x", "y", "id").select("id", F.spark_partition_id().alias("block"), "x", "y") if blocks > 1 else start.select("id", F.lit(0).alias("block"), "x", "y"))
    edges = cut_lineage(graph.where(F.col("weight") >= F.lit(top / epochs)).join(places.select(F.col("id").alias("a"), F.col("block").alias("home")), "a"))  # a weaker one would not be taken once
    kind = dict(places.dtypes)["id"]
    each = math.ceil(epochs / rounds)
    for r in range(rounds):
        pool = np.array([(p["x"], p["y"]) for p in places.orderBy(F.xxhash64("id", F.lit(r)), "id").limit(POOL).collect()]) if blocks > 1 else np.zeros((0, 2))
        span = range(r * each, min((r + 1) * each, epochs))

        ends = edges.join(places.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by")), "b").select("home", "a", "b", "weight", "bx", "by")
        places = cut_lineage(places.groupBy("block").cogroup(ends.groupBy("home")).applyInArrow(_mover(pool, span, top, epochs, seed), f"id {kind}, block int, x double, y double"))
    return places.select("id", "x", "y")


def manifold_map(rows: DataFrame, metric: str = "cosine", k: int | None = None, seed: int = 42, **more) -> DataFrame:
    """(id, x, y) of rows (id, v), from their principal components on."""
    k = k or neighbour_count(rows.count())
    near = cut_lineage(nearest(rows, rows, k - 1, metric=metric))
    first, _ = E.pca_map(rows)
    flat = first.select("id", *[F.col("components")[i].alias(c) for i, c in enumerate("xy")])
    widest = flat.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).first()[0] or 1.0
    # A little noise from the id parts rows that are alike.
    noise = lambda i: (F.pmod(F.xxhash64("id", F.lit(seed + i)), F.lit(10_000)) / 10_000 - 0.5) * 1e-3
    start = flat.select("id", *[(F.col(c) * (10 / widest) + noise(i)).alias(c) for i, c in enumerate("xy")])
    return layout(cut_lineage(fuzzy_graph(near, k)), start, seed, **more)


def placed(queries: DataFrame, reference: DataFrame, metric: str = "cosine", k: int | None = None) -> DataFrame:
    """(id, x, y) of rows (id, v) on a map that stays as it is: the mean place of the nearest rows of ``reference`` (id, v, x, y), by their memberships. A row that the reference has unchanged keeps its place."""
    k = k or neighbour_count(reference.count())
    known = reference.select(F.col("id").alias("i"), F.col("v").alias("w"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    same = queries.join(known, (F.col("id") == F.col("i")) & (F.col("v") == F.col("w")))
    new = queries.join(known.select("i", "w"), (F.col("id") == F.col("i")) & (F.col("v") == F.col("w")), "left_anti")
    near = cut_lineage(nearest(new, reference.select("id", "v"), k - 1, metric=metric))
    at = memberships(near, k).join(known.select("i", "rx", "ry"), F.col("neighbour") == F.col("i"))
    mean = lambda c: (F.sum(F.col("weight") * F.col(c)) / F.sum("weight"))
    return at.groupBy(F.col("query").alias("id")).agg(mean("rx").alias("x"), mean("ry").alias("y")).unionByName(same.select("id", F.col("rx").alias("x"), F.col("ry").alias("y")))
