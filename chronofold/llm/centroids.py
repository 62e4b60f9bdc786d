"""Operator 13, centroid clustering by partial-distance search over integer vectors.

Vectors of exactly ``dims`` finite components become integers floor(scale * x) and
are written once. Every round sends the few centroids to all tasks. A task looks at
the dimensions in descending order of variance: after the first few, the centroid
that is nearest so far is taken to the end, which gives each vector a bound, and a
pair of vector and centroid is abandoned as soon as its partial sum is strictly
above that bound. The others finish all dimensions; of equal distances the smaller
number wins. A task returns one sum a cluster and dimension, so what is shuffled
and what the driver sees is bounded by centroids times dimensions.

Arithmetic is exact at any size: components up to 2^27 are taken as 64-bit integers,
larger ones as Python integers, and sums travel in limbs of eighteen decimal digits.

Defined cases: null, short, long and non-finite vectors are left out; repeated rows
and ids count as often as they occur; equal hashes (equal ids) are ordered by
their components; a null id is hashed as an empty one; fewer vectors than centroids
give fewer centroids; no vectors give no rows; a distance or a sum that does not fit
a long is null, and so is each sum that holds it. Other columns are never read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.llm.tables import stored

K, ROUNDS, DIMS, SCALE, SEED = 16, 3, 64, 64, 1
#: Components up to this size leave squared distances of 64 dimensions within 64 bits.
SAFE = 1 << 27
#: Dimensions that all pairs are compared on, and that are added before pairs are abandoned again.
HEAD, STEP = 8, 8
_SLICE, _LIMB = 4096, 10**18


def _integers(x: float, scale: int) -> int:
    """floor(scale * x) of a finite double, whatever its size."""
    top, bottom = x.as_integer_ratio()
    return scale * top // bottom


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(id, small, large): integers as packed 64-bit numbers, or as text where one passes ``SAFE``."""
    v = F.transform(vectors[vector_col], lambda x: x.cast("double"))
    good = (F.size("v") == dims) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(vectors[id_col].alias("id"), v.alias("v")).where(F.coalesce(good, F.lit(False)))

    def go(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            with np.errstate(over="ignore"):
                y = np.floor(x * float(scale))
            fits = (np.abs(y) <= SAFE).all(1)
            whole = np.where(fits[:, None], y, 0).astype("<i8")
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([r.tobytes() if ok else None for r, ok in zip(whole, fits)], pa.binary()),
                    pa.array([None if ok else ",".join(str(_integers(float(c), scale)) for c in r) for r, ok in zip(x, fits)], pa.string()),
                ],
                ["id", "small", "large"],
            )

    schema = T.StructType([rows.schema["id"], T.StructField("small", T.BinaryType()), T.StructField("large", T.StringType())])
    return rows.mapInArrow(go, schema)


def nearest(x: np.ndarray, centres: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of each row, and the number of squared differences taken, by partial distances in the dimensions' ``order``."""
    x, c = x[:, order], centres[:, order]
    n, dims = x.shape
    head = min(HEAD, dims)
    part = ((x[:, None, :head] - c[None, :, :head]) ** 2).sum(2)
    guess = part.argmin(1)
    bound = part[np.arange(n), guess] + ((x[:, head:] - c[guess, head:]) ** 2).sum(1)
    rows, cols = np.nonzero(part <= bound[:, None])
    part, taken = part[rows, cols], n * len(c) * head + n * (dims - head)
    for a in range(head, dims, STEP):
        part = part + ((x[rows, a : a + STEP] - c[cols, a : a + STEP]) ** 2).sum(1)
        taken += len(rows) * min(STEP, dims - a)
        alive = part <= bound[rows]
        rows, cols, part = rows[alive], cols[alive], part[alive]
    best = np.lexsort((cols, part, rows))  # the survivors, at least one a row, nearest and smallest number first
    first = best[np.flatnonzero(np.diff(rows[best], prepend=-1))]
    return cols[first], part[first], taken


def _exact(x: list[list[int]], centres: list[list[int]]) -> tuple[list[int], list[int]]:
    """The same for integers of any size, one by one."""
    found = []
    for v in x:
        best, at = None, 0
        for k, c in enumerate(centres):
            total = 0
            for a, b in zip(v, c):
                total += (a - b) ** 2
                if best is not None and total > best:
                    break
            else:
                if best is None or total < best:
                    best, at = total, k
        found.append((at, best))
    return [a for a, _ in found], [d for _, d in found]


def _assigned(batches, centres: list[list[int]], order: list[int]):
    """(ids, vectors, clusters, distances) of each slice; vectors as an integer matrix, or as lists where 64 bits are too few."""
    small = all(abs(c) <= SAFE for row in centres for c in row)
    matrix, turn, dims = np.array(centres, np.int64) if small else None, np.array(order), len(order)
    for b in batches:
        for i in range(0, b.num_rows, _SLICE):
            s = b.slice(i, _SLICE)
            tight = s.column(1).is_valid()
            for own, large in ((s.filter(tight), False), (s.filter(pc.invert(tight)), True)):
                if not own.num_rows:
                    continue
                if large:
                    x = [[int(c) for c in t.split(",")] for t in own.column(2).to_pylist()]
                else:
                    x = np.frombuffer(b"".join(own.column(1).to_pylist()), "<i8").reshape(-1, dims)
                if large or not small:
                    yield own.column(0), x, *_exact([list(map(int, v)) for v in x], centres)
                else:
                    yield own.column(0), x, *nearest(x, matrix, turn)[:2]


def _limbs(n: int) -> list[int]:
    """``n`` in limbs of eighteen digits, each with the sign of ``n``, lowest first."""
    sign, n, out = (-1 if n < 0 else 1), abs(n), []
    while n or not out:
        n, low = divmod(n, _LIMB)
        out.append(sign * low)
    return out


def _spread(kept: DataFrame, dims: int) -> list[int]:
    """The dimensions by descending variance; only the order of work hangs on it."""

    def go(batches):
        n, s, q = 0, np.zeros(dims), np.zeros(dims)
        for b in batches:
            own = b.column(1).drop_null()
            x = np.frombuffer(b"".join(own.to_pylist()), "<i8").reshape(-1, dims).astype(float)
            n, s, q = n + len(x), s + x.sum(0), q + (x * x).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([float(n)] * dims), pa.array(s), pa.array(q)], ["dim", "n", "s", "q"])

    sums = kept.mapInArrow(go, "dim int, n double, s double, q double").groupBy("dim").agg(*[F.sum(c).alias(c) for c in "nsq"])
    rows = {r["dim"]: r["q"] - r["s"] * r["s"] / max(r["n"], 1) for r in sums.collect()}  # a row a dimension
    return sorted(range(dims), key=lambda d: (-rows.get(d, 0.0), d))


def centroid_clusters(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    rounds: int = ROUNDS,
    dims: int = DIMS,
    scale: int = SCALE,
    seed: int = SEED,
) -> DataFrame:
    """One row per kept vector: id, cluster, distance, the sums of distance of its cluster and of all, and its centroid's digest."""
    spark = vectors.sparkSession
    kept = stored(kept_vectors(vectors, id_col, vector_col, dims, scale), "vectors")
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    tie = F.coalesce("large", F.hex("small"))
    first = kept.select(named.alias("h"), tie.alias("t"), "small", "large").orderBy("h", "t").limit(k).collect()  # k rows
    centres = [list(map(int, np.frombuffer(r["small"], "<i8"))) if r["small"] else [int(c) for c in r["large"].split(",")] for r in first]
    order = _spread(kept, dims) if centres else list(range(dims))

    for _ in range(rounds if centres else 0):
        now = centres

        def sums(batches, now=now):
            total = [[0] * dims for _ in now]
            count = [0] * len(now)
            for _, x, cluster, _ in _assigned(batches, now, order):
                cluster = np.array(cluster)
                for c in np.unique(cluster).tolist():
                    mine = cluster == c
                    count[c] += int(mine.sum())
                    added = x[mine].sum(0).tolist() if isinstance(x, np.ndarray) else [sum(v) for v in zip(*(v for v, m in zip(x, mine) if m))]
                    total[c] = [a + b for a, b in zip(total[c], added)]
            rows = [(c, d, i, limb, count[c] if not d and not i else 0) for c in range(len(now)) if count[c] for d in range(dims) for i, limb in enumerate(_limbs(total[c][d]))]
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows), [pa.int32()] * 3 + [pa.int64()] * 2)], ["c", "d", "i", "s", "n"]) if rows else pa.RecordBatch.from_pylist([], pa.schema([("c", pa.int32()), ("d", pa.int32()), ("i", pa.int32()), ("s", pa.int64()), ("n", pa.int64())]))

        per = kept.mapInArrow(sums, "c int, d int, i int, s long, n long").groupBy("c", "d", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
        total, count = {}, {}
        for r in per.collect():  # centroids times dimensions
            total[r["c"], r["d"]] = total.get((r["c"], r["d"]), 0) + int(r["s"]) * _LIMB ** r["i"]
            count[r["c"]] = count.get(r["c"], 0) + r["n"]
        centres = [[total[c, d] // count[c] for d in range(dims)] if count.get(c) else now[c] for c in range(len(now))]

    def last(batches):
        for ids, _, cluster, distance in _assigned(batches, centres, order):
            fits = [d if (d := int(v)) < 1 << 63 else None for v in distance]
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(fits, pa.int64())], ["id", "cluster", "distance"])

    schema = T.StructType([kept.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    placed = stored(kept.mapInArrow(last, schema), "clusters")
    whole = lambda c: F.when(F.count(c) == F.count(F.lit(1)), F.sum(F.col(c).cast("decimal(38,0)")))
    own = placed.groupBy("cluster").agg(whole("distance").alias("own"))  # a row a centroid
    rows = [(r["cluster"], r["own"]) for r in own.collect()]
    every = sum(r[1] for r in rows) if all(r[1] is not None for r in rows) else None
    fit = lambda v: int(v) if v is not None and v < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    table = spark.createDataFrame([(c, fit(v), fit(every), digest[c]) for c, v in rows], "c int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(table), F.col("cluster") == F.col("c")).select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
