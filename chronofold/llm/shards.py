"""Operator 3, sharding by a k-d tree over metadata, DataFrame operations only.

The tree is cut top down: each node takes the dimension whose values reach
widest in it (relative to the whole table) and is cut at the weighted quantile
that leaves each side the bytes of the shards it still has to yield. A quantile
is found by summing bytes over a histogram of the node's keys and refining the
one bucket that holds it; what reaches the driver is at most ``BINS`` numbers a
node and pass, whatever the table's size. Rows are never sorted or gathered.

A metadata value's number is its place among all distinct values of its column,
found by a range sort, so values that begin alike are still told apart.

Keys are unique but for hash collisions: the upper bits are the value, the lower
bits a hash of the row, so a single hot value (a third of all rows from one
source) is cut as finely as any other. A document is never cut, so a shard's
bytes differ from the target by about one document at most.

Defined cases: null text has size 1; null metadata come before all values;
rows that repeat are separate rows, and ids may repeat or be null; an empty table
gives an empty result; columns other than id, text and the metadata are never read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm.tables import discard, gapless_rank, stored, text_of, with_place

VALUE_BITS, HASH_BITS, BIN_BITS = 24, 38, 13
BINS = 1 << BIN_BITS
#: Distinct values of a metadata column that may be broadcast, and their bytes.
MOST_VALUES, MOST_VALUE_BYTES = 500_000, 32 << 20
#: A cut is near enough once the bucket that holds it has this share of a shard.
NEAR = 0.0002


def _scaled(c: Column, low: float, high: float) -> Column:
    span = max(high - low, 1e-9)
    return F.coalesce(F.least(F.lit((1 << VALUE_BITS) - 1), ((c - low) / span * (1 << VALUE_BITS)).cast("long")), F.lit(0))


class _Node:
    def __init__(self, name: int, leaves: int):
        self.name, self.leaves, self.low, self.prefix, self.shift = name, leaves, 0.0, 0, VALUE_BITS + HASH_BITS


def _cuts(rows: DataFrame, node_of: Column, nodes: list[_Node], dims: list[str], target: float) -> None:
    """Set ``dim`` and ``cut`` of each node; a row goes left if its key is under the cut."""
    reach = rows.groupBy(node_of.alias("n")).agg(
        F.sum("size").alias("w"), *[F.max(F.shiftright(d, HASH_BITS)).alias(f"x{i}") for i, d in enumerate(dims)],
        *[F.min(F.shiftright(d, HASH_BITS)).alias(f"m{i}") for i, d in enumerate(dims)],
    )
    seen = {r["n"]: r for r in reach.collect()}
    todo = []
    for node in nodes:
        r = seen.get(node.name)
        widths = [r[f"x{i}"] - r[f"m{i}"] for i in range(len(dims))] if r else [0]
        node.dim, node.cut = dims[widths.index(max(widths))], 0
        node.want = (r["w"] if r else 0) * (node.leaves // 2) / node.leaves
        if r:
            todo.append(node)
    while todo:
        key = reduce(lambda c, n: c.when(node_of == n.name, F.col(n.dim)), todo[1:], F.when(node_of == todo[0].name, F.col(todo[0].dim)))
        wanted = [
            (node_of == n.name) & (F.shiftright(n.dim, n.shift) == n.prefix) if n.shift < VALUE_BITS + HASH_BITS else node_of == n.name for n in todo
        ]
        width = min(BIN_BITS, todo[0].shift)
        shift = todo[0].shift - width
        hist = (
            rows.where(reduce(lambda a, b: a | b, wanted))
            .groupBy(node_of.alias("n"), F.shiftright(key, shift).alias("b")).agg(F.sum("size").alias("w")).collect()
        )
        left = []
        for node in todo:
            bins = sorted((r["b"], r["w"]) for r in hist if r["n"] == node.name)
            for b, w in bins:
                node.prefix, last = b, w
                if node.low + w >= node.want:
                    break
                node.low += w
            node.shift = shift
            near = max(1.0, NEAR * target)
            if shift and last > near:
                left.append(node)
            else:
                node.cut = (node.prefix + (node.want - node.low > last / 2)) << shift
        todo = left


def _numbered(raw: DataFrame, column: str, name: str) -> DataFrame:
    """``raw`` with the place of ``column``'s value among the column's distinct values, from 1; 0 for null."""
    places = stored(with_place(raw, column, name), "metadata-places").withColumnRenamed(column, "__v")
    n, width = places.agg(F.count(F.lit(1)), F.sum(F.octet_length("__v"))).first()
    if n <= MOST_VALUES and (width or 0) <= MOST_VALUE_BYTES:
        places = F.broadcast(places)
    return raw.join(places, raw[column] == places["__v"], "left").drop("__v").withColumn(name, F.coalesce(F.col(name) + 1, F.lit(0)))


def shard_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", metadata: tuple = ("source", "lang")) -> tuple[DataFrame, list[str], int]:
    """(id, size, crc, row and a key for each dimension) of every row of ``docs``, the names of the keys, all bytes."""
    text = docs[text_col].cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    named = [m for m in metadata if m in docs.columns]
    raw = stored(
        docs.select(
            docs[id_col].alias("id"), size.alias("size"), F.crc32(F.encode(text_of(docs, text_col), "UTF-8")).alias("crc"),
            *[docs[m].cast("string").alias(f"m{i}") for i, m in enumerate(named)],
        ).withColumn("row", F.monotonically_increasing_id()),
        "shard-sketch",
    )
    for i in range(len(named)):
        raw = _numbered(raw, f"m{i}", f"v{i}")
    measures = [*[f"v{i}" for i in range(len(named))], "log2(size)"]
    ends = raw.agg(*[f(F.expr(m)) for m in measures for f in (F.min, F.max)], F.sum("size")).first()
    total = ends[-1] or 0
    tie = F.shiftrightunsigned(F.xxhash64("crc", "size", "id", "row"), 64 - HASH_BITS)
    dims = [f"k{i}" for i in range(len(measures))]
    keyed = raw.select(
        "id", "size", "crc", "row",
        *[
            (F.shiftleft(_scaled(F.expr(m), float(ends[2 * i] or 0), float(ends[2 * i + 1] or 0)), HASH_BITS).bitwiseOR(tie)).alias(dims[i])
            for i, m in enumerate(measures)
        ],
    )
    return stored(keyed, "shard-keys"), dims, total


def kd_shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", metadata: tuple = ("source", "lang")) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, shard, slot."""
    keys, dims, total = shard_keys(docs, id_col, text_col, metadata)
    rows = keys
    node_of, level, first = F.lit(0), [_Node(0, n_shards)], {0: 0}
    while any(n.leaves > 1 for n in level):
        open_nodes = [n for n in level if n.leaves > 1]
        _cuts(rows, node_of, open_nodes, dims, total / n_shards)
        nxt, expr = [], None
        for n in level:
            if n.leaves == 1:
                a = _Node(2 * n.name + 1, 1)
                first[a.name] = first[n.name]
                nxt.append(a)
                branch = F.lit(a.name)
            else:
                a, b = _Node(2 * n.name + 1, n.leaves // 2), _Node(2 * n.name + 2, n.leaves - n.leaves // 2)
                first[a.name], first[b.name] = first[n.name], first[n.name] + n.leaves // 2
                nxt += [a, b]
                branch = F.when(F.col(n.dim) < n.cut, F.lit(a.name)).otherwise(F.lit(b.name))
            n.branch, n.children = branch, nxt[-2:] if n.leaves > 1 else nxt[-1:]
        # One column per level keeps the expression linear in the number of nodes.
        for n in level:
            expr = F.when(node_of == n.name, n.branch) if expr is None else expr.when(node_of == n.name, n.branch)
        rows = rows.withColumn("node", expr)
        node_of, level = F.col("node"), nxt
    number = F.lit(0) if n_shards == 1 else reduce(lambda c, n: c.when(node_of == n.name, first[n.name]), level, F.when(F.lit(False), F.lit(0)))
    placed = stored(rows.select("id", "size", "crc", "row", number.cast("int").alias("shard")), "shard-placed")
    discard(keys)
    out = gapless_rank(placed, ["shard"], ["id", "crc", "size"], "slot", "row")
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def write_shards(docs: DataFrame, path: str, n_shards: int = 16, text_col: str = "text", metadata: tuple = ("source", "lang")) -> None:
    """Write the documents into one folder per shard (``shard=``, or ``__shard=`` if they have a column of that name), all columns unchanged; a number given to each row first joins it to its shard."""
    name = "__shard" if "shard" in docs.columns else "shard"
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "shard-rows")
    shards = kd_shards(rows, n_shards, "__row", text_col, metadata).select(F.col("__row").alias("__r"), F.col("shard").alias("__s"))
    rows.join(shards, F.col("__row") == F.col("__r")).select(*docs.columns, F.col("__s").alias(name)).write.partitionBy(name).parquet(path)
    discard(rows)
