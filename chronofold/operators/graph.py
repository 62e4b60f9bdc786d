"""Connected components: few links at once, more by iterated minimum labels with pointer jumping; lineage is cut by checkpoints."""

from __future__ import annotations

import re
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` from a checkpoint in the folder that the cluster names; a folder of this process only in local mode."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="chronofold-"))
    return df.checkpoint()


#: Links that the driver joins by itself (some 4 MB); each round over more costs it several plans.
FEW_LINKS = 1 << 18


def _joined(a: pa.ChunkedArray, b: pa.ChunkedArray) -> pa.Table:
    """(n, c): the smallest id that each end of the links reaches."""
    ids, at = np.unique(np.concatenate([x.to_numpy(zero_copy_only=False) for x in (a, b)]), return_inverse=True)
    a, b = at[: len(at) // 2], at[len(at) // 2 :]
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        for side in (a, b):
            np.minimum.at(new, side, low)
            np.minimum.at(new, label[side], low)  # the root follows
        new = new[new]
        if (new == label).all():
            return pa.table({"n": ids, "c": ids[label]})
        label = new


def components(links: DataFrame, nodes: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(id, component): the smallest id that each node of ``nodes`` (id) reaches over ``links`` (a, b)."""
    links = cut_lineage(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if links.count() <= FEW_LINKS:
        found = links.toArrow()
        if not found.num_rows:
            return nodes.select("id", F.col("id").alias("component"))
        joined = nodes.sparkSession.createDataFrame(_joined(*found.columns))
        return nodes.select("id").join(joined, F.col("id") == F.col("n"), "left").select("id", F.coalesce("c", "id").alias("component"))
    both = cut_lineage(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = cut_lineage(nodes.select("id", F.col("id").alias("component")))
    for _ in range(most_rounds):
        lower = both.join(label, F.col("b") == F.col("id")).groupBy(F.col("a").alias("n")).agg(F.min("component").alias("c"))
        step = label.join(lower, F.col("id") == F.col("n"), "left").select(
            "id",
            F.least("component", F.coalesce("c", "component")).alias("component"),
        )
        jump = step.select(F.col("id").alias("j"), F.col("component").alias("jc"))
        new = cut_lineage(
            step.join(jump, F.col("component") == F.col("j"), "left").select(
                "id",
                F.least("component", F.coalesce("jc", "component")).alias("component"),
            )
        )
        moved = new.select("id", F.col("component").alias("x")).join(label, "id").where("x <> component").isEmpty()
        label = new
        if moved:
            return label
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
