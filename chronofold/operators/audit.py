"""Joins that check themselves, first known metadata, global ranks and example choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that fails when either side repeats a key."""
    for side, name in ((left, "left"), (right, "right")):
        if not side.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError(f"the {name} side repeats a key")
    return left.join(right, keys)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    b = b.select(a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def first_known(df: DataFrame, key: str, order: str, columns: dict[str, list[str]]) -> DataFrame:
    """One row a key: for each name, the first non-null value (in ``order``) of the first of its columns that has one."""
    value = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order)))
    return df.groupBy(key).agg(*[F.coalesce(*[value(c) for c in names]).alias(to) for to, names in columns.items()])


def percentile_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the rank over the whole table as a share, ties averaged, nulls without rank.

    Equal values are counted first. The distinct values are dealt by range, ranges
    are summed, and each value adds what lies in ranges below its own; no task sees
    more than one range.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    ranged = counts.repartitionByRange("__v").withColumn("__p", F.spark_partition_id())
    from chronofold.operators.graph import cut_lineage

    ranged = cut_lineage(ranged)
    sums = ranged.groupBy("__p").agg(F.sum("__n").alias("__s"))
    below = sums.select(
        F.col("__p").alias("__q"),
        F.coalesce(F.sum("__s").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__b"),
        F.sum("__s").over(W.partitionBy()).alias("__t"),
    )
    inner = W.partitionBy("__p").orderBy("__v").rowsBetween(W.unboundedPreceding, -1)
    ranks = ranged.withColumn("__a", F.coalesce(F.sum("__n").over(inner), F.lit(0))).join(F.broadcast(below), F.col("__p") == F.col("__q"))  # one row a range
    ranks = ranks.select("__v", ((F.col("__b") + F.col("__a") + (F.col("__n") + 1) / 2) / F.col("__t")).alias(name))
    return df.join(ranks, F.col(value) == F.col("__v"), "left").drop("__v")


def removed_fraction_examples(summary: DataFrame) -> DataFrame:
    """The sources with the highest and lowest removed fraction and the first by name: which panels to show."""
    s = summary.select("source_id", (1 - F.col("fraction_kept")).alias("removed"))
    top = s.orderBy(F.desc("removed"), "source_id").limit(1).withColumn("role", F.lit("highest"))
    low = s.orderBy("removed", "source_id").limit(1).withColumn("role", F.lit("lowest"))
    return top.unionByName(low).unionByName(s.orderBy("source_id").limit(1).withColumn("role", F.lit("first")))


def neighbour_preservation(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(query, preserved): share of the k nearest in space ``a`` that are also among those in ``b``."""
    lists = lambda x, n: x.where(F.col("rank") <= k).groupBy("query").agg(F.collect_set("neighbour").alias(n))
    return lists(a, "x").join(lists(b, "y"), "query").select(
        "query",
        (F.size(F.array_intersect("x", "y")) / F.lit(float(k))).alias("preserved"),
    )


def medoid_distances(rows: DataFrame) -> DataFrame:
    """(id, label, distance): distance of each row of (id, label, v) to the mean of its label."""
    long_rows = rows.select("id", "label", F.posexplode("v").alias("dim", "x"))
    mean = F.avg("x").over(W.partitionBy("label", "dim"))
    d = long_rows.withColumn("d", F.pow(F.col("x") - mean, F.lit(2.0)))
    return d.groupBy("id", "label").agg(F.sqrt(F.sum("d")).alias("distance"))
