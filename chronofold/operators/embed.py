"""Feature spaces, neighbours, outliers and density families.

Exact neighbours come from ``neighbours.nearest``, coordinates of maps from ``layout``.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.functions.columns import median
from chronofold.operators.neighbours import nearest


def fit_scaler(values: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(dim, centre, scale, empty, weight) of long rows (id, dim, x): exact median and interquartile range; a dimension without any value becomes 0."""
    fin = F.when(~F.isnan("x") & (F.abs("x") < float("inf")), F.col("x"))
    s = values.withColumn("v", fin).groupBy("dim").agg(
        median(F.col("v")).alias("centre"),
        (F.percentile("v", F.lit(0.75)) - F.percentile("v", F.lit(0.25))).alias("iqr"),
    )
    out = s.select(
        "dim",
        F.coalesce("centre", F.lit(0.0)).alias("centre"),
        F.when(F.col("iqr") > 0, F.col("iqr")).otherwise(1.0).alias("scale"),
        F.col("centre").isNull().alias("empty"),
    )
    return out.withColumn("weight", F.lit(1.0)) if weights is None else out.join(
        weights.select("dim", "weight"),
        "dim",
        "left",
    ).withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def scaled(values: DataFrame, scaler: DataFrame) -> DataFrame:
    """Long rows imputed with the frozen medians, scaled and weighted by the square root of the block weight."""
    j = values.join(scaler, "dim")
    x = F.when(F.isnan("x") | (F.abs("x") == float("inf")), None).otherwise(F.col("x"))
    return j.withColumn(
        "z",
        F.when(F.col("empty"), 0.0).otherwise((F.coalesce(x, F.col("centre")) - F.col("centre")) / F.col("scale")) * F.sqrt("weight"),
    )


def vectors(long_rows: DataFrame, id_col: str, value: str = "z") -> DataFrame:
    """(id, v): one array a row, in the order of dim."""
    return long_rows.groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.struct("dim", value))).alias("p")
    ).select(id_col, F.col(f"p.{value}").alias("v"))


def ood_scores(neighbours: DataFrame, n: int, quantile: float = 0.99) -> DataFrame:
    """Mean distance to the k-1 nearest (k = min(6, max(2, n-1))) over its ``quantile`` in the reference."""
    k = int(min(6, max(2, n - 1))) - 1
    typical = neighbours.where(F.col("rank") <= k).groupBy("query").agg(F.avg("distance").alias("typical"))
    scale = typical.agg(F.greatest(F.percentile("typical", F.lit(quantile)), F.lit(1e-9)).alias("scale"))
    return typical.join(F.broadcast(scale)).select("query", "typical", (F.col("typical") / F.col("scale")).alias("out_of_distribution_score"))  # one row is broadcast


def neighbour_agreement(neighbours: DataFrame, labels: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """(query, label, agreement@k): share of the k nearest that have the query's label. ``labels`` is (id, label)."""
    own = labels.select(F.col("id").alias("query"), F.col("label").alias("label"))
    other = labels.select(F.col("id").alias("neighbour"), F.col("label").alias("other"))
    j = neighbours.join(own, "query").join(other, "neighbour")
    same = (F.col("label") == F.col("other")).cast("double")
    return j.groupBy("query", "label").agg(*[F.avg(F.when(F.col("rank") <= k, same)).alias(f"agreement_at_{k}") for k in ks])


def category_validation(agreement: DataFrame) -> DataFrame:
    cols = [c for c in agreement.columns if c.startswith("agreement_at_")]
    return agreement.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"mean_{c}") for c in cols],
        *[median(F.col(c)).alias(f"median_{c}") for c in cols],
    )


def silhouette(rows: DataFrame) -> DataFrame:
    """(label, n, silhouette) by squared distances to cluster moments: no pairs are formed.

    The mean squared distance from x to a cluster is |x|^2 - 2 x.mean + mean |y|^2, so
    one small row per cluster suffices.
    """
    dims = len(rows.select("v").first()[0])
    sq = lambda v: F.aggregate(v, F.lit(0.0), lambda a, b: a + b * b)
    flat = rows.select("id", "label", "v", sq(F.col("v")).alias("n2"))
    c = flat.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("n2").alias("m2"),
        F.array(*[F.avg(F.col("v")[i]) for i in range(dims)]).alias("mean"),
    )
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
    table = c.groupBy().agg(F.collect_list(F.struct("label", "n", "m2", "mean")).alias("cs"))  # one row a cluster
    j = flat.crossJoin(F.broadcast(table)).withColumn(
        "d",
        F.transform(
            "cs",
            lambda k: F.struct(
                k["label"].alias("label"),
                k["n"].alias("n"),
                (F.col("n2") + k["m2"] - 2 * dot(F.col("v"), k["mean"])).alias("d"),
            ),
        ),
    )
    own = F.filter("d", lambda k: k["label"] == F.col("label"))[0]
    other = F.array_min(F.transform(F.filter("d", lambda k: k["label"] != F.col("label")), lambda k: k["d"]))
    j = j.withColumn("a", F.when(own["n"] > 1, own["d"] * own["n"] / (own["n"] - 1))).withColumn("b", other)
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")))
    return j.withColumn("s", F.coalesce(s, F.lit(0.0))).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("silhouette"))


def score_similarity(neighbours: DataFrame, evidence: DataFrame, k: int = 10) -> DataFrame:
    """(query, similarity): mean cosine between a row's evidence and its neighbours'; a zero vector gives 0. ``evidence`` is (id, v)."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
    a, b = evidence.select(F.col("id").alias("query"), F.col("v").alias("x")), evidence.select(
        F.col("id").alias("neighbour"),
        F.col("v").alias("y"),
    )
    j = neighbours.where(F.col("rank") <= k).join(a, "query").join(b, "neighbour")
    cos = F.coalesce(
        F.try_divide(dot(F.col("x"), F.col("y")), F.sqrt(dot(F.col("x"), F.col("x"))) * F.sqrt(dot(F.col("y"), F.col("y")))),
        F.lit(0.0),
    )
    return j.groupBy("query").agg(F.avg(cos).alias("similarity"))


def pca_map(rows: DataFrame, variance: float | None = None, k: int = 2) -> tuple[DataFrame, object]:
    """((id, components), model): ``k`` components, or as many as reach ``variance`` (at most 20)."""
    v = rows.withColumn("features", array_to_vector("v"))
    want = min(20, len(rows.select("v").first()[0])) if variance else k
    model = PCA(k=want, inputCol="features", outputCol="pc").fit(v)
    if variance:
        got = np.cumsum(model.explainedVariance.toArray())
        want = int(min(want, 1 + np.searchsorted(got, variance)))
    return model.transform(v).select("id", F.slice(vector_to_array("pc"), 1, want).alias("components")), model


def density_families(points: DataFrame, k: int = 5, quantile: float = 0.95, least: int = 100, share: float = 0.02) -> DataFrame:
    """(id, family): DBSCAN over 2-D points; eps is the ``quantile`` of the k-th neighbour's distance, the largest body is 'main', small ones 'none'.

    A cell of the grid has a diagonal of eps, so core points of one cell are of one body: bodies are
    components of cells, which link where any two of their core points are within eps; of equal points one is compared. Other
    points have fewer than ``k`` core points within eps and join the body of the smallest of them.
    """
    from chronofold.operators.graph import components, cut_lineage

    points = cut_lineage(points)  # read by each step below
    near = nearest(points, points, k)
    p = points.join(near.where(F.col("rank") == k).select(F.col("query").alias("id"), F.col("distance").alias("d")), "id", "left")
    p = cut_lineage(p.select("id", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"), "d"))
    eps, total = p.agg(F.percentile("d", F.lit(quantile)), F.count(F.lit(1))).first()
    if not eps:
        return points.select("id", F.lit("main").alias("family"))
    side = eps / 2**0.5 * (1 - 1e-9)  # whatever is rounded, two points of a cell are within eps
    p = p.withColumn("cx", F.floor(F.col("x") / side)).withColumn("cy", F.floor(F.col("y") / side))
    core = p.where(F.col("d") <= eps)
    # A row for each place: the smallest id there, and of its cell.
    places = core.groupBy("cx", "cy", "x", "y").agg(F.min("id").alias("id"))
    places = cut_lineage(places.withColumn("a", F.min("id").over(W.partitionBy("cx", "cy"))).select("cx", "cy", "x", "y", "a"))
    within = F.pow(F.col("x") - F.col("ox"), F.lit(2.0)) + F.pow(F.col("y") - F.col("oy"), F.lit(2.0)) <= eps * eps

    def about(rows, steps: list[tuple[int, int]]):
        """``rows`` once for each of the cells that are ``steps`` away, named as the places there are."""
        at = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])
        return rows.select("*", F.explode(at).alias("s")).select(
            (F.col("cx") + F.col("s.i")).alias("cx"),
            (F.col("cy") + F.col("s.j")).alias("cy"),
            *[c for c in rows.columns if c not in ("cx", "cy")],
        )

    steps = [(i, j) for i in range(-2, 3) for j in range(-2, 3)]
    others = places.withColumnsRenamed({"x": "ox", "y": "oy", "a": "b"})
    links = places.transform(about, [s for s in steps if s > (0, 0)]).join(others, ["cx", "cy"]).where(within).select("a", "b")
    cells = components(links, places.select(F.col("a").alias("id")).distinct())
    cells = cut_lineage(places.select("cx", "cy", "a").distinct().join(cells, F.col("a") == F.col("id")).select("cx", "cy", "a", "component"))
    comp = core.join(cells, ["cx", "cy"]).select("id", "component")
    rim = p.where(F.col("d").isNull() | (F.col("d") > eps)).select("id", "x", "y", "cx", "cy").transform(about, steps)
    rim = rim.join(others, ["cx", "cy"]).where(within)
    border = rim.join(cells.select(F.col("a").alias("b"), "component"), "b").groupBy("id").agg(F.min("component").alias("component"))
    all_in = cut_lineage(comp.unionByName(border))
    sizes = all_in.groupBy("component").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "r",
        F.row_number().over(W.orderBy(F.desc("n"), "component")),
    )
    sizes = sizes.withColumn(
        "family",
        F.when(F.col("r") == 1, "main").when(
            F.col("n") >= max(least, share * total),
            F.concat(F.lit("family_"), F.col("r") - 1),
        ).otherwise("none"),
    )
    return p.select("id").join(all_in, "id", "left").join(sizes.select("component", "family"), "component", "left").select(
        "id",
        F.coalesce("family", F.lit("none")).alias("family"),
    )


def append(frozen: DataFrame, batch: DataFrame, keys: list[str], existing: str = "skip") -> DataFrame:
    """A saved catalogue plus a new batch. ``existing`` says what rows with known keys do: skip, replace or error; saved rows never change otherwise."""
    if existing not in ("skip", "replace", "error"):
        raise ValueError(f"existing={existing!r} is not skip, replace or error")
    if existing == "error" and not batch.join(frozen.select(*keys), keys, "left_semi").isEmpty():
        raise ValueError("the batch has keys that the catalogue has")
    if existing == "replace":
        return frozen.join(batch.select(*keys), keys, "left_anti").unionByName(batch, allowMissingColumns=True)
    return frozen.unionByName(batch.join(frozen.select(*keys), keys, "left_anti"), allowMissingColumns=True)
