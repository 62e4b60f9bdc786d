"""Queries over feature spaces, neighbours, precedence, targets and incremental batches, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofold.operators import embed as E
from chronofold.operators import layout as L
from chronofold.plans.cleaning import _rounded, rounded
from chronofold.sources import io as IO
from chronofold.sources.adapters import feature_values, table


def robust_scale(spark, sf_dir):
    f = feature_values(spark, sf_dir)
    return E.scaled(f, E.fit_scaler(f)).select("vec_id", "dim", rounded("z", 5).alias("z"))


def _rows(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        "label",
        F.transform("embedding", lambda x: x.cast("double")).alias("v"),
    )


def _near(spark, sf_dir, k=10):
    r = _rows(spark, sf_dir)
    return E.nearest(r, r, k)


def knn(spark, sf_dir):
    return _near(spark, sf_dir).select("query", "rank", "neighbour", rounded("distance", 5).alias("distance"))


def ood_scores(spark, sf_dir):
    return _rounded(E.ood_scores(_near(spark, sf_dir, 5), table(spark, sf_dir, "embeddings").count()), 5)


def neighbour_agreement(spark, sf_dir):
    return _rounded(E.neighbour_agreement(_near(spark, sf_dir), _rows(spark, sf_dir).select("id", "label")))


def category_neighbours(spark, sf_dir):
    return _rounded(E.category_validation(E.neighbour_agreement(_near(spark, sf_dir), _rows(spark, sf_dir).select("id", "label"))))


def silhouette(spark, sf_dir):
    return _rounded(E.silhouette(_rows(spark, sf_dir)), 5)


def score_similarity(spark, sf_dir):
    r = _rows(spark, sf_dir).select("id", F.slice("v", 1, 7).alias("v"))
    return _rounded(E.score_similarity(_near(spark, sf_dir), r), 5)


def pca_map(spark, sf_dir):
    out, _ = E.pca_map(_rows(spark, sf_dir))
    return out.select("id", F.round(F.abs(F.col("components")[0]), 4).alias("pc1"), F.round(F.abs(F.col("components")[1]), 4).alias("pc2"))


def fuzzy_graph(spark, sf_dir):
    """The weighted graph that maps are laid out by."""
    r = _rows(spark, sf_dir)
    k = L.neighbour_count(r.count())
    return L.fuzzy_graph(E.nearest(r, r, k - 1), k).select("a", "b", rounded("weight", 5).alias("weight"))


def manifold_map(spark, sf_dir):
    """Coordinates by stochastic layout: no SQL; tests hold their trustworthiness against that of components."""
    return L.manifold_map(_rows(spark, sf_dir).select("id", "v")).select("id", rounded("x", 4).alias("x"), rounded("y", 4).alias("y"))


def density_families(spark, sf_dir):
    out, _ = E.pca_map(_rows(spark, sf_dir))
    return E.density_families(out.select("id", F.col("components").alias("v")), least=20)


def _catalogues(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    old = o.where("o_orderkey % 3 <> 0").select(
        F.col("o_orderkey").alias("source_id"),
        F.col("o_orderpriority").alias("tag"),
        F.lit("old").alias("batch"),
    )
    new = o.where("o_orderkey % 2 = 0").select(
        F.col("o_orderkey").alias("source_id"),
        F.col("o_orderstatus").alias("tag"),
        F.lit("new").alias("batch"),
    )
    return old, new


def incremental_append(spark, sf_dir):
    return E.append(*_catalogues(spark, sf_dir), ["source_id"])


def incremental_replace(spark, sf_dir):
    return E.append(*_catalogues(spark, sf_dir), ["source_id"], existing="replace")


def _records(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_partkey").cast("string").alias("source_id"),
        (F.col("l_quantity") + 1.0).alias("period"),
        (F.col("l_returnflag") == "R").alias("authoritative"),
        F.col("l_linenumber").alias("priority"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("arrival"),
        F.col("l_linestatus").alias("table"),
    )


def period_table_precedence(spark, sf_dir):
    return IO.period_precedence(_records(spark, sf_dir))[0].select("source_id", "period", "authoritative", "priority", "arrival")


def period_table_conflicts(spark, sf_dir):
    return IO.period_precedence(_records(spark, sf_dir))[1]


def _targets(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    raw = c.select(
        F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.concat(F.col("c_custkey").cast("string"), F.lit(".0"))).alias("GaiaDR3"),
        (F.col("c_custkey") % 400).cast("string").alias("RAdeg"),
        ((F.col("c_custkey") * 7 % 200) - 100).cast("string").alias("DEdeg"),
        F.col("c_mktsegment").alias("group"),
    )
    return IO.prepare_targets(raw, group="auto-mobile")


def target_preparation(spark, sf_dir):
    return _targets(spark, sf_dir)[0].select("gaia_dr3", "ra_deg", "dec_deg", "target_group")


def target_counters(spark, sf_dir):
    return _targets(spark, sf_dir)[1]


def target_summary(spark, sf_dir):
    return IO.target_summary(table(spark, sf_dir, "customer"), "c_mktsegment", 3)


_EMB = "e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_NEAR = _EMB + """, d AS (SELECT a.id AS query, b.id AS neighbour, list_distance(a.v, b.v) AS distance FROM e a JOIN e b ON a.id <> b.id),
near AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS INTEGER) AS rank FROM d QUALIFY rank <= 10)"""
_AGREE = _NEAR + """, j AS (SELECT query, a.label, rank, CASE WHEN a.label = b.label THEN CAST(1 AS DOUBLE) ELSE 0 END AS same FROM near JOIN e a ON a.id = query JOIN e b ON b.id = neighbour),
agree AS (SELECT query, label, avg(same) FILTER (rank <= 5) AS a5, avg(same) FILTER (rank <= 10) AS a10 FROM j GROUP BY query, label)"""
_CATS = "old AS (SELECT o_orderkey AS source_id, o_orderpriority AS tag, 'old' AS batch FROM orders WHERE o_orderkey % 3 <> 0), new AS (SELECT o_orderkey AS source_id, o_orderstatus AS tag, 'new' AS batch FROM orders WHERE o_orderkey % 2 = 0)"
_REC = "r AS (SELECT CAST(l_partkey AS VARCHAR) AS source_id, l_quantity + 1 AS period, l_returnflag = 'R' AS authoritative, l_linenumber AS priority, l_orderkey * 10 + l_linenumber AS arrival, l_linestatus AS tab FROM lineitem), n AS (SELECT *, row_number() OVER w AS k, first_value(period) OVER w AS kept, first_value(tab) OVER w AS kt FROM r WINDOW w AS (PARTITION BY source_id ORDER BY authoritative DESC, priority, arrival))"
_TGT = "t AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS gaia_dr3, CAST(c_custkey % 400 AS DOUBLE) AS ra_deg, CAST(c_custkey * 7 % 200 - 100 AS DOUBLE) AS dec_deg, c_mktsegment AS target_group FROM customer), v AS (SELECT *, ra_deg <= 360 AND dec_deg >= -90 AND dec_deg <= 90 AS valid, lower(target_group) = 'automobile' AS wanted, CASE WHEN gaia_dr3 <> '' THEN gaia_dr3 ELSE ra_deg || ',' || dec_deg END AS key FROM t)"

QUERIES = {
    f.__name__: f
    for f in (
        robust_scale,
        knn,
        ood_scores,
        neighbour_agreement,
        category_neighbours,
        silhouette,
        score_similarity,
        pca_map,
        fuzzy_graph,
        manifold_map,
        density_families,
        incremental_append,
        incremental_replace,
        period_table_precedence,
        period_table_conflicts,
        target_preparation,
        target_counters,
        target_summary,
    )
}
_TOTAL = "list_sum(list_transform(ds, lambda d: exp(-greatest(d - rho, 0) / wid)))"
ORACLES = {
    "fuzzy_graph": f"""WITH RECURSIVE {_EMB}, size AS (SELECT least(15, greatest(5, CAST(round(sqrt(count(*))) AS INTEGER)), greatest(2, count(*) - 1)) AS k FROM e),
        near AS MATERIALIZED (SELECT * FROM (SELECT a.id AS query, b.id AS neighbour, list_distance(a.v, b.v) AS distance, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS rank FROM e a JOIN e b ON a.id <> b.id) WHERE rank < (SELECT k FROM size)),
        r AS (SELECT query, list(distance) AS ds, coalesce(min(distance) FILTER (distance > 0), 0) AS rho FROM near GROUP BY query),
        h AS (SELECT query, ds, rho, CAST(0 AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high, CAST(1 AS DOUBLE) AS wid, 0 AS i FROM r
              UNION ALL SELECT query, ds, rho, l2, h2, CASE WHEN h2 IS NULL THEN wid * 2 ELSE (l2 + h2) / 2 END, i + 1 FROM (
              SELECT *, CASE WHEN {_TOTAL} > log2((SELECT k FROM size)) THEN low ELSE wid END AS l2, CASE WHEN {_TOTAL} > log2((SELECT k FROM size)) THEN wid ELSE high END AS h2 FROM h WHERE i < {L.HALVINGS})),
        b AS (SELECT query, rho, greatest(wid, list_avg(ds) * 1e-3, 1e-12) AS wid FROM h WHERE i = {L.HALVINGS}),
        m AS (SELECT query AS a, neighbour AS b, exp(-greatest(distance - rho, 0) / wid) AS w FROM near JOIN b USING (query)),
        g AS (SELECT a, b, w FROM m UNION ALL SELECT b, a, w FROM m)
        SELECT a, b, round(sum(w) - CASE WHEN count(*) > 1 THEN max(w) * min(w) ELSE 0 END, 5) AS weight FROM g GROUP BY a, b""",
    "robust_scale": """WITH f AS (SELECT vec_id, d - 1 AS dim, CAST(embedding[d] AS DOUBLE) AS x FROM embeddings, unnest(range(1, len(embedding) + 1)) t(d)), s AS (SELECT dim, median(x) AS c, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS q FROM f GROUP BY dim)
        SELECT vec_id, CAST(dim AS INTEGER) AS dim, round((x - c) / CASE WHEN q > 0 THEN q ELSE 1 END, 5) + 0.0 AS z FROM f JOIN s USING (dim)""",
    "knn": f"WITH {_NEAR} SELECT query, rank, neighbour, round(distance, 5) AS distance FROM near",
    "ood_scores": f"WITH {_NEAR}, t AS (SELECT query, avg(distance) AS typical FROM near WHERE rank <= 5 GROUP BY query) SELECT query, round(typical, 5) AS typical, round(typical / (SELECT greatest(quantile_cont(typical, 0.99), 1e-9) FROM t), 5) AS out_of_distribution_score FROM t",
    "neighbour_agreement": f"WITH {_AGREE} SELECT query, label, round(a5, 6) AS agreement_at_5, round(a10, 6) AS agreement_at_10 FROM agree",
    "category_neighbours": f"WITH {_AGREE} SELECT label, count(*) AS n, round(avg(a5), 6) AS mean_agreement_at_5, round(avg(a10), 6) AS mean_agreement_at_10, round(median(a5), 6) AS median_agreement_at_5, round(median(a10), 6) AS median_agreement_at_10 FROM agree GROUP BY label",
    "silhouette": f"""WITH {_EMB}, p AS (SELECT a.id, a.label, b.label AS o, avg(list_distance(a.v, b.v) * list_distance(a.v, b.v)) AS d FROM e a JOIN e b ON a.id <> b.id GROUP BY a.id, a.label, b.label),
        s AS (SELECT id, label, max(d) FILTER (o = label) AS a, min(d) FILTER (o <> label) AS b FROM p GROUP BY id, label) SELECT label, count(*) AS n, round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 5) AS silhouette FROM s GROUP BY label""",
    "score_similarity": f"WITH {_NEAR} SELECT query, round(avg(list_cosine_similarity(a.v[1:7], b.v[1:7])), 5) AS similarity FROM near JOIN e a ON a.id = query JOIN e b ON b.id = neighbour GROUP BY query",
    "incremental_append": f"WITH {_CATS} SELECT * FROM old UNION ALL SELECT * FROM new WHERE source_id NOT IN (SELECT source_id FROM old)",
    "incremental_replace": f"WITH {_CATS} SELECT * FROM new UNION ALL SELECT * FROM old WHERE source_id NOT IN (SELECT source_id FROM new)",
    "period_table_precedence": f"WITH {_REC} SELECT source_id, period, authoritative, priority, arrival FROM n WHERE k = 1",
    "period_table_conflicts": f"WITH {_REC} SELECT source_id, kept AS kept_period_days, period AS other_period_days, kt AS kept_table, tab AS other_table FROM n WHERE k > 1 AND abs(period - kept) > 0.001 * greatest(period, kept)",
    "target_preparation": f"WITH {_TGT} SELECT gaia_dr3, ra_deg, dec_deg, target_group FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY k) AS r FROM v WHERE valid AND wanted) WHERE r = 1",
    "target_counters": f"WITH {_TGT} SELECT count(*) AS n_rows, count(*) FILTER (NOT valid) AS n_invalid, count(*) FILTER (valid AND NOT wanted) AS n_filtered, count(DISTINCT key) FILTER (valid AND wanted) AS n_targets FROM v",
    "target_summary": "SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY c_mktsegment ORDER BY n DESC, value LIMIT 3",
}
