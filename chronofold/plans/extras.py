"""Queries over ranks, preserved neighbours, cross-band folds, metadata and audits, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofold.operators import audit as U
from chronofold.operators import clean as C
from chronofold.operators import embed as E
from chronofold.operators import recommend as R
from chronofold.plans import periods, recommendation, spaces
from chronofold.plans.cleaning import SUMMARY_SQL, _rounded, cleaned
from chronofold.sources.adapters import CATALOGUE_SQL, catalogue_rows, peak_rows, table


def percentile_rank(spark, sf_dir):
    return _rounded(U.percentile_rank(catalogue_rows(spark, sf_dir).select("source_id", "confidence"), "confidence", "confidence_rank"))


def neighbour_preservation(spark, sf_dir):
    r = spaces._rows(spark, sf_dir)
    part = r.select("id", F.slice("v", 1, 16).alias("v"))
    return _rounded(U.neighbour_preservation(E.nearest(r, r, 10), E.nearest(part, part, 10), 10))


def medoid_distances(spark, sf_dir):
    return _rounded(U.medoid_distances(spaces._rows(spark, sf_dir)), 5)


def removed_examples(spark, sf_dir):
    return _rounded(U.removed_fraction_examples(C.summary(cleaned(spark, sf_dir))))


def cross_band_recovery(spark, sf_dir):
    """Do both bands recover a fold at the source's adopted period?"""
    f = periods.S.fold_coherence(periods._folds(spark, sf_dir))
    snr = lambda s: F.max(F.when(F.col("series") == s, F.col("fold_amp_snr")))
    w = f.groupBy("source_id").agg(snr("o").alias("o_snr"), snr("c").alias("c_snr"))
    return _rounded(w.withColumn("colour_recovery", R.colour_recovery(F.col("o_snr"), F.col("c_snr"))))


def extra_folds(spark, sf_dir):
    out = R.extra_fold_candidates(peak_rows(spark, sf_dir), recommendation._scored(spark, sf_dir))
    return _rounded(out.select("source_id", "series", "rank", "choice", "separation"))


def first_known_metadata(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        "o_custkey",
        "o_orderkey",
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("a"),
        F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderstatus")).alias("b"),
    )
    return U.first_known(o, "o_custkey", "o_orderkey", {"object_name": ["a", "b"], "cluster_name": ["b"]})


def truth_audit(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    left = n.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("n_regionkey", "k")
    return U.one_to_one(left, r.select(F.col("r_regionkey").alias("k"), "r_name"), ["k"])


def fold_period_choice(spark, sf_dir):
    c = catalogue_rows(spark, sf_dir)
    forced = F.when(F.col("source_id").cast("long") % 10 == 0, 5.0)
    return c.select(
        "source_id",
        R.fold_period(forced, F.col("recommended_period_days"), F.col("profile_chi2"), F.lit(1.0)).alias("fold_period"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        percentile_rank,
        neighbour_preservation,
        medoid_distances,
        removed_examples,
        cross_band_recovery,
        extra_folds,
        first_known_metadata,
        truth_audit,
        fold_period_choice,
    )
}
_KNN = lambda name, cut: f"{name} AS (SELECT a.id AS query, b.id AS neighbour, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v{cut}, b.v{cut}), b.id) AS r FROM e a JOIN e b ON a.id <> b.id)"
ORACLES = {
    "percentile_rank": f"WITH {CATALOGUE_SQL} SELECT source_id, confidence, round((rank() OVER (ORDER BY confidence) + (count(*) OVER (PARTITION BY confidence) - 1) / 2) / count(*) OVER (), 6) AS confidence_rank FROM cat",
    "neighbour_preservation": f"WITH {spaces._EMB}, {_KNN('x', '')}, {_KNN('y', '[1:16]')} SELECT q AS query, round(count(y.neighbour) / CAST(10 AS DOUBLE), 6) AS preserved FROM (SELECT query AS q, neighbour AS nb FROM x WHERE r <= 10) x LEFT JOIN y ON y.query = q AND y.neighbour = nb AND y.r <= 10 GROUP BY q",
    "medoid_distances": f"WITH {spaces._EMB}, l AS (SELECT id, label, d, v[d] AS x FROM e, unnest(range(1, len(v) + 1)) t(d)), m AS (SELECT label, d, avg(x) AS m FROM l GROUP BY label, d) SELECT id, label, round(sqrt(sum((x - m) * (x - m))), 5) AS distance FROM l JOIN m USING (label, d) GROUP BY id, label",
    "removed_examples": f"""WITH {SUMMARY_SQL}, s AS (SELECT source_id, 1 - fraction_kept AS removed FROM summary) SELECT source_id, round(removed, 6) + 0.0 AS removed, role FROM (
        (SELECT *, 'highest' AS role FROM s ORDER BY removed DESC, source_id LIMIT 1) UNION ALL (SELECT *, 'lowest' FROM s ORDER BY removed, source_id LIMIT 1) UNION ALL (SELECT *, 'first' FROM s ORDER BY source_id LIMIT 1))""",
    "cross_band_recovery": f"""SELECT source_id, max(fold_amp_snr) FILTER (series = 'o') AS o_snr, max(fold_amp_snr) FILTER (series = 'c') AS c_snr, CASE WHEN coalesce(max(fold_amp_snr) FILTER (series = 'o') >= 3, false) AND coalesce(max(fold_amp_snr) FILTER (series = 'c') >= 3, false) THEN 'both'
        WHEN coalesce(max(fold_amp_snr) FILTER (series = 'o') >= 3, false) THEN 'o_only' WHEN coalesce(max(fold_amp_snr) FILTER (series = 'c') >= 3, false) THEN 'c_only' ELSE 'weak' END AS colour_recovery FROM ({periods.ORACLES['fold_coherence']}) GROUP BY source_id""",
    "extra_folds": f"""WITH {recommendation.SCORED_SQL}, f AS (SELECT s.*, abs(ln(s.period_days / g.period_days)) AS separation FROM scored s JOIN (SELECT * FROM scored WHERE rank = 1) g USING (source_id, series) WHERE s.rank > 1),
        c AS (SELECT *, CAST(row_number() OVER (PARTITION BY source_id ORDER BY separation DESC, alias_score, series, rank) AS INTEGER) AS choice FROM f) SELECT source_id, series, rank, choice, round(separation, 6) AS separation FROM c WHERE choice <= 3""",
    "first_known_metadata": """WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS a, CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus END AS b FROM orders)
        SELECT o_custkey, coalesce(arg_min(a, o_orderkey) FILTER (a IS NOT NULL), arg_min(b, o_orderkey) FILTER (b IS NOT NULL)) AS object_name, arg_min(b, o_orderkey) FILTER (b IS NOT NULL) AS cluster_name FROM o GROUP BY o_custkey""",
    "truth_audit": "SELECT n_regionkey AS k, count(*) AS n, any_value(r_name) AS r_name FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey",
    "fold_period_choice": f"WITH {CATALOGUE_SQL} SELECT source_id, coalesce(CASE WHEN CAST(source_id AS BIGINT) % 10 = 0 THEN CAST(5 AS DOUBLE) END, recommended_period_days, CASE WHEN profile_chi2 > 0 THEN profile_chi2 END, 1) AS fold_period FROM cat",
}
