"""Queries over phase profiles, events and time-domain features, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofold.config import MorphologyConfig
from chronofold.operators import classify as K
from chronofold.operators import features as M
from chronofold.operators import measures as P
from chronofold.plans.cleaning import AUDIT_SQL, _rounded, cleaned
from chronofold.sources.adapters import catalogue

EVENT_SIGMA = 1.5


def points(spark, sf_dir):
    obs = cleaned(spark, sf_dir).where("final_keep and m is not null").select(
        "source_id",
        "row_id",
        F.col("mjd").alias("time"),
        F.col("m").alias("mag"),
        F.col("dm").alias("err"),
        F.col("band").alias("filter"),
    )
    return obs.join(catalogue(spark, sf_dir).withColumnRenamed("catalogue_period_days", "period"), "source_id").where("period > 0")


def phase_profile_bins(spark, sf_dir):
    return _rounded(M.phase_profile(points(spark, sf_dir)), 9)


def profile_significance(spark, sf_dir):
    return _rounded(M.profile_significance(M.phase_profile(points(spark, sf_dir))))


def fourier_descriptors(spark, sf_dir):
    return _rounded(M.fourier(M.phase_profile(points(spark, sf_dir))))


def _events(spark, sf_dir):
    p = points(spark, sf_dir)
    return M.excursion_events(M.residuals(p, M.phase_profile(p)), EVENT_SIGMA)


def excursion_events(spark, sf_dir):
    return _rounded(_events(spark, sf_dir), 9)


def event_metrics(spark, sf_dir):
    n = points(spark, sf_dir).groupBy("source_id").agg(F.count(F.lit(1)).alias("n_points"))
    return _rounded(M.event_metrics(_events(spark, sf_dir), n))


def section_profile(spark, sf_dir):
    return _rounded(
        M.with_sections(points(spark, sf_dir)).groupBy("source_id", "section").agg(
            F.count(F.lit(1)).alias("n"),
            F.percentile("mag", F.lit(0.5)).alias("median_mag"),
            F.min("time").alias("first"),
            F.max("time").alias("last"),
        )
    )


def temporal_coherence(spark, sf_dir):
    return _rounded(M.temporal_coherence(points(spark, sf_dir)))


def phase_section_mi(spark, sf_dir):
    return _rounded(M.phase_section_dependence(points(spark, sf_dir)))


def cycle_dimming(spark, sf_dir):
    p = points(spark, sf_dir)
    return _rounded(M.cycle_dimming(p, M.dips(M.phase_profile(p))))


def _listed(c: str):
    return F.array_join(F.transform(c, lambda x: F.format_number(F.coalesce(x, F.lit(0.0)), 4)), ";").alias(c)


def features_full(spark, sf_dir):
    """Every feature of every source, with its two blocks and profile as text; tests hold them against plain formulas."""
    f = P.source_features(points(spark, sf_dir))
    return _rounded(f.select(*[_listed(c) if t == "array<double>" else F.col(c) for c, t in f.dtypes if c != "events"]))


def feature_events(spark, sf_dir):
    """The excursion events that the features rest on, rejected ones included."""
    return _rounded(P.event_table(P.source_features(points(spark, sf_dir), MorphologyConfig(event_sigma=EVENT_SIGMA))), 9)


def classified_curves(spark, sf_dir):
    """Families of the light curves' own features."""
    out = K.classified(P.source_features(points(spark, sf_dir)).drop("events"))
    return _rounded(out.select("source_id", "primary_tag", "secondary_tags", "review_reasons", "interest_status", "confidence", *K.SCORES))


POINTS_SQL = AUDIT_SQL + """,
pts AS (SELECT source_id, row_id, mjd AS time, m AS mag, dm AS err, band AS filter, CAST(p_size AS DOUBLE) AS period, mjd / CAST(p_size AS DOUBLE) - floor(mjd / CAST(p_size AS DOUBLE)) AS phase
        FROM cleaned JOIN part ON source_id = CAST(p_partkey AS VARCHAR) WHERE final_keep AND m IS NOT NULL AND p_size > 0)"""
BINS_SQL = POINTS_SQL + """,
cen AS (SELECT *, mag - median(mag) OVER (PARTITION BY source_id, filter) AS x, CAST(least(floor(phase * 64), 63) AS INTEGER) AS bin FROM pts),
bins AS (SELECT source_id, filter, bin, count(*) AS n, median(x) AS value,
         coalesce(CASE WHEN count(*) > 3 AND quantile_cont(x, 0.84) - quantile_cont(x, 0.16) > 0 THEN (quantile_cont(x, 0.84) - quantile_cont(x, 0.16)) / 2 END, median(err)) / sqrt(count(*)) AS sigma FROM cen GROUP BY source_id, filter, bin)"""
EVENTS_SQL = BINS_SQL + f""",
res AS (SELECT cen.*, x - value AS r FROM cen JOIN bins USING (source_id, filter, bin)),
zed AS (SELECT *, r / greatest(err, (quantile_cont(r, 0.84) OVER w - quantile_cont(r, 0.16) OVER w) / 2) AS z FROM res WINDOW w AS (PARTITION BY source_id)),
exc AS (SELECT *, CASE WHEN z > 0 THEN 'dimming' ELSE 'brightening' END AS event_type FROM zed WHERE abs(z) > {EVENT_SIGMA}),
brk AS (SELECT *, lag(time) OVER w AS before FROM exc WINDOW w AS (PARTITION BY source_id, event_type ORDER BY time, row_id)),
num AS (SELECT *, sum(CASE WHEN before IS NULL OR time - before > 1 OR floor(time) <> floor(before) THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, event_type ORDER BY time, row_id ROWS UNBOUNDED PRECEDING) AS event_number FROM brk),
evt AS (SELECT source_id, event_type, CAST(event_number AS BIGINT) AS event_number, median(time) AS event_time, count(*) AS n_measurements, max(time) - min(time) AS event_duration_days, string_agg(DISTINCT filter, ';' ORDER BY filter) AS represented_filters,
        max(abs(z)) AS peak, median(abs(z)) AS med, median(err) AS mq, min(err) AS lq, max(err) AS hq, count(*) >= 2 AS multi, count(DISTINCT filter) >= 2 AND count(*) >= 2 AS crossed FROM num GROUP BY source_id, event_type, event_number)"""


_FLARE, _DIM = ("event_type = '" + t + "' AND (multi OR crossed)" for t in ("brightening", "dimming"))
_METRICS = {
    "flare_event_count": f"count(*) FILTER ({_FLARE})",
    "dimming_event_count": f"count(*) FILTER ({_DIM})",
    "strongest_flare_sigma": f"max(peak) FILTER ({_FLARE})",
    "strongest_dimming_sigma": f"max(peak) FILTER ({_DIM})",
    "flare_point_fraction": "sum(n_measurements) FILTER (event_type = 'brightening') / any_value(n_points)",
    "dimming_point_fraction": "sum(n_measurements) FILTER (event_type = 'dimming') / any_value(n_points)",
    "flare_duty_fraction": f"sum(n_measurements) FILTER ({_FLARE}) / any_value(n_points)",
    "validated_flare_independent_nights": f"count(DISTINCT floor(event_time)) FILTER ({_FLARE})",
    "validated_flare_median_significance": f"median(med) FILTER ({_FLARE})",
    "validated_flare_cross_filter_fraction": f"avg(CAST(crossed AS INT)) FILTER ({_FLARE})",
    "validated_flare_multi_point_fraction": f"avg(CAST(multi AS INT)) FILTER ({_FLARE})",
    "validated_flare_well_sampled_event_count": f"count(*) FILTER ({_FLARE} AND n_measurements >= 3)",
    "validated_flare_cross_filter_event_count": f"count(*) FILTER ({_FLARE} AND crossed)",
    "single_point_flare_event_count": "count(*) FILTER (event_type = 'brightening' AND n_measurements = 1)",
}


_PI2 = "CAST(6.283185307179586 AS DOUBLE)"
_FOURIER = ", ".join(f"avg(v * cos({_PI2} * bin / 64 * {h})) AS a{h}, avg(v * sin({_PI2} * bin / 64 * {h})) AS b{h}" for h in range(1, 5))


def _amp(h: int) -> str:
    return f"2 * sqrt(a{h} * a{h} + b{h} * b{h})"


def _phi(h: int) -> str:
    d = f"(atan2(b{h}, a{h}) - {h} * atan2(b1, a1) + CAST(3.141592653589793 AS DOUBLE))"
    return f"{d} - floor({d} / {_PI2}) * {_PI2} - CAST(3.141592653589793 AS DOUBLE)"


QUERIES = {
    f.__name__: f
    for f in (
        phase_profile_bins,
        profile_significance,
        fourier_descriptors,
        excursion_events,
        event_metrics,
        section_profile,
        temporal_coherence,
        phase_section_mi,
        cycle_dimming,
        features_full,
        feature_events,
        classified_curves,
    )
}

ORACLES = {
    "phase_profile_bins": f"WITH {BINS_SQL} SELECT source_id, filter, bin, n, round(value, 9) AS value, round(sigma, 9) AS sigma FROM bins",
    "profile_significance": f"""WITH {BINS_SQL}, b AS (SELECT *, value - median(value) OVER (PARTITION BY source_id, filter) AS v, CASE WHEN sigma > 0 THEN sigma END AS s FROM bins),
        g AS (SELECT source_id, filter, count(*) AS occupied, quantile_cont(v, 0.95) - quantile_cont(v, 0.05) AS amp, avg((v / s) * (v / s)) AS chi2, median(s) AS typ FROM b GROUP BY source_id, filter)
        SELECT source_id, filter, occupied, round(occupied / 64, 6) AS coverage, round(amp, 6) AS amplitude, CASE WHEN occupied >= 8 THEN round(chi2, 6) END AS profile_chi2, CASE WHEN occupied >= 8 THEN round(amp / greatest(typ, 1e-9), 6) END AS profile_snr,
          CASE WHEN occupied >= 8 THEN round(greatest(0, least(1, (chi2 - 1) / 24)) * greatest(0, least(1, occupied / 64 / CAST(0.65 AS DOUBLE))), 6) ELSE 0 END AS reliability FROM g""",
    "fourier_descriptors": f"""WITH {BINS_SQL}, b AS (SELECT *, value - avg(value) OVER (PARTITION BY source_id, filter) AS v FROM bins), s AS (SELECT source_id, filter, {_FOURIER} FROM b GROUP BY source_id, filter)
        SELECT source_id, filter, round({_amp(1)}, 6) AS fourier_amplitude, {", ".join(f"round({_amp(h)} / greatest({_amp(1)}, 1e-12), 6) AS fourier_r{h}1, round({_phi(h)}, 6) AS fourier_phi{h}1" for h in (2, 3, 4))} FROM s""",
    "excursion_events": f"""WITH {EVENTS_SQL} SELECT source_id, event_type, event_number, round(event_time, 9) AS event_time, n_measurements, round(event_duration_days, 9) AS event_duration_days, represented_filters, round(peak, 9) AS peak_residual_significance,
        round(med, 9) AS median_residual_significance, round(mq, 9) AS median_quoted_uncertainty, round(lq, 9) AS minimum_quoted_uncertainty, round(hq, 9) AS maximum_quoted_uncertainty, multi AS is_multi_point, crossed AS has_cross_filter_support, multi OR crossed AS passes_quality_validation, CAST(floor(event_time) AS BIGINT) AS independent_observing_night,
        CASE WHEN multi OR crossed THEN '' ELSE 'single_point_excursion' END AS rejection_reason FROM evt""",
    "event_metrics": f"""WITH {EVENTS_SQL}, n AS (SELECT source_id, count(*) AS n_points FROM pts GROUP BY source_id),
        m AS (SELECT n.source_id, any_value(n_points) AS n_points, {", ".join(f"round(coalesce(CAST({x} AS DOUBLE), 0), 6) AS {c}" for c, x in _METRICS.items())} FROM n LEFT JOIN evt USING (source_id) GROUP BY n.source_id)
        SELECT *, round(coalesce(flare_event_count / nullif(flare_event_count + dimming_event_count, 0), 0), 6) AS flare_asymmetry, CAST(flare_event_count - 1 >= 2 AS DOUBLE) AS flare_leave_one_event_out_persistent,
          CAST(flare_event_count >= 2 OR validated_flare_well_sampled_event_count >= 1 OR validated_flare_cross_filter_event_count >= 1 AS DOUBLE) AS flare_primary_validation_pass FROM m""",
    "section_profile": f"""WITH {POINTS_SQL}, s AS (SELECT *, CAST(ntile(4) OVER (PARTITION BY source_id ORDER BY time, row_id) - 1 AS INTEGER) AS section FROM pts)
        SELECT source_id, section, count(*) AS n, round(median(mag), 6) AS median_mag, round(min(time), 6) AS first, round(max(time), 6) AS last FROM s GROUP BY source_id, section""",
    "temporal_coherence": f"""WITH {POINTS_SQL}, a AS (SELECT *, mag - median(mag) OVER s AS c, ntile(4) OVER (PARTITION BY source_id ORDER BY time, row_id) AS section, count(*) OVER s AS n FROM pts WINDOW s AS (PARTITION BY source_id)),
        a2 AS (SELECT *, abs(c - median(c) OVER (PARTITION BY source_id)) AS dev FROM a),
        b AS (SELECT *, greatest(CASE WHEN n >= 8 THEN (quantile_cont(c, 0.84) OVER s - quantile_cont(c, 0.16) OVER s) / 2 ELSE 1.4826 * median(dev) OVER s END, median(err) OVER s, 1e-9) AS scale, lead(c) OVER (PARTITION BY source_id ORDER BY time, row_id) AS nxt, median(c) OVER s AS mc FROM a2 WHERE n >= 6 WINDOW s AS (PARTITION BY source_id)),
        d AS (SELECT *, CASE WHEN abs(c) >= 2 * scale THEN sign(c) ELSE 0 END AS sg FROM b), e AS (SELECT *, CASE WHEN sg = lag(sg) OVER (PARTITION BY source_id ORDER BY time, row_id) THEN 0 ELSE 1 END AS brk FROM d),
        f AS (SELECT *, sum(brk) OVER (PARTITION BY source_id ORDER BY time, row_id ROWS UNBOUNDED PRECEDING) AS isl FROM e),
        runs AS (SELECT source_id, count(*) AS groups FROM (SELECT source_id, isl FROM f WHERE sg <> 0 GROUP BY source_id, isl HAVING count(*) >= 2) GROUP BY source_id),
        secs AS (SELECT source_id, max(sm) - min(sm) AS sr FROM (SELECT source_id, section, median(mag) AS sm FROM b GROUP BY source_id, section) GROUP BY source_id),
        g AS (SELECT source_id, avg((nxt - c) * (nxt - c)) / greatest(var_pop(c), 1e-12) AS eta, corr(c, nxt) AS lag, any_value(scale) AS scale, 1.4826 * median(abs(c - mc)) AS rob, median(err) AS me FROM b GROUP BY source_id),
        j AS (SELECT g.*, coalesce(groups, 0) AS groups, sr / scale AS rng FROM g LEFT JOIN runs USING (source_id) JOIN secs USING (source_id)),
        k AS (SELECT *, greatest(0, least(1, CAST(0.35 AS DOUBLE) * greatest(0, least(1, (2 - eta) / CAST(1.5 AS DOUBLE))) + CAST(0.3 AS DOUBLE) * greatest(0, least(1, coalesce(lag, 0))) + CAST(0.2 AS DOUBLE) * greatest(0, least(1, groups / 3)) + CAST(0.15 AS DOUBLE) * greatest(0, least(1, rng / 4)))) AS sc FROM j)
        SELECT source_id, round(eta, 6) AS von_neumann_ratio, round(lag, 6) AS raw_time_lag1_correlation, groups AS same_direction_excursion_groups, round(rng, 6) AS section_median_range_sigma, round(sc, 6) AS temporal_coherence_score,
          round(sc * greatest(0, least(1, (rob / greatest(me, 1e-9) - CAST(1.5 AS DOUBLE)) / 4)), 6) AS irregular_variability_score FROM k""",
    "phase_section_mi": f"""WITH {POINTS_SQL}, s AS (SELECT source_id, ntile(4) OVER (PARTITION BY source_id ORDER BY time, row_id) AS section, least(floor(phase * 8), 7) AS o FROM pts),
        c AS (SELECT source_id, o, section, count(*) AS n FROM s GROUP BY source_id, o, section), t AS (SELECT source_id, sum(n) AS tot FROM c GROUP BY source_id),
        po AS (SELECT source_id, o, sum(n) AS n_o FROM c GROUP BY source_id, o), ps AS (SELECT source_id, section, sum(n) AS n_s FROM c GROUP BY source_id, section),
        mi AS (SELECT source_id, sum(n / tot * ln((n / tot) / ((n_o / tot) * (n_s / tot)))) AS mi FROM c JOIN t USING (source_id) JOIN po USING (source_id, o) JOIN ps USING (source_id, section) GROUP BY source_id),
        h AS (SELECT source_id, -sum(n_o / tot * ln(n_o / tot)) AS h FROM po JOIN t USING (source_id) GROUP BY source_id)
        SELECT source_id, round(greatest(0, least(1, mi / greatest(h, 1e-9))), 6) AS phase_time_section_dependence FROM mi JOIN h USING (source_id)""",
    "cycle_dimming": f"""WITH {BINS_SQL}, vb AS (SELECT source_id, bin, avg(value) AS v FROM bins GROUP BY source_id, bin), db AS (SELECT *, v - median(v) OVER (PARTITION BY source_id) AS depth FROM vb),
        xb AS (SELECT *, max(depth) OVER (PARTITION BY source_id) AS deepest FROM db),
        dip AS (SELECT source_id, min(bin) FILTER (depth = deepest) / CAST(64 AS DOUBLE) AS dp, avg(CAST(depth >= deepest / 2 AS INT)) AS duty FROM xb GROUP BY source_id),
        s AS (SELECT pts.*, dp, greatest(least(duty, CAST(0.65 AS DOUBLE)), CAST(0.02 AS DOUBLE)) AS width, ntile(4) OVER (PARTITION BY source_id ORDER BY time, row_id) AS section, (time - min(time) OVER (PARTITION BY source_id)) / period AS turn FROM pts JOIN dip USING (source_id)),
        g AS (SELECT *, floor(turn) AS cycle, least(abs(turn - floor(turn) - dp), 1 - abs(turn - floor(turn) - dp)) <= width / 2 AS inside FROM s),
        w AS (SELECT *, greatest((quantile_cont(mag, 0.84) OVER a - quantile_cont(mag, 0.16) OVER a) / 2, median(err) OVER a, 1e-6) AS scale, coalesce(median(CASE WHEN NOT inside THEN mag END) OVER a, median(mag) OVER a) AS level,
              median(CASE WHEN NOT inside THEN mag END) OVER (PARTITION BY source_id, cycle) AS own, count(*) FILTER (inside) OVER a AS n_in FROM g WINDOW a AS (PARTITION BY source_id)),
        d AS (SELECT *, coalesce(own, level) AS base FROM w WHERE n_in >= 2 AND inside AND (own IS NOT NULL OR width >= 0.40)),
        c AS (SELECT source_id, cycle, median(mag) - any_value(base) AS depth, greatest(any_value(scale) / sqrt(count(*)), median(err), 1e-9) AS sigma FROM d GROUP BY source_id, cycle),
        k AS (SELECT *, depth / sigma AS contrast, depth / sigma >= 1.5 AND depth > 0 AS good FROM c),
        t AS (SELECT source_id, count(DISTINCT section) AS sections, count(DISTINCT floor(time)) AS nights FROM d JOIN k USING (source_id, cycle) WHERE good AND mag > base GROUP BY source_id)
        SELECT k.source_id, count(*) AS dip_covered_cycles, count(*) FILTER (good) AS dip_supporting_cycles, CAST(coalesce(any_value(sections), 0) AS INT) AS dip_supporting_time_sections, CAST(coalesce(any_value(nights), 0) AS INT) AS dip_independent_nights,
          round(count(*) FILTER (good) / count(*), 6) AS dip_cycle_support_fraction, round(median(contrast), 6) AS dip_local_contrast_sigma FROM k LEFT JOIN t USING (source_id) GROUP BY k.source_id""",
}
