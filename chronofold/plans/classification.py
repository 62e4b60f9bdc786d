"""Queries over classification, labels and reports, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofold.operators import classify as K
from chronofold.operators import reports as R
from chronofold.plans.cleaning import _rounded
from chronofold.sources.adapters import CATALOGUE_SQL, FEATURE_SQL, catalogue_rows, feature_rows, table


def category_scores(spark, sf_dir):
    return _rounded(K.category_scores(feature_rows(spark, sf_dir)).select("source_id", *K.SCORES), 9)


def hellinger(spark, sf_dir):
    h = K.hellinger(K.category_scores(feature_rows(spark, sf_dir)))
    return _rounded(h.select("source_id", *[F.col("evidence")[i].alias(f"e{i}") for i in range(7)]))


def family_ladder(spark, sf_dir):
    d = K.families(K.category_scores(feature_rows(spark, sf_dir)))
    return _rounded(d.select("source_id", "primary_tag", "rung", "confidence"), 9)


def classified_catalogue(spark, sf_dir):
    d = K.classified(feature_rows(spark, sf_dir))
    return _rounded(
        d.select(
            "source_id",
            "dataset",
            "primary_tag",
            "secondary_tags",
            "review_reasons",
            "confidence",
            "interest_status",
            "interest_confidence",
            "interest_reasons",
            "needs_review",
        )
    )


def _manual(spark, sf_dir):
    m = table(spark, sf_dir, "labels")
    tag = F.when(F.col("toxic") == 1, "exotic;transit").when(
        (F.col("quality") == 0) & (F.col("doc_id") % 2 == 0),
        "exotic",
    ).when(F.col("quality") == 0, "flaring").when(F.col("doc_id") % 5 == 0, "nonsense").otherwise("")
    return m.select(
        F.col("doc_id").cast("string").alias("source_id"),
        F.concat(F.lit("d"), F.col("doc_id") % 2).alias("dataset"),
        tag.alias("manual_primary_tag"),
        F.when(F.col("doc_id") % 7 == 0, "checked").otherwise("").alias("manual_secondary_tags"),
    )


def manual_label_overlay(spark, sf_dir):
    t = catalogue_rows(spark, sf_dir).withColumnsRenamed(
        {"final_primary_tag": "primary_tag", "final_secondary_tags": "secondary_tags", "final_interest_status": "interest_status"}
    )
    return K.overlay(t, _manual(spark, sf_dir)).select(
        "source_id",
        "dataset",
        "final_primary_tag",
        "final_secondary_tags",
        "final_interest_status",
        "label_source",
    )


def memberships(spark, sf_dir):
    return K.memberships(catalogue_rows(spark, sf_dir))


def strength(spark, sf_dir):
    d = feature_rows(spark, sf_dir).withColumn(
        "final_primary_tag",
        F.element_at(F.array(*[F.lit(x) for x in K.FAMILIES]), (F.col("source_id").cast("long") % 7 + 1).cast("int")),
    ).withColumn("score_unknown", F.lit(0.25))
    return _rounded(d.select("source_id", "final_primary_tag", K.strength(d).alias("strength")))


def category_summary(spark, sf_dir):
    return _rounded(R.category_summary(catalogue_rows(spark, sf_dir)))


def dataset_categories(spark, sf_dir):
    return R.dataset_categories(catalogue_rows(spark, sf_dir))


def tag_summary(spark, sf_dir):
    return R.tag_summary(catalogue_rows(spark, sf_dir))


def family_tag_crosstab(spark, sf_dir):
    return R.family_tag_crosstab(catalogue_rows(spark, sf_dir), ["transit", "wavelike", "unknown", "noisy", "flaring"])


def unknown_reasons(spark, sf_dir):
    return R.unknown_reasons(catalogue_rows(spark, sf_dir))


def alias_summary(spark, sf_dir):
    return _rounded(R.alias_summary(catalogue_rows(spark, sf_dir)))


def interest_summary(spark, sf_dir):
    return _rounded(R.interest_summary(catalogue_rows(spark, sf_dir)))


def crosstab_margins(spark, sf_dir):
    return R.crosstab_with_margins(catalogue_rows(spark, sf_dir), "dataset", "final_primary_tag")


def review_queue(spark, sf_dir):
    return R.review_queue(catalogue_rows(spark, sf_dir))


def exotic_candidates(spark, sf_dir):
    return R.exotic_candidates(catalogue_rows(spark, sf_dir))


def strongest_examples(spark, sf_dir):
    return R.examples(catalogue_rows(spark, sf_dir), "profile_chi2", 12)


def _c(e: str) -> str:
    return f"greatest(0, least(1, {e}))"


SCORES_SQL = FEATURE_SQL + f""",
s0 AS (SELECT *, {_c('CAST(0.55 AS DOUBLE) * ' + _c('(profile_chi2 - 5) / 20') + ' + CAST(0.25 AS DOUBLE) * ' + _c('profile_snr / 12') + ' + CAST(0.2 AS DOUBLE) * ' + _c('phase_coverage / CAST(0.7 AS DOUBLE)'))} AS per, {_c('coherent_dimming_score')} AS dim, {_c('flare_event_count / 2')} AS fe,
   {_c('CAST(0.65 AS DOUBLE) * irregular_variability_score + CAST(0.35 AS DOUBLE) * ' + _c('evolution_raw_score / 2'))} AS irr, {_c('(scatter_over_error - CAST(1.5 AS DOUBLE)) / 5')} AS sc, {_c('dip_point_quality_fraction')} AS rel FROM fr),
s1 AS (SELECT *, {_c('flare_asymmetry')} * {_c('CAST(0.25 AS DOUBLE) * fe + CAST(0.15 AS DOUBLE) * ' + _c('validated_flare_independent_nights / 3') + ' + CAST(0.2 AS DOUBLE) * ' + _c('validated_flare_median_significance / 10') + ' + CAST(0.15 AS DOUBLE) * ' + _c('validated_flare_cross_filter_fraction') + ' + CAST(0.15 AS DOUBLE) * ' + _c('validated_flare_multi_point_fraction') + ' + CAST(0.1 AS DOUBLE) * ' + _c('flare_leave_one_event_out_persistent'))} AS fq FROM s0),
s2 AS (SELECT *, {_c('(1 - greatest(per, dim, irr, fe * fq)) * (1 - sc)')} AS score_nonvar, {_c('sc * (1 - greatest(per, irr, fe * fq)) + (1 - rel) * CAST(0.25 AS DOUBLE)')} AS score_noisy,
   {_c('dim * (CAST(0.65 AS DOUBLE) + CAST(0.35 AS DOUBLE) * rel) * ' + _c('(dip_dominance - 1) / CAST(1.5 AS DOUBLE)'))} AS score_transit FROM s1),
s3 AS (SELECT *, irr AS score_irregular_variable, {_c('per * (CAST(0.45 AS DOUBLE) * ' + _c('wave_model_score / CAST(0.65 AS DOUBLE)') + ' + CAST(0.55 AS DOUBLE) * ' + _c('ls_peak_ratio / 60') + ') * (1 - CAST(0.35 AS DOUBLE) * score_transit)')} AS score_wavelike,
   {_c('fq * ' + _c('flare_primary_validation_pass') + ' * ' + _c('1 - flare_point_fraction / CAST(0.1 AS DOUBLE)'))} AS score_flaring FROM s2),
scores AS (SELECT *, {_c('1 - greatest(score_transit, score_wavelike, score_flaring, score_irregular_variable, score_nonvar, score_noisy)')} AS score_unknown FROM s3)"""

LADDER_SQL = SCORES_SQL + f""",
a AS (SELECT *, coalesce(least(abs(recommended_period_days - 0.5) / 0.5, abs(recommended_period_days - CAST(2 AS DOUBLE) / 3) / (CAST(2 AS DOUBLE) / 3), abs(recommended_period_days - 1), abs(recommended_period_days - 2) / 2) < 0.01, false) AS al,
   coalesce(recommended_period_days > 0, false) AS has, coalesce(recommended_period_days > 0, false) AND profile_chi2 >= 5 AND profile_snr >= 5 AND phase_coverage >= 0.3 AS periodic, median_quoted_error > 0.25 AND robust_amplitude_mag < 3 * median_quoted_error AS poor,
   coherent_dimming_score >= 0.15 OR score_transit >= 0.25 OR dimming_event_count >= 1 OR dip_significance >= 3 OR dip_supporting_cycles > 0 AS claim,
   (dip_supporting_cycles >= 3 OR (dip_supporting_cycles >= 2 AND score_transit >= 0.88 AND dip_independent_nights >= 2)) AND dip_cycle_support_fraction >= 0.45 AS rep FROM scores),
b AS (SELECT *, claim AND (phase_time_section_dependence > 0.25 OR dip_single_section_fraction > 0.7) AS seas, claim AND (phase_coverage_near_dip < 0.45 OR phase_coverage_outside_dip < 0.3) AS gap, claim AND dip_point_quality_fraction < 0.65 AS drv,
   claim AND dip_supporting_cycles > 0 AND (dip_supporting_time_sections < 2 OR dip_single_section_fraction > 0.7) AS one,
   flare_event_count >= 2 AND flare_primary_validation_pass > 0 AND flare_leave_one_event_out_persistent > 0 AND strongest_flare_sigma >= 5 AND flare_asymmetry >= 0.75 AND flare_point_fraction <= 0.1 AND flare_duty_fraction >= 0.002 AND NOT poor AS fl,
   periodic AND ls_peak_ratio >= 20 AND evolution_raw_score >= 0.65 AND minimum_section_correlation <= 0.25 AS evo, periodic AND score_transit >= 0.3 AND score_wavelike >= 0.3 AND abs(wave_dimming_score_margin) <= 0.1 AS amb,
   periodic AND flare_dominance >= 1.6 AND flare_duty_cycle <= 0.35 AND out_of_flare_variation <= 0.4 AS bri FROM a),
c AS (SELECT *, CASE WHEN poor THEN 'poor' WHEN score_transit >= 0.52 AND dip_duty_cycle BETWEEN 0.02 AND 0.25 AND rep AND NOT drv AND NOT seas AND NOT gap AND NOT one AND (NOT amb OR score_transit >= score_wavelike) THEN 'transit' WHEN evo THEN 'evolved' WHEN amb THEN 'ambiguous'
   WHEN (periodic AND score_wavelike >= 0.35) OR bri THEN 'wave' WHEN fl THEN 'flaring' WHEN (scatter_over_error >= 2 AND temporal_coherence_score >= 0.42) OR evo THEN 'irregular' WHEN score_transit >= 0.3 OR dimming_event_count >= 1 THEN 'dimming' WHEN scatter_over_error > 4 THEN 'noisy'
   WHEN profile_chi2 < 5 AND temporal_coherence_score < 0.25 THEN 'nonvar' ELSE 'unresolved' END AS rung, list_sort([score_transit, score_wavelike, score_flaring, score_irregular_variable, score_nonvar, score_noisy, score_unknown], 'DESC') AS srt FROM b),
d AS (SELECT *, CASE rung WHEN 'poor' THEN 'noisy' WHEN 'transit' THEN 'transit' WHEN 'evolved' THEN 'irregular_variable' WHEN 'ambiguous' THEN CASE WHEN score_transit >= score_wavelike THEN 'transit' ELSE 'wavelike' END WHEN 'wave' THEN 'wavelike' WHEN 'flaring' THEN 'flaring'
   WHEN 'irregular' THEN 'irregular_variable' WHEN 'noisy' THEN 'noisy' WHEN 'nonvar' THEN 'nonvar' ELSE 'unknown' END AS tag FROM c),
e AS (SELECT *, CASE WHEN tag = 'transit' THEN CAST(0.3 AS DOUBLE) + CAST(0.35 AS DOUBLE) * score_transit + CAST(0.15 AS DOUBLE) * {_c('dip_supporting_cycles / 5')} + CAST(0.1 AS DOUBLE) * {_c('dip_supporting_time_sections / 3')} + CAST(0.1 AS DOUBLE) * {_c('dip_point_quality_fraction')}
   ELSE CAST(0.35 AS DOUBLE) + CAST(0.35 AS DOUBLE) * CASE tag WHEN 'wavelike' THEN score_wavelike WHEN 'flaring' THEN score_flaring WHEN 'irregular_variable' THEN score_irregular_variable WHEN 'nonvar' THEN score_nonvar WHEN 'noisy' THEN score_noisy ELSE score_unknown END
     + CAST(0.3 AS DOUBLE) * {_c('(srt[1] - srt[2]) / CAST(0.5 AS DOUBLE)')} END AS c0 FROM d),
f AS (SELECT *, CASE WHEN poor THEN least(c0, 0.5) ELSE c0 END * CASE WHEN gap OR seas THEN CAST(0.75 AS DOUBLE) ELSE 1 END AS c1 FROM e), g AS (SELECT *, CASE WHEN al THEN least(c1, 0.6) ELSE c1 END * CASE WHEN amb THEN CAST(0.85 AS DOUBLE) ELSE 1 END AS c2 FROM f)"""

_HALF = ", ".join(f"greatest({s}, 0) + 1e-12 AS r{i}" for i, s in enumerate(K.SCORES))
QUERIES = {
    f.__name__: f
    for f in (
        category_scores,
        hellinger,
        family_ladder,
        classified_catalogue,
        manual_label_overlay,
        memberships,
        strength,
        category_summary,
        dataset_categories,
        tag_summary,
        family_tag_crosstab,
        unknown_reasons,
        alias_summary,
        interest_summary,
        crosstab_margins,
        review_queue,
        exotic_candidates,
        strongest_examples,
    )
}
_TAGS = "list_distinct(list_filter(string_split({0}, ';'), lambda x: x <> ''))"
_ST, _RR = _TAGS.format("final_secondary_tags"), _TAGS.format("review_reasons")
ORACLES = {
    "category_scores": f"WITH {SCORES_SQL} SELECT source_id, {', '.join(f'round({s}, 9) + 0.0 AS {s}' for s in K.SCORES)} FROM scores",
    "hellinger": f"WITH {SCORES_SQL}, h AS (SELECT source_id, {_HALF} FROM scores), t AS (SELECT *, r0 + r1 + r2 + r3 + r4 + r5 + r6 AS s FROM h) SELECT source_id, {', '.join(f'round(sqrt(r{i} / s), 6) AS e{i}' for i in range(7))} FROM t",
    "family_ladder": f"WITH {LADDER_SQL} SELECT source_id, tag AS primary_tag, rung, round(CASE WHEN NOT has AND tag IN ('transit', 'wavelike') THEN least(c2, 0.4) ELSE c2 END, 9) AS confidence FROM g",
    "manual_label_overlay": f"""WITH {CATALOGUE_SQL}, m AS (SELECT CAST(doc_id AS VARCHAR) AS source_id, 'd' || (doc_id % 2) AS dataset, CASE WHEN toxic = 1 THEN 'exotic;transit' WHEN quality = 0 AND doc_id % 2 = 0 THEN 'exotic' WHEN quality = 0 THEN 'flaring' WHEN doc_id % 5 = 0 THEN 'nonsense' ELSE '' END AS t,
          CASE WHEN doc_id % 7 = 0 THEN 'checked' ELSE '' END AS s FROM labels),
        j AS (SELECT cat.*, t, s FROM cat LEFT JOIN m USING (source_id)), k AS (SELECT *, CASE t WHEN 'exotic;transit' THEN 'transit' WHEN 'exotic' THEN 'unknown' WHEN 'flaring' THEN 'flaring' END AS p, CASE WHEN t LIKE 'exotic%' THEN 'manually_confirmed_exotic' END AS i FROM j)
        SELECT source_id, dataset, coalesce(p, final_primary_tag) AS final_primary_tag, CASE WHEN s = 'checked' THEN s ELSE final_secondary_tags END AS final_secondary_tags, coalesce(i, final_interest_status) AS final_interest_status,
          CASE WHEN p IS NOT NULL OR s = 'checked' THEN 'manual' ELSE 'rules' END AS label_source FROM k""",
    "memberships": f"""WITH {CATALOGUE_SQL} SELECT DISTINCT * FROM (SELECT 'primary' AS group_type, final_primary_tag AS group_name, source_id, dataset FROM cat UNION ALL SELECT 'interest', final_interest_status, source_id, dataset FROM cat
        UNION ALL SELECT 'secondary', unnest({_ST}), source_id, dataset FROM cat UNION ALL SELECT 'review', unnest({_RR}), source_id, dataset FROM cat)""",
    "strength": f"""WITH {FEATURE_SQL}, p AS (SELECT *, ['transit', 'wavelike', 'flaring', 'irregular_variable', 'nonvar', 'noisy', 'unknown'][CAST(source_id AS BIGINT) % 7 + 1] AS t FROM fr)
        SELECT source_id, t AS final_primary_tag, round(CASE t WHEN 'transit' THEN coherent_dimming_score WHEN 'wavelike' THEN profile_chi2 WHEN 'flaring' THEN least(strongest_flare_sigma, 20) * log10(1 + flare_event_count) * greatest(flare_asymmetry, 0) * greatest(flare_leave_one_event_out_persistent, 0.25)
          WHEN 'irregular_variable' THEN irregular_variability_score WHEN 'noisy' THEN scatter_over_error WHEN 'nonvar' THEN -scatter_over_error ELSE 0.25 END, 6) + 0.0 AS strength FROM p""",
    "category_summary": f"WITH {CATALOGUE_SQL} SELECT final_primary_tag, count(*) AS n, round(median(confidence), 6) AS median_confidence, round(median(recommended_period_days), 6) AS median_period_days, round(median(profile_chi2), 6) AS median_chi2, count(*) FILTER (needs_review) AS n_review FROM cat GROUP BY final_primary_tag",
    "dataset_categories": f"WITH {CATALOGUE_SQL} SELECT dataset, final_primary_tag, count(*) AS n FROM cat GROUP BY dataset, final_primary_tag",
    "tag_summary": f"WITH {CATALOGUE_SQL} SELECT tag, count(*) AS n FROM (SELECT unnest({_ST}) AS tag FROM cat) GROUP BY tag",
    "family_tag_crosstab": f"WITH {CATALOGUE_SQL} SELECT tag, {', '.join(f'''count(*) FILTER (f = '{x}') AS {x}''' for x in ('transit', 'wavelike', 'unknown', 'noisy', 'flaring'))} FROM (SELECT final_primary_tag AS f, unnest({_ST}) AS tag FROM cat) GROUP BY tag",
    "unknown_reasons": f"WITH {CATALOGUE_SQL}, r AS (SELECT list_distinct(list_concat({_ST}, {_RR})) AS l FROM cat WHERE final_primary_tag = 'unknown') SELECT reason, count(*) AS n FROM (SELECT unnest(CASE WHEN len(l) > 0 THEN l ELSE ['untagged_unknown'] END) AS reason FROM r) GROUP BY reason",
    "alias_summary": f"WITH {CATALOGUE_SQL}, x AS (SELECT final_primary_tag, list_contains({_ST}, 'alias_period') AS a FROM cat) SELECT final_primary_tag, count(*) AS n, count(*) FILTER (a) AS n_alias, round(avg(CASE WHEN a THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS alias_fraction FROM x GROUP BY final_primary_tag",
    "interest_summary": f"WITH {CATALOGUE_SQL} SELECT final_interest_status, count(*) AS n, round(median(interest_confidence), 6) AS median_interest_confidence, round(median(confidence), 6) AS median_confidence FROM cat GROUP BY final_interest_status",
    "crosstab_margins": f"WITH {CATALOGUE_SQL} SELECT coalesce(dataset, 'All') AS dataset, coalesce(final_primary_tag, 'All') AS final_primary_tag, count(*) AS n FROM cat GROUP BY CUBE (dataset, final_primary_tag)",
    "review_queue": f"WITH {CATALOGUE_SQL} SELECT source_id, dataset, final_primary_tag, confidence, review_reasons FROM cat WHERE needs_review",
    "exotic_candidates": f"WITH {CATALOGUE_SQL} SELECT source_id, dataset, final_primary_tag, interest_confidence, interest_reasons FROM cat WHERE final_interest_status = 'exotic_candidate'",
    "strongest_examples": f"""WITH {CATALOGUE_SQL}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY final_primary_tag ORDER BY profile_chi2 DESC, source_id, dataset) AS INTEGER) AS place FROM cat)
        SELECT final_primary_tag, place, CAST((place - 1) // 9 AS INTEGER) AS page, source_id, dataset, profile_chi2 FROM r WHERE place <= 12""",
}
