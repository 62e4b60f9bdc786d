"""Queries over aliases and recommendations, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofold.config import UNIVERSAL_ALIASES, PeriodConfig
from chronofold.functions import columns as K
from chronofold.operators import aliases as A
from chronofold.operators import recommend as R
from chronofold.plans.cleaning import _rounded, rounded
from chronofold.sources.adapters import PEAK_SQL, SERIES_SQL, peak_rows, series_rows, table


def _inventory(spark, sf_dir):
    r = table(spark, sf_dir, "region").select((F.col("r_regionkey") * 2).cast("int").alias("ra_bin"), F.col("r_regionkey").alias("k"))
    r = r.select(
        "ra_bin",
        F.lit(0).alias("dec_bin"),
        F.explode(
            F.array(*[F.struct(F.lit(p).alias("p"), F.lit(h).alias("h")) for p, h in ((7.3, 0.5), (12.75, 0.4), (7.4, 0.6))])
        ).alias("x"),
        "k",
    )
    return r.select(
        "ra_bin",
        "dec_bin",
        (F.col("x.p") + F.col("k").cast("double") * 0.01).alias("alias_period_days"),
        F.col("x.h").alias("hit_fraction"),
    )


def _scored(spark, sf_dir):
    return A.score(peak_rows(spark, sf_dir), _inventory(spark, sf_dir))


def alias_score(spark, sf_dir):
    return _scored(spark, sf_dir).select(
        "source_id",
        "series",
        "rank",
        "universal_alias",
        rounded("field_alias_period").alias("field_alias_period"),
        rounded("alias_score").alias("alias_score"),
        "alias_labels",
        "is_alias",
    )


def alias_replacement(spark, sf_dir):
    return _rounded(A.replace(_scored(spark, sf_dir)))


def two_p_support(spark, sf_dir):
    p = peak_rows(spark, sf_dir)
    return _rounded(A.two_p_support(p, A.replace(_scored(spark, sf_dir))))


def field_alias_inventory(spark, sf_dir):
    return _rounded(A.learn_inventory(peak_rows(spark, sf_dir)))


def alias_memory(spark, sf_dir):
    current = A.learn_inventory(peak_rows(spark, sf_dir)).drop("field_key")
    kept = _inventory(spark, sf_dir).select(
        "ra_bin",
        "dec_bin",
        "alias_period_days",
        F.lit(10).cast("long").alias("n_stars_in_field"),
        (F.col("hit_fraction") * 10).cast("long").alias("n_stars_hit"),
        "hit_fraction",
    )
    return _rounded(A.merge_memory(current.unionByName(kept)))


def harmonic_relations(spark, sf_dir):
    s = series_rows(spark, sf_dir)
    return s.select(
        "source_id",
        "series",
        K.harmonic_relation(F.col("recommended_series_period_days"), F.col("catalogue_period_days")).alias("relation"),
        K.catalogue_match(F.col("recommended_series_period_days"), F.col("catalogue_period_days")).alias("match"),
        K.universal_alias(F.col("recommended_series_period_days")).alias("universal_alias"),
    )


def validation_rates(spark, sf_dir):
    return _rounded(R.validation_rates(harmonic_relations(spark, sf_dir), "series", "match"))


def series_class(spark, sf_dir):
    out = R.classify_series(R.evidence(series_rows(spark, sf_dir)).withColumn("filter_disagreement", F.col("top4_flat")))
    return out.select(
        "source_id",
        "series",
        "dominant",
        "significant",
        "likely_nonvar",
        rounded("series_score").alias("series_score"),
        "primary_classification",
        "secondary_classification",
    )


def source_recommendations(spark, sf_dir):
    return _rounded(R.recommend(series_rows(spark, sf_dir)))


def source_consensus(spark, sf_dir):
    s = series_rows(spark, sf_dir)
    return _rounded(R.consensus(s, R.recommend(s)))


def _rel(a: str, b: str, tol: float = 0.02) -> str:
    steps = "".join(
        f" WHEN abs({a}/{b} - CAST(1 AS DOUBLE)/{n}) / (CAST(1 AS DOUBLE)/{n}) <= {tol} THEN 'P/{n}' WHEN abs({a}/{b} - {n}) / {n} <= {tol} THEN '{n}P'"
        for n in range(2, 7)
    )
    return f"CASE WHEN NOT coalesce({a} > 0 AND {b} > 0, false) THEN '' WHEN abs({a}/{b} - 1) <= {tol} THEN 'direct'{steps} ELSE '' END"


def _match(a: str, b: str) -> str:
    r = _rel(a, b, 0.03)
    return f"CASE WHEN NOT coalesce({b} > 0, false) THEN 'no_catalogue_period' WHEN NOT coalesce({a} > 0, false) THEN 'no_recovered_period' WHEN ({r}) = '' THEN 'mismatch' ELSE {r} END"


def _universal(p: str) -> str:
    return "CASE" + "".join(
        f" WHEN abs({p} - CAST({d!r} AS DOUBLE)) / CAST({d!r} AS DOUBLE) <= 0.015 THEN '{n}'"
        for n, d in UNIVERSAL_ALIASES
    ) + " ELSE '' END"


_W = PeriodConfig()
SCORED_SQL = PEAK_SQL + f""",
inv AS (SELECT CAST(r_regionkey * 2 AS INTEGER) AS rb, p + CAST(r_regionkey AS DOUBLE) * CAST(0.01 AS DOUBLE) AS a, h FROM region, (VALUES (CAST(7.3 AS DOUBLE), CAST(0.5 AS DOUBLE)), (12.75, 0.4), (7.4, 0.6)) t(p, h)),
hit AS (SELECT source_id, series, rank, a, row_number() OVER (PARTITION BY source_id, series, rank ORDER BY h DESC, a) AS r FROM pk JOIN inv ON floor(ra_deg / 5) = rb AND abs(period_days - a) / a <= 0.02),
uni AS (SELECT pk.*, {_universal('period_days')} AS universal_alias, a AS field_alias_period, CASE WHEN pk.rank = 1 THEN raw_sampling_window_power ELSE 0 END AS win
        FROM pk LEFT JOIN (SELECT * FROM hit WHERE r = 1) h ON pk.source_id = h.source_id AND pk.series = h.series AND pk.rank = h.rank),
scored AS (SELECT *, alias_score >= 0.5 AS is_alias FROM (SELECT *, least(CAST(1 AS DOUBLE), CASE WHEN universal_alias <> '' THEN CAST(0.5 AS DOUBLE) ELSE 0 END + CASE WHEN field_alias_period IS NOT NULL THEN CAST(0.5 AS DOUBLE) ELSE 0 END + CAST(0.35 AS DOUBLE) * win) AS alias_score,
        concat_ws(';', CASE WHEN universal_alias <> '' THEN 'universal:' || universal_alias END, CASE WHEN field_alias_period IS NOT NULL THEN 'field' END, CASE WHEN win >= 0.4 THEN 'window' END) AS alias_labels FROM uni)),
able AS (SELECT s.*, f.period_days AS p1, f.is_alias AS bad, f.alias_score AS s1, f.alias_labels AS l1 FROM scored s JOIN (SELECT * FROM scored WHERE rank = 1) f USING (source_id, series)),
repl AS (SELECT source_id, series, any_value(p1) AS p1, any_value(bad) AS bad, any_value(s1) AS s1, any_value(l1) AS l1,
         min(rank) FILTER (bad AND rank BETWEEN 2 AND 3 AND NOT is_alias AND power_fraction_of_best >= 0.25 AND ({_rel('period_days', 'p1')}) = '') AS nr FROM able GROUP BY source_id, series),
adopted AS (SELECT repl.*, coalesce(pk.period_days, p1) AS p FROM repl LEFT JOIN pk ON pk.source_id = repl.source_id AND pk.series = repl.series AND pk.rank = nr)"""

EVIDENCE_SQL = SERIES_SQL + """,
ev0 AS (SELECT *, coalesce(best_to_second_power_ratio >= 1.5, false) OR coalesce(best_to_fourth_power_ratio >= 1.8, false) AS dominant, coalesce(raw_ls_fap <= 0.01, false) AS f,
        coalesce(ls_peak_snr >= 3, false) AS p, coalesce(raw_fold_amp_snr >= 3, false) AS d FROM ser),
ev1 AS (SELECT *, (f AND (dominant OR d OR p)) OR (dominant AND (d OR p)) OR (p AND d) AS significant, coalesce(best_to_fourth_power_ratio <= 1.2, false) AND NOT coalesce(raw_ls_fap <= 0.05, false) AND NOT p AND NOT d AS likely_nonvar FROM ev0),
ev AS (SELECT *, CASE WHEN significant THEN CAST(3 AS DOUBLE) ELSE 0 END + CASE WHEN dominant THEN 1 ELSE 0 END + coalesce(greatest(0, least(2, (best_to_second_power_ratio - 1) / CAST(0.5 AS DOUBLE))), 0)
   + coalesce(greatest(0, least(2, (best_to_fourth_power_ratio - 1) / CAST(0.8 AS DOUBLE))), 0) + coalesce(least(ls_peak_snr / 6, 1.5), 0) + coalesce(least(raw_fold_amp_snr / 6, 1.5), 0)
   + CASE WHEN raw_fold_scatter_reduction > 0 THEN least(raw_fold_scatter_reduction * 3, 1) ELSE 0 END + CASE WHEN f THEN CAST(0.5 AS DOUBLE) ELSE 0 END - CASE WHEN raw_is_alias_suspect THEN CAST(0.75 AS DOUBLE) ELSE 0 END
   + CASE WHEN alias_correction_applied THEN CAST(0.25 AS DOUBLE) ELSE 0 END - CASE WHEN top4_flat THEN CAST(0.75 AS DOUBLE) ELSE 0 END AS score FROM ev1)"""

_COLS = {
    "P": "recommended_series_period_days",
    "sig": "significant",
    "nv": "likely_nonvar",
    "sc": "score",
    "fs": "raw_fold_amp_snr",
    "ps": "ls_peak_snr",
    "tp": "two_p_supported",
    "mh": "mh_2p_supported",
    "pk": "top_peak_2p_present",
    "al": "raw_is_alias_suspect",
    "co": "alias_correction_applied",
    "bl": "bls_best_period_days",
}
_WIDE = ", ".join(
    f"any_value({c}) FILTER (series = '{s}') AS {k}_{t}"
    for t, s in (("m", "combined"), ("o", "o"), ("c", "c"))
    for k, c in _COLS.items()
)
_T = ("m", "o", "c")


def _any(k: str) -> str:
    return "(" + " OR ".join(f"coalesce({k}_{t}, false)" for t in _T) + ")"


def _pick(k: str) -> str:
    return f"CASE nearest WHEN 0 THEN {k}_m WHEN 1 THEN {k}_o WHEN 2 THEN {k}_c ELSE CASE WHEN P_m IS NOT NULL THEN {k}_m WHEN P_o IS NOT NULL THEN {k}_o ELSE {k}_c END END"


RECOMMEND_SQL = EVIDENCE_SQL + f""",
w0 AS (SELECT source_id, max(catalogue_period_days) AS cat, {_WIDE} FROM ev GROUP BY source_id),
w1 AS (SELECT *, {_any('sig')} AS any_sig, coalesce(nv_m, true) AND coalesce(nv_o, true) AND coalesce(nv_c, true) AS all_nv, CASE WHEN P_o IS NOT NULL AND P_c IS NOT NULL THEN {_rel('P_o', 'P_c')} ELSE '' END AS rel FROM w0),
w2 AS (SELECT *, CASE WHEN P_o IS NULL OR P_c IS NULL THEN 'insufficient' WHEN rel <> '' THEN 'agree' ELSE 'disagree' END AS xf,
   CASE WHEN coalesce(sig_o, false) AND coalesce(sig_c, false) THEN 'both_filters_significant' WHEN coalesce(sig_o, false) THEN 'o_only_significant' WHEN coalesce(sig_c, false) THEN 'c_only_significant'
        WHEN coalesce(sig_m, false) THEN 'combined_only_significant' ELSE 'no_significant_series' END AS band,
   CASE WHEN P_m IS NOT NULL AND sc_m >= coalesce(sc_o, -1e9) AND sc_m >= coalesce(sc_c, -1e9) THEN 'combined' WHEN P_o IS NOT NULL AND sc_o >= coalesce(sc_c, -1e9) THEN 'o' WHEN P_c IS NOT NULL THEN 'c' END AS top FROM w1),
w3 AS (SELECT *, CASE WHEN rel = 'direct' THEN P_o WHEN xf = 'agree' THEN least(P_o, P_c) END AS anchor, xf = 'agree' AND (coalesce(sig_o, false) OR coalesce(sig_c, false)) AS cons,
   CASE top WHEN 'combined' THEN P_m WHEN 'o' THEN P_o WHEN 'c' THEN P_c END AS top_p FROM w2),
w4 AS (SELECT *, NOT cons AND coalesce(top IN ('o', 'c'), false) AS single, xf = 'agree' AND P_m IS NOT NULL AND ({_rel('P_m', 'anchor')}) = '' AS over FROM w3),
w5 AS (SELECT *, single AND NOT coalesce(CASE top WHEN 'o' THEN fs_o >= 3 AND ps_o >= 4 ELSE fs_c >= 3 AND ps_c >= 4 END, false) AS warn, CASE WHEN cons OR over THEN anchor ELSE top_p END AS phot FROM w4),
w6 AS (SELECT *, CASE WHEN over THEN 'o_c_consensus_over_combined' WHEN cons THEN 'o_c_consensus' WHEN single THEN top || CASE WHEN warn OR NOT coalesce(CASE top WHEN 'o' THEN sig_o ELSE sig_c END, false) THEN '_low_support' ELSE '_single_filter' END
        ELSE coalesce(top, 'none') END AS src,
   CASE WHEN P_m IS NOT NULL AND abs(P_m - phot) <= coalesce(abs(P_o - phot), 1e9) AND abs(P_m - phot) <= coalesce(abs(P_c - phot), 1e9) THEN 0 WHEN P_o IS NOT NULL AND abs(P_o - phot) <= coalesce(abs(P_c - phot), 1e9) THEN 1 WHEN P_c IS NOT NULL THEN 2 END AS nearest FROM w5),
w7 AS (SELECT *, coalesce({_pick('tp')}, false) AS oe, coalesce({_pick('mh')}, false) AS mh, {_any('pk')} AS tp FROM w6),
w8 AS (SELECT *, CASE WHEN phot IS NULL THEN 'photometric_period' WHEN oe THEN '2P_supported_by_odd_even_difference' WHEN mh THEN '2P_supported_by_multiharmonic' WHEN tp THEN 'P_vs_2P_competitive' ELSE 'photometric_period' END AS hs FROM w7),
w9 AS (SELECT *, CASE WHEN hs LIKE '2P_supported%' THEN 2 * phot ELSE phot END AS fin, hs LIKE '2P_supported%' AS dbl, {_any('al')} AS na, {_any('co')} AS nc FROM w8),
w10 AS (SELECT *, concat_ws(';', {", ".join(f"CASE WHEN ({_rel(f'bl_{t}', 'fin')}) <> '' THEN '{n}:' || {_rel(f'bl_{t}', 'fin')} END" for t, n in zip(_T, ("combined", "o", "c")))}) AS det,
   concat_ws(';', {", ".join(f"CASE WHEN {k}_{t} THEN '{n}:{x}' END" for t, n in zip(_T, ("combined", "o", "c")) for k, x in (("al", "raw_alias"), ("co", "corrected")))}) AS flags FROM w9),
rec AS (SELECT *, CASE WHEN fin IS NULL THEN 'none' WHEN det <> '' THEN 'supports_recommended' ELSE 'no_bls_support' END AS bls FROM w10)"""

QUERIES = {
    f.__name__: f
    for f in (
        alias_score,
        alias_replacement,
        two_p_support,
        field_alias_inventory,
        alias_memory,
        harmonic_relations,
        validation_rates,
        series_class,
        source_recommendations,
        source_consensus,
    )
}

_MATCHED = f"WITH {SERIES_SQL}, h AS (SELECT source_id, series, {_rel('recommended_series_period_days', 'catalogue_period_days')} AS relation, {_match('recommended_series_period_days', 'catalogue_period_days')} AS match, {_universal('recommended_series_period_days')} AS universal_alias FROM ser)"

ORACLES = {
    "alias_score": f"WITH {SCORED_SQL} SELECT source_id, series, rank, universal_alias, round(field_alias_period, 6) AS field_alias_period, round(alias_score, 6) AS alias_score, alias_labels, is_alias FROM scored",
    "alias_replacement": f"""WITH {SCORED_SQL} SELECT source_id, series, round(s1, 6) AS raw_alias_score, l1 AS raw_alias_labels, bad AS raw_is_alias_suspect, nr IS NOT NULL AS alias_correction_applied, round(p, 6) AS recommended_series_period_days,
        coalesce(nr, 1) AS alias_corrected_rank, CASE WHEN nr IS NOT NULL THEN 'alias_corrected' WHEN bad THEN 'alias_period_possible_true_or_artifact' ELSE 'non_alias_period' END AS series_confidence_class FROM adopted""",
    "two_p_support": f"""WITH {SCORED_SQL}, near AS (SELECT a.source_id, a.series, pk.rank, period_days, power_fraction_of_best, row_number() OVER (PARTITION BY a.source_id, a.series ORDER BY power_fraction_of_best DESC, pk.rank) AS r
          FROM adopted a JOIN pk ON a.source_id = pk.source_id AND a.series = pk.series WHERE abs(period_days - 2 * p) / (2 * p) <= 0.02)
        SELECT a.source_id, a.series, round(period_days, 6) AS top_peak_2p_period_days, rank AS top_peak_2p_rank, round(power_fraction_of_best, 6) AS top_peak_2p_power_fraction, coalesce(power_fraction_of_best >= 0.05, false) AS top_peak_2p_present
        FROM adopted a LEFT JOIN (SELECT * FROM near WHERE r = 1) n ON a.source_id = n.source_id AND a.series = n.series""",
    "harmonic_relations": f"{_MATCHED} SELECT * FROM h",
    "validation_rates": f"""{_MATCHED} SELECT series, count(*) AS n, round(avg(CASE WHEN match = 'direct' THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS direct_rate,
        round(avg(CASE WHEN match NOT IN ('mismatch', 'no_recovered_period') THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS any_rate FROM h WHERE match <> 'no_catalogue_period' GROUP BY series""",
    "series_class": f"""WITH {EVIDENCE_SQL}, c AS (SELECT *, coalesce(best_to_fourth_power_ratio <= 1.2, false) AS flat, raw_alias_score >= 0.5 AS al, two_p_supported OR mh_2p_supported OR top_peak_2p_present AS ha FROM ev),
        t AS (SELECT *, list_filter([CASE WHEN alias_correction_applied THEN 'alias_corrected' END, CASE WHEN NOT alias_correction_applied AND al THEN 'alias_possible' END, CASE WHEN ha THEN 'harmonic_possible' END, CASE WHEN top4_flat THEN 'filter_disagreement' END], lambda x: x IS NOT NULL) AS tags FROM c)
        SELECT source_id, series, dominant, significant, likely_nonvar, round(score, 6) AS series_score,
          CASE WHEN NOT significant AND flat THEN 'nonvar' WHEN NOT significant OR flat OR NOT dominant THEN 'weak_or_ambiguous' WHEN al OR alias_correction_applied THEN 'alias_possible' WHEN ha THEN 'harmonic_possible' ELSE 'strong' END AS primary_classification,
          CASE WHEN len(tags) > 0 THEN array_to_string(tags[1:2], ';') ELSE 'none' END AS secondary_classification FROM t""",
    "source_recommendations": f"""WITH {RECOMMEND_SQL} SELECT source_id, cat AS catalogue_period_days, round(P_m, 6) AS combined_period_days, round(P_o, 6) AS o_period_days, round(P_c, 6) AS c_period_days, round(sc_m, 6) AS combined_score, round(sc_o, 6) AS o_score, round(sc_c, 6) AS c_score,
        band AS band_detection_status, xf AS cross_filter_status, rel AS cross_filter_relation, round(anchor, 6) AS cross_filter_anchor_period_days, round(phot, 6) AS photometric_period_days, round(2 * phot, 6) AS possible_2p_period_days, oe AS odd_even_2p_supported,
        mh AS multiharmonic_2p_supported, tp AS top_peak_2p_present, round(fin, 6) AS recommended_period_days, src AS recommended_period_source, hs AS harmonic_status, flags AS alias_flags,
        concat_ws(';', CASE WHEN warn THEN 'single_filter_below_snr_thresholds' END, CASE WHEN na THEN 'alias_warning' END, CASE WHEN nc THEN 'alias_corrected' END, CASE WHEN hs = 'P_vs_2P_competitive' THEN 'harmonic_review' END, CASE WHEN dbl THEN '2P_selected' END,
          CASE WHEN band IN ('o_only_significant', 'c_only_significant', 'combined_only_significant') THEN 'single_filter_or_combined_only' END, CASE WHEN xf = 'disagree' THEN 'filter_disagreement' END, CASE WHEN bls = 'supports_recommended' THEN 'BLS_support' END) AS warning_flags,
        CASE WHEN NOT any_sig AND all_nv THEN 'likely_nonvar' WHEN NOT any_sig OR warn THEN 'weak_period' ELSE 'strong_period' END AS detection_label,
        CASE WHEN NOT any_sig AND all_nv THEN 'likely_nonvar_low_significance_flat_peaks' WHEN NOT any_sig THEN 'weak_or_low_support_period' WHEN warn THEN 'single_filter_below_snr_thresholds' WHEN xf = 'agree' AND NOT na AND NOT nc AND NOT dbl THEN 'secure_non_alias'
          WHEN dbl THEN 'secure_2P_full_cycle' WHEN nc THEN 'alias_corrected_needs_review' WHEN na AND xf <> 'agree' THEN 'alias_period_not_filter_confirmed' WHEN band = 'o_only_significant' THEN 'single_filter_o_supported_check_colour_or_snr'
          WHEN band = 'c_only_significant' THEN 'single_filter_c_supported_check_colour_or_snr' WHEN xf = 'disagree' THEN 'filter_disagreement' ELSE 'single_series_or_low_support' END AS confidence_class,
        bls AS bls_support_status, det AS bls_support_detail, {_match('fin', 'cat')} AS recommended_catalogue_match FROM rec""",
    "source_consensus": f"""WITH {RECOMMEND_SQL}, p AS (SELECT *, concat_ws(';', {", ".join(f"CASE WHEN P_{a} IS NOT NULL AND P_{b} IS NOT NULL THEN '{x}:' || CASE WHEN ({_rel(f'P_{a}', f'P_{b}')}) = '' THEN 'mismatch' ELSE {_rel(f'P_{a}', f'P_{b}')} END END" for a, b, x in (("m", "o", "combined-o"), ("m", "c", "combined-c"), ("o", "c", "o-c")))}) AS pairs FROM rec)
        SELECT source_id, round(P_m, 6) AS combined_adopted_period_days, round(P_o, 6) AS o_adopted_period_days, round(P_c, 6) AS c_adopted_period_days, CAST(P_m IS NOT NULL AS INTEGER) + CAST(P_o IS NOT NULL AS INTEGER) + CAST(P_c IS NOT NULL AS INTEGER) AS n_successful_series,
        xf AS series_agreement, pairs AS pairwise_relations, round(coalesce(fin, P_m, P_o, P_c), 6) AS consensus_period_days FROM p""",
}
