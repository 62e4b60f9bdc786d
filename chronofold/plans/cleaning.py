"""Queries over the cleaning and selection operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofold.operators import clean as C
from chronofold.sources.adapters import LC_SQL, light_curves


def cleaned(spark, sf_dir):
    return C.clean(light_curves(spark, sf_dir))


def clean_audit(spark, sf_dir):
    return cleaned(spark, sf_dir).select(
        "source_id",
        "row_id",
        F.round("snr", 6).alias("snr"),
        "hard_reject",
        "standard_keep",
        "final_keep",
        "reject_reason",
    )


def rounded(c, digits=6):
    """Rounded, with no negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def _rounded(df, digits=6):
    return df.select(*[rounded(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def clean_summary(spark, sf_dir):
    return _rounded(C.summary(cleaned(spark, sf_dir)))


def reject_reasons(spark, sf_dir):
    return C.reason_counts(cleaned(spark, sf_dir), per_source=False)


def reject_top3(spark, sf_dir):
    return C.top_reasons(C.reason_counts(cleaned(spark, sf_dir)))


def clean_totals(spark, sf_dir):
    return _rounded(C.totals(C.summary(cleaned(spark, sf_dir))))


def source_selection(spark, sf_dir):
    return C.select_sources(C.summary(cleaned(spark, sf_dir))).select("source_id", "n_final_keep", "selected", "selection_reasons")


def selection_reason_counts(spark, sf_dir):
    return C.selection_reasons(C.select_sources(C.summary(cleaned(spark, sf_dir))))


def selected_observations(spark, sf_dir):
    found = cleaned(spark, sf_dir)
    kept = C.selected_observations(found, C.select_sources(C.summary(found)))
    return kept.groupBy("source_id", "band").agg(F.count(F.lit(1)).alias("n"), F.min("mjd").alias("first"), F.max("mjd").alias("last"))


def rolling_baseline(spark, sf_dir):
    found = C.baseline(C.audit(light_curves(spark, sf_dir)))
    return found.select("source_id", "row_id", F.round("baseline_ujy", 6).alias("baseline_ujy"), F.round("z_resid", 6).alias("z_resid"))


AUDIT_SQL = LC_SQL + """,
audit AS (SELECT *, ujy / nullif(dujy, 0) AS snr,
    (mjd IS NOT NULL AND (m IS NULL OR (m > -5 AND m < 30)) AND (dm IS NULL OR (dm > 0 AND dm < 5)) AND coalesce(dujy > 0, false) AND coalesce(abs(ujy) < 1e9, false)) AS hard_valid,
    band IN ('c', 'o') AS filter_ok FROM lc),
judged AS (SELECT *, NOT hard_valid OR NOT filter_ok OR mag5sig < 10 AS hard_reject,
    concat_ws(';', CASE WHEN err <> 0 THEN 'fail_err==0' END, CASE WHEN NOT dujy < 10000 THEN 'fail_duJy<10000' END, CASE WHEN snr < -5 THEN 'fail_SNR>-5' END,
      CASE WHEN NOT mag5sig > 17 THEN 'fail_mag5sig>17' END, CASE WHEN NOT sky > 17 THEN 'fail_Sky>17' END) AS failed FROM audit),
cleaned AS (SELECT *, NOT hard_reject AND failed = '' AS standard_keep, NOT hard_reject AND failed = '' AS final_keep, false AS rescued,
    CASE WHEN hard_reject THEN concat_ws(';', CASE WHEN NOT hard_valid THEN 'HARD_invalid_nan_inf_or_bad_m_dm_flux' END, CASE WHEN NOT filter_ok THEN 'HARD_filter' END,
      CASE WHEN mag5sig < 10 THEN 'HARD_mag5sig<10' END) ELSE failed END AS reject_reason FROM judged)"""

SUMMARY_SQL = AUDIT_SQL + """,
summary AS (SELECT source_id, count(*) AS n_raw, count(*) FILTER (hard_reject) AS n_hard_reject, count(*) FILTER (standard_keep) AS n_standard_keep,
    count(*) FILTER (rescued) AS n_rescued, count(*) FILTER (final_keep) AS n_final_keep, count(*) FILTER (NOT final_keep) AS n_removed,
    count(*) FILTER (final_keep) / count(*) AS fraction_kept, min(mjd) AS mjd_min_raw, max(mjd) AS mjd_max_raw,
    CASE WHEN count(mjd) > 1 THEN max(mjd) - min(mjd) END AS baseline_days_raw, min(mjd) FILTER (final_keep) AS mjd_min_clean, max(mjd) FILTER (final_keep) AS mjd_max_clean,
    CASE WHEN count(mjd) FILTER (final_keep) > 1 THEN max(mjd) FILTER (final_keep) - min(mjd) FILTER (final_keep) END AS baseline_days_clean,
    count(*) FILTER (band = 'c') AS n_c_raw, count(*) FILTER (band = 'c' AND final_keep) AS n_c_clean, median(dm) FILTER (band = 'c' AND final_keep) AS median_dm_c_clean,
    median(dujy) FILTER (band = 'c' AND final_keep) AS median_dujy_c_clean, count(*) FILTER (band = 'o') AS n_o_raw, count(*) FILTER (band = 'o' AND final_keep) AS n_o_clean,
    median(dm) FILTER (band = 'o' AND final_keep) AS median_dm_o_clean, median(dujy) FILTER (band = 'o' AND final_keep) AS median_dujy_o_clean,
    string_agg(DISTINCT band, ',' ORDER BY band) AS filters_present_raw, coalesce(string_agg(DISTINCT band, ',' ORDER BY band) FILTER (final_keep), '') AS filters_present_clean
  FROM cleaned GROUP BY source_id)"""

SELECTION_SQL = SUMMARY_SQL + """,
best AS (SELECT *, least(CASE WHEN n_c_clean >= 30 THEN median_dm_c_clean END, CASE WHEN n_o_clean >= 30 THEN median_dm_o_clean END) AS dm FROM summary),
chosen AS (SELECT *, concat_ws(';', CASE WHEN n_final_keep < 100 THEN 'fewer_than_100_points' END, CASE WHEN greatest(n_c_clean, n_o_clean) < 30 THEN 'no_band_with_30_points' END,
    CASE WHEN NOT coalesce(baseline_days_clean >= 365, false) THEN 'baseline_under_365_days' END, CASE WHEN 1 - fraction_kept > 0.5 THEN 'more_than_50%_removed' END,
    CASE WHEN NOT coalesce(dm <= 0.2, false) THEN 'median_uncertainty_over_0.2_mag' END) AS selection_reasons FROM best)"""

_SUMMARY_ROUNDED = ", ".join(
    f"round({c}, 6) AS {c}"
    if c.startswith(("fraction", "mjd", "baseline", "median")) else c
    for c in (
        "source_id n_raw n_hard_reject n_standard_keep n_rescued n_final_keep n_removed fraction_kept mjd_min_raw mjd_max_raw baseline_days_raw mjd_min_clean mjd_max_clean " "baseline_days_clean n_c_raw n_c_clean median_dm_c_clean median_dujy_c_clean n_o_raw n_o_clean median_dm_o_clean median_dujy_o_clean filters_present_raw filters_present_clean"
    ).split()
)

QUERIES = {
    f.__name__: f
    for f in (
        clean_audit,
        clean_summary,
        reject_reasons,
        reject_top3,
        clean_totals,
        source_selection,
        selection_reason_counts,
        selected_observations,
        rolling_baseline,
    )
}

ORACLES = {
    "clean_audit": f"WITH {AUDIT_SQL} SELECT source_id, row_id, round(snr, 6) AS snr, hard_reject, standard_keep, final_keep, reject_reason FROM cleaned",
    "clean_summary": f"WITH {SUMMARY_SQL} SELECT {_SUMMARY_ROUNDED} FROM summary",
    "reject_reasons": f"WITH {AUDIT_SQL} SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reject_reason, ';')) AS reason FROM cleaned WHERE NOT final_keep) GROUP BY reason",
    "reject_top3": f"""WITH {AUDIT_SQL}, counts AS (SELECT source_id, reason, count(*) AS n FROM (SELECT source_id, unnest(string_split(reject_reason, ';')) AS reason FROM cleaned WHERE NOT final_keep)
        GROUP BY source_id, reason) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source_id ORDER BY n DESC, reason) AS INTEGER) AS rank FROM counts) WHERE rank <= 3""",
    "clean_totals": f"""WITH {SUMMARY_SQL} SELECT count(*) AS n_sources, CAST(sum(n_raw) AS BIGINT) AS n_raw, CAST(sum(n_final_keep) AS BIGINT) AS n_kept, CAST(sum(n_removed) AS BIGINT) AS n_removed,
        round(sum(n_removed) / sum(n_raw), 6) AS removed_fraction, round(median(1 - fraction_kept), 6) AS median_removed_fraction FROM summary""",
    "source_selection": f"WITH {SELECTION_SQL} SELECT source_id, n_final_keep, selection_reasons = '' AS selected, selection_reasons FROM chosen",
    "selection_reason_counts": f"WITH {SELECTION_SQL} SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(selection_reasons, ';')) AS reason FROM chosen WHERE selection_reasons <> '') GROUP BY reason",
    "selected_observations": f"""WITH {SELECTION_SQL} SELECT source_id, band, count(*) AS n, min(mjd) AS first, max(mjd) AS last FROM cleaned
        WHERE final_keep AND source_id IN (SELECT source_id FROM chosen WHERE selection_reasons = '') GROUP BY source_id, band""",
    "rolling_baseline": f"""WITH {AUDIT_SQL},
        t AS (SELECT *, CASE WHEN CASE WHEN count(*) FILTER (standard_keep) OVER (PARTITION BY source_id) > 50 THEN standard_keep ELSE hard_valid AND filter_ok END THEN ujy END AS good FROM cleaned),
        w AS (SELECT *, count(good) OVER roll AS n_roll, quantile_cont(good, 0.5) OVER roll AS q_roll, count(good) OVER b AS n_band, quantile_cont(good, 0.5) OVER b AS q_band,
               quantile_cont(ujy, 0.5) OVER b AS q_all FROM t
              WINDOW roll AS (PARTITION BY source_id, band ORDER BY mjd, row_id ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING), b AS (PARTITION BY source_id, band)),
        base AS (SELECT *, CASE WHEN n_band >= 20 THEN coalesce(CASE WHEN n_roll >= 8 THEN q_roll END, q_band) ELSE q_all END AS b0 FROM w)
        SELECT source_id, row_id, round(b0, 6) AS baseline_ujy, round((ujy - b0) / nullif(dujy, 0), 6) AS z_resid FROM base""",
}
