"""Observation tables made from the star-schema tables, so that every operator has data at any scale factor.

All literals are doubles and all steps elementwise, so other engines get the same bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.functions.columns import task_count


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def light_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as light curves in bands c, o and (not allowed) w: one source per supplier."""
    x = table(spark, sf_dir, "lineitem")
    neg = F.col("l_orderkey") % 97 == 0
    scale = F.col("l_extendedprice") / F.lit(100.0)
    x = x.select(
        F.col("l_suppkey").cast("string").alias("source_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
        (
            F.datediff("l_shipdate", F.lit("1858-11-17")).cast("double")
            + (F.col("l_orderkey") % 1000).cast("double") / F.lit(1000.0)
        ).alias("mjd"),
        F.when(
            (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7),
            "w",
        ).when(F.col("l_linestatus") == "O", "o").otherwise("c").alias("band"),
        F.when(neg, -scale).otherwise(scale).alias("ujy"),
        (
            scale * (F.lit(0.01) + F.col("l_discount") / F.lit(2.0)) * (1 + F.col("l_suppkey") % 10).cast("double") * F.when(
                neg,
                (1 + F.col("l_linenumber")).cast("double"),
            ).otherwise(F.lit(1.0))
        ).alias("dujy"),
        (F.lit(16.0) + F.col("l_quantity") / F.lit(10.0)).alias("mag5sig"),
        (F.lit(17.0) + F.col("l_tax") * F.lit(20.0)).alias("sky"),
        F.when(
            (F.col("l_partkey") % 211 == 0) | ((F.col("l_suppkey") % 7 == 0) & (F.col("l_orderkey") % 2 == 0)),
            1,
        ).otherwise(0).alias("err"),
    )
    bright = F.col("ujy") > 0
    return x.withColumn("m", F.when(bright, F.lit(23.9) - F.lit(2.5) * F.log10("ujy"))).withColumn(
        "dm",
        F.when(bright, F.lit(1.0857) * F.col("dujy") / F.col("ujy")),
    )


def event_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as sparse curves: one source per user, one band per event type."""
    x = table(spark, sf_dir, "events")
    day = F.datediff("ts", F.lit("1970-01-01")).cast("double") * F.lit(86400e6)  # independent of the session's time zone
    micros = day + (
        F.hour("ts") * 3600
        + F.minute("ts") * 60
    ).cast("double") * F.lit(1e6) + F.expr("extract(SECOND FROM ts)").cast("double") * F.lit(1e6)
    return x.select(
        F.col("user_id").cast("string").alias("source_id"), F.col("event_id").alias("row_id"),
        (micros / F.lit(86400e6) + F.lit(40587.0)).alias("mjd"),
        F.col("event_type").alias("band"), F.col("value").alias("ujy"),
    )


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sky positions of the light curves' sources: one field per region."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(
        s["s_suppkey"].cast("string").alias("source_id"),
        (n["n_regionkey"] * 10).cast("double").alias("ra_deg"),
        F.lit(0.0).alias("dec_deg"),
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as a catalogue of periods."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("source_id"),
        F.col("p_size").cast("double").alias("catalogue_period_days"),
    )


def feature_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` in long form: (vec_id, label, dim, x)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


LC_SQL = """lc AS (
  SELECT *, CASE WHEN ujy > 0 THEN CAST(23.9 AS DOUBLE) - CAST(2.5 AS DOUBLE) * log10(ujy) END AS m,
            CASE WHEN ujy > 0 THEN CAST(1.0857 AS DOUBLE) * dujy / ujy END AS dm
  FROM (SELECT CAST(l_suppkey AS VARCHAR) AS source_id, l_orderkey * 10 + l_linenumber AS row_id,
    CAST(date_diff('day', DATE '1858-11-17', CAST(l_shipdate AS DATE)) AS DOUBLE) + CAST(l_orderkey % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS mjd,
    CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN 'w' WHEN l_linestatus = 'O' THEN 'o' ELSE 'c' END AS band,
    CASE WHEN l_orderkey % 97 = 0 THEN -(l_extendedprice / CAST(100 AS DOUBLE)) ELSE l_extendedprice / CAST(100 AS DOUBLE) END AS ujy,
    l_extendedprice / CAST(100 AS DOUBLE) * (CAST(0.01 AS DOUBLE) + l_discount / CAST(2 AS DOUBLE)) * CAST(1 + l_suppkey % 10 AS DOUBLE)
      * CASE WHEN l_orderkey % 97 = 0 THEN CAST(1 + l_linenumber AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS dujy,
    CAST(16 AS DOUBLE) + l_quantity / CAST(10 AS DOUBLE) AS mag5sig, CAST(17 AS DOUBLE) + l_tax * CAST(20 AS DOUBLE) AS sky,
    CASE WHEN l_partkey % 211 = 0 OR (l_suppkey % 7 = 0 AND l_orderkey % 2 = 0) THEN 1 ELSE 0 END AS err
  FROM lineitem))"""

EV_SQL = """ev AS (SELECT CAST(user_id AS VARCHAR) AS source_id, event_id AS row_id,
  CAST(epoch_us(ts) AS DOUBLE) / CAST(86400e6 AS DOUBLE) + CAST(40587 AS DOUBLE) AS mjd, event_type AS band, value AS ujy FROM events)"""


def _mod(a: int, m: int, b: int = 0):
    return (F.col("k") * a + b) % m


def series_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Period-search summaries, three series (o, c, combined) a part, made by modular arithmetic so that every rule's branches occur."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    p = p.repartition(task_count(p)).select(  # few bytes and much work a row: read alone, many parts are one task
        F.col("p_partkey").alias("part"),
        F.col("p_size").alias("size"),
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("name"), F.lit(i).alias("i")) for i, n in enumerate(("o", "c", "combined"))])
        ).alias("s"),
    )
    p = p.where("(part * 5 + s.i) % 11 <> 0").withColumn("k", F.col("part") * 3 + F.col("s.i"))
    base = (F.col("part") * 37 % 400).cast("double") / 10.0 + 0.7
    factor = F.element_at(F.array(*[F.lit(x) for x in (1.0, 1.0, 1.01, 2.0, 0.5, 1.37)]), (_mod(7, 6) + 1).cast("int"))
    period = F.when(_mod(1, 13) == 0, 1.0).when(_mod(1, 13) == 1, 0.5).otherwise(base * factor)
    part = lambda a, m, scale, b=0: _mod(a, m, b).cast("double") / scale
    return p.select(
        F.col("part").cast("string").alias("source_id"),
        F.col("s.name").alias("series"),
        period.alias("recommended_series_period_days"),
        period.alias("raw_ls_best_period_days"),
        part(17, 100, 125.0).alias("raw_ls_best_power"),
        F.when(_mod(3, 5) == 0, None).otherwise(part(11, 40, 1000.0)).alias("raw_ls_fap"),
        F.when(_mod(1, 17) == 0, None).otherwise(part(13, 90, 10.0)).alias("ls_peak_snr"),
        F.when(_mod(1, 19) == 0, None).otherwise(part(19, 80, 10.0)).alias("raw_fold_amp_snr"),
        (part(23, 60, 100.0) - 0.1).alias("raw_fold_scatter_reduction"),
        (part(29, 90, 100.0) + 1.0).alias("best_to_second_power_ratio"),
        F.when(_mod(1, 23) == 0, None).otherwise(part(31, 120, 100.0) + 1.0).alias("best_to_fourth_power_ratio"),
        (_mod(5, 7) == 0).alias("top4_flat"),
        part(41, 100, 100.0).alias("raw_alias_score"),
        (_mod(41, 100) >= 50).alias("raw_is_alias_suspect"),
        (_mod(43, 9) == 0).alias("alias_correction_applied"),
        (_mod(47, 8) == 0).alias("two_p_supported"),
        (_mod(53, 10) == 0).alias("mh_2p_supported"),
        (_mod(59, 6) == 0).alias("top_peak_2p_present"),
        F.when(_mod(1, 3) == 0, period * 2).otherwise(None).alias("bls_best_period_days"),
        F.col("size").cast("double").alias("catalogue_period_days"),
    )


SERIES_SQL = """ser AS (SELECT CAST(part AS VARCHAR) AS source_id, series, P AS recommended_series_period_days, P AS raw_ls_best_period_days, CAST(k * 17 % 100 AS DOUBLE) / 125 AS raw_ls_best_power,
  CASE WHEN k * 3 % 5 <> 0 THEN CAST(k * 11 % 40 AS DOUBLE) / 1000 END AS raw_ls_fap, CASE WHEN k % 17 <> 0 THEN CAST(k * 13 % 90 AS DOUBLE) / 10 END AS ls_peak_snr,
  CASE WHEN k % 19 <> 0 THEN CAST(k * 19 % 80 AS DOUBLE) / 10 END AS raw_fold_amp_snr, CAST(k * 23 % 60 AS DOUBLE) / 100 - CAST(0.1 AS DOUBLE) AS raw_fold_scatter_reduction,
  CAST(k * 29 % 90 AS DOUBLE) / 100 + 1 AS best_to_second_power_ratio, CASE WHEN k % 23 <> 0 THEN CAST(k * 31 % 120 AS DOUBLE) / 100 + 1 END AS best_to_fourth_power_ratio,
  k * 5 % 7 = 0 AS top4_flat, CAST(k * 41 % 100 AS DOUBLE) / 100 AS raw_alias_score, k * 41 % 100 >= 50 AS raw_is_alias_suspect, k * 43 % 9 = 0 AS alias_correction_applied,
  k * 47 % 8 = 0 AS two_p_supported, k * 53 % 10 = 0 AS mh_2p_supported, k * 59 % 6 = 0 AS top_peak_2p_present, CASE WHEN k % 3 = 0 THEN P * 2 END AS bls_best_period_days, CAST(size AS DOUBLE) AS catalogue_period_days
  FROM (SELECT *, CASE WHEN k % 13 = 0 THEN CAST(1 AS DOUBLE) WHEN k % 13 = 1 THEN CAST(0.5 AS DOUBLE) ELSE
        (CAST(part * 37 % 400 AS DOUBLE) / 10 + CAST(0.7 AS DOUBLE)) * CAST([1.0, 1.0, 1.01, 2.0, 0.5, 1.37][k * 7 % 6 + 1] AS DOUBLE) END AS P
        FROM (SELECT p_partkey AS part, p_size AS size, i, ['o', 'c', 'combined'][i + 1] AS series, p_partkey * 3 + i AS k FROM part, (VALUES (0), (1), (2)) t(i) WHERE (p_partkey * 5 + i) % 11 <> 0)))"""


def peak_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked peaks, four a series and three series a supplier, with the supplier's sky position."""
    s = fields(spark, sf_dir)
    s = s.select(
        "*",
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("name"), F.lit(i).alias("i")) for i, n in enumerate(("o", "c", "combined"))])
        ).alias("s"),
    )
    s = s.select("*", F.explode(F.array(*[F.lit(r) for r in (1, 2, 3, 4)])).alias("rank")).withColumn(
        "k",
        F.col("source_id").cast("long") * 12 + F.col("s.i") * 4 + F.col("rank"),
    )
    periods = F.array(*[F.lit(x) for x in (7.321, 1.0, 14.642, 3.3, 12.7, 25.4, 5.1, 2.0, 29.6, 9.9)])
    period = F.element_at(periods, (_mod(7, 10) + 1).cast("int")) * (1.0 + (_mod(3, 5) - 2).cast("double") * 0.002)
    return s.select(
        "source_id",
        "ra_deg",
        "dec_deg",
        F.col("s.name").alias("series"),
        "rank",
        period.alias("period_days"),
        (F.lit(0.9) / F.col("rank")).alias("power"),
        (F.lit(1.0) / F.col("rank")).alias("power_fraction_of_best"),
        (_mod(11, 100).cast("double") / 100.0).alias("raw_sampling_window_power"),
    )


PEAK_SQL = """pk AS (SELECT source_id, ra_deg, CAST(0 AS DOUBLE) AS dec_deg, series, rank, CAST([7.321, 1.0, 14.642, 3.3, 12.7, 25.4, 5.1, 2.0, 29.6, 9.9][k * 7 % 10 + 1] AS DOUBLE) * (1 + CAST(k * 3 % 5 - 2 AS DOUBLE) * CAST(0.002 AS DOUBLE)) AS period_days,
  CAST(0.9 AS DOUBLE) / rank AS power, CAST(1 AS DOUBLE) / rank AS power_fraction_of_best, CAST(k * 11 % 100 AS DOUBLE) / 100 AS raw_sampling_window_power
  FROM (SELECT CAST(s_suppkey AS VARCHAR) AS source_id, CAST(n_regionkey * 10 AS DOUBLE) AS ra_deg, ['o', 'c', 'combined'][i + 1] AS series, r AS rank, s_suppkey * 12 + i * 4 + r AS k
        FROM supplier JOIN nation ON s_nationkey = n_nationkey, (VALUES (0), (1), (2)) t(i), (VALUES (1), (2), (3), (4)) u(r)))"""


#: Name: (a, m, scale, offset); the value of part k is (k * a % m) / scale + offset.
FEATURE_SPECS = {
    "profile_chi2": (7, 60, 1.5, 0.0),
    "profile_snr": (11, 40, 2.0, 0.0),
    "phase_coverage": (13, 100, 100.0, 0.0),
    "coherent_dimming_score": (17, 100, 100.0, 0.0),
    "wave_model_score": (19, 80, 100.0, 0.0),
    "ls_peak_ratio": (23, 80, 1.0, 0.0),
    "flare_event_count": (5, 6, 1.0, 0.0),
    "validated_flare_median_significance": (29, 120, 10.0, 0.0),
    "validated_flare_independent_nights": (3, 5, 1.0, 0.0),
    "validated_flare_cross_filter_fraction": (31, 10, 10.0, 0.0),
    "validated_flare_multi_point_fraction": (37, 11, 10.0, 0.0),
    "flare_leave_one_event_out_persistent": (1, 2, 1.0, 0.0),
    "flare_asymmetry": (41, 100, 100.0, 0.0),
    "irregular_variability_score": (43, 100, 100.0, 0.0),
    "evolution_raw_score": (47, 150, 100.0, 0.0),
    "scatter_over_error": (53, 70, 10.0, 0.5),
    "dip_point_quality_fraction": (59, 50, 100.0, 0.5),
    "dip_dominance": (61, 30, 10.0, 0.5),
    "flare_primary_validation_pass": (1, 3, 2.0, 0.0),
    "flare_point_fraction": (67, 30, 300.0, 0.0),
    "median_quoted_error": (71, 40, 100.0, 0.01),
    "robust_amplitude_mag": (73, 100, 100.0, 0.05),
    "mirror_symmetry": (79, 30, 100.0, 0.71),
    "profile_peak_count": (1, 4, 1.0, 0.0),
    "dip_significance": (83, 120, 10.0, 0.0),
    "dip_duty_cycle": (89, 40, 100.0, 0.0),
    "dip_supporting_cycles": (97, 7, 1.0, 0.0),
    "dip_cycle_support_fraction": (101, 100, 100.0, 0.0),
    "dip_supporting_time_sections": (103, 5, 1.0, 0.0),
    "dip_independent_nights": (107, 6, 1.0, 0.0),
    "secondary_dip_depth_norm": (109, 100, 100.0, 0.0),
    "secondary_dip_phase_separation": (113, 50, 100.0, 0.0),
    "dip_depth_norm": (127, 80, 100.0, 0.2),
    "strongest_flare_sigma": (131, 150, 10.0, 0.0),
    "dimming_event_count": (3, 4, 1.0, 0.0),
    "strongest_dimming_sigma": (137, 150, 10.0, 0.0),
    "temporal_coherence_score": (139, 100, 100.0, 0.0),
    "out_of_distribution_score": (149, 130, 100.0, 0.0),
    "phase_time_section_dependence": (151, 40, 100.0, 0.0),
    "dip_single_section_fraction": (157, 100, 100.0, 0.0),
    "phase_coverage_near_dip": (163, 60, 100.0, 0.4),
    "phase_coverage_outside_dip": (167, 80, 100.0, 0.2),
    "flare_duty_fraction": (173, 20, 2000.0, 0.0),
    "single_point_flare_event_count": (1, 5, 2.0, 0.0),
    "flare_dominance": (179, 30, 10.0, 0.5),
    "flare_duty_cycle": (181, 60, 100.0, 0.0),
    "out_of_flare_variation": (191, 70, 100.0, 0.0),
    "minimum_section_correlation": (193, 200, 100.0, -1.0),
    "wave_dimming_score_margin": (197, 60, 100.0, -0.3),
    "section_median_range_sigma": (199, 60, 10.0, 0.0),
    "same_direction_excursion_groups": (1, 4, 1.0, 0.0),
    "dip_cycle_contrast_scatter": (211, 80, 100.0, 0.0),
    "maximum_section_distance": (223, 90, 100.0, 0.0),
    "sections_with_shape": (1, 5, 1.0, 0.0),
    "dimming_point_fraction": (227, 100, 1000.0, 0.0),
    "validated_flare_well_sampled_event_count": (1, 1, 1.0, 0.0),
}


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of morphology features a part, by modular arithmetic, so that the rules' branches occur."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"))
    period = F.when(F.col("k") % 9 == 0, None).when(F.col("k") % 14 == 1, 1.0).otherwise(F.col("size").cast("double") + 0.37)
    cols = [(_mod(a, m).cast("double") / float(s) + float(o)).alias(n) for n, (a, m, s, o) in FEATURE_SPECS.items()]
    return p.select(
        F.col("k").cast("string").alias("source_id"),
        F.concat(F.lit("d"), F.col("k") % 3).alias("dataset"),
        period.alias("recommended_period_days"),
        (F.col("k") % 6 == 0).alias("filter_disagreement"),
        *cols,
    )


FEATURE_SQL = "fr AS (SELECT CAST(p_partkey AS VARCHAR) AS source_id, 'd' || (p_partkey % 3) AS dataset, CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 14 = 1 THEN CAST(1 AS DOUBLE) ELSE CAST(p_size AS DOUBLE) + CAST(0.37 AS DOUBLE) END AS recommended_period_days, p_partkey % 6 = 0 AS filter_disagreement, " + ", ".join(f"CAST(p_partkey * {a} % {m} AS DOUBLE) / CAST({s} AS DOUBLE) + CAST({o} AS DOUBLE) AS {n}" for n, (a, m, s, o) in FEATURE_SPECS.items()) + " FROM part)"


def catalogue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classified catalogue, one row a part, with families, tags and reasons by modular arithmetic."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"))
    pick = lambda names, a: F.element_at(F.array(*[F.lit(n) for n in names]), (_mod(a, len(names)) + 1).cast("int"))
    return p.select(
        F.col("k").cast("string").alias("source_id"),
        pick(("d0", "d1"), 1).alias("dataset"),
        pick(("transit", "wavelike", "unknown", "noisy", "flaring"), 3).alias("final_primary_tag"),
        pick(
            ("", "alias_period", "multi_bump;symmetric", "symmetric", "alias_period;asymmetric;alias_period", "poor_photometry", ""),
            5,
        ).alias("final_secondary_tags"),
        pick(("", "low_confidence", "low_confidence;gappy_phase_coverage"), 7).alias("review_reasons"),
        pick(("routine", "review", "exotic_candidate", "review"), 11).alias("final_interest_status"),
        (_mod(13, 100).cast("double") / 100.0).alias("confidence"),
        (_mod(17, 100).cast("double") / 100.0).alias("interest_confidence"),
        F.when(_mod(1, 8) == 0, None).otherwise(F.col("size").cast("double")).alias("recommended_period_days"),
        _mod(19, 60).cast("double").alias("profile_chi2"),
        (_mod(7, 3) != 0).alias("needs_review"),
        pick(("", "complex_occultation"), 1).alias("interest_reasons"),
    )


CATALOGUE_SQL = """cat AS (SELECT CAST(k AS VARCHAR) AS source_id, ['d0', 'd1'][k % 2 + 1] AS dataset, ['transit', 'wavelike', 'unknown', 'noisy', 'flaring'][k * 3 % 5 + 1] AS final_primary_tag,
  ['', 'alias_period', 'multi_bump;symmetric', 'symmetric', 'alias_period;asymmetric;alias_period', 'poor_photometry', ''][k * 5 % 7 + 1] AS final_secondary_tags, ['', 'low_confidence', 'low_confidence;gappy_phase_coverage'][k * 7 % 3 + 1] AS review_reasons,
  ['routine', 'review', 'exotic_candidate', 'review'][k * 11 % 4 + 1] AS final_interest_status, CAST(k * 13 % 100 AS DOUBLE) / 100 AS confidence, CAST(k * 17 % 100 AS DOUBLE) / 100 AS interest_confidence,
  CASE WHEN k % 8 <> 0 THEN CAST(p_size AS DOUBLE) END AS recommended_period_days, CAST(k * 19 % 60 AS DOUBLE) AS profile_chi2, k * 7 % 3 <> 0 AS needs_review, ['', 'complex_occultation'][k % 2 + 1] AS interest_reasons
  FROM (SELECT p_partkey AS k, p_size FROM part))"""
