"""All features of a source's light curve, from relational parts.

``source_features`` joins what ``folds``, ``shapes``, ``evidence`` and ``features`` work
out, each grouped by source, into one row a source with its numbers, its excursion
events and its two feature blocks. The diagnostic periodogram alone needs sums of
sines over a grid: a small numpy helper works them out inside a source's group.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.config import MorphologyConfig
from chronofold.functions import circles as C
from chronofold.functions.columns import bin_of, clip01, let, median, task_count
from chronofold.operators import evidence as D
from chronofold.operators import features as M
from chronofold.operators import folds as O
from chronofold.operators import shapes as S
from chronofold.operators import spectral
from chronofold.operators.graph import cut_lineage

# Names of the features, by what makes them, in the order of the table.
BASIC = ("n_points", "n_observations_c", "n_observations_o", "baseline_days", "c_band_weight", "o_band_weight")
FOLD = (
    "profile_chi2", "profile_snr", "c_profile_chi2", "o_profile_chi2", "amplitude_over_point_scatter", "phase_coverage", "robust_amplitude_mag", "median_quoted_error", "scatter_over_error", "bin_sigma_mag",
    "filter_profile_correlation", "half_period_profile_distance", "double_period_profile_distance", "double_period_odd_even_difference",
)
POWER = ("ls_peak_power", "ls_peak_period_days", "ls_peak_ratio")
EVOLUTION = ("evolution_raw_score", "minimum_section_correlation", "maximum_section_correlation", "sections_with_shape", "maximum_section_distance", "section_amplitude_log_range")
SHAPE = (
    "dip_depth_norm", "flare_depth_norm", "dip_duty_cycle", "dip_width_bins", "secondary_dip_depth_norm", "secondary_dip_phase_separation", "out_of_dip_variation", "out_of_flare_variation", "flare_dominance",
    "flare_duty_cycle", "dip_dominance", "dip_significance", "mirror_symmetry", "profile_peak_count", "sinusoid_residual_ratio", "harmonic_energy_ratio", "skewness", *(f"fourier_h{h}_amplitude" for h in S.HARMONICS),
)
EVENTS = (
    "flare_event_count", "dimming_event_count", "flare_asymmetry", "flare_point_fraction", "dimming_point_fraction", "strongest_flare_sigma", "strongest_dimming_sigma", "flare_duty_fraction",
    "validated_flare_independent_nights", "validated_flare_median_significance", "validated_flare_cross_filter_fraction", "validated_flare_multi_point_fraction", "validated_flare_well_sampled_event_count",
    "validated_flare_cross_filter_event_count", "single_point_flare_event_count", "flare_leave_one_event_out_persistent", "flare_primary_validation_pass",
)
TEMPORAL = ("von_neumann_ratio", "raw_time_lag1_correlation", "same_direction_excursion_groups", "section_median_range_sigma", "temporal_coherence_score", "irregular_variability_score")
DIMMING = (
    "dip_supporting_cycles", "dip_covered_cycles", "dip_cycle_support_fraction", "dip_independent_nights", "dip_supporting_time_sections", "phase_time_section_dependence", "dip_section_concentration",
    "dip_single_section_fraction", "phase_coverage_near_dip", "phase_coverage_outside_dip", "dip_local_contrast_sigma", "dip_cycle_contrast_scatter", "dip_point_quality_fraction",
    *(f"coherent_dimming_{e}_component" for e in (*D.COMPONENTS, "seasonal_penalty", "alias_penalty")), "coherent_dimming_score",
)
MODELS = ("wave_model_score", "dimming_model_score", "wave_dimming_score_margin")
FOURIER = tuple(f"fourier_{x}{h}1" for h in S.HARMONICS[1:] for x in ("R", "phi"))
NUMBERS = (*BASIC, *FOLD, *POWER, *EVOLUTION, "cycles_with_dip", "dip_phase", *SHAPE, *EVENTS, *TEMPORAL, *DIMMING, *MODELS, "profile_align_shift_bins", *FOURIER)
TEXTS = ("selected_filter_or_consensus", "filters_used", "diagnostic_tags")

# The scalars of the two feature blocks, in order.
PERIODIC = (
    "profile_chi2", "profile_snr", "dip_depth_norm", "flare_depth_norm", "dip_duty_cycle", "dip_dominance", "secondary_dip_depth_norm", "secondary_dip_phase_separation", "mirror_symmetry", "out_of_dip_variation",
    "out_of_flare_variation", "flare_dominance", "flare_duty_cycle", "profile_peak_count", "harmonic_energy_ratio", "skewness", "phase_coverage", "scatter_over_error", "ls_peak_ratio",
    "half_period_profile_distance", "double_period_profile_distance", "double_period_odd_even_difference", "coherent_dimming_score", "dip_cycle_support_fraction", "dip_supporting_cycles", "dip_independent_nights",
    "dip_supporting_time_sections", "phase_time_section_dependence", "dip_single_section_fraction", "phase_coverage_near_dip", "phase_coverage_outside_dip", "dip_local_contrast_sigma", "dip_cycle_contrast_scatter",
    *MODELS, "fourier_R21", "fourier_R31", "fourier_R41", "fourier_phi21", "fourier_phi31", "fourier_phi41",
)
TRANSIENT = (
    "evolution_raw_score", "minimum_section_correlation", "maximum_section_distance", "section_amplitude_log_range", "flare_event_count", "dimming_event_count", "flare_asymmetry", "flare_point_fraction",
    "dimming_point_fraction", "flare_duty_fraction", "strongest_flare_sigma", "strongest_dimming_sigma", "scatter_over_error", "profile_chi2", "phase_coverage", "ls_peak_ratio", "maximum_section_correlation",
    "sections_with_shape", *TEMPORAL,
)


def block_names(cfg: MorphologyConfig = MorphologyConfig()) -> tuple[list[str], list[str]]:
    """The names of the periodic and of the transient block's columns."""
    k = range(cfg.sections)
    periodic = [*(f"aligned_phase_bin_{i:02d}" for i in range(cfg.map_bins)), "log_amplitude", *PERIODIC]
    transient = [*(f"section{i}_relative_amplitude" for i in k), *(f"section{i}_correlation" for i in k), "section_level_drift", "log_amplitude", "log_baseline_days", "log_n_observations", *TRANSIENT]
    return periodic, transient


# A diagnostic periodogram; it never sets a period.


def block_power(t: np.ndarray, y: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """Normalised Lomb-Scargle power of centred values at some periods, sines and cosines made orthogonal."""
    turn = np.exp(2j * np.pi / periods[:, None] * t)
    turn *= np.exp(-0.5j * np.angle((turn**2).sum(1)))[:, None]
    with np.errstate(all="ignore"):
        return ((turn.real @ y) ** 2 / (turn.real**2).sum(1) + (turn.imag @ y) ** 2 / (turn.imag**2).sum(1)) / (y @ y)


#: Bins of the kernel between samples, samples a turn of the baseline, and the kernel's shape (cosh over a semicircle).
TAPS, OVER = 14, 2
SHAPE_OF_KERNEL = 0.99 * math.pi * TAPS * (1 - 0.5 / OVER)


def _sampled(samples: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums between their samples at 0, 1, ..; those below 0 are the conjugates."""
    place = np.ceil(at - TAPS / 2).astype(np.int64)[:, None] + np.arange(TAPS)
    arc = np.sqrt(np.maximum(1 - (2 * (at[:, None] - place) / TAPS) ** 2, 1e-4))
    near = samples[np.abs(place)]
    return np.einsum("ij,ij->i", np.cosh(SHAPE_OF_KERNEL * arc) / arc, np.where(place < 0, near.conj(), near))


def _samples(t: np.ndarray, w: np.ndarray, step: float, n: int) -> np.ndarray:
    """Sums with the middle of the baseline as origin at 0, step, ..; a turn of the baseline has ``OVER`` steps, so a step turns the origin by a right angle."""
    (sums,) = spectral._sums(t, [w], 0.0, step, n)
    return sums * np.array([1, -1j, -1, 1j])[np.arange(n) % 4]


def power(t: np.ndarray, y: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """As ``block_power``, to some 1e-12, from sums sampled evenly in frequency and taken between the samples.

    Samples are two a turn of the baseline and come from one fast transform each. Where the baseline has more turns than
    samples pay for, and where the sine's own sum nearly cancels, sums are plain.
    """
    span = np.ptp(t)
    step = 1 / (OVER * span)
    at, n = 1 / (periods * step), len(t)
    plain, out = np.ones(len(periods), bool), np.empty(len(periods))
    if 2 * at.max() <= 64 * len(periods):
        x = (t - (t.min() + t.max()) / 2) * step
        level = 1 / (np.i0(np.sqrt(np.maximum(SHAPE_OF_KERNEL**2 - (np.pi * TAPS * x) ** 2, 0))) * np.pi * TAPS / 2)
        ones, values = (_samples(t - t.min(), w, step, int(most) + TAPS) for w, most in ((level, 2 * at.max()), (level * y, at.max())))
        double = _sampled(ones, 2 * at)
        level = _sampled(values, at) * np.exp(-0.5j * np.angle(double))
        even = np.abs(double)
        plain = n - even < 1e-6 * n
        with np.errstate(all="ignore"):
            out = 2 * (level.real**2 / (n + even) + level.imag**2 / (n - even)) / (y @ y)
    rows, left = max(1, (1 << 18) // n), np.flatnonzero(plain)
    for k in range(0, len(left), rows):
        out[left[k : k + rows]] = block_power(t - t.min(), y, periods[left[k : k + rows]])
    return out


def diagnostic_power(points: DataFrame, shortest: float = 0.5, longest: float = 200.0, count: int = 3000) -> DataFrame:
    """(source_id, peak power, its period, peak over median) on a geometric grid of periods, for sources of 20 points and more that vary at all."""
    names = ["source_id", *POWER]

    def go(t: pa.Table) -> pa.Table:
        own = t.column("source_id").slice(0, 1)
        time, mag = t.column("time").to_numpy(), t.column("mag").to_numpy()
        ordered, span = np.sort(mag), np.ptp(time)
        found = np.empty(0)
        if len(time) >= 20 and span > 0 and O._at(ordered, 0.84) - O._at(ordered, 0.16) > 0:
            periods = np.geomspace(shortest, min(longest, max(span / 2, 2 * shortest)), count)
            found = power(time, mag - O._at(ordered, 0.5), periods)
            periods, found = periods[np.isfinite(found)], found[np.isfinite(found)]
        if not len(found):
            return pa.Table.from_arrays([own.slice(0, 0), *[pa.array([], pa.float64())] * 3], names)
        k = int(np.argmax(found))
        return pa.Table.from_arrays([own, *(pa.array([x], pa.float64()) for x in (found[k], periods[k], found[k] / max(O._at(np.sort(found), 0.5), 1e-12)))], names)

    p = points.select("source_id", "time", "mag").repartition(task_count(points), "source_id")
    schema = T.StructType([p.schema["source_id"], *(T.StructField(c, T.DoubleType()) for c in POWER)])
    return p.groupBy("source_id").applyInArrow(go, schema)


def residual_points(points: DataFrame, bands: DataFrame, cfg: MorphologyConfig) -> DataFrame:
    """Points of both bands with ``z``: what is left once the band's fold is taken off, over the larger of the error and the source's own spread."""
    whole = bands.where(F.col("fold") == O.WHOLE).select(F.col("source_id").alias("s"), F.col("filter").alias("f"), F.col("value").alias("bins"))
    p = points.where(F.col("filter").isin(*O.BANDS)).withColumn("x", F.col("mag") - median(F.col("mag")).over(W.partitionBy("source_id", "filter")))
    p = p.join(whole, (F.col("source_id") == F.col("s")) & (F.col("filter") == F.col("f")), "left").drop("s", "f")
    bin_ = bin_of(F.col("turn") - F.floor("turn"), cfg.phase_bins)
    p = p.withColumn("residual", F.col("x") - F.coalesce(F.get("bins", bin_), F.lit(0.0))).drop("bins", "x").withColumn("n", F.count(F.lit(1)).over(D.by_source()))
    p = p.withColumn("dev", F.abs(F.col("residual") - median(F.col("residual")).over(D.by_source())))
    scale = F.greatest(O.spread_over("residual", "dev", F.col("n"), D.by_source()), F.lit(1e-6))
    return p.withColumn("z", F.coalesce(F.col("residual") / F.greatest("err", scale), F.lit(0.0))).drop("dev", "n")


def source_features(points: DataFrame, cfg: MorphologyConfig = MorphologyConfig(), partitions: int | None = None) -> DataFrame:
    """One row per source of ``points`` (source_id, row_id, time, mag, err, filter, period or null, and period_flags if there are any)."""
    session, n = points.sparkSession, cfg.phase_bins
    if "period_flags" not in points.columns:
        points = points.withColumn("period_flags", F.lit(""))
    parts = partitions or max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    rows = points.select("source_id", "row_id", *[F.col(c).cast("double").alias(c) for c in ("time", "mag", "err")], "filter", F.when(~F.isnan(F.col("period").cast("double")), F.col("period").cast("double")).alias("period"), "period_flags")
    p = cut_lineage(O.in_sections(O.usable(rows.repartition(parts, "source_id")), cfg.sections))

    bands = cut_lineage(O.profiles(p, cfg))
    folds = S.by_fold(O.combined(bands, cfg))
    low = F.lower(F.coalesce("period_flags", F.lit("")))
    basic = p.groupBy("source_id").agg(
        F.count(F.lit(1)).cast("double").alias("n_points"), *[F.count_if(F.col("filter") == b).cast("double").alias(f"n_observations_{b}") for b in O.BANDS],
        (F.max("time") - F.min("time")).alias("baseline_days"), F.first("period").alias("recommended_period_days"), F.first(low).alias("flags"),
    ).withColumn("alias", F.contains("flags", F.lit("alias")) & ~F.contains("flags", F.lit("correct")))
    none = F.array_repeat(F.lit(0.0), n)
    f = basic.join(folds, "source_id", "left")
    f = S.period_alternatives(S.section_evolution(f.withColumn("sections", F.coalesce("sections", F.array())), cfg.sections), n)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    alike = C.correlation(F.coalesce("whole.c_norm", none), F.coalesce("whole.o_norm", none))
    f = f.select(
        "*", F.coalesce("whole.norm", none).alias("norm"), F.col("whole.amplitude").alias("amplitude"), F.col("whole.typical").alias("bin_sigma"),
        zero("whole.c_weight").alias("c_band_weight"), zero("whole.o_weight").alias("o_band_weight"), zero("whole.chi2").alias("profile_chi2"), zero("whole.snr").alias("profile_snr"),
        zero("whole.c_chi2").alias("c_profile_chi2"), zero("whole.o_chi2").alias("o_profile_chi2"), F.col("whole.over_scatter").alias("amplitude_over_point_scatter"), zero("whole.coverage").alias("phase_coverage"),
        F.col("whole.amplitude").alias("robust_amplitude_mag"), F.col("whole.median_error").alias("median_quoted_error"), F.col("whole.scatter_over_error").alias("scatter_over_error"), F.col("whole.typical").alias("bin_sigma_mag"),
        alike.alias("filter_profile_correlation"),
    ).drop("whole", "half", "double", "sections")
    f = cut_lineage(S.shape(f, n))

    dips = f.select("source_id", "dip_phase", "dip_duty_cycle")
    q = p.join(dips, "source_id").repartition(parts, "source_id")
    judged = f.select("source_id", "dip_significance", "out_of_dip_variation", "alias")
    found = M.excursion_events(residual_points(p, bands, cfg), cfg.event_sigma, cfg.event_gap_days, cfg.event_min_points)
    counted = p.where(F.col("filter").isin(*O.BANDS)).groupBy("source_id").agg(F.count(F.lit(1)).alias("n_points"))
    metrics = M.event_metrics(found, counted, int(cfg.threshold("flare_min_events"))).drop("n_points")
    rows_of = F.sort_array(F.collect_list(F.struct(*[c.split()[0] for c in EVENT_SQL.split(", ")])))
    lists = found.groupBy("source_id").agg(rows_of.alias("events"))
    evidence = D.dip_evidence(q, judged, n)
    for part, names in ((diagnostic_power(p), ()), (metrics, EVENTS), (M.temporal_coherence(p.drop("section", "turn", "origin")), ()), (D.cycles_with_dip(q), ("cycles_with_dip",)), (evidence, DIMMING), (D.wave_or_dip(q), MODELS), (lists, ())):
        f = f.join(part, "source_id", "left")
        for name in names:
            f = f.withColumn(name, zero(name))
    for name in TEMPORAL[2:]:
        f = f.withColumn(name, F.coalesce(F.col(name).cast("double"), F.lit(0.0)))
    return _assembled(f, cfg)


EVENT_SQL = (
    "event_type string, event_number bigint, event_time double, independent_observing_night bigint, n_measurements bigint, event_duration_days double, represented_filters string, peak_residual_significance double, "
    "median_residual_significance double, median_quoted_uncertainty double, minimum_quoted_uncertainty double, maximum_quoted_uncertainty double, is_multi_point boolean, has_cross_filter_support boolean, "
    "passes_quality_validation boolean, rejection_reason string"
)


def _assembled(f: DataFrame, cfg: MorphologyConfig) -> DataFrame:
    """Texts and feature blocks on top of the numbers."""
    gate = cfg.threshold("periodic_chi2")
    strong = {b: F.col(f"{b}_profile_chi2") >= gate for b in O.BANDS}
    disagree = F.coalesce(strong["c"] & strong["o"] & (F.col("filter_profile_correlation") < cfg.threshold("filter_disagreement_correlation")), F.lit(False))
    chosen = F.when(strong["c"] & strong["o"] & ~disagree, "consensus").when(strong["c"] & ~strong["o"], "c").when(strong["o"] & ~strong["c"], "o").otherwise("consensus_weak")
    has = lambda word: F.contains("flags", F.lit(word))
    weak = ~F.coalesce(F.col("recommended_period_days") > 0, F.lit(False)) | has("weak") | has("ambiguous") | has("uncertain")
    tags = [
        F.when(has("alias"), F.when(has("correct"), "alias_corrected").otherwise("alias_possible")),
        F.when(has("harmonic") | F.coalesce(F.col("half_period_profile_distance") < 0.15, F.lit(False)), "harmonic_possible"),
        F.when(F.col("double_period_odd_even_difference") > 0.25, "two_p_eclipse_preferred"),
        F.when(weak, "period_weak_or_ambiguous"),
    ]
    used = [F.when(F.col(f"n_observations_{b}") > 0, b) for b in O.BANDS]
    f = f.withColumn("filter_disagreement", disagree).withColumn(TEXTS[0], chosen).withColumn(TEXTS[1], F.concat_ws(";", *used)).withColumn(TEXTS[2], F.concat_ws(";", *tags))
    amp = F.greatest(F.coalesce("amplitude", F.lit(0.0)), F.lit(0.0))
    trust = clip01((F.col("profile_snr") - 1.5) / 2.5) * clip01((F.col("phase_coverage") - 0.20) / 0.40)  # a weak profile's bins say nothing
    f = f.withColumn("log_amplitude", F.log10(1 + amp)).withColumn("unit_amplitude", F.greatest(amp, F.lit(1e-9)))
    coarse = let(F.struct("turned", trust.alias("t")), lambda s: F.transform(_coarse(s["turned"], cfg.phase_bins, cfg.map_bins), lambda x: x * s["t"]))
    relative = let(F.struct("section_amplitudes", "unit_amplitude"), lambda s: F.transform(s["section_amplitudes"], lambda a: a / s["unit_amplitude"]))
    levels = C.known(F.col("section_levels"))
    drift = (F.array_max(levels) - F.array_min(levels)) / F.col("unit_amplitude")
    log_of = lambda c: F.log10(F.greatest(F.col(c), F.lit(1.0)))
    number = lambda names: F.array(*[F.col(c).cast("double") for c in names])
    f = f.withColumn("periodic_block", F.concat(coarse, F.array("log_amplitude"), number(PERIODIC)))
    f = f.withColumn("transient_block", F.concat(relative, "section_correlations", F.array(drift, F.col("log_amplitude"), log_of("baseline_days"), log_of("n_points")), number(TRANSIENT)))
    f = f.withColumn("events", F.coalesce("events", F.array().cast(f"array<struct<{', '.join(c.replace(' ', ': ') for c in EVENT_SQL.split(', '))}>>")))
    return f.select("source_id", "recommended_period_days", *[F.col(c).cast("double").alias(c) for c in NUMBERS], "filter_disagreement", *TEXTS, "periodic_block", "transient_block", F.col("norm").alias("profile"), "events")


def _coarse(v: Column, n: int, bins: int) -> Column:
    """``bins`` means of neighbouring bins; between the nearest ones where the numbers do not divide."""
    if n % bins == 0:
        return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: C.total(F.slice(v, i * (n // bins) + 1, n // bins)) / (n // bins))

    def between(i):
        at = i * (n / bins)
        low = F.floor(at).cast("int")
        left, right = F.get(v, low), F.get(v, F.pmod(low + 1, F.lit(n)))
        return left + (at - low) * (right - left)

    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), between)


def event_table(features: DataFrame) -> DataFrame:
    """One row per excursion event of ``source_features``, rejected ones included."""
    return features.select("source_id", F.explode("events").alias("e")).select("source_id", "e.*")
