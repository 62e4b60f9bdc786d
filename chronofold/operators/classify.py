"""Evidence scores, rule classification, interest, manual labels and groupings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.config import MorphologyConfig
from chronofold.functions.columns import clip01, tags

SCORES = ("score_transit", "score_wavelike", "score_flaring", "score_irregular_variable", "score_nonvar", "score_noisy", "score_unknown")
FAMILIES = tuple(s.removeprefix("score_") for s in SCORES)


#: Inputs that some tables have and others don't; all others must be there.
OPTIONAL = ("out_of_distribution_score",)


def _reader(df: DataFrame):
    """Values of a feature, null as a default. A feature that the table lacks altogether is an error, not a zero."""

    def v(name: str, default: float | None = 0.0) -> Column:
        if name not in df.columns and name not in OPTIONAL:
            raise ValueError(f"the features lack {name}")
        c = F.col(name).cast("double") if name in df.columns else F.lit(None).cast("double")
        return c if default is None else F.coalesce(c, F.lit(float(default)))

    return v


def category_scores(df: DataFrame, cfg: MorphologyConfig = MorphologyConfig()) -> DataFrame:
    """Adds the seven evidence scores in [0, 1]; they don't depend on any label."""
    v, t = _reader(df), cfg.threshold
    gate, strong = t("periodic_chi2"), t("periodic_chi2_strong")
    d = df.withColumn(
        "__per",
        clip01(
            0.55 * clip01((v("profile_chi2") - gate) / max(strong - gate, 1e-9))
            + 0.25 * clip01(v("profile_snr") / 12.0)
            + 0.20 * clip01(v("phase_coverage") / 0.7)
        ),
    )
    d = d.withColumn("__dim", clip01(v("coherent_dimming_score"))).withColumn(
        "__fe",
        clip01(v("flare_event_count") / max(t("flare_min_events"), 1.0)),
    )
    support = (
        0.25 * F.col("__fe")
        + 0.15 * clip01(v("validated_flare_independent_nights") / 3.0)
        + 0.20 * clip01(v("validated_flare_median_significance") / 10.0)
        + 0.15 * clip01(v("validated_flare_cross_filter_fraction"))
        + 0.15 * clip01(v("validated_flare_multi_point_fraction"))
        + 0.10 * clip01(v("flare_leave_one_event_out_persistent"))
    )
    d = d.withColumn("__fq", clip01(v("flare_asymmetry")) * clip01(support)).withColumn(
        "score_irregular_variable",
        clip01(0.65 * v("irregular_variability_score") + 0.35 * clip01(v("evolution_raw_score") / 2.0)),
    )
    d = d.withColumn(
        "__sc",
        clip01((v("scatter_over_error") - 1.5) / 5.0),
    ).withColumn("__rel", clip01(v("dip_point_quality_fraction", 1.0)))
    flare, irregular, periodic, dim = F.col("__fe") * F.col("__fq"), F.col("score_irregular_variable"), F.col("__per"), F.col("__dim")
    d = d.withColumn("score_nonvar", clip01((1 - F.greatest(periodic, dim, irregular, flare)) * (1 - F.col("__sc"))))
    d = d.withColumn("score_noisy", clip01(F.col("__sc") * (1 - F.greatest(periodic, irregular, flare)) + (1 - F.col("__rel")) * 0.25))
    d = d.withColumn("score_transit", clip01(dim * (0.65 + 0.35 * F.col("__rel")) * clip01((v("dip_dominance", 1.0) - 1) / 1.5)))
    d = d.withColumn(
        "score_wavelike",
        clip01(
            periodic * (
                0.45 * clip01(v("wave_model_score") / 0.65)
                + 0.55 * clip01(v("ls_peak_ratio") / 60.0)
            ) * (1 - 0.35 * F.col("score_transit"))
        ),
    )
    d = d.withColumn(
        "score_flaring",
        clip01(
            F.col("__fq") * clip01(v("flare_primary_validation_pass")) * clip01(
                1 - v("flare_point_fraction", 1.0) / t("flare_max_point_fraction")
            )
        ),
    )
    d = d.withColumn(
        "score_unknown",
        clip01(
            1 - F.greatest("score_transit", "score_wavelike", "score_flaring", "score_irregular_variable", "score_nonvar", "score_noisy")
        ),
    )
    return d.drop("__per", "__dim", "__fe", "__fq", "__sc", "__rel")


def families(scored: DataFrame, cfg: MorphologyConfig = MorphologyConfig()) -> DataFrame:
    """Adds primary_tag, secondary_tags, review_reasons and confidence to rows with scores.

    The ladder is staged in columns, each rung a boolean, so that no expression
    outgrows generated code.
    """
    v, t = _reader(scored), cfg.threshold
    period, dim = F.col("recommended_period_days"), F.col("score_transit")
    disagree = F.coalesce("filter_disagreement", F.lit(False)) if "filter_disagreement" in scored.columns else F.lit(False)
    has = F.coalesce(period > 0, F.lit(False))
    flags: dict[str, Column] = {
        "alias_like": F.coalesce(
            F.least(*[F.abs(period - a) / a for a in (0.5, 2.0 / 3.0, 1.0, 2.0)]) < t("alias_relative_tolerance"),
            F.lit(False),
        ),
        "periodic": has & (
            v("profile_chi2") >= t("periodic_chi2")
        ) & (v("profile_snr") >= t("periodic_snr")) & (v("phase_coverage") >= cfg.min_coverage),
        "poor": (v("median_quoted_error") > t("poor_photometry_error")) & (
            v("robust_amplitude_mag") < t("poor_photometry_amplitude_ratio") * v("median_quoted_error")
        ),
        "claim": (
            v("coherent_dimming_score") >= 0.15
        ) | (dim >= 0.25) | (v("dimming_event_count") >= 1) | (v("dip_significance") >= 3) | (v("dip_supporting_cycles") > 0),
        "repeatable": (
            (v("dip_supporting_cycles") >= t("transit_min_cycles"))
            | ((v("dip_supporting_cycles") >= 2) & (dim >= t("transit_exceptional_two_cycle_score")) & (v("dip_independent_nights") >= 2))
        ) & (v("dip_cycle_support_fraction") >= t("transit_min_cycle_support_fraction")),
        "double_dip": (v("secondary_dip_depth_norm") >= t("double_dip_fraction") * F.greatest(v("dip_depth_norm"), F.lit(1e-9))) & (F.abs(v("secondary_dip_phase_separation") - 0.5) > t("eclipse_phase_tolerance")) & (v("dip_significance") >= t("transit_min_dip_significance")) & (v("secondary_dip_depth_norm") * v("dip_significance") / F.greatest(v("dip_depth_norm"), F.lit(1e-9)) >= t("transit_min_dip_significance")),
    }
    d = scored
    for name, c in flags.items():
        d = d.withColumn(f"__{name}", c)
    f = lambda name: F.col(f"__{name}")
    second: dict[str, Column] = {
        "seasonal": f("claim") & ((v("phase_time_section_dependence") > 0.25) | (v("dip_single_section_fraction") > 0.70)),
        "gappy": f("claim") & ((v("phase_coverage_near_dip") < 0.45) | (v("phase_coverage_outside_dip") < 0.30)),
        "driven": f("claim") & (v("dip_point_quality_fraction", 1.0) < 0.65),
        "single_section": f("claim") & (v("dip_supporting_cycles") > 0) & (
            (v("dip_supporting_time_sections") < t("transit_min_supporting_sections"))
            | (v("dip_single_section_fraction") > 0.70)
        ),
        "flaring": (v("flare_event_count") >= t("flare_min_events")) & (v("flare_primary_validation_pass") > 0) & (v("flare_leave_one_event_out_persistent") > 0) & (v("strongest_flare_sigma") >= t("flare_min_event_snr")) & (v("flare_asymmetry") >= t("flare_min_asymmetry")) & (v("flare_point_fraction", 1.0) <= t("flare_max_point_fraction")) & (v("flare_duty_fraction") >= t("flare_min_duty_fraction")) & ~f("poor"),
        "evolved": f("periodic") & (v("ls_peak_ratio") >= 20) & (v("evolution_raw_score") >= t("evolving_min_section_distance")) & (
            v("minimum_section_correlation", 1.0) <= t("evolving_max_section_correlation")
        ),
        "ambiguous": f("periodic") & (dim >= 0.30) & (F.col("score_wavelike") >= 0.30) & (
            F.abs(v("wave_dimming_score_margin")) <= t("wave_dimming_ambiguity_margin")
        ),
        "brightening": f("periodic") & (v("flare_dominance", 1.0) >= t("flare_min_dominance")) & (v("flare_duty_cycle", 1.0) <= t("flare_max_duty_cycle")) & (v("out_of_flare_variation", 9e9) <= t("flare_max_baseline_variation")),
    }
    for name, c in second.items():
        d = d.withColumn(f"__{name}", c)
    d = d.withColumn(
        "__eligible",
        (
            dim >= t("transit_score_threshold")
        ) & v("dip_duty_cycle", 1.0).between(
            0.02,
            t("transit_max_duty_cycle"),
        ) & f("repeatable") & ~f("driven") & ~f("seasonal") & ~f("gappy") & ~f("single_section"),
    )
    d = d.withColumn(
        "__irregular",
        (
            (v("scatter_over_error", 9e9) >= t("irregular_min_scatter_over_error"))
            & (v("temporal_coherence_score") >= t("irregular_min_temporal_coherence"))
        ) | f("evolved"),
    )
    transit_first = dim >= F.col("score_wavelike")
    rung = (
        F.when(f("poor"), "poor").when(f("eligible") & (~f("ambiguous") | transit_first), "transit").when(f("evolved"), "evolved").when(f("ambiguous"), "ambiguous").when((f("periodic") & (F.col("score_wavelike") >= 0.35)) | f("brightening"), "wave").when(f("flaring"), "flaring").when(f("irregular"), "irregular").when((dim >= 0.30) | (v("dimming_event_count") >= 1), "dimming").when(v("scatter_over_error", 9e9) > t("noisy_min_scatter_over_error"), "noisy").when((v("profile_chi2") < t("periodic_chi2")) & (v("temporal_coherence_score") < 0.25), "nonvar").otherwise("unresolved")
    )
    d = d.withColumn("rung", rung)
    r = F.col("rung")
    family = {
        "poor": "noisy",
        "transit": "transit",
        "evolved": "irregular_variable",
        "wave": "wavelike",
        "flaring": "flaring",
        "irregular": "irregular_variable",
        "dimming": "unknown",
        "noisy": "noisy",
        "nonvar": "nonvar",
        "unresolved": "unknown",
    }
    primary = F.when(r == "ambiguous", F.when(transit_first, "transit").otherwise("wavelike"))
    for k, name in family.items():
        primary = primary.when(r == k, name)
    d = d.withColumn("primary_tag", primary)
    on = lambda k, cond=None: (r == k) if cond is None else (r == k) & cond
    eclipse = (
        v("secondary_dip_depth_norm") >= t("secondary_eclipse_fraction") * F.greatest(v("dip_depth_norm"), F.lit(1e-9))
    ) & (F.abs(v("secondary_dip_phase_separation") - 0.5) <= t("eclipse_phase_tolerance"))
    single_flare = (v("flare_event_count") == 1) & (v("validated_flare_well_sampled_event_count") >= 1) & ~f("flaring")
    tag_rules = [
        (f("alias_like"), "alias_period"),
        (f("poor"), "poor_photometry"),
        (~has, "missing_recommended_period"),
        (disagree, "filter_disagreement"),
        (f("seasonal"), "seasonal_phase_coupling"),
        (f("gappy"), "gappy_phase_coverage"),
        (f("driven"), "poor_point_driven"),
        (f("single_section"), "single_section_dimming"),
        (v("single_point_flare_event_count") >= 1, "single_point_bright_excursions"),
        (single_flare, "single_flare_candidate"),
        (f("ambiguous"), "transit_wave_ambiguous"),
        (on("poor"), "low_snr_photometry"),
        (on("transit", v("dip_duty_cycle", 1.0) <= 0.16), "narrow_eclipse"),
        (on("transit", v("dip_duty_cycle", 1.0) > 0.16), "broad_occultation"),
        (on("transit", v("dip_duty_cycle", 1.0) > 0.16), "dust_occultation_like"),
        (on("transit", v("mirror_symmetry") < 0.98), "asymmetric_occultation"),
        (on("transit", f("double_dip")), "double_dip"),
        (on("transit", f("double_dip")), "complex_occultation"),
        (on("transit", (v("dip_cycle_contrast_scatter") >= 0.45) & (v("dip_supporting_cycles") >= 3)), "variable_depth_occultation"),
        (on("transit", eclipse), "eclipsing_binary_like"),
        (on("evolved"), "temporally_evolving"),
        (on("evolved"), "evolving_periodic"),
        (on("wave", f("brightening")), "periodic_brightening"),
        (on("wave", v("mirror_symmetry") < t("symmetry_min_correlation")), "asymmetric"),
        (on("wave", v("mirror_symmetry") >= t("symmetry_min_correlation")), "symmetric"),
        (on("wave", v("profile_peak_count", 1.0) >= 2), "multi_bump"),
        (on("flaring") | (f("flaring") & F.col("primary_tag").isin("transit", "wavelike") & ~f("brightening")), "transient_flares"),
        (on("irregular"), "aperiodic_variable"),
        (on("irregular", f("periodic") | (v("ls_peak_ratio") >= 20)), "quasi_periodic"),
        (on("irregular", v("section_median_range_sigma") >= 3), "long_term_trend"),
        (on("irregular", v("section_median_range_sigma") >= 3), "state_change"),
        (on("irregular", v("same_direction_excursion_groups") >= 2), "intermittent_variability"),
        (on("irregular", v("dimming_event_count") >= 1), "irregular_dimming"),
        (on("dimming"), "unresolved_dimming"),
        (v("out_of_distribution_score") > 1, "out_of_distribution_shape"),
    ]
    d = d.withColumn("secondary_tags", F.array_join(F.array_compact(F.array(*[F.when(c, n) for c, n in tag_rules])), ";"))
    best = F.sort_array(F.array(*SCORES), asc=False)
    d = d.withColumn("__sorted", best).withColumn(
        "__own",
        F.coalesce(*[F.when(F.col("primary_tag") == x, F.col(f"score_{x}")) for x in FAMILIES]),
    )
    margin = F.element_at("__sorted", 1) - F.element_at("__sorted", 2)
    conf = F.when(
        F.col("primary_tag") == "transit",
        0.30 + 0.35 * dim + 0.15 * clip01(v("dip_supporting_cycles") / 5.0) + 0.10 * clip01(
            v("dip_supporting_time_sections") / 3.0
        ) + 0.10 * clip01(v("dip_point_quality_fraction")),
    ).otherwise(0.35 + 0.35 * F.col("__own") + 0.30 * clip01(margin / 0.5))
    conf = F.when(f("poor"), F.least(conf, F.lit(0.5))).otherwise(conf) * F.when(f("gappy") | f("seasonal"), 0.75).otherwise(1.0)
    conf = F.when(f("alias_like"), F.least(conf, F.lit(0.6))).otherwise(conf) * F.when(f("ambiguous"), 0.85).otherwise(1.0)
    conf = F.when(~has & F.col("primary_tag").isin("transit", "wavelike"), F.least(conf, F.lit(0.4))).otherwise(conf)
    d = d.withColumn("confidence", conf)
    review_rules = [
        (f("alias_like"), "period_on_one_day_alias"),
        (f("poor"), "median_error_above_limit"),
        (~has, "missing_recommended_period"),
        (disagree, "significant_filters_disagree"),
        (f("seasonal"), "transit_rejected_seasonal"),
        (f("gappy"), "gappy_phase_coverage"),
        (f("driven"), "poor_point_driven"),
        (f("single_section"), "single_section_dimming"),
        (v("single_point_flare_event_count") >= 1, "single_point_bright_excursions"),
        (single_flare, "single_flare_candidate"),
        (f("ambiguous"), "transit_wave_ambiguous"),
        (on("dimming"), "dimming_without_repeatability"),
        (on("unresolved"), "unresolved_morphology"),
        (F.col("confidence") < t("low_confidence"), "low_confidence"),
        (v("out_of_distribution_score") > 1, "out_of_distribution"),
        (f("alias_like"), "alias_or_harmonic"),
    ]
    d = d.withColumn("review_reasons", F.array_join(F.array_compact(F.array(*[F.when(c, n) for c, n in review_rules])), ";"))
    return d.drop("__sorted", "__own")


def interest(d: DataFrame, cfg: MorphologyConfig = MorphologyConfig(), minimum: float = 0.70) -> DataFrame:
    """Adds interest_status, interest_confidence, interest_reasons and needs_review to the rows of ``families``."""
    v, f = _reader(d), lambda name: F.col(f"__{name}")
    transit, conf, dim = F.col("primary_tag") == "transit", F.col("confidence"), F.col("score_transit")
    credible = ~f("poor") & ~f("driven") & ~f("seasonal") & ~f("gappy")
    evolving = 0.30 * F.col("score_irregular_variable") + 0.20 * clip01(v("temporal_coherence_score")) + 0.20 * clip01(v("evolution_raw_score") / 1.2) + 0.15 * clip01(v("maximum_section_distance") / 0.6) + 0.15 * clip01(conf)
    strict = (
        (F.col("primary_tag") == "irregular_variable")
        & f("evolved")
        & ~f("poor")
        & (F.col("score_irregular_variable") >= 0.55)
        & (v("temporal_coherence_score") >= 0.55)
        & (v("evolution_raw_score") >= 1.0)
        & (v("maximum_section_distance") >= 0.55)
        & (v("minimum_section_correlation", 1.0) <= 0.15)
        & (v("sections_with_shape") >= 2)
        & (conf >= 0.60)
    )
    shape = F.greatest("score_transit", "score_wavelike")
    flare = (
        f("flaring")
        & ~f("brightening")
        & F.col("primary_tag").isin("transit", "wavelike")
        & f("periodic")
        & ~f("poor")
        & (F.col("score_flaring") >= 0.80)
        & (shape >= 0.65)
        & (conf >= 0.65)
        & (v("flare_event_count") >= 4)
        & (v("flare_asymmetry") >= 0.90)
        & (v("flare_point_fraction", 1.0) <= 0.05)
    )
    possible = (v("dimming_event_count") >= 1) & (v("strongest_dimming_sigma") >= 7) & (
        v("dimming_point_fraction", 1.0) <= 0.08
    ) & ~f("periodic") & credible
    single = possible & (v("dimming_event_count") == 1) & (v("strongest_dimming_sigma") >= 10) & (
        v("dimming_point_fraction", 1.0) <= 0.005
    ) & (v("median_quoted_error") <= 0.10) & (v("scatter_over_error", 9e9) <= 2.5) & (conf >= 0.50)
    once = 0.45 * clip01(v("strongest_dimming_sigma") / 15.0) + 0.20 * clip01(1 - v("median_quoted_error") / 0.10) + 0.20 * clip01(
        1 - v("dimming_point_fraction", 1.0) / 0.005
    ) + 0.15 * clip01(v("temporal_coherence_score"))
    rules = [
        (transit & f("double_dip") & credible & f("repeatable"), "unusual_repeating_double_dip", dim),
        (transit & F.array_contains(tags(F.col("secondary_tags")), "complex_occultation") & credible, "complex_occultation", 0.85 * dim),
        (
            transit & (v("dip_duty_cycle", 1.0) >= 0.25) & (v("dip_significance") >= 10) & credible & (v("dip_supporting_cycles") >= 3),
            "deep_dust_occultation",
            dim,
        ),
        (strict, "temporally_evolving_morphology", evolving),
        (flare, "periodic_plus_validated_flaring", 0.45 * F.col("score_flaring") + 0.35 * shape + 0.20 * clip01(conf)),
        (single, "credible_single_epoch_dimming", once),
    ]
    out = d.withColumn("interest_reasons", F.concat_ws(";", *[F.when(c, n) for c, n, _ in rules])).withColumn(
        "__x",
        clip01(F.coalesce(F.greatest(*[F.when(c, s) for c, _, s in rules]), F.lit(0.0))),
    )
    reasons = F.col("interest_reasons") != ""
    top = reasons & (F.col("__x") >= minimum) & (conf >= 0.60)
    extra = F.concat_ws(
        ";",
        F.when((F.col("primary_tag") == "irregular_variable") & f("evolved") & ~strict, "interesting_evolving_morphology"),
        F.when(
            f("flaring") & F.col("primary_tag").isin("transit", "wavelike") & ~f("brightening") & ~flare,
            "periodic_with_possible_flares",
        ),
        F.when(possible & ~single, "single_epoch_dimming_review"),
        F.when(reasons & ~top, "interesting_but_below_exotic_threshold"),
    )
    out = out.withColumn(
        "review_reasons",
        F.concat_ws(";", F.nullif(F.col("review_reasons"), F.lit("")), F.nullif(extra, F.lit(""))),
    ).withColumn("needs_review", F.col("review_reasons") != "")
    out = out.withColumn(
        "interest_status",
        F.when(top, "exotic_candidate").when(reasons | F.col("needs_review"), "review").otherwise("routine"),
    )
    return out.withColumn(
        "interest_confidence",
        F.when(reasons, F.col("__x")).when(F.col("interest_status") == "review", clip01(0.45 + 0.35 * (1 - conf))).otherwise(clip01(conf)),
    )


def classified(features: DataFrame, cfg: MorphologyConfig = MorphologyConfig()) -> DataFrame:
    """Features through scores, rules and interest; helper columns dropped."""
    out = interest(families(category_scores(features, cfg), cfg), cfg)
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def hellinger(df: DataFrame) -> DataFrame:
    """Adds ``evidence``: the square roots of the row-normalised scores."""
    raw = F.array(*[F.greatest(F.coalesce(F.col(s), F.lit(0.0)), F.lit(0.0)) + F.lit(1e-12) for s in SCORES])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    return df.withColumn("__r", raw).withColumn("evidence", F.transform("__r", lambda x: F.sqrt(x / total(F.col("__r"))))).drop("__r")


def strength(df: DataFrame, family: str = "final_primary_tag") -> Column:
    """How strongly a source shows its family."""
    v, p = _reader(df), F.col(family)
    flare = F.least(v("strongest_flare_sigma"), F.lit(20.0)) * F.log10(1 + v("flare_event_count")) * F.greatest(v("flare_asymmetry"), F.lit(0.0)) * F.greatest(v("flare_leave_one_event_out_persistent"), F.lit(0.25))
    return (
        F.when(p == "transit", v("coherent_dimming_score")).when(p == "wavelike", v("profile_chi2")).when(p == "flaring", flare).when(
            p == "irregular_variable",
            v("irregular_variability_score"),
        ).when(p == "noisy", v("scatter_over_error")).when(
            p == "nonvar",
            -v("scatter_over_error", 9.9),
        ).when(p == "unknown", v("score_unknown")).otherwise(0.0)
    )


MANUAL = (
    "source_id",
    "dataset",
    "manual_primary_tag",
    "manual_secondary_tags",
    "manual_interest_status",
    "manual_interest_reasons",
    "notes",
    "reviewer",
)


def with_label_columns(manual: DataFrame) -> DataFrame:
    """A label table with every expected column, absent ones empty; what was entered stays."""
    for c in MANUAL:
        if c not in manual.columns:
            manual = manual.withColumn(c, F.lit(""))
    return manual


def overlay(table: DataFrame, manual: DataFrame) -> DataFrame:
    """Manual labels over the rules': by source and dataset, else by source alone (the last ``row`` wins); the old label 'exotic' becomes an interest status."""
    m = with_label_columns(manual)
    order = F.desc("row") if "row" in m.columns else F.desc("dataset")
    pick = lambda keys: m.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("__r = 1")
    fields = ["manual_primary_tag", "manual_secondary_tags", "manual_interest_status", "manual_interest_reasons"]
    exact = pick(["source_id", "dataset"]).select(
        F.col("source_id").alias("es"),
        F.col("dataset").alias("ed"),
        F.struct(*fields).alias("e"),
    )
    loose = pick(["source_id"]).select(F.col("source_id").alias("ls"), F.struct(*fields).alias("l"))
    j = table.join(
        exact,
        (F.col("source_id") == F.col("es")) & (F.col("dataset") == F.col("ed")),
        "left",
    ).join(loose, F.col("source_id") == F.col("ls"), "left").withColumn("m", F.coalesce("e", "l"))
    found = F.filter(tags(F.col("m.manual_primary_tag")), lambda x: x.isin(*FAMILIES))
    exotic = F.exists(tags(F.col("m.manual_primary_tag")), lambda x: F.lower(x) == "exotic")
    given = lambda c: F.nullif(F.trim(F.coalesce(F.col(f"m.{c}"), F.lit(""))), F.lit(""))
    primary = F.when(
        F.size(found) > 0,
        F.element_at(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(""))), 1),
    ).when(exotic, "unknown")
    status = F.coalesce(given("manual_interest_status"), F.when(exotic, "manually_confirmed_exotic"))
    j = j.withColumn("final_primary_tag", F.coalesce(primary, "primary_tag")).withColumn(
        "final_secondary_tags",
        F.coalesce(given("manual_secondary_tags"), "secondary_tags"),
    ).withColumn("final_interest_status", F.coalesce(status, "interest_status"))
    j = j.withColumn(
        "label_source",
        F.when(primary.isNotNull() | status.isNotNull() | given("manual_secondary_tags").isNotNull(), "manual").otherwise("rules"),
    )
    return j.drop("es", "ed", "ls", "e", "l", "m")


def memberships(table: DataFrame) -> DataFrame:
    """(group_type, group_name, source_id, dataset): every group that a source belongs to."""
    groups = F.concat(
        F.array(F.struct(F.lit("primary").alias("t"), F.col("final_primary_tag").alias("g"))),
        F.transform(tags(F.col("final_secondary_tags")), lambda x: F.struct(F.lit("secondary").alias("t"), x.alias("g"))),
        F.array(F.struct(F.lit("interest").alias("t"), F.col("final_interest_status").alias("g"))),
        F.transform(tags(F.col("review_reasons")), lambda x: F.struct(F.lit("review").alias("t"), x.alias("g"))),
    )
    return table.select("source_id", "dataset", F.explode(groups).alias("x")).select(
        F.col("x.t").alias("group_type"),
        F.col("x.g").alias("group_name"),
        "source_id",
        "dataset",
    ).distinct()


def carry_over(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose keys are not in ``new``, then the new ones; columns by name."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def traceability(table: DataFrame) -> DataFrame:
    """Adds single_band_source and low_phase_coverage where the inputs are there."""
    bands = F.col("filters_present") if "filters_present" in table.columns else F.lit(None).cast("string")
    return table.withColumn(
        "single_band_source",
        F.coalesce(F.size(F.split(bands, ",")) == 1, F.lit(False)),
    ).withColumn("low_phase_coverage", F.coalesce(F.col("phase_coverage") < 0.30, F.lit(False)))
