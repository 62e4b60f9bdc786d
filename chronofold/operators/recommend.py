"""Significance, series classes, source recommendation and consensus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.config import WARNING_ORDER, PeriodConfig
from chronofold.functions.columns import catalogue_match, harmonic_relation
from chronofold.operators.series import fold_coherence

SERIES = ("combined", "o", "c")


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def evidence(rows: DataFrame, cfg: PeriodConfig = PeriodConfig()) -> DataFrame:
    """Adds dominant, significant, likely_nonvar and series_score to series rows."""
    r2, r4, fap, peak, fold = (
        F.col(c)
        for c in ("best_to_second_power_ratio", "best_to_fourth_power_ratio", "raw_ls_fap", "ls_peak_snr", "raw_fold_amp_snr")
    )
    out = rows.withColumn("dominant", _yes(r2 >= cfg.strong_ratio2) | _yes(r4 >= cfg.strong_ratio4))
    f, p, d = _yes(fap <= cfg.fap_threshold), _yes(peak >= cfg.peak_snr), _yes(fold >= cfg.fold_snr)
    out = out.withColumn("significant", (f & (F.col("dominant") | d | p)) | (F.col("dominant") & (d | p)) | (p & d))
    out = out.withColumn("likely_nonvar", _yes(r4 <= cfg.flat_ratio4) & ~_yes(fap <= cfg.nonvar_fap) & ~p & ~d)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    gain = lambda c, v: F.when(c, v).otherwise(0.0)
    total = (
        gain(F.col("significant"), 3.0)
        + gain(F.col("dominant"), 1.0)
        + zero(_clip((r2 - 1) / (cfg.strong_ratio2 - 1), 0.0, 2.0))
        + zero(_clip((r4 - 1) / (cfg.strong_ratio4 - 1), 0.0, 2.0))
        + zero(F.least(peak / 6.0, F.lit(1.5)))
        + zero(F.least(fold / 6.0, F.lit(1.5)))
        + gain(_yes(F.col("raw_fold_scatter_reduction") > 0), F.least(F.col("raw_fold_scatter_reduction") * 3.0, F.lit(1.0)))
        + gain(f, 0.5) - gain(_yes(F.col("raw_is_alias_suspect")), 0.75)
        + gain(_yes(F.col("alias_correction_applied")), 0.25) - gain(_yes(F.col("top4_flat")), 0.75)
    )
    return out.withColumn("series_score", total)


def best_rows(rows: DataFrame) -> DataFrame:
    """One row per source and series: the most defensible of duplicates."""
    order = [
        F.desc_nulls_last(c)
        for c in ("significant", "best_to_second_power_ratio", "raw_fold_amp_snr", "raw_ls_best_power")
    ] + [F.asc_nulls_last("recommended_series_period_days")]
    return rows.withColumn("__r", F.row_number().over(W.partitionBy("source_id", "series").orderBy(*order))).where("__r = 1").drop("__r")


def classify_series(rows: DataFrame, cfg: PeriodConfig = PeriodConfig()) -> DataFrame:
    """Adds primary_classification and secondary_classification (at most two warnings) to rows with ``evidence``; uses the optional booleans filter_disagreement, single_filter_only."""
    flat = _yes(F.col("best_to_fourth_power_ratio") <= cfg.flat_ratio4)
    alias = _yes(F.col("raw_alias_score") >= cfg.alias_threshold)
    fixed = _yes(F.col("alias_correction_applied"))
    harmonic = _yes(F.col("two_p_supported")) | _yes(F.col("mh_2p_supported")) | _yes(F.col("top_peak_2p_present"))
    primary = (
        F.when(~F.col("significant") & flat, "nonvar").when(
            ~F.col("significant") | flat | ~F.col("dominant"),
            "weak_or_ambiguous",
        ).when(alias | fixed, "alias_possible").when(harmonic, "harmonic_possible").otherwise("strong")
    )
    flag = lambda c: _yes(F.col(c)) if c in rows.columns else F.lit(False)
    raised = {
        "alias_corrected": fixed,
        "alias_possible": ~fixed & alias,
        "harmonic_possible": harmonic,
        "filter_disagreement": flag("filter_disagreement"),
        "single_filter_only": flag("single_filter_only"),
    }
    found = F.slice(F.array_compact(F.array(*[F.when(raised[w], w) for w in WARNING_ORDER])), 1, 2)
    return rows.withColumn("primary_classification", primary).withColumn(
        "secondary_classification",
        F.when(F.size(found) > 0, F.array_join(found, ";")).otherwise("none"),
    )


_FIELDS = (
    "recommended_series_period_days",
    "significant",
    "likely_nonvar",
    "series_score",
    "raw_fold_amp_snr",
    "ls_peak_snr",
    "two_p_supported",
    "mh_2p_supported",
    "top_peak_2p_present",
    "raw_is_alias_suspect",
    "alias_correction_applied",
    "bls_best_period_days",
)


def wide(rows: DataFrame) -> DataFrame:
    """One row per source with the three series side by side as structs ``combined``, ``o``, ``c``: one aggregate instead of joins."""
    kept = [c for c in _FIELDS if c in rows.columns]
    return rows.groupBy("source_id").agg(
        *[F.first(F.when(F.col("series") == s, F.struct(*kept)), ignorenulls=True).alias(s) for s in SERIES],
        F.max("catalogue_period_days").alias("catalogue_period_days"),
    )


def recommend(rows: DataFrame, cfg: PeriodConfig = PeriodConfig()) -> DataFrame:
    """One recommendation per source from its series rows (status ok)."""
    w = wide(best_rows(evidence(rows, cfg)))
    has = {s: F.col(s).isNotNull() for s in SERIES}
    per = {s: F.col(f"{s}.recommended_series_period_days") for s in SERIES}
    sig = {s: _yes(F.col(f"{s}.significant")) for s in SERIES}
    any_of = lambda f: _yes(F.col(f"combined.{f}")) | _yes(F.col(f"o.{f}")) | _yes(F.col(f"c.{f}"))
    related = lambda a, b: harmonic_relation(a, b, cfg.harmonic_order, cfg.harmonic_tolerance)
    w = w.withColumn("any_sig", any_of("significant")).withColumn(
        "all_nonvar",
        F.coalesce(
            F.col("combined.likely_nonvar"),
            F.lit(True),
        ) & F.coalesce(F.col("o.likely_nonvar"), F.lit(True)) & F.coalesce(F.col("c.likely_nonvar"), F.lit(True)),
    )
    both = per["o"].isNotNull() & per["c"].isNotNull()
    w = w.withColumn("cross_filter_relation", F.when(both, related(per["o"], per["c"])).otherwise(""))
    w = w.withColumn(
        "cross_filter_status",
        F.when(~both, "insufficient").when(F.col("cross_filter_relation") != "", "agree").otherwise("disagree"),
    )
    w = w.withColumn(
        "anchor",
        F.when(F.col("cross_filter_relation") == "direct", per["o"]).when(
            F.col("cross_filter_status") == "agree",
            F.least(per["o"], per["c"]),
        ),
    )
    w = w.withColumn(
        "band_detection_status",
        F.when(
            sig["o"] & sig["c"],
            "both_filters_significant",
        ).when(sig["o"], "o_only_significant").when(sig["c"], "c_only_significant").when(
            sig["combined"],
            "combined_only_significant",
        ).otherwise("no_significant_series"),
    )
    # The strongest series: best score, ties in the order combined, o, c.
    usable = {s: has[s] & _yes(per[s] > 0) for s in SERIES}
    entry = lambda s, i: F.when(usable[s], F.struct(F.col(f"{s}.series_score").alias("score"), F.lit(-i).alias("i"), F.lit(s).alias("name"), per[s].alias("p")))
    w = w.withColumn("top", F.greatest(*[entry(s, i) for i, s in enumerate(SERIES)]))
    consensus = (F.col("cross_filter_status") == "agree") & (sig["o"] | sig["c"])
    chosen = F.when(F.col("top.name") == "o", F.col("o")).when(F.col("top.name") == "c", F.col("c"))
    w = w.withColumn("single", ~consensus & _yes(F.col("top.name").isin("o", "c"))).withColumn("row", chosen)
    supported = _yes((F.col("row.raw_fold_amp_snr") >= cfg.single_fold_snr) & (F.col("row.ls_peak_snr") >= cfg.single_peak_snr))
    w = w.withColumn("single_warning", F.col("single") & ~supported)
    low = F.col("single_warning") | ~_yes(F.col("row.significant"))
    source = F.when(consensus, "o_c_consensus").when(
        F.col("single"),
        F.concat(F.col("top.name"), F.when(low, "_low_support").otherwise("_single_filter")),
    ).otherwise(F.coalesce("top.name", F.lit("none")))
    over = (F.col("cross_filter_status") == "agree") & per["combined"].isNotNull() & (related(per["combined"], F.col("anchor")) == "")
    w = w.withColumn(
        "photometric_period_days",
        F.when(consensus | over, F.col("anchor")).otherwise(F.col("top.p")),
    ).withColumn("recommended_period_source", F.when(over, "o_c_consensus_over_combined").otherwise(source))
    # The series closest to that period supplies the harmonic tests.
    gap = lambda s, i: F.when(usable[s] & F.col("photometric_period_days").isNotNull(), F.struct((F.abs(per[s] - F.col("photometric_period_days")) / F.col("photometric_period_days")).alias("d"), F.lit(i).alias("i")))
    nearest = F.least(*[gap(s, i) for i, s in enumerate(SERIES)])["i"]
    w = w.withColumn(
        "test",
        F.when(nearest == 0, F.col("combined")).when(nearest == 1, F.col("o")).when(nearest == 2, F.col("c")).otherwise(
            F.coalesce("combined", "o", "c")
        ),
    )
    w = w.withColumn("odd_even_2p_supported", _yes(F.col("test.two_p_supported"))).withColumn(
        "multiharmonic_2p_supported",
        _yes(F.col("test.mh_2p_supported")),
    ).withColumn("top_peak_2p_present", any_of("top_peak_2p_present"))
    known = F.col("photometric_period_days").isNotNull()
    w = w.withColumn("possible_2p_period_days", 2 * F.col("photometric_period_days"))
    w = w.withColumn(
        "harmonic_status",
        F.when(
            known & F.col("odd_even_2p_supported"),
            "2P_supported_by_odd_even_difference",
        ).when(
            known & F.col("multiharmonic_2p_supported"),
            "2P_supported_by_multiharmonic",
        ).when(known & F.col("top_peak_2p_present"), "P_vs_2P_competitive").otherwise("photometric_period"),
    )
    doubled = F.col("harmonic_status").startswith("2P_supported")
    w = w.withColumn(
        "recommended_period_days",
        F.when(doubled, F.col("possible_2p_period_days")).otherwise(F.col("photometric_period_days")),
    )
    n_alias, n_fixed = any_of("raw_is_alias_suspect"), any_of("alias_correction_applied")
    flags = [
        F.when(_yes(F.col(f"{s}.{f}")), f"{s}:{t}")
        for s in SERIES
        for f, t in (("raw_is_alias_suspect", "raw_alias"), ("alias_correction_applied", "corrected"))
    ]
    box = [
        F.when(
            related(F.col(f"{s}.bls_best_period_days"), F.col("recommended_period_days")) != "",
            F.concat(F.lit(f"{s}:"), related(F.col(f"{s}.bls_best_period_days"), F.col("recommended_period_days"))),
        )
        for s in SERIES
    ]
    w = w.withColumn("alias_flags", F.concat_ws(";", *flags)).withColumn("bls_support_detail", F.concat_ws(";", *box))
    w = w.withColumn(
        "bls_support_status",
        F.when(F.col("recommended_period_days").isNull(), "none").when(
            F.col("bls_support_detail") != "",
            "supports_recommended",
        ).otherwise("no_bls_support"),
    )
    only = F.col("band_detection_status").isin("o_only_significant", "c_only_significant", "combined_only_significant")
    w = w.withColumn(
        "warning_flags",
        F.concat_ws(
            ";",
            F.when(F.col("single_warning"), "single_filter_below_snr_thresholds"),
            F.when(n_alias, "alias_warning"),
            F.when(n_fixed, "alias_corrected"),
            F.when(F.col("harmonic_status") == "P_vs_2P_competitive", "harmonic_review"),
            F.when(doubled, "2P_selected"),
            F.when(only, "single_filter_or_combined_only"),
            F.when(F.col("cross_filter_status") == "disagree", "filter_disagreement"),
            F.when(F.col("bls_support_status") == "supports_recommended", "BLS_support"),
        ),
    )
    agree = F.col("cross_filter_status") == "agree"
    weak = ~F.col("any_sig")
    confidence = (
        F.when(weak & F.col("all_nonvar"), "likely_nonvar_low_significance_flat_peaks").when(weak, "weak_or_low_support_period").when(F.col("single_warning"), "single_filter_below_snr_thresholds").when(agree & ~n_alias & ~n_fixed & ~doubled, "secure_non_alias").when(doubled, "secure_2P_full_cycle").when(n_fixed, "alias_corrected_needs_review").when(n_alias & ~agree, "alias_period_not_filter_confirmed").when(F.col("band_detection_status") == "o_only_significant", "single_filter_o_supported_check_colour_or_snr").when(F.col("band_detection_status") == "c_only_significant", "single_filter_c_supported_check_colour_or_snr").when(F.col("cross_filter_status") == "disagree", "filter_disagreement").otherwise("single_series_or_low_support")
    )
    label = F.when(weak & F.col("all_nonvar"), "likely_nonvar").when(
        weak | F.col("single_warning"),
        "weak_period",
    ).otherwise("strong_period")
    w = w.withColumn("confidence_class", confidence).withColumn("detection_label", label)
    return w.select(
        "source_id",
        "catalogue_period_days",
        *[per[s].alias(f"{s}_period_days") for s in SERIES],
        *[F.col(f"{s}.series_score").alias(f"{s}_score") for s in SERIES],
        "band_detection_status",
        "cross_filter_status",
        "cross_filter_relation",
        F.col("anchor").alias("cross_filter_anchor_period_days"),
        "photometric_period_days",
        "possible_2p_period_days",
        "odd_even_2p_supported",
        "multiharmonic_2p_supported",
        "top_peak_2p_present",
        "recommended_period_days",
        "recommended_period_source",
        "harmonic_status",
        "alias_flags",
        "warning_flags",
        "detection_label",
        "confidence_class",
        "bls_support_status",
        "bls_support_detail",
        catalogue_match(
            F.col("recommended_period_days"),
            F.col("catalogue_period_days"),
            cfg.harmonic_order,
            cfg.catalogue_tolerance,
        ).alias("recommended_catalogue_match"),
    )


def consensus(rows: DataFrame, recommended: DataFrame, cfg: PeriodConfig = PeriodConfig()) -> DataFrame:
    """The compact table: pairwise relations, agreement, and the adopted period (recommended, else combined, o, c)."""
    w = wide(best_rows(evidence(rows, cfg)))
    per = {s: F.col(f"{s}.recommended_series_period_days") for s in SERIES}
    pairs = []
    for a, b in (("combined", "o"), ("combined", "c"), ("o", "c")):
        rel = harmonic_relation(per[a], per[b], cfg.harmonic_order, cfg.harmonic_tolerance)
        pairs.append(
            F.when(per[a].isNotNull() & per[b].isNotNull(), F.concat(F.lit(f"{a}-{b}:"), F.when(rel == "", "mismatch").otherwise(rel)))
        )
    w = w.withColumn("pairwise_relations", F.concat_ws(";", *pairs)).withColumn(
        "n_successful_series",
        sum(F.col(s).isNotNull().cast("int") for s in SERIES),
    )
    own = F.when(F.col("pairwise_relations") == "", "insufficient").when(
        F.col("pairwise_relations").contains("mismatch"),
        "disagree",
    ).otherwise("agree")
    rec = recommended.select("source_id", F.col("recommended_period_days").alias("rp"), F.col("cross_filter_status").alias("cs"))
    j = w.join(rec, "source_id", "left")
    positive = lambda c: F.when(c > 0, c)
    return j.select(
        "source_id",
        *[per[s].alias(f"{s}_adopted_period_days") for s in SERIES],
        "n_successful_series",
        F.coalesce("cs", own).alias("series_agreement"),
        "pairwise_relations",
        F.coalesce(positive(F.col("rp")), *[positive(per[s]) for s in SERIES]).alias("consensus_period_days"),
    )


def validation_rates(rows: DataFrame, group: str, match: str) -> DataFrame:
    """Share of searchable rows whose match is direct, or direct or harmonic."""
    # Counted by match first: a condition on ``match`` before that would work it out a second time for every row.
    counts = rows.groupBy(group, match).agg(F.count(F.lit(1)).alias("k"))
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("k"))), F.lit(0))
    found = counts.groupBy(group).agg(
        of(F.col(match) != "no_catalogue_period").alias("n"),
        of(F.col(match) == "direct").alias("direct"),
        of(~F.col(match).isin("no_catalogue_period", "mismatch", "no_recovered_period")).alias("any"),
    )
    return found.where("n > 0").select(group, "n", (F.col("direct") / F.col("n")).alias("direct_rate"), (F.col("any") / F.col("n")).alias("any_rate"))


def override_catalogue(rows: DataFrame, external: DataFrame) -> DataFrame:
    """Catalogue periods from an external table (finite and positive, last ``row`` wins) over the embedded ones."""
    w = W.partitionBy("source_id").orderBy(F.desc("row"))
    ext = external.where("catalogue_period_days > 0").withColumn("__r", F.row_number().over(w)).where("__r = 1").select(
        "source_id",
        F.col("catalogue_period_days").alias("__x"),
    )
    return rows.join(ext, "source_id", "left").withColumn("catalogue_period_days", F.coalesce("__x", "catalogue_period_days")).drop("__x")


def colour_recovery(o_snr: Column, c_snr: Column, limit: float = 3.0) -> Column:
    """Which bands recover a forced fold."""
    o, c = _yes(o_snr >= limit), _yes(c_snr >= limit)
    return F.when(o & c, "both").when(o, "o_only").when(c, "c_only").otherwise("weak")


def fold_period(forced: Column, source: Column, series: Column, raw: Column) -> Column:
    """Period of a fold figure: forced, source, series, raw."""
    return F.coalesce(*[F.when(c > 0, c) for c in (forced, source, series, raw)])


def extra_fold_candidates(peaks: DataFrame, scored: DataFrame, k: int = 3) -> DataFrame:
    """Peaks to show besides the adopted period: farthest first (ratio), then lower alias score, then rank."""
    j = peaks.join(
        scored.select("source_id", "series", "rank", "alias_score", F.col("period_days").alias("__p")),
        ["source_id", "series", "rank"],
    )
    first = F.first(F.when(F.col("rank") == 1, F.col("period_days")), ignorenulls=True).over(W.partitionBy("source_id", "series"))
    j = j.withColumn("separation", F.abs(F.log(F.col("period_days") / first))).where("rank > 1")
    w = W.partitionBy("source_id").orderBy(F.desc("separation"), "alias_score", "series", "rank")
    return j.withColumn("choice", F.row_number().over(w)).where(F.col("choice") <= k).drop("__p")


def forced_folds(points: DataFrame, recommended: DataFrame, cfg: PeriodConfig = PeriodConfig()) -> DataFrame:
    """Per source: how each band folds at the recommended period and at the other band's own, and which bands show the signal.

    ``points`` are prepared series rows (source_id, series, mjd, ...). A band that
    does not find the period by itself may still show it in the fold.
    """
    at = lambda name, c: F.struct(F.lit(name).alias("which"), F.col(c).alias("period"))
    wanted = F.array(at("recommended", "recommended_period_days"), at("o_period", "o_period_days"), at("c_period", "c_period_days"))
    periods = recommended.select(
        F.col("source_id").alias("__s"),
        F.explode(wanted).alias("f"),
    ).select("__s", "f.which", F.col("f.period").alias("__p")).where("__p > 0")
    crossed = (F.col("which") == "recommended") | (
        (F.col("series") == "o")
        & (F.col("which") == "c_period")
    ) | ((F.col("series") == "c") & (F.col("which") == "o_period"))
    rows = points.where(F.col("series").isin("o", "c")).join(periods, F.col("source_id") == F.col("__s")).where(crossed)
    rows = rows.withColumn("series", F.concat_ws("@", "series", "which")).withColumn(
        "phase",
        F.col("mjd") / F.col("__p") - F.floor(F.col("mjd") / F.col("__p")),
    ).drop("__s", "__p", "which")
    folds = fold_coherence(rows, cfg)
    get = lambda band, which, c: F.max(F.when(F.col("series") == f"{band}@{which}", F.col(c)))
    names = {"amp": "fold_amplitude", "snr": "fold_amp_snr", "scatter_reduction": "fold_scatter_reduction"}
    own = [get(b, "recommended", c).alias(f"{b}_forced_at_recommended_{n}") for b in ("o", "c") for n, c in names.items()]
    other = [
        get(b, f"{o}_period", names[n]).alias(f"{b}_forced_at_{o}_period_{n}")
        for b, o in (("c", "o"), ("o", "c"))
        for n in ("amp", "snr")
    ]
    w = recommended.select("source_id").join(folds.groupBy("source_id").agg(*own, *other), "source_id", "left")
    o, c = (_yes(F.col(f"{b}_forced_at_recommended_snr") >= cfg.fold_snr) for b in ("o", "c"))
    status = F.when(
        o & c,
        "both_filters_show_forced_signal",
    ).when(o, "o_only_at_recommended_period").when(c, "c_only_at_recommended_period").otherwise("forced_fold_weak_or_unavailable")
    ratio = F.when(F.col("c_forced_at_recommended_amp") > 0, F.col("o_forced_at_recommended_amp") / F.col("c_forced_at_recommended_amp"))
    return w.withColumn("o_over_c_forced_amp_ratio", ratio).withColumn("colour_recovery_status", status)
