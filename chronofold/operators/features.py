"""Relational forms of phase profiles, excursion events and time-domain features.

Observations are (source_id, row_id, time, mag, err, filter). Profiles of
all folds are in ``folds`` and ``shapes``, models and dip evidence in ``evidence``, and all
features of a source in ``measures``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.config import MorphologyConfig
from chronofold.functions.columns import MAD_SIGMA, bin_of, clip01, median, phase, positive
from chronofold.operators.folds import spread_over

TAU = 2 * 3.141592653589793


def spread(c, window=None):
    """Half the span of the central 68 %, as an aggregate or over a window."""
    high, low = F.percentile(c, F.lit(0.84)), F.percentile(c, F.lit(0.16))
    return (high - low) / 2 if window is None else (high.over(window) - low.over(window)) / 2


def phase_profile(points: DataFrame, cfg: MorphologyConfig = MorphologyConfig()) -> DataFrame:
    """(source_id, filter, bin, n, value, sigma) of points with ``period``: bin medians of the band-centred magnitude."""
    band = W.partitionBy("source_id", "filter")
    p = points.withColumn("x", F.col("mag") - median(F.col("mag")).over(band)).withColumn(
        "bin",
        bin_of(phase(F.col("time"), F.col("period")), cfg.phase_bins),
    )
    scale = F.when(F.count(F.lit(1)) > 3, positive(spread(F.col("x"))))
    return p.groupBy("source_id", "filter", "bin").agg(
        F.count(F.lit(1)).alias("n"),
        median(F.col("x")).alias("value"),
        (F.coalesce(scale, median(F.col("err"))) / F.sqrt(F.count(F.lit(1)))).alias("sigma"),
    )


def profile_significance(bins: DataFrame, cfg: MorphologyConfig = MorphologyConfig()) -> DataFrame:
    """Per source and band over occupied bins (8 at least): coverage, amplitude, chi2, snr, reliability."""
    w = W.partitionBy("source_id", "filter")
    b = bins.withColumn("v", F.col("value") - median(F.col("value")).over(w)).withColumn("s", positive(F.col("sigma")))
    out = b.groupBy("source_id", "filter").agg(
        F.count(F.lit(1)).alias("occupied"),
        (F.percentile("v", F.lit(0.95)) - F.percentile("v", F.lit(0.05))).alias("amplitude"),
        F.avg(F.pow(F.col("v") / F.col("s"), F.lit(2.0))).alias("chi2"),
        median(F.col("s")).alias("typical"),
    )
    ok = F.col("occupied") >= 8
    out = out.withColumn("coverage", F.col("occupied") / cfg.phase_bins).withColumn("profile_chi2", F.when(ok, F.col("chi2"))).withColumn(
        "profile_snr",
        F.when(ok, F.col("amplitude") / F.greatest("typical", F.lit(1e-9))),
    )
    rel = clip01((F.col("profile_chi2") - 1) / 24.0) * clip01(F.col("coverage") / 0.65)
    return out.select(
        "source_id",
        "filter",
        "occupied",
        "coverage",
        "amplitude",
        "profile_chi2",
        "profile_snr",
        F.coalesce(rel, F.lit(0.0)).alias("reliability"),
    )


def fourier(bins: DataFrame, harmonics: int = 4, n_bins: int = 64) -> DataFrame:
    """Amplitude ratios R21.. and phase differences phi21.. of each band's bin values."""
    w = W.partitionBy("source_id", "filter")
    b = bins.withColumn("v", F.col("value") - F.avg("value").over(w)).withColumn("p", F.lit(TAU) * F.col("bin") / float(n_bins))
    sums = b.groupBy("source_id", "filter").agg(
        *[F.avg(F.col("v") * f(F.col("p") * h)).alias(f"{n}{h}") for h in range(1, harmonics + 1) for n, f in (("a", F.cos), ("b", F.sin))]
    )
    amp = lambda h: 2 * F.sqrt(F.col(f"a{h}") * F.col(f"a{h}") + F.col(f"b{h}") * F.col(f"b{h}"))
    ang = lambda h: F.atan2(F.col(f"b{h}"), F.col(f"a{h}"))
    wrap = lambda d: d + F.lit(TAU / 2) - F.floor((d + F.lit(TAU / 2)) / F.lit(TAU)) * F.lit(TAU) - F.lit(TAU / 2)
    cols = [
        c
        for h in range(2, harmonics + 1)
        for c in ((amp(h) / F.greatest(amp(1), F.lit(1e-12))).alias(f"fourier_r{h}1"), wrap(ang(h) - h * ang(1)).alias(f"fourier_phi{h}1"))
    ]
    return sums.select("source_id", "filter", amp(1).alias("fourier_amplitude"), *cols)


def residuals(points: DataFrame, bins: DataFrame, cfg: MorphologyConfig = MorphologyConfig()) -> DataFrame:
    """Points with their folded profile taken off: residual and z = residual over max(error, the source's residual spread)."""
    band = W.partitionBy("source_id", "filter")
    p = points.withColumn("x", F.col("mag") - median(F.col("mag")).over(band)).withColumn(
        "bin",
        bin_of(phase(F.col("time"), F.col("period")), cfg.phase_bins),
    )
    b = bins.select(F.col("source_id").alias("bs"), F.col("filter").alias("bf"), F.col("bin").alias("bb"), "value")
    p = p.join(
        b,
        (F.col("source_id") == F.col("bs")) & (F.col("filter") == F.col("bf")) & (F.col("bin") == F.col("bb")),
    ).withColumn("residual", F.col("x") - F.col("value"))
    return p.withColumn(
        "z",
        F.col("residual") / F.greatest("err", spread(F.col("residual"), W.partitionBy("source_id"))),
    ).drop("bs", "bf", "bb")


def excursion_events(rows: DataFrame, sigma: float = 5.0, gap: float = 1.0, min_points: int = 2) -> DataFrame:
    """Gaps and islands over points with |z| > sigma: one row per event, rejected ones included. Larger magnitudes are dimmings."""
    r = rows.where(F.abs("z") > sigma).withColumn("event_type", F.when(F.col("z") > 0, "dimming").otherwise("brightening"))
    w = W.partitionBy("source_id", "event_type").orderBy("time", "row_id")
    before = F.lag("time").over(w)
    new = before.isNull() | (F.col("time") - before > gap) | (F.floor("time") != F.floor(before))
    r = r.withColumn("event_number", F.sum(new.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = r.groupBy("source_id", "event_type", "event_number").agg(
        median(F.col("time")).alias("event_time"),
        F.count(F.lit(1)).alias("n_measurements"),
        (F.max("time") - F.min("time")).alias("event_duration_days"),
        F.array_join(F.array_sort(F.collect_set("filter")), ";").alias("represented_filters"),
        F.countDistinct("filter").alias("nf"),
        F.max(F.abs("z")).alias("peak_residual_significance"),
        median(F.abs("z")).alias("median_residual_significance"),
        median(F.col("err")).alias("median_quoted_uncertainty"),
        F.min("err").alias("minimum_quoted_uncertainty"),
        F.max("err").alias("maximum_quoted_uncertainty"),
    )
    multi, cross = F.col("n_measurements") >= max(2, min_points), (F.col("nf") >= 2) & (F.col("n_measurements") >= 2)
    out = out.withColumn("is_multi_point", multi).withColumn("has_cross_filter_support", cross).withColumn("passes_quality_validation", multi | cross).withColumn("independent_observing_night", F.floor("event_time").cast("long"))
    return out.withColumn("rejection_reason", F.when(F.col("passes_quality_validation"), "").otherwise("single_point_excursion")).drop("nf")


def event_metrics(events: DataFrame, n_points: DataFrame, min_events: int = 2) -> DataFrame:
    """Per source of ``n_points`` (source_id, n_points): validated events of either kind, and what supports the brightenings."""
    ok, kind = F.col("passes_quality_validation"), F.col("event_type")
    flare, dim = ok & (kind == "brightening"), ok & (kind == "dimming")
    of = lambda c, x: F.when(c, F.col(x))
    e = events.groupBy("source_id").agg(
        F.count_if(flare).alias("flare_event_count"),
        F.count_if(dim).alias("dimming_event_count"),
        F.max(of(flare, "peak_residual_significance")).alias("strongest_flare_sigma"),
        F.max(of(dim, "peak_residual_significance")).alias("strongest_dimming_sigma"),
        F.sum(of(kind == "brightening", "n_measurements")).alias("bright"),
        F.sum(of(kind == "dimming", "n_measurements")).alias("faint"),
        F.sum(of(flare, "n_measurements")).alias("in_flares"),
        F.countDistinct(of(flare, "independent_observing_night")).alias("validated_flare_independent_nights"),
        median(of(flare, "median_residual_significance")).alias("validated_flare_median_significance"),
        F.avg(F.when(flare, F.col("has_cross_filter_support").cast("double"))).alias("validated_flare_cross_filter_fraction"),
        F.avg(F.when(flare, F.col("is_multi_point").cast("double"))).alias("validated_flare_multi_point_fraction"),
        F.count_if(flare & (F.col("n_measurements") >= 3)).alias("validated_flare_well_sampled_event_count"),
        F.count_if(flare & F.col("has_cross_filter_support")).alias("validated_flare_cross_filter_event_count"),
        F.count_if((kind == "brightening") & (F.col("n_measurements") == 1)).alias("single_point_flare_event_count"),
    )
    j = n_points.join(e, "source_id", "left")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    names = [c for c in e.columns if c not in ("source_id", "bright", "faint", "in_flares")]
    j = j.select(
        "source_id",
        "n_points",
        *[zero(c).alias(c) for c in names],
        *[
            (zero(c) / F.col("n_points")).alias(n)
            for c, n in (("bright", "flare_point_fraction"), ("faint", "dimming_point_fraction"), ("in_flares", "flare_duty_fraction"))
        ],
    )
    n, d = F.col("flare_event_count"), F.col("dimming_event_count")
    passes = (n >= 2) | (F.col("validated_flare_well_sampled_event_count") >= 1) | (F.col("validated_flare_cross_filter_event_count") >= 1)
    return j.withColumn("flare_asymmetry", F.coalesce(F.try_divide(n, n + d), F.lit(0.0))).withColumn(
        "flare_leave_one_event_out_persistent",
        (n - 1 >= max(2, min_events - 1)).cast("double"),
    ).withColumn("flare_primary_validation_pass", passes.cast("double"))


def with_sections(points: DataFrame, k: int = 4) -> DataFrame:
    """Adds ``section``: chronological quarters of equal size, earlier ones take the remainder."""
    return points.withColumn("section", F.ntile(k).over(W.partitionBy("source_id").orderBy("time", "row_id")) - 1)


def temporal_coherence(points: DataFrame) -> DataFrame:
    """Raw-time coherence of each source with six points or more, independent of phase."""
    src = W.partitionBy("source_id")
    order = src.orderBy("time", "row_id")
    p = with_sections(points).withColumn(
        "c",
        F.col("mag") - median(F.col("mag")).over(src),
    ).withColumn("n", F.count(F.lit(1)).over(src)).where("n >= 6")
    p = p.withColumn("dev", F.abs(F.col("c") - median(F.col("c")).over(src)))
    scale = F.greatest(spread_over("c", "dev", F.col("n"), src), median(F.col("err")).over(src), F.lit(1e-9))
    p = p.withColumn("scale", scale).withColumn("nxt", F.lead("c").over(order)).withColumn(
        "sg",
        F.when(F.abs("c") >= 2 * F.col("scale"), F.signum("c")).otherwise(0.0),
    )
    p = p.withColumn(
        "brk",
        F.coalesce((F.col("sg") != F.lag("sg").over(order)).cast("int"), F.lit(1)),
    ).withColumn("isl", F.sum("brk").over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = p.where("sg <> 0").groupBy("source_id", "isl").count().where("count >= 2").groupBy("source_id").agg(
        F.count(F.lit(1)).alias("groups")
    )
    secs = p.groupBy("source_id", "section").agg(median(F.col("mag")).alias("sm")).groupBy("source_id").agg(
        (F.max("sm") - F.min("sm")).alias("srange")
    )
    base = p.withColumn("__a", F.abs(F.col("c") - median(F.col("c")).over(src))).groupBy("source_id").agg(
        (F.avg(F.pow(F.col("nxt") - F.col("c"), F.lit(2.0))) / F.greatest(F.var_pop("c"), F.lit(1e-12))).alias("von_neumann_ratio"),
        F.try_divide(F.covar_pop("c", "nxt"), F.stddev_pop(F.when(F.col("nxt").isNotNull(), F.col("c"))) * F.stddev_pop("nxt")).alias("lag"),
        F.first("scale").alias("scale"),
        (MAD_SIGMA * median(F.col("__a"))).alias("robust"),
        median(F.col("err")).alias("med_err"),
    )
    j = base.join(runs, "source_id", "left").join(secs, "source_id").withColumn("groups", F.coalesce("groups", F.lit(0))).withColumn(
        "section_median_range_sigma",
        F.col("srange") / F.col("scale"),
    )
    j = j.withColumn("raw_time_lag1_correlation", F.when(F.isnan("lag"), None).otherwise(F.col("lag")))
    score = clip01(
        0.35 * clip01((2 - F.col("von_neumann_ratio")) / 1.5)
        + 0.30 * clip01(F.coalesce("raw_time_lag1_correlation", F.lit(0.0)))
        + 0.20 * clip01(F.col("groups") / 3.0)
        + 0.15 * clip01(F.col("section_median_range_sigma") / 4.0)
    )
    excess = clip01((F.col("robust") / F.greatest("med_err", F.lit(1e-9)) - 1.5) / 4.0)
    return j.select(
        "source_id",
        "von_neumann_ratio",
        "raw_time_lag1_correlation",
        F.col("groups").alias("same_direction_excursion_groups"),
        "section_median_range_sigma",
        score.alias("temporal_coherence_score"),
        (score * excess).alias("irregular_variability_score"),
    )


def phase_section_dependence(points: DataFrame) -> DataFrame:
    """Mutual information of phase octant and section over the entropy of the octant, in [0, 1]."""
    p = with_sections(points).withColumn("o", bin_of(phase(F.col("time"), F.col("period")), 8))
    cells = p.groupBy("source_id", "o", "section").agg(F.count(F.lit(1)).alias("n"))
    total, row, col = W.partitionBy("source_id"), W.partitionBy("source_id", "o"), W.partitionBy("source_id", "section")
    c = cells.withColumn("j", F.col("n") / F.sum("n").over(total)).withColumn(
        "po",
        F.sum("n").over(row) / F.sum("n").over(total),
    ).withColumn("ps", F.sum("n").over(col) / F.sum("n").over(total))
    # Each cell carries its share of the octant's entropy, so one aggregate gives both sums.
    out = c.groupBy("source_id").agg(
        F.sum(F.col("j") * F.log(F.col("j") / (F.col("po") * F.col("ps")))).alias("mi"),
        (-F.sum(F.col("j") * F.log("po"))).alias("h"),
    )
    return out.select("source_id", clip01(F.col("mi") / F.greatest("h", F.lit(1e-9))).alias("phase_time_section_dependence"))


def dips(bins: DataFrame, n_bins: int = 64) -> DataFrame:
    """(source_id, dip_phase, dip_duty_cycle): the faintest bin's phase and the share of occupied bins at least half as deep."""
    w = W.partitionBy("source_id")
    b = bins.groupBy("source_id", "bin").agg(F.avg("value").alias("v")).withColumn("depth", F.col("v") - median(F.col("v")).over(w))
    b = b.withColumn("deepest", F.max("depth").over(w))
    at = F.min(F.when(F.col("depth") == F.col("deepest"), F.col("bin")))
    return b.groupBy("source_id").agg(
        (at / float(n_bins)).alias("dip_phase"),
        F.avg((F.col("depth") >= F.col("deepest") / 2).cast("double")).alias("dip_duty_cycle"),
    )


def cycle_dimming(points: DataFrame, dip: DataFrame) -> DataFrame:
    """Per source: cycles with points in the dip and a baseline, those whose dip is fainter by 1.5 sigma, and the nights and sections of their faint points.

    ``dip`` has dip_phase and dip_duty_cycle. Very broad dips (0.40 and more) need no baseline of their own cycle.
    """
    src = W.partitionBy("source_id")
    p = with_sections(points).join(dip.withColumnRenamed("source_id", "__d"), F.col("source_id") == F.col("__d"))
    p = p.withColumn(
        "turn",
        (F.col("time") - F.min("time").over(src)) / F.col("period"),
    ).withColumn("cycle", F.floor("turn")).withColumn("gap", F.abs(F.col("turn") - F.floor("turn") - F.col("dip_phase")))
    p = p.withColumn(
        "width",
        F.least(F.greatest("dip_duty_cycle", F.lit(0.02)), F.lit(0.65)),
    ).withColumn("inside", F.least("gap", 1 - F.col("gap")) <= F.col("width") / 2)
    base = F.when(~F.col("inside"), F.col("mag"))
    p = p.withColumn(
        "scale",
        F.greatest(spread(F.col("mag"), src), median(F.col("err")).over(src), F.lit(1e-6)),
    ).withColumn("level", F.coalesce(median(base).over(src), median(F.col("mag")).over(src)))
    p = p.withColumn("n_in_all", F.count_if("inside").over(src)).withColumn(
        "own",
        median(base).over(W.partitionBy("source_id", "cycle")),
    ).where("n_in_all >= 2")
    dipped = p.where("inside and (own is not null or width >= 0.40)").withColumn("base", F.coalesce("own", "level"))
    c = dipped.groupBy("source_id", "cycle").agg(
        (median(F.col("mag")) - F.first("base")).alias("depth"),
        F.greatest(F.first("scale") / F.sqrt(F.count(F.lit(1))), median(F.col("err")), F.lit(1e-9)).alias("sigma"),
        F.collect_set(F.when(F.col("mag") > F.col("base"), F.floor("time"))).alias("nights"),
        F.collect_set(F.when(F.col("mag") > F.col("base"), F.col("section"))).alias("sections"),
    )
    c = c.withColumn("contrast", F.col("depth") / F.col("sigma")).withColumn("good", (F.col("contrast") >= 1.5) & (F.col("depth") > 0))
    distinct = lambda name: F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("good"), F.col(name))))))
    return c.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("dip_covered_cycles"),
        F.count_if("good").alias("dip_supporting_cycles"),
        distinct("sections").alias("dip_supporting_time_sections"),
        distinct("nights").alias("dip_independent_nights"),
        (F.count_if("good") / F.count(F.lit(1))).alias("dip_cycle_support_fraction"),
        median(F.col("contrast")).alias("dip_local_contrast_sigma"),
    )
