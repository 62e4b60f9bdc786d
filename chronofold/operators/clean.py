"""Quality cleaning with auditable rejection reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.config import CleanConfig, SelectConfig
from chronofold.functions.columns import ERR_PER_MAG, MAD_SIGMA, flux_of, median, number, positive

#: Accepted names of each column, first match wins (exact; header names are trimmed before).
ALIASES = {
    "mjd": ("###MJD", "MJD", "mjd"), "band": ("F", "filter", "band"), "ujy": ("uJy", "ujy", "flux"), "dujy": ("duJy", "dujy", "flux_err"),
    "m": ("m", "mag"), "dm": ("dm", "mag_err"), "mag5sig": ("mag5sig",), "sky": ("Sky", "sky"), "err": ("err",), "x": ("x",), "y": ("y",),
    "maj": ("maj",), "min": ("min",), "apfit": ("apfit",), "flags": ("flags",),
}


def standardise(raw: DataFrame, source_col: str = "source_id", row_col: str = "row_id") -> DataFrame:
    """Rename by ``ALIASES`` and make every measurement a finite double or NULL; flux from magnitude only if there is no flux column."""
    by_name = {c.strip(): c for c in raw.columns}
    found = {to: next((by_name[n] for n in names if n in by_name), None) for to, names in ALIASES.items()}
    if not found["mjd"] or not found["band"]:
        raise ValueError("a time and a filter column are required")
    if not found["ujy"] and not (found["m"] and found["dm"]):
        raise ValueError("a flux or a magnitude pair is required")
    out = raw.select(
        raw[source_col].cast("string").alias("source_id"),
        raw[row_col].alias("row_id"),
        F.trim(raw[found["band"]].cast("string")).alias("band"),
        *[number(raw[f"`{c}`"]).alias(to) for to, c in found.items() if c and to != "band"],
    )
    for to in ("m", "dm"):
        if not found[to]:
            out = out.withColumn(to, F.lit(None).cast("double"))
    if not found["ujy"]:
        out = out.withColumn("ujy", flux_of(F.col("m"))).withColumn("dujy", F.col("ujy") * ERR_PER_MAG * F.col("dm"))
    return out


def cuts(columns: list[str], cfg: CleanConfig) -> dict[str, Column]:
    """Named soft cuts of the columns that are there, in order. Bounds are strict, a missing value fails."""

    def between(name: str, low: float, high: float) -> Column:
        return (F.col(name) > low) & (F.col(name) < high)

    snr = F.try_divide("ujy", "dujy")
    all_cuts = {
        "err==0": ("err", F.col("err") == 0) if cfg.require_err_zero else None,
        f"duJy<{cfg.dujy_max:g}": ("dujy", F.col("dujy") < cfg.dujy_max),
        f"SNR>{cfg.snr_min:g}": ("ujy", ~F.coalesce(snr < cfg.snr_min, F.lit(False))),
        "x_in": ("x", between("x", *cfg.xy_range)),
        "y_in": ("y", between("y", *cfg.xy_range)),
        "maj_in": ("maj", between("maj", *cfg.axis_range)),
        "min_in": ("min", between("min", *cfg.axis_range)),
        "apfit_in": ("apfit", between("apfit", *cfg.apfit_range)),
        f"mag5sig>{cfg.depth_min:g}": ("mag5sig", F.col("mag5sig") > cfg.depth_min),
        f"Sky>{cfg.sky_min:g}": ("sky", F.col("sky") > cfg.sky_min),
        "flags==0": ("flags", F.col("flags") == 0) if cfg.require_flags_zero else None,
    }
    return {k: F.coalesce(v[1], F.lit(False)) for k, v in all_cuts.items() if v and v[0] in columns}


def audit(obs: DataFrame, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """Every observation with snr, hard_valid, filter_ok, hard_reject, standard_keep and ``failed``, the names of its failed cuts."""
    ok = lambda c: F.coalesce(c, F.lit(False))
    within = lambda c, r: F.col(c).isNull() | ((F.col(c) > r[0]) & (F.col(c) < r[1]))
    valid = F.col("mjd").isNotNull() & within("m", cfg.mag_range) & within("dm", cfg.dm_range) & ok(F.col("dujy") > 0) & ok(
        F.abs("ujy") < cfg.flux_limit
    )
    if cfg.require_magnitude:
        valid = valid & F.col("m").isNotNull() & F.col("dm").isNotNull()
    deep = ok(F.col("mag5sig") < cfg.hard_depth) if "mag5sig" in obs.columns else F.lit(False)
    soft = cuts(obs.columns, cfg)
    out = obs.withColumn("snr", F.try_divide("ujy", "dujy")).withColumn("hard_valid", valid).withColumn(
        "filter_ok",
        ok(F.col("band").isin(*cfg.bands)),
    )
    out = out.withColumn("hard_reject", ~F.col("hard_valid") | ~F.col("filter_ok") | deep).withColumn("__deep", deep)
    out = out.withColumn("failed", F.array_compact(F.array(*[F.when(~c, f"fail_{k}") for k, c in soft.items()])))
    return out.withColumn("standard_keep", ~F.col("hard_reject") & (F.size("failed") == 0))


def baseline(audited: DataFrame, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """Adds baseline_ujy and z_resid: a centred rolling median over the trusted points of each source and band."""
    half = cfg.window // 2
    source, band = W.partitionBy("source_id"), W.partitionBy("source_id", "band")
    rolling = band.orderBy(F.col("mjd").asc_nulls_last(), "row_id").rowsBetween(-half, half)
    trusted = F.when(
        F.count_if("standard_keep").over(source) > 50,
        F.col("standard_keep"),
    ).otherwise(F.col("hard_valid") & F.col("filter_ok"))
    out = audited.withColumn("__t", F.when(trusted, F.col("ujy")))
    roll = F.when(F.count("__t").over(rolling) >= max(5, cfg.window // 5), median(F.col("__t")).over(rolling))
    enough = F.count("__t").over(band) >= max(10, half)
    value = F.when(enough, F.coalesce(roll, median(F.col("__t")).over(band))).otherwise(median(F.col("ujy")).over(band))
    return out.withColumn("baseline_ujy", value).withColumn(
        "z_resid",
        F.try_divide(F.col("ujy") - F.col("baseline_ujy"), "dujy"),
    ).drop("__t")


def clean(obs: DataFrame, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """The audited observations with rescued, final_keep and reject_reason."""
    out = audit(obs, cfg)
    rescued = F.lit(False)
    if cfg.rescue:
        out = baseline(out, cfg)
        rescued = F.coalesce(F.col("z_resid") < cfg.rescue_z, F.lit(False)) & ~F.col("standard_keep") & ~F.col("hard_reject")
    out = out.withColumn("rescued", rescued).withColumn("final_keep", F.col("standard_keep") | F.col("rescued"))
    hard = F.concat_ws(
        ";",
        F.when(~F.col("hard_valid"), "HARD_invalid_nan_inf_or_bad_m_dm_flux"),
        F.when(~F.col("filter_ok"), "HARD_filter"),
        F.when(F.col("__deep"), f"HARD_mag5sig<{cfg.hard_depth:g}"),
    )
    soft = F.concat_ws(";", F.array_join("failed", ";"))
    reason = F.when(F.col("hard_reject"), hard).when(~F.col("standard_keep"), soft).otherwise("")
    reason = F.when(F.col("rescued"), F.concat_ws(";", F.nullif(reason, F.lit("")), F.lit("RESCUED_dip_candidate"))).otherwise(reason)
    return out.withColumn("reject_reason", reason).drop("__deep", "failed")


def summary(cleaned: DataFrame) -> DataFrame:
    """One row per source: counts, fractions, bands, spans and median errors before and after cleaning; one shuffle."""
    kept, n = F.col("final_keep"), lambda c: F.count_if(c)
    has = F.col("mjd").isNotNull()
    span = lambda c: F.when(F.count(F.when(c, F.col("mjd"))) > 1, F.max(F.when(c, F.col("mjd"))) - F.min(F.when(c, F.col("mjd"))))
    aggs = [
        F.count(F.lit(1)).alias("n_raw"),
        n("hard_reject").alias("n_hard_reject"),
        n("standard_keep").alias("n_standard_keep"),
        n("rescued").alias("n_rescued"),
        n("final_keep").alias("n_final_keep"),
        n(~kept).alias("n_removed"),
        (n(kept) / F.count(F.lit(1))).alias("fraction_kept"),
        F.min("mjd").alias("mjd_min_raw"),
        F.max("mjd").alias("mjd_max_raw"),
        span(has).alias("baseline_days_raw"),
        F.min(F.when(kept, F.col("mjd"))).alias("mjd_min_clean"),
        F.max(F.when(kept, F.col("mjd"))).alias("mjd_max_clean"),
        span(kept).alias("baseline_days_clean"),
    ]
    for b in ("c", "o"):
        mine = F.col("band") == b
        aggs += [
            n(mine).alias(f"n_{b}_raw"),
            n(mine & kept).alias(f"n_{b}_clean"),
            median(F.when(mine & kept, F.col("dm"))).alias(f"median_dm_{b}_clean"),
            median(F.when(mine & kept, F.col("dujy"))).alias(f"median_dujy_{b}_clean"),
        ]
    aggs += [
        F.array_join(F.array_sort(F.collect_set("band")), ",").alias("filters_present_raw"),
        F.array_join(F.array_sort(F.collect_set(F.when(kept, F.col("band")))), ",").alias("filters_present_clean"),
    ]
    return cleaned.groupBy("source_id").agg(*aggs)


def reason_counts(cleaned: DataFrame, per_source: bool = True) -> DataFrame:
    """Counts of each reason over rejected rows."""
    rows = cleaned.where(~F.col("final_keep")).select("source_id", F.explode(F.split("reject_reason", ";")).alias("reason"))
    return rows.groupBy(*(["source_id"] if per_source else []), "reason").agg(F.count(F.lit(1)).alias("n"))


def top_reasons(counts: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` most frequent reasons of each source, ties by name."""
    w = W.partitionBy("source_id").orderBy(F.desc("n"), "reason")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def totals(per_source: DataFrame) -> DataFrame:
    """Run totals from the per-source summary."""
    return per_source.agg(
        F.count(F.lit(1)).alias("n_sources"),
        F.sum("n_raw").alias("n_raw"),
        F.sum("n_final_keep").alias("n_kept"),
        F.sum("n_removed").alias("n_removed"),
        (F.sum("n_removed") / F.sum("n_raw")).alias("removed_fraction"),
        median(1 - F.col("fraction_kept")).alias("median_removed_fraction"),
    )


def select_sources(per_source: DataFrame, cfg: SelectConfig = SelectConfig()) -> DataFrame:
    """Adds selection_reasons (joined by ;) and selected. Precision must hold in a band that has enough points."""
    col = lambda c: F.col(c) if c in per_source.columns else F.lit(None).cast("double")
    eligible = [F.when(F.coalesce(col(f"n_{b}_clean"), F.lit(0)) >= cfg.min_band_points, col(f"median_dm_{b}_clean")) for b in ("c", "o")]
    best = F.least(*eligible)
    ok = F.lower(F.coalesce(F.col("status").cast("string"), F.lit("ok"))) == "ok" if "status" in per_source.columns else F.lit(True)
    no = lambda c: ~F.coalesce(c, F.lit(False))
    reasons = F.concat_ws(
        ";",
        F.when(~ok, "cleaning_failed"),
        F.when(no(col("n_final_keep") >= cfg.min_points), f"fewer_than_{cfg.min_points}_points"),
        F.when(
            F.greatest(*[F.coalesce(col(f"n_{b}_clean"), F.lit(0)) for b in ("c", "o")]) < cfg.min_band_points,
            f"no_band_with_{cfg.min_band_points}_points",
        ),
        F.when(no(col("baseline_days_clean") >= cfg.min_baseline), f"baseline_under_{cfg.min_baseline:g}_days"),
        F.when(1 - col("fraction_kept") > cfg.max_removed, f"more_than_{cfg.max_removed:.0%}_removed"),
        F.when(no(best <= cfg.max_dm), f"median_uncertainty_over_{cfg.max_dm:g}_mag"),
    )
    return per_source.withColumn("selection_reasons", reasons).withColumn("selected", F.col("selection_reasons") == "")


def selection_reasons(selected: DataFrame) -> DataFrame:
    rows = selected.where(~F.col("selected")).select(F.explode(F.split("selection_reasons", ";")).alias("reason"))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def selected_observations(cleaned: DataFrame, selected: DataFrame) -> DataFrame:
    """The kept observations of selected sources; the planner broadcasts the ids only while they are few."""
    return cleaned.where("final_keep").join(selected.where("selected").select("source_id"), "source_id", "left_semi")


def sigma_of(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Aggregate form of the robust sigma: (keys, centre, sigma)."""
    w = W.partitionBy(*keys)
    dev = df.withColumn("__c", median(F.col(value)).over(w))
    return dev.groupBy(*keys).agg(
        F.first("__c").alias("centre"),
        F.coalesce(positive(MAD_SIGMA * median(F.abs(F.col(value) - F.col("__c")))), positive(F.stddev_pop(value))).alias("sigma"),
    )
