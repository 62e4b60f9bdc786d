"""Summary tables over a classified catalogue (A10-A20, T5-T10, IO20)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.functions.columns import median, tags


def category_summary(t: DataFrame) -> DataFrame:
    return t.groupBy("final_primary_tag").agg(
        F.count(F.lit(1)).alias("n"),
        median(F.col("confidence")).alias("median_confidence"),
        median(F.col("recommended_period_days")).alias("median_period_days"),
        median(F.col("profile_chi2")).alias("median_chi2"),
        F.count_if("needs_review").alias("n_review"),
    )


def dataset_categories(t: DataFrame) -> DataFrame:
    return t.groupBy("dataset", "final_primary_tag").agg(F.count(F.lit(1)).alias("n"))


def tag_summary(t: DataFrame, column: str = "final_secondary_tags") -> DataFrame:
    return t.select(F.explode(tags(F.col(column))).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def family_tag_crosstab(t: DataFrame, families: list[str], column: str = "final_secondary_tags") -> DataFrame:
    rows = t.select("final_primary_tag", F.explode(tags(F.col(column))).alias("tag"))
    return rows.groupBy("tag").pivot("final_primary_tag", families).count().fillna(0)


def unknown_reasons(t: DataFrame) -> DataFrame:
    u = t.where("final_primary_tag = 'unknown'").select(
        F.array_union(tags(F.col("final_secondary_tags")), tags(F.col("review_reasons"))).alias("r")
    )
    u = u.select(F.explode(F.when(F.size("r") > 0, F.col("r")).otherwise(F.array(F.lit("untagged_unknown")))).alias("reason"))
    return u.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def alias_summary(t: DataFrame) -> DataFrame:
    """By family: how many sources carry the alias tag."""
    alias = F.array_contains(tags(F.col("final_secondary_tags")), "alias_period")
    return t.groupBy("final_primary_tag").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(alias).alias("n_alias"),
        F.avg(alias.cast("double")).alias("alias_fraction"),
    )


def interest_summary(t: DataFrame) -> DataFrame:
    return t.groupBy("final_interest_status").agg(
        F.count(F.lit(1)).alias("n"),
        median(F.col("interest_confidence")).alias("median_interest_confidence"),
        median(F.col("confidence")).alias("median_confidence"),
    )


def crosstab_with_margins(t: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of ``a`` by ``b`` with totals named 'All': one cube."""
    c = t.cube(a, b).agg(F.count(F.lit(1)).alias("n"), F.grouping(a).alias("ga"), F.grouping(b).alias("gb"))
    return c.select(
        F.when(F.col("ga") == 1, "All").otherwise(F.col(a)).alias(a),
        F.when(F.col("gb") == 1, "All").otherwise(F.col(b)).alias(b),
        "n",
    )


def review_queue(t: DataFrame) -> DataFrame:
    return t.where("needs_review").select("source_id", "dataset", "final_primary_tag", "confidence", "review_reasons")


def exotic_candidates(t: DataFrame) -> DataFrame:
    return t.where("final_interest_status in ('exotic_candidate', 'manually_confirmed_exotic')").select(
        "source_id",
        "dataset",
        "final_primary_tag",
        "interest_confidence",
        "interest_reasons",
    )


# Columns of the diagnostic tables; those that a catalogue lacks are left out.
TRANSIT = (
    "source_id",
    "dataset",
    "final_primary_tag",
    "final_secondary_tags",
    "confidence",
    "coherent_dimming_score",
    "dip_significance",
    "dip_duty_cycle",
    "dip_supporting_cycles",
    "dip_covered_cycles",
    "dip_cycle_support_fraction",
    "dip_independent_nights",
    "dip_supporting_time_sections",
    "dip_local_contrast_sigma",
    "phase_time_section_dependence",
    "dip_section_concentration",
    "dip_single_section_fraction",
    "phase_coverage_near_dip",
    "phase_coverage_outside_dip",
    "dip_point_quality_fraction",
    "dip_cycle_contrast_scatter",
    "wave_model_score",
    "dimming_model_score",
    "wave_dimming_score_margin",
    "review_reasons",
)
IRREGULAR = (
    "source_id",
    "dataset",
    "final_secondary_tags",
    "confidence",
    "irregular_variability_score",
    "temporal_coherence_score",
    "von_neumann_ratio",
    "raw_time_lag1_correlation",
    "same_direction_excursion_groups",
    "section_median_range_sigma",
    "evolution_raw_score",
    "minimum_section_correlation",
    "maximum_section_distance",
    "final_interest_status",
    "interest_reasons",
    "review_reasons",
)


def _some(t: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return t.select(*[n for n in names if n in t.columns])


def _tagged(*names: str):
    return F.arrays_overlap(tags(F.coalesce("final_secondary_tags", F.lit(""))), F.array(*map(F.lit, names)))


def transit_diagnostics(t: DataFrame) -> DataFrame:
    """Evidence of every transit, best score first."""
    return _some(t.where("final_primary_tag = 'transit'"), TRANSIT).orderBy(F.desc_nulls_last("coherent_dimming_score"), "source_id")


def transit_ambiguous(t: DataFrame) -> DataFrame:
    return _some(t.where(_tagged("transit_wave_ambiguous")), TRANSIT)


def seasonal_false_positives(t: DataFrame) -> DataFrame:
    """Dimmings whose fold the seasons, the coverage or a few poor points may have made."""
    return _some(
        t.where(_tagged("seasonal_phase_coupling", "single_section_dimming", "gappy_phase_coverage", "poor_point_driven")),
        TRANSIT,
    )


def irregular_summary(t: DataFrame) -> DataFrame:
    return _some(t.where("final_primary_tag = 'irregular_variable'"), IRREGULAR)


def coverage_and_period_flags(t: DataFrame) -> DataFrame:
    """Sources of one band, of little phase coverage, or with a period on an alias."""
    flags = t.withColumn("alias_period", _tagged("alias_period"))
    names = (
        "source_id",
        "dataset",
        "final_primary_tag",
        "single_band_source",
        "phase_coverage",
        "low_phase_coverage",
        "recommended_period_days",
        "alias_period",
    )
    odd = [
        F.coalesce(F.col(c).cast("boolean"), F.lit(False))
        for c in ("single_band_source", "low_phase_coverage", "alias_period")
        if c in flags.columns
    ]
    hit = odd[0]
    for c in odd[1:]:
        hit = hit | c
    return _some(flags.where(hit), names)


def event_validation(events: DataFrame, t: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """Every excursion event with its source's label; events of an ``earlier`` table stay for sources that ``events`` does not cover."""
    if earlier is not None:
        kept = earlier.drop("final_primary_tag", "confidence").join(events.select("source_id").distinct(), "source_id", "left_anti")
        events = kept.unionByName(events, allowMissingColumns=True)
    return events.join(t.select("source_id", "final_primary_tag", "confidence"), "source_id", "left")


def examples(t: DataFrame, score: str, k: int = 9) -> DataFrame:
    """The ``k`` strongest sources of each family, in pages of nine."""
    w = W.partitionBy("final_primary_tag").orderBy(F.desc_nulls_last(score), "source_id", "dataset")
    r = t.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    return r.withColumn("page", F.floor((F.col("place") - 1) / 9).cast("int")).select(
        "final_primary_tag",
        "place",
        "page",
        "source_id",
        "dataset",
        score,
    )


def validation_sample(t: DataFrame, earlier: DataFrame, n: int) -> DataFrame:
    """``n`` sources in a fixed hash order; those of an earlier sample stay first."""
    e = earlier.select("source_id", "dataset").distinct().withColumn("__e", F.lit(0))
    j = t.join(e, ["source_id", "dataset"], "left").orderBy(
        F.coalesce("__e", F.lit(1)),
        F.xxhash64("source_id", "dataset"),
        "source_id",
        "dataset",
    )
    return j.limit(n).drop("__e")


def csv_safe(df: DataFrame) -> DataFrame:
    """Arrays as ;-joined text, maps and structs as JSON, non-finite numbers as NULL."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind.startswith("array<") and not kind.startswith(("array<struct", "array<map", "array<array")):
            c = F.array_join(c.cast("array<string>"), ";")
        elif kind.startswith(("array<", "map<", "struct<")):
            c = F.to_json(c)
        elif kind in ("double", "float"):
            c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
        out.append(c.alias(name))
    return df.select(*out)
