"""Cadence aliases: learning per field, matching, scoring and replacement."""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.config import PeriodConfig
from chronofold.functions.columns import harmonic_relation, task_count, universal_alias


def with_field(df: DataFrame, cfg: PeriodConfig = PeriodConfig()) -> DataFrame:
    """Adds ra_bin, dec_bin and field_key; NULL bins and 'unknown' without a position."""
    known = F.col("ra_deg").isNotNull() & F.col("dec_deg").isNotNull()
    out = df.withColumn("ra_bin", F.when(known, F.floor(F.col("ra_deg") / cfg.field_deg)).cast("int")).withColumn(
        "dec_bin",
        F.when(known, F.floor(F.col("dec_deg") / cfg.field_deg)).cast("int"),
    )
    return out.withColumn(
        "field_key",
        F.coalesce(F.concat(F.col("ra_bin").cast("string"), F.lit("_"), F.col("dec_bin").cast("string")), F.lit("unknown")),
    )


def learning_peaks(peaks: DataFrame, cfg: PeriodConfig = PeriodConfig(), series: str = "auto", most: int = 12) -> DataFrame:
    """(ra_bin, dec_bin, source_id, periods): each star's peaks once. ``auto`` uses combined rows where a star has them, else pools o and c; repeats of (source, series, rank) count once, the first ``priority`` wins."""
    prio = F.col("priority") if "priority" in peaks.columns else F.lit(0)
    w = W.partitionBy("source_id", "series", "rank").orderBy(prio, "period_days")
    p = with_field(peaks, cfg).where(
        F.col("ra_bin").isNotNull()
        & (F.col("rank") <= most)
    ).withColumn("__r", F.row_number().over(w)).where("__r = 1")
    if series == "auto":
        whole = F.max(F.col("series") == "combined").over(W.partitionBy("source_id"))
        p = p.withColumn("__c", whole).where(F.when(F.col("__c"), F.col("series") == "combined").otherwise(F.col("series").isin("o", "c")))
    else:
        p = p.where(F.col("series") == series)
    p = p.where((F.col("period_days") > 0) & (universal_alias(F.col("period_days"), cfg.universal_tolerance) == ""))
    listed = p.groupBy("ra_bin", "dec_bin", "source_id").agg(
        F.array_sort(F.collect_list(F.struct(F.when(F.col("series") == "o", 0).otherwise(1).alias("s"), "rank", "period_days"))).alias("l")
    )
    return listed.select("ra_bin", "dec_bin", "source_id", F.col("l.period_days").alias("periods"))


INVENTORY = "ra_bin int, dec_bin int, field_key string, alias_period_days double, n_stars_in_field long, n_stars_hit long, hit_fraction double"


def learn_inventory(peaks: DataFrame, cfg: PeriodConfig = PeriodConfig(), series: str = "auto") -> DataFrame:
    """Periods that pile up over the stars of a field.

    Clustering is greedy in the order of source id and rank, so it runs per
    field. A field is a bounded patch of sky and holds one short list a star; a
    cluster's members stay sorted, so a field's work does not grow with the square of its stars.
    """

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        clusters: list[dict] = []
        centres = np.empty(64)
        for star, periods in zip(*(pdf.sort_values("source_id")[c] for c in ("source_id", "periods"))):
            for p in periods:
                known = centres[: len(clusters)]
                far = np.abs(p - known) / known
                i = int(far.argmin()) if len(far) else 0
                if len(far) and far[i] <= cfg.cluster_tolerance:
                    c = clusters[i]
                    bisect.insort(c["members"], p)
                    c["stars"].add(star)
                    m, odd = divmod(len(c["members"]), 2)
                    c["centre"] = float(c["members"][m] if odd else (c["members"][m - 1] + c["members"][m]) / 2)
                else:
                    i = len(clusters)
                    clusters.append({"centre": float(p), "members": [p], "stars": {star}})
                    if i == len(centres):
                        centres = np.concatenate([centres, np.empty(i)])
                centres[i] = clusters[i]["centre"]
        n = int(pdf["n_stars"].iloc[0])
        rows = [
            (key[0], key[1], f"{key[0]}_{key[1]}", c["centre"], n, len(c["stars"]), len(c["stars"]) / n)
            for c in clusters
            if len(c["stars"]) / n >= cfg.field_min_fraction
        ]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in INVENTORY.split(", ")])

    stars = with_field(peaks, cfg).where("ra_bin is not null").select("ra_bin", "dec_bin", "source_id").distinct()
    sizes = stars.groupBy("ra_bin", "dec_bin").agg(F.count(F.lit(1)).alias("n_stars")).where(F.col("n_stars") >= cfg.field_min_stars)
    listed = learning_peaks(peaks, cfg, series).join(sizes, ["ra_bin", "dec_bin"])
    return listed.repartition(task_count(listed), "ra_bin", "dec_bin").groupBy("ra_bin", "dec_bin").applyInPandas(one, INVENTORY)


def merge_memory(inventories: DataFrame, cfg: PeriodConfig = PeriodConfig()) -> DataFrame:
    """One memory from several inventories: periods of a field within 2 % of the smallest ungrouped one join; stars and hits add up."""

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["alias_period_days"] > 0].sort_values(["alias_period_days", "n_stars_in_field", "n_stars_hit"])
        rows, start = [], None
        groups: list[list[int]] = []
        for i, p in enumerate(pdf["alias_period_days"]):
            if start is None or (p - start) / start > cfg.field_tolerance:
                groups.append([])
                start = p
            groups[-1].append(i)
        for g in groups:
            sub = pdf.iloc[g]
            n, hit = int(sub["n_stars_in_field"].sum()), int(sub["n_stars_hit"].sum())
            rows.append(
                (key[0], key[1], f"{key[0]}_{key[1]}", float(sub["alias_period_days"].median()), n, hit, hit / n if n else math.nan)
            )
        return pd.DataFrame(rows, columns=[c.split()[0] for c in INVENTORY.split(", ")])

    return inventories.groupBy("ra_bin", "dec_bin").applyInPandas(one, INVENTORY)


def score(peaks: DataFrame, inventory: DataFrame, cfg: PeriodConfig = PeriodConfig()) -> DataFrame:
    """Peaks with universal alias, field alias, score, labels and is_alias.

    The relative-range match on the field is an equi join on field and a
    logarithmic period bucket (its own and both neighbours), so it never
    compares all peaks with all aliases.
    """
    width = math.log1p(cfg.field_tolerance)
    p = with_field(peaks, cfg).withColumn("__id", F.struct("source_id", "series", "rank"))
    near = F.explode(F.array(*[(F.floor(F.log("alias_period_days") / width) + d).cast("long") for d in (-1, 0, 1)]))
    inv = inventory.where("alias_period_days > 0").select(
        F.col("ra_bin").alias("rb"),
        F.col("dec_bin").alias("db"),
        F.col("alias_period_days").alias("a"),
        "hit_fraction",
        near.alias("lb"),
    )
    p = p.withColumn("__lb", F.floor(F.log("period_days") / width).cast("long"))
    hit = (F.col("ra_bin") == F.col("rb")) & (F.col("dec_bin") == F.col("db")) & (F.col("__lb") == F.col("lb")) & (
        F.abs(F.col("period_days") - F.col("a")) / F.col("a") <= cfg.field_tolerance
    )
    j = p.join(inv, hit, "left")
    w = W.partitionBy("source_id", "series", "rank").orderBy(F.desc_nulls_last("hit_fraction"), "a")
    j = j.withColumn("__r", F.row_number().over(w)).where("__r = 1")
    j = j.withColumn(
        "universal_alias",
        universal_alias(F.col("period_days"), cfg.universal_tolerance),
    ).withColumnRenamed("a", "field_alias_period")
    window = F.when(
        F.col("rank") == 1,
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("raw_sampling_window_power", F.lit(0.0)))),
    ).otherwise(0.0)
    s = F.when(F.col("universal_alias") != "", cfg.weight_universal).otherwise(0.0) + F.when(
        F.col("field_alias_period").isNotNull(),
        cfg.weight_field,
    ).otherwise(0.0) + cfg.weight_window * window
    j = j.withColumn("alias_score", F.least(F.lit(1.0), s)).withColumn("is_alias", F.col("alias_score") >= cfg.alias_threshold)
    labels = F.concat_ws(
        ";",
        F.when(F.col("universal_alias") != "", F.concat(F.lit("universal:"), F.col("universal_alias"))),
        F.when(F.col("field_alias_period").isNotNull(), "field"),
        F.when(window >= cfg.window_warning, "window"),
    )
    return j.withColumn("alias_labels", labels).drop("__id", "__lb", "__r", "rb", "db", "lb")


def replace(scored: DataFrame, cfg: PeriodConfig = PeriodConfig()) -> DataFrame:
    """One row per series: the first peak, or the first strong, unrelated non-alias peak of rank 2 to ``replacement_rank`` if the first is an alias."""
    key = ["source_id", "series"]
    first = scored.where("rank = 1").select(
        *[F.col(k).alias(f"__{k}") for k in key],
        F.col("period_days").alias("p1"),
        F.col("alias_score").alias("raw_alias_score"),
        F.col("alias_labels").alias("raw_alias_labels"),
        F.col("is_alias").alias("raw_is_alias_suspect"),
    )
    j = scored.join(first, [F.col(k) == F.col(f"__{k}") for k in key])
    able = (
        F.col("raw_is_alias_suspect")
        & (F.col("rank") > 1)
        & (F.col("rank") <= cfg.replacement_rank)
        & ~F.col("is_alias")
        & (F.col("power_fraction_of_best") >= cfg.replacement_fraction)
        & (harmonic_relation(F.col("period_days"), F.col("p1"), cfg.harmonic_order, cfg.harmonic_tolerance) == "")
    )
    out = j.groupBy(*key).agg(
        F.first("p1").alias("p1"),
        F.first("raw_alias_score").alias("raw_alias_score"),
        F.first("raw_alias_labels").alias("raw_alias_labels"),
        F.first("raw_is_alias_suspect").alias("raw_is_alias_suspect"),
        F.min(F.when(able, F.struct("rank", "period_days", "power_fraction_of_best"))).alias("r"),
    )
    swapped = F.col("r").isNotNull()
    return out.select(
        *key,
        "raw_alias_score",
        "raw_alias_labels",
        "raw_is_alias_suspect",
        swapped.alias("alias_correction_applied"),
        F.coalesce("r.period_days", "p1").alias("recommended_series_period_days"),
        F.coalesce("r.rank", F.lit(1)).alias("alias_corrected_rank"),
        F.when(swapped, "alias_corrected").when(
            F.col("raw_is_alias_suspect"),
            "alias_period_possible_true_or_artifact",
        ).otherwise("non_alias_period").alias("series_confidence_class"),
    )


def two_p_support(peaks: DataFrame, adopted: DataFrame, cfg: PeriodConfig = PeriodConfig(), by: str = "power") -> DataFrame:
    """The peak near twice the adopted period: the strongest (``power``) or first in rank (``rank``), and whether it counts (5 % of the best power)."""
    a = adopted.select("source_id", "series", F.col("recommended_series_period_days").alias("p"))
    j = peaks.join(a, ["source_id", "series"]).where(
        (F.col("rank") <= cfg.n_peaks)
        & (F.abs(F.col("period_days") - 2 * F.col("p")) / (2 * F.col("p")) <= cfg.harmonic_tolerance)
    )
    order = (-F.col("power_fraction_of_best")) if by == "power" else F.col("rank").cast("double")
    best = j.groupBy("source_id", "series").agg(
        F.min(F.struct(order.alias("o"), "rank", "period_days", "power_fraction_of_best")).alias("b")
    )
    return a.join(best, ["source_id", "series"], "left").select(
        "source_id",
        "series",
        F.col("b.period_days").alias("top_peak_2p_period_days"),
        F.col("b.rank").alias("top_peak_2p_rank"),
        F.col("b.power_fraction_of_best").alias("top_peak_2p_power_fraction"),
        F.coalesce(F.col("b.power_fraction_of_best") >= 0.05, F.lit(False)).alias("top_peak_2p_present"),
    )


def suspect(labels, status) -> tuple:
    """(alias, harmonic) predicates on the text columns of a finished row."""
    text = F.lower(F.coalesce(labels, F.lit("")))
    return text.contains("alias"), F.lower(F.coalesce(status, F.lit(""))).contains("2p")
