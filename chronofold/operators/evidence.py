"""Held-out models of a fold, and evidence that a dip repeats.

Points carry ``turn`` (periods since the source's first time), ``section`` and, joined
from the source's profile, ``dip_phase`` and ``dip_duty_cycle``. Fits are sums: each
third of a source's points adds up its own products, and the sums of the other two
thirds are solved in columns. Dips are judged by aggregates of cycles, nights,
sections and bins, one grouping each, that meet in one row a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.functions.columns import bin_of, clip01, median

TAU = 2 * 3.141592653589793
FOLDS, LEAST_POINTS = 3, 24
#: Bounds of a dip's width in phase; a dip this wide may leave no baseline in its own cycle; a cycle supports a dip from this contrast on.
NARROWEST, WIDEST, BROAD, CONTRAST = 0.02, 0.65, 0.40, 1.5


def by_source():
    return W.partitionBy("source_id")


def dip_width() -> Column:
    return F.least(F.greatest(F.coalesce("dip_duty_cycle", F.lit(0.1)), F.lit(NARROWEST)), F.lit(WIDEST))


def from_dip(points: DataFrame) -> DataFrame:
    """Adds ``ph`` and ``away``, a point's phase and its distance from the dip."""
    p = points.withColumn("ph", F.col("turn") - F.floor("turn")).withColumn("off", F.abs(F.col("ph") - F.col("dip_phase")))
    return p.withColumn("away", F.least("off", 1 - F.col("off"))).drop("off")


def solved(sums: DataFrame, name: str, m: int, keys: list[str]) -> DataFrame:
    """``keys`` and ``name``, the solution of the m normal equations in columns {name}_i_j (upper half) and {name}_i_y, by elimination; a column that the others already span gets 0."""
    cell = lambda i, j: f"{name}_{min(i, j)}_{max(i, j)}" if j < m else f"{name}_{i}_y"
    rows = sums.select(*keys, *[F.col(cell(i, j)).alias(f"m_{i}_{j}") for i in range(m) for j in range(m + 1)], *[F.col(cell(i, i)).alias(f"own_{i}") for i in range(m)])
    for p in range(m):
        pivot = F.when(F.col(f"m_{p}_{p}") > 1e-10 * F.col(f"own_{p}"), F.col(f"m_{p}_{p}"))
        share = lambda j: F.coalesce(F.col(f"m_{p}_{j}") / pivot, F.lit(0.0))  # noqa: E731, B023
        rows = rows.select(
            *keys, *[f"own_{i}" for i in range(m)],
            *[(share(j) if i == p else F.col(f"m_{i}_{j}") - F.col(f"m_{i}_{p}") * share(j)).alias(f"m_{i}_{j}") for i in range(m) for j in range(p + 1, m + 1)],
        )
    return rows.select(*keys, F.array(*[F.col(f"m_{i}_{m}") for i in range(m)]).alias(name))


def wave_or_dip(points: DataFrame) -> DataFrame:
    """(source_id, wave_model_score, dimming_model_score, wave_dimming_score_margin): errors on the third of the points that a fit did not see, of a wave with two harmonics and of a dip on a level, both charged for their size."""
    p = from_dip(points.where("turn is not null"))
    p = p.withColumn("n", F.count(F.lit(1)).over(by_source())).where(F.col("n") >= LEAST_POINTS)
    p = p.withColumn("third", (F.row_number().over(by_source().orderBy("time", "row_id")) - 1) % FOLDS).withColumn("y", F.col("mag") - median(F.col("mag")).over(by_source()))
    x, d = TAU * F.col("ph"), F.col("away") / F.greatest(dip_width() / 2.355, F.lit(1 / 64))
    shapes = {
        "wave": [F.lit(1.0), F.sin(x), F.cos(x), F.sin(2 * x), F.cos(2 * x)],
        "dip": [F.lit(1.0), F.exp(-d * d / 2), F.exp(-d * d / 8)],
    }
    p = p.select("source_id", "third", "n", "y", F.greatest("err", F.lit(1e-6)).alias("e"), *[c.alias(f"{k}{i}") for k, cs in shapes.items() for i, c in enumerate(cs)])
    products = {}
    for k, cs in shapes.items():
        for i in range(len(cs)):
            products |= {f"{k}_{i}_{j}": F.col(f"{k}{i}") * F.col(f"{k}{j}") for j in range(i, len(cs))} | {f"{k}_{i}_y": F.col(f"{k}{i}") * F.col("y")}
    # Both readers of the points ask for the same columns (``e`` too), and solutions are joined by source alone: the points are dealt once and stay where they are.
    third = p.groupBy("source_id", "third").agg(F.max("e").alias("most"), *[F.sum(c).alias(n) for n, c in products.items()]).where("most > 0")
    others = third.select("source_id", "third", *[(F.sum(n).over(by_source()) - F.col(n)).alias(n) for n in products])
    waves = solved(others, "wave", len(shapes["wave"]), ["source_id", "third", *[n for n in products if n.startswith("dip")]])
    fits = solved(waves, "dip", len(shapes["dip"]), ["source_id", "third", "wave"])
    fits = fits.groupBy("source_id").agg(*[F.map_from_entries(F.collect_list(F.struct("third", k))).alias(k) for k in shapes])
    p = p.join(fits, "source_id")
    for k, cs in shapes.items():
        fit = sum((F.col(f"{k}{i}") * F.col(k)[F.col("third")][i] for i in range(len(cs))), F.lit(0.0))
        p = p.withColumn(f"{k}_missed", F.abs(F.col("y") - fit) / F.col("e")).drop(k)
    missed = p.groupBy("source_id", "third").agg(F.first("n").alias("n"), *[median(F.col(f"{k}_missed")).alias(k) for k in shapes])
    cost = lambda k: median(F.col(k)) + len(shapes[k]) * F.log(F.first("n")) / F.first("n")
    scores = missed.groupBy("source_id").agg(*[(1 / (1 + F.greatest(cost(k), F.lit(0.0)))).alias(f"{n}_model_score") for k, n in (("wave", "wave"), ("dip", "dimming"))])
    return scores.withColumn("wave_dimming_score_margin", F.col("dimming_model_score") - F.col("wave_model_score"))


# The components of the evidence, in order.
COMPONENTS = ("folded_significance", "phase_concentration", "cycle_support", "cycle_fraction", "night_support", "section_support", "local_contrast", "outside_stability", "coverage", "point_quality")


def dip_evidence(points: DataFrame, shapes: DataFrame, bins: int = 64) -> DataFrame:
    """One row per source with a period, eight points and two of them in its dip: counts of what repeats, its coverage, and the score.

    ``shapes`` is (source_id, dip_significance, out_of_dip_variation, alias); a dip in a
    cycle is held against the rest of that cycle, or if it is broad and fills it, against
    the curve's level outside dips.
    """
    p = from_dip(points.where("turn is not null and err > 0")).withColumn("width", dip_width()).withColumn("inside", F.col("away") <= F.col("width") / 2)
    count = lambda c: F.count_if(c).over(by_source())
    p = p.withColumn("n", F.count(F.lit(1)).over(by_source())).withColumn("n_inside", count("inside")).where("n >= 8 and n_inside >= 2")
    span = (F.percentile("mag", F.lit(0.84)).over(by_source()) - F.percentile("mag", F.lit(0.16)).over(by_source())) / 2
    rest = F.when(~F.col("inside"), F.col("mag"))
    p = p.withColumn("typical", median(F.col("err")).over(by_source())).withColumn("scale", F.greatest(span, F.col("typical"), F.lit(1e-6)))
    p = p.withColumn("level", F.coalesce(median(rest).over(by_source()), median(F.col("mag")).over(by_source()))).withColumn("cycle", F.floor("turn"))
    p = p.withColumn("base", F.coalesce(median(rest).over(W.partitionBy("source_id", "cycle")), F.when(F.col("width") >= BROAD, F.col("level"))))
    # Always so: with it all readers of the points ask for the same columns, so that the points are dealt once for all of them.
    p = p.where("scale > 0 and section >= 0")
    p = p.withColumn("bin", bin_of(F.col("ph"), bins)).withColumn("octant", bin_of(F.col("ph"), 8)).withColumn("night", F.floor("time"))

    dipped = F.col("inside") & F.col("base").isNotNull()
    cycles = p.where(dipped).groupBy("source_id", "cycle").agg(
        (median(F.col("mag")) - F.first("base")).alias("depth"),
        F.greatest(F.first("scale") / F.sqrt(F.count(F.lit(1))), median(F.col("err")), F.lit(1e-9)).alias("error"),
    ).withColumn("contrast", F.col("depth") / F.col("error")).withColumn("good", (F.col("contrast") >= CONTRAST) & (F.col("depth") > 0))
    wide = F.when(F.count(F.lit(1)) >= 8, (F.percentile("contrast", F.lit(0.84)) - F.percentile("contrast", F.lit(0.16))) / 2)
    centred = cycles.withColumn("dev", F.abs(F.col("contrast") - median(F.col("contrast")).over(by_source())))
    by_cycle = centred.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("covered"), F.count_if("good").alias("supporting"), median(F.col("contrast")).alias("contrast"),
        F.when(F.count(F.lit(1)) >= 3, F.coalesce(wide, 1.4826 * median(F.col("dev")))).alias("contrast_spread"),
    )
    supported = p.where(dipped & (F.col("mag") > F.col("base"))).join(cycles.where("good").select("source_id", "cycle"), ["source_id", "cycle"], "left_semi").select("source_id", "section", "night", F.lit(1).alias("supports"))
    # Sections of the supporting points, or of all points inside where none supports.
    every = p.where("inside").select("source_id", "section", "night", F.lit(0).alias("supports")).unionByName(supported)
    per = every.groupBy("source_id", "supports", "section").agg(F.count(F.lit(1)).alias("n"), F.collect_set("night").alias("nights"))
    per = per.groupBy("source_id", "supports").agg((F.max("n") / F.sum("n")).alias("alone"), F.count(F.lit(1)).alias("sections"), F.size(F.array_distinct(F.flatten(F.collect_list("nights")))).alias("nights"))
    by_section = per.groupBy("source_id").agg(
        F.max_by("alone", "supports").alias("alone"),
        *[F.coalesce(F.max(F.when(F.col("supports") == 1, F.col(c))), F.lit(0)).alias(c) for c in ("sections", "nights")],
    )
    faint = F.col("mag") > F.col("level") + F.col("scale") / 2
    by_point = p.groupBy("source_id").agg(
        F.first("width").alias("width"),
        F.countDistinct("bin").alias("seen_bins"), F.countDistinct(F.when(~F.col("inside"), F.col("bin"))).alias("rest_bins"),
        F.avg(F.when(F.col("inside"), (F.col("err") <= 2 * F.greatest("typical", F.lit(1e-9))).cast("double"))).alias("quality"),
        F.avg(F.when(faint, F.col("inside").cast("double"))).alias("gathered"),
    )
    j = by_point.join(by_section, "source_id").join(by_cycle, "source_id", "left").join(dependence(p), "source_id").join(shapes, "source_id")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    for c in ("covered", "supporting", "contrast", "sections", "nights", "gathered", "dip_significance"):
        j = j.withColumn(c, zero(c))
    near = F.least(F.lit(1.0), F.col("seen_bins") / F.greatest(F.lit(1.0), F.ceil(F.least(F.lit(1.0), 3 * F.col("width")) * bins)))
    far = F.least(F.lit(1.0), F.col("rest_bins") / F.greatest(F.lit(1.0), bins - F.greatest(F.lit(1.0), F.ceil(F.col("width") * bins))))
    j = j.withColumn("near", near).withColumn("far", far).withColumn("fraction", F.coalesce(F.try_divide("supporting", "covered"), F.lit(0.0)))
    parts = [
        F.col("dip_significance") / 12,
        (F.col("gathered") - F.col("width")) / F.greatest(1 - F.col("width"), F.lit(1e-9)),
        F.col("supporting") / 3,
        F.col("fraction"),
        F.col("nights") / 3,
        F.col("sections") / 2,
        F.col("contrast") / 5,
        1 - F.coalesce("out_of_dip_variation", F.lit(1.0)) / 1.2,
        (F.col("near") + F.col("far")) / 2,
        F.col("quality"),
    ]
    season = clip01(0.55 * F.col("phase_time_section_dependence") + 0.45 * F.greatest(F.lit(0.0), F.col("alone") - 0.5) / 0.5)
    component = lambda name: f"coherent_dimming_{name}_component"
    for name, c in [*zip(COMPONENTS, map(clip01, parts)), ("seasonal_penalty", season), ("alias_penalty", F.when(F.col("alias"), 0.20).otherwise(0.0))]:
        j = j.withColumn(component(name), c)
    score = sum((F.col(component(c)) for c in COMPONENTS), F.lit(0.0)) / len(COMPONENTS) - 0.35 * F.col(component("seasonal_penalty")) - F.col(component("alias_penalty"))
    return j.select(
        "source_id",
        F.col("supporting").alias("dip_supporting_cycles"),
        F.col("covered").alias("dip_covered_cycles"),
        F.col("fraction").alias("dip_cycle_support_fraction"),
        F.col("nights").alias("dip_independent_nights"),
        F.col("sections").alias("dip_supporting_time_sections"),
        "phase_time_section_dependence",
        F.col("alone").alias("dip_section_concentration"),
        F.col("alone").alias("dip_single_section_fraction"),
        F.col("near").alias("phase_coverage_near_dip"),
        F.col("far").alias("phase_coverage_outside_dip"),
        F.col("contrast").alias("dip_local_contrast_sigma"),
        F.coalesce(F.col("contrast_spread") / F.greatest(F.abs("contrast"), F.lit(1e-9)), F.lit(0.0)).alias("dip_cycle_contrast_scatter"),
        F.col("quality").alias("dip_point_quality_fraction"),
        *[component(c) for c in (*COMPONENTS, "seasonal_penalty", "alias_penalty")],
        clip01(score).alias("coherent_dimming_score"),
    )


def dependence(points: DataFrame) -> DataFrame:
    """(source_id, phase_time_section_dependence): mutual information of phase octant and section over the octant's entropy."""
    cells = points.groupBy("source_id", "octant", "section").agg(F.count(F.lit(1)).alias("k"))
    among = lambda *more: F.sum("k").over(W.partitionBy("source_id", *more))
    c = cells.withColumn("n", among()).withColumn("of_octant", among("octant") / F.col("n")).withColumn("of_section", among("section") / F.col("n")).withColumn("j", F.col("k") / F.col("n"))
    out = c.groupBy("source_id").agg(F.sum(F.col("j") * F.log(F.col("j") / (F.col("of_octant") * F.col("of_section")))).alias("mi"), (-F.sum(F.col("j") * F.log("of_octant"))).alias("h"))
    return out.select("source_id", clip01(F.col("mi") / F.greatest("h", F.lit(1e-9))).alias("phase_time_section_dependence"))


def cycles_with_dip(points: DataFrame) -> DataFrame:
    """(source_id, cycles_with_dip): distinct cycles with a point in the dip; of the deep ones alone if there are three."""
    p = from_dip(points.where("turn is not null")).withColumn("m", median(F.col("mag")).over(by_source())).withColumn("n", F.count(F.lit(1)).over(by_source()))
    p = p.withColumn("dev", F.abs(F.col("mag") - F.col("m")))
    wide = (F.percentile("mag", F.lit(0.84)).over(by_source()) - F.percentile("mag", F.lit(0.16)).over(by_source())) / 2
    p = p.withColumn("scale", F.greatest(F.when(F.col("n") >= 8, wide).otherwise(1.4826 * median(F.col("dev")).over(by_source())), F.lit(1e-9)))
    inside = F.col("away") <= F.greatest(F.coalesce("dip_duty_cycle", F.lit(0.1)) / 2, F.lit(1 / 64))
    p = p.withColumn("cycle", F.floor("turn")).withColumn("inside", inside).withColumn("deep", inside & (F.col("mag") > F.col("m") + F.col("scale") / 2))
    of = lambda c: F.countDistinct(F.when(F.col(c), F.col("cycle")))
    return p.groupBy("source_id").agg(F.when(F.count_if("deep") >= 3, of("deep")).otherwise(of("inside")).cast("double").alias("cycles_with_dip"))
