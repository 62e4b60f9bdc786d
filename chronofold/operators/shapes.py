"""What a folded profile looks like, and how folds of one source compare.

All of it is array expressions over one row a profile: no row meets another, so there
is no exchange beyond that of the folds. Larger values are fainter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.functions import circles as C
from chronofold.functions.columns import let
from chronofold.operators import folds as O

TAU = 2 * 3.141592653589793
HARMONICS = (1, 2, 3, 4)
LEAST = 1e-9


def mirror_symmetry(v: Column, noise: Column, n: int) -> Column:
    """The largest share of the significant harmonics' power that is even about one of 4n axes; null without such harmonics."""

    def of(s):
        waves = F.array(*[F.struct(F.lit(h).alias("h"), *[x.alias(c) for c, x in zip("ab", C.harmonic(s["v"], h, n))]) for h in HARMONICS])
        least = 3 * s["noise"] * (2 / n) ** 0.5
        return let(F.filter(waves, lambda w: F.sqrt(w["a"] * w["a"] + w["b"] * w["b"]) >= least), share)

    def share(ws):
        def even(axis):
            angle = F.lit(TAU / (4 * n)) * axis
            part = lambda w: w["a"] * F.cos(w["h"] * angle) + w["b"] * F.sin(w["h"] * angle)
            return C.total(F.transform(ws, lambda w: part(w) * part(w)))

        power = C.total(F.transform(ws, lambda w: w["a"] * w["a"] + w["b"] * w["b"]))
        return F.when(F.size(ws) > 0, F.array_max(F.transform(F.sequence(F.lit(0), F.lit(4 * n - 1)), even)) / power)

    return let(F.struct(v.alias("v"), noise.alias("noise")), of)


def prominent(v: Column, noise: Column, n: int) -> Column:
    """How many separate maxima of the five-bin mean stand out: over a third of the highest bin, and over four times the noise."""

    def smooth(s):
        top = F.array_max(F.transform(s["x"], F.abs))
        near = lambda i: F.sequence(i - 2, i + 2)
        means = F.transform(s["x"], lambda _, i: C.total(F.transform(near(i), lambda j: F.get(s["x"], F.pmod(j, F.lit(n))))) / 5)
        return let(F.struct(means.alias("m"), top.alias("top"), F.greatest(F.lit(0.35), 4 * s["noise"]).alias("least")), count)

    def count(s):
        at = lambda i: F.get(s["m"], F.pmod(i, F.lit(n)))

        def peak(x, i):
            return (x >= at(i - 1)) & (x >= at(i + 1)) & (x > at(i - 2)) & (x > at(i + 2)) & (x / s["top"] >= s["least"])

        return F.when(s["top"] > 1e-12, F.size(F.filter(F.transform(s["m"], peak), lambda p: p)).cast("double")).otherwise(0.0)

    return let(F.struct(C.central(v).alias("x"), noise.alias("noise")), smooth)


def alignment(v: Column, n: int) -> Column:
    """The place of the faintest credible bin: its own value counts four fifths, the mean of it and its neighbours the rest."""
    at = lambda s, i: F.get(s, F.pmod(i, F.lit(n)))
    return let(v, lambda s: C.first_max(F.transform(s, lambda x, i: 0.8 * x + 0.2 * (at(s, i - 1) + x + at(s, i + 1)) / 3)))


def skewness(v: Column) -> Column:
    """Bias-corrected skewness."""

    def of(s):
        moment = lambda k: C.mean(F.transform(s["d"], lambda x: F.pow(x, F.lit(float(k)))))
        m = F.size(s["d"]).cast("double")
        return F.sqrt(m * (m - 1)) / (m - 2) * moment(3) / F.pow(moment(2), F.lit(1.5))

    return let(F.struct(let(v, lambda x: C.less(x, C.mean(x))).alias("d")), of)


def shape(rows: DataFrame, n: int = 64) -> DataFrame:
    """``rows`` (norm, amplitude, bin_sigma, ...) with the numbers of the normalised profile; null for a flat one."""
    keep = rows.columns
    varied = F.array_max("norm") > F.array_min("norm")
    r = rows.withColumn("v", F.when(varied, F.col("norm")))
    amp, sigma = F.coalesce("amplitude", F.lit(0.0)), F.greatest(F.coalesce("bin_sigma", F.lit(0.0)), F.lit(LEAST))
    r = r.withColumn("noise", sigma / F.greatest(F.abs(amp), F.lit(LEAST))).withColumn("m", C.middle(F.col("v")))
    r = r.withColumn("dip_depth_norm", C.quantile(F.col("v"), 0.98) - F.col("m")).withColumn("flare_depth_norm", F.col("m") - C.quantile(F.col("v"), 0.02))
    wide = lambda sign, depth: C.longest_run(let(F.struct("v", "m", F.greatest(F.col(depth) / 2, F.lit(1e-12)).alias("d")), lambda s: F.transform(s["v"], lambda x: sign * (x - s["m"]) >= s["d"])), n)
    r = r.withColumn("dip_width", wide(1, "dip_depth_norm")).withColumn("flare_width", wide(-1, "flare_depth_norm"))
    r = r.withColumn("faintest", C.first_max(F.col("v"))).withColumn("brightest", C.first_max(F.transform("v", lambda x: -x)))

    def outside(at: str, width: str) -> Column:
        """Bins away from an extreme, null near it."""
        reach = F.least(F.greatest(F.lit(2), 2 * F.col(width) + 1), F.lit(max(2, n // 5)))
        return let(F.struct("v", F.col(at).alias("at"), reach.alias("reach")), lambda s: F.transform(s["v"], lambda x, i: F.when(C.around(i, s["at"], n) > s["reach"], x)))

    r = r.withColumn("off_dip", outside("faintest", "dip_width")).withColumn("off_flare", outside("brightest", "flare_width"))
    flat = lambda off, depth: F.when((F.size(C.known(F.col(off))) >= 8) & (F.col(depth) > LEAST), C.span(F.col(off), 0.10, 0.90) / F.col(depth))
    r = r.withColumn("second", C.first_max(F.col("off_dip"))).withColumn("apart", C.around(F.col("second"), F.col("faintest"), n) / float(n))
    for h in HARMONICS:
        a, b = C.harmonic(F.col("v"), h, n)
        r = r.withColumn(f"a{h}", a).withColumn(f"b{h}", b)
    size = lambda h: F.sqrt(F.col(f"a{h}") * F.col(f"a{h}") + F.col(f"b{h}") * F.col(f"b{h}"))
    angle = lambda h: F.atan2(F.col(f"b{h}"), F.col(f"a{h}"))
    power = lambda hs: sum((size(h) * size(h) for h in hs), F.lit(0.0))
    wave = let(F.struct("v", "a1", "b1"), lambda s: F.transform(s["v"], lambda x, i: x - s["a1"] * F.cos(F.lit(TAU / n) * i) - s["b1"] * F.sin(F.lit(TAU / n) * i)))
    wrapped = lambda d: d + TAU / 2 - F.floor((d + TAU / 2) / TAU) * TAU - TAU / 2
    ok = F.col("v").isNotNull()
    some = F.exists("off_dip", lambda x: x.isNotNull())
    numbers = {
        "dip_depth_norm": F.col("dip_depth_norm"),
        "flare_depth_norm": F.col("flare_depth_norm"),
        "dip_duty_cycle": F.col("dip_width") / float(n),
        "dip_width_bins": F.col("dip_width").cast("double"),
        "secondary_dip_depth_norm": F.when(some, F.get("off_dip", "second") - F.col("m")).otherwise(0.0),
        "secondary_dip_phase_separation": F.when(some, F.col("apart")).otherwise(0.0),
        "out_of_dip_variation": flat("off_dip", "dip_depth_norm"),
        "out_of_flare_variation": flat("off_flare", "flare_depth_norm"),
        "flare_dominance": F.col("flare_depth_norm") / F.greatest("dip_depth_norm", F.lit(LEAST)),
        "flare_duty_cycle": F.col("flare_width") / float(n),
        "dip_dominance": F.col("dip_depth_norm") / F.greatest("flare_depth_norm", F.lit(LEAST)),
        "dip_significance": F.col("dip_depth_norm") * amp / sigma,
        "mirror_symmetry": mirror_symmetry(F.col("v"), F.col("noise"), n),
        "profile_peak_count": prominent(F.col("v"), F.col("noise"), n),
        "sinusoid_residual_ratio": C.mad(wave) / F.greatest(C.mad(F.col("v")), F.lit(LEAST)),
        "harmonic_energy_ratio": power(HARMONICS[1:]) / F.greatest(power(HARMONICS), F.lit(1e-12)),
        "skewness": skewness(F.col("v")),
        **{f"fourier_h{h}_amplitude": size(h) for h in HARMONICS},
        **{f"fourier_R{h}1": size(h) / F.greatest(size(1), F.lit(1e-12)) for h in HARMONICS[1:]},
        **{f"fourier_phi{h}1": wrapped(angle(h) - h * angle(1)) for h in HARMONICS[1:]},
    }
    turn = F.coalesce(F.when(ok, alignment(F.col("v"), n)), F.lit(0))
    r = r.withColumn("turn_bins", turn).withColumn("dip_bin", F.coalesce("faintest", F.lit(0)))
    return r.select(
        *keep, *[F.when(ok, c).alias(k) for k, c in numbers.items()],
        F.col("turn_bins").cast("double").alias("profile_align_shift_bins"), (F.col("dip_bin") / float(n)).alias("dip_phase"),
        C.rolled(F.col("norm"), -F.col("turn_bins"), n).alias("turned"),
    )


def by_fold(both: DataFrame) -> DataFrame:
    """One row a source: structs ``whole``, ``half`` and ``double`` of ``folds.combined``, and its sections' structs in order."""
    fields = ["amplitude", "norm", "value", "chi2", "snr", "coverage", "points", "folded", "sigma", "typical", "median_error", "scatter_over_error", "over_scatter", "c_weight", "o_weight", "c_chi2", "o_chi2", "c_norm", "o_norm"]
    one = lambda name: F.max(F.when(F.col("fold") == name, F.struct(*fields))).alias(name)
    parts = F.sort_array(F.collect_list(F.when(F.col("fold").startswith(O.SECTION), F.struct(F.substring("fold", len(O.SECTION) + 1, 3).cast("int").alias("section"), "amplitude", "norm", "value"))))
    return both.groupBy("source_id").agg(one(O.WHOLE), one(O.HALF), one(O.DOUBLE), parts.alias("sections"))


def period_alternatives(sources: DataFrame, n: int = 64) -> DataFrame:
    """``sources`` (of ``by_fold``, with recommended_period_days) with the distances of the folds at half and twice the period, and how far the halves of the latter differ at their faintest."""
    near = lambda name: F.when(C.any_nonzero(F.col("whole.norm")) & C.any_nonzero(F.col(f"{name}.norm")), C.best_shift(F.col("whole.norm"), F.col(f"{name}.norm"), n)["distance"])
    part = lambda start: F.array_max(F.slice("double.norm", start, n // 2))
    return (
        sources.withColumn("half_period_profile_distance", near("half"))
        .withColumn("double_period_profile_distance", near("double"))
        .withColumn("double_period_odd_even_difference", F.when(F.col("recommended_period_days") > 0, F.coalesce(F.abs(part(1) - part(n // 2 + 1)), F.lit(0.0))))
    )


def section_evolution(sources: DataFrame, sections: int = 4) -> DataFrame:
    """``sources`` with the changes of the fold between sections: likeness to the whole, largest distance of two, range of amplitudes, and a score of the three."""
    s = sources.withColumn("likes", let(F.struct("sections", F.col("whole.norm").alias("w")), lambda t: F.transform(t["sections"], lambda p: F.struct(p["section"].alias("section"), C.correlation(p["norm"], t["w"]).alias("like")))))
    seen = F.filter(F.transform("likes", lambda x: x["like"]), lambda x: x.isNotNull())
    grown = F.filter(F.transform("sections", lambda p: p["amplitude"]), lambda a: a > 0)
    shaped = F.filter(F.transform("sections", lambda p: p["norm"]), C.any_nonzero)
    apart = let(shaped, lambda v: F.array_max(F.flatten(F.transform(v, lambda a: F.transform(v, lambda b: C.rms(a, b))))))
    s = s.withColumn("seen", seen).withColumn("grown", grown).withColumn("maximum_section_distance", F.coalesce(apart, F.lit(0.0)))
    s = s.withColumn("minimum_section_correlation", F.array_min("seen")).withColumn("maximum_section_correlation", F.array_max("seen"))
    s = s.withColumn("sections_with_shape", F.size(F.filter("seen", lambda x: x >= 0.55)).cast("double"))
    s = s.withColumn("section_amplitude_log_range", F.when(F.size("grown") >= 2, F.log(F.array_max("grown") / F.greatest(F.array_min("grown"), F.lit(LEAST)))).otherwise(0.0))
    lost = F.greatest(F.lit(0.0), 1 - F.coalesce("minimum_section_correlation", F.lit(1.0)))
    s = s.withColumn("evolution_raw_score", F.col("maximum_section_distance") + 0.5 * lost + 0.25 * F.col("section_amplitude_log_range"))
    every = F.sequence(F.lit(0), F.lit(sections - 1))
    found = lambda rows, name: let(F.col(rows), lambda r: F.transform(every, lambda k: F.get(F.transform(F.filter(r, lambda p: p["section"] == k), lambda p: p[name]), F.lit(0))))
    return s.withColumn("section_amplitudes", found("sections", "amplitude")).withColumn("section_correlations", found("likes", "like")).withColumn("section_levels", F.transform(F.transform("sections", lambda p: p["value"]), C.middle)).drop("seen", "grown", "likes")
