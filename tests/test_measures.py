"""Features of light curves against plain, loop-by-loop formulas, and the staged run's families on made stars."""

import math
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.operators import classify as K
from chronofold.functions import circles as C
from chronofold.operators import evidence as D
from chronofold.operators import features as M
from chronofold.operators import folds as O
from chronofold.operators import measures as P
from chronofold.operators import shapes as S

def star(kind, seed=0, n=400, period=9.7, noise=0.02):
    r = np.random.default_rng(seed)
    t = np.sort(r.uniform(58000, 59000, n))
    band = np.where(np.arange(n) % 2 == 0, "c", "o")
    ph = (t - t[0]) / period % 1
    m = np.full(n, 15.0)
    near = np.minimum(np.abs(ph - 0.4), 1 - np.abs(ph - 0.4))
    if kind == "wave":
        m += 0.25 * np.sin(2 * np.pi * ph)
    elif kind == "dip":
        m += 0.6 * np.exp(-0.5 * (near / 0.035) ** 2)
    elif kind == "evolving":
        m += np.where(t < 58500, 0.3, 0.15) * np.sin(2 * np.pi * (ph + 0.5 * (t >= 58500)))
    m += r.normal(0, noise, n)
    if kind == "flare":
        for k in range(6):
            at = 58100.3 + 140 * k
            far = np.argsort(np.abs(t - at))[:3]
            t[far] = at + np.array([0.0, 0.02, 0.04])
            m[far] -= 0.7
    by = np.argsort(t, kind="stable")
    return t[by], m[by], np.full(n, noise), band[by], period


SCHEMA = "source_id string, row_id long, time double, mag double, err double, filter string, period double, period_flags string"
#: name: kind of star, seed, points, noise, factor of the period, flags
STARS = {
    **{k: (k, 0, 400, 0.02, 1, "") for k in ("wave", "dip", "none", "flare", "evolving")},
    "loud": ("dip", 0, 400, 0.03, 1, ""),
    "bright": ("flare", 0, 400, 0.01, 1, ""),
    "doubled": ("wave", 0, 400, 0.02, 2, "alias_warning"),
    "sparse": ("dip", 5, 70, 0.02, 1, ""),
    "few": ("wave", 6, 26, 0.02, 1, ""),
}


@pytest.fixture(scope="module")
def stars():
    """Points of each star: arrays of time, magnitude, error, band, and the period."""
    out = {}
    for name, (kind, seed, n, noise, factor, _) in STARS.items():
        t, m, e, b, p = star(kind, seed, n, noise=noise)
        out[name] = (t, m, e, b, p * factor)
    return out


@pytest.fixture(scope="module")
def points(spark, stars):
    rows = [(name, i, *map(float, x), str(f), float(p), STARS[name][5]) for name, (t, m, e, b, p) in stars.items() for i, (*x, f) in enumerate(zip(t, m, e, b))]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def features(points):
    return {r["source_id"]: r for r in P.source_features(points).collect()}


@pytest.fixture(scope="module")
def bands(points):
    """Arrays of each source, fold and band."""
    out = O.profiles(O.in_sections(O.usable(points), 4)).cache()
    return out


@pytest.fixture(scope="module")
def whole(bands):
    """Combined profiles by source and fold."""
    return {(r["source_id"], r["fold"]): r for r in O.combined(bands).collect()}


def quantile(x, q):
    x = sorted(x)
    at = q * (len(x) - 1)
    low = int(at)
    return x[low] + (at - low) * (x[min(low + 1, len(x) - 1)] - x[low])


def plain_spread(x):
    if len(x) < 8:
        return 1.4826 * median(abs(v - median(x)) for v in x) if len(x) else math.nan
    return (quantile(x, 0.84) - quantile(x, 0.16)) / 2


def plain_fill(value):
    n, at = len(value), [k for k, v in enumerate(value) if not math.isnan(v)]
    xs = [k + turn * n for turn in (-1, 0, 1) for k in at]
    return list(np.interp(range(n), xs, [value[k % n] for k in xs])) if at else [0.0] * n


def plain_fold(t, m, e, period, origin, bins=64):
    """value, sigma, chi2, snr, amplitude of one band, bin by bin."""
    centre = median(m)
    rows = [(a, b - centre, c) for a, b, c in zip(t, m, e)]
    limit = plain_spread([r[1] for r in rows])
    near = [r for r in rows if abs(r[1]) <= 6 * limit]
    rows = near if len(near) >= max(20, len(rows) // 2) else rows
    scatter = plain_spread([r[1] for r in rows])
    held = [[] for _ in range(bins)]
    for a, x, c in rows:
        held[min(int(((a - origin) / period % 1) * bins), bins - 1)].append((x, c))
    value, sigma = [math.nan] * bins, [scatter] * bins
    for k, h in enumerate(held):
        if h:
            xs = [x for x, _ in h]
            value[k] = median(xs)
            s = plain_spread(xs) if len(xs) > 3 else 0
            s = s if s > 0 else median([c for _, c in h])
            floor = scatter / math.sqrt(len(xs))
            sigma[k] = max(s / math.sqrt(len(xs)) or floor, floor / 2)
    filled = plain_fill(value)
    mid = median(filled)
    filled = [v - mid for v in filled]
    used = [k for k in range(bins) if held[k]]
    amp = quantile(filled, 0.95) - quantile(filled, 0.05)
    return filled, sigma, sum((filled[k] / sigma[k]) ** 2 for k in used) / len(used), amp / median(sigma[k] for k in used), amp


def test_folds_match_plain_ones(bands, stars):
    got = {(r["source_id"], r["fold"], r["filter"]): r for r in bands.collect()}
    for name in ("wave", "dip", "none", "sparse", "few"):
        t, m, e, b, p = stars[name]
        section = np.empty(len(t), int)
        section[np.argsort(t, kind="stable")] = np.repeat(range(4), [len(x) for x in np.array_split(np.arange(len(t)), 4)])
        for band in "co":
            for fold, factor in (("whole", 1), ("half", 0.5), ("double", 2), ("section2", 1)):
                own = (b == band) & ((section == 2) | (fold != "section2"))
                if own.sum() < 3:
                    assert (name, fold, band) not in got
                    continue
                value, sigma, chi2, snr, amp = plain_fold(t[own], m[own], e[own], p * factor, t[0])
                r = got[name, fold, band]
                assert np.allclose(r["value"], value) and np.allclose(r["sigma"], sigma) and r["amplitude"] == pytest.approx(amp)
                if sum(k > 0 for k in r["n"]) >= 8:
                    assert (r["chi2"], r["snr"]) == pytest.approx((chi2, snr))
                else:
                    assert r["chi2"] is None and r["snr"] is None
    assert len(got["flare", "whole", "c"]["value"]) == 64


def plain_shift(a, b):
    """(distance, shift) by all rolls."""
    return min((math.sqrt(np.mean((np.roll(b, k) - a) ** 2)), k) for k in range(len(a)))


def test_bands_are_combined_at_the_best_shift(bands, whole):
    got = {(r["source_id"], r["fold"], r["filter"]): r for r in bands.collect()}
    for (name, fold), r in whole.items():
        parts = [got.get((name, fold, f)) for f in "co"]
        if None in parts:
            one = parts[0] or parts[1]
            assert r["value"] == one["value"] and (r["c_weight"], r["o_weight"]) == (float(parts[0] is not None), float(parts[1] is not None))
            continue
        w = np.array([max(p["chi2"] or 0, 0.1) * math.sqrt(p["points"]) for p in parts])
        w /= w.sum()
        c, o = (np.array(p["norm"]) for p in parts)
        shift = 0 if fold.startswith("section") else plain_shift(c, o)[1]
        value = w[0] * np.array(parts[0]["value"]) + w[1] * np.roll(parts[1]["value"], shift)
        sigma = np.hypot(w[0] * np.array(parts[0]["sigma"]), w[1] * np.roll(parts[1]["sigma"], shift))
        assert r["shift"] == shift and (r["c_weight"], r["o_weight"]) == pytest.approx(tuple(w))
        assert np.allclose(r["value"], value - np.median(value)) and np.allclose(r["sigma"], sigma)
        assert r["chi2"] == pytest.approx(np.mean((np.array(r["value"]) / r["sigma"]) ** 2))


def test_folds_of_a_source_are_compared(features, whole):
    for name in STARS:
        f, norm = features[name], np.array(whole[name, "whole"]["norm"])
        for fold, column in (("half", "half_period_profile_distance"), ("double", "double_period_profile_distance")):
            assert f[column] == pytest.approx(plain_shift(norm, np.array(whole[name, fold]["norm"]))[0])
        two = np.array(whole[name, "double"]["norm"])
        assert f["double_period_odd_even_difference"] == pytest.approx(abs(two[:32].max() - two[32:].max()))
        parts = [np.array(whole[name, f"section{k}"]["norm"]) for k in range(4) if (name, f"section{k}") in whole]
        likes = [np.corrcoef(p, norm)[0, 1] for p in parts]
        assert (f["minimum_section_correlation"], f["maximum_section_correlation"]) == pytest.approx((min(likes), max(likes)))
        assert f["maximum_section_distance"] == pytest.approx(max(math.sqrt(np.mean((a - b) ** 2)) for a in parts for b in parts))
        sizes = [whole[name, f"section{k}"]["amplitude"] for k in range(4)]
        assert f["section_amplitude_log_range"] == pytest.approx(math.log(max(sizes) / min(sizes)))


def plain_shape(v, amp, sigma):
    """A few of the numbers, by plain formulas."""
    n, m, out = len(v), np.median(v), {}
    noise, x = sigma / amp, 2 * np.pi * np.arange(n) / n
    z = [2 / n * (np.sum(v * np.cos(h * x)) + 1j * np.sum(v * np.sin(h * x))) for h in (1, 2, 3, 4)]
    real = [(h, a) for h, a in zip((1, 2, 3, 4), z) if abs(a) >= 3 * noise * math.sqrt(2 / n)]
    even = [sum((a * np.exp(-1j * h * k * 2 * np.pi / (4 * n))).real ** 2 for h, a in real) for k in range(4 * n)]
    out["mirror_symmetry"] = max(even) / sum(abs(a) ** 2 for _, a in real) if real else None
    s = np.array([np.mean([(v - m)[(i + k) % n] for k in range(-2, 3)]) for i in range(n)]) / max(abs(v - m))
    out["profile_peak_count"] = sum(s[i] >= max(s[i - 1], s[(i + 1) % n], 0.35, 4 * noise) and s[i] > max(s[i - 2], s[(i + 2) % n]) for i in range(n))
    lean = [0.8 * v[i] + 0.2 * (v[i - 1] + v[i] + v[(i + 1) % n]) / 3 for i in range(n)]
    out["profile_align_shift_bins"] = int(np.argmax(lean))
    dip = np.percentile(v, 98) - m
    mask = list(v >= m + dip / 2) * 2
    runs = [0]
    for a in mask:
        runs.append(runs[-1] + 1 if a else 0)
    width = min(max(runs), n)
    at = int(np.argmax(v))
    off = [i for i in range(n) if min(abs(i - at), n - abs(i - at)) > min(max(2, 2 * width + 1), n // 5)]
    second = max(off, key=lambda i: (v[i], -i))
    d = v - v.mean()
    out |= {
        "dip_depth_norm": dip, "flare_depth_norm": m - np.percentile(v, 2), "dip_width_bins": width, "dip_significance": dip * amp / sigma, "dip_phase": at / n,
        "out_of_dip_variation": np.subtract(*np.percentile(v[off], (90, 10))) / dip, "secondary_dip_depth_norm": v[second] - m, "secondary_dip_phase_separation": min(abs(second - at), n - abs(second - at)) / n,
        "harmonic_energy_ratio": sum(abs(a) ** 2 for a in z[1:]) / sum(abs(a) ** 2 for a in z), "fourier_R21": abs(z[1]) / abs(z[0]), "fourier_h3_amplitude": abs(z[2]),
        "skewness": math.sqrt(n * (n - 1)) / (n - 2) * np.mean(d**3) / np.mean(d**2) ** 1.5,
        "fourier_phi31": (np.angle(z[2]) - 3 * np.angle(z[0]) + np.pi) % (2 * np.pi) - np.pi,
    }
    return out


def test_shapes_match_plain_formulas(features, whole):
    for name in STARS:
        r = whole[name, "whole"]
        for column, want in plain_shape(np.array(r["norm"]), r["amplitude"], float(np.median(r["sigma"]))).items():
            assert features[name][column] == (None if want is None else pytest.approx(want, abs=1e-9)), (name, column)


def test_held_out_models(features, stars):
    """Least squares by a library, on the two thirds that are not held out."""
    for name in STARS:
        t, m, e, _, p = stars[name]
        f, ph = features[name], (t - t[0]) / p % 1
        by = np.argsort(t, kind="stable")
        sigma = max(min(max(f["dip_duty_cycle"], 0.02), 0.65) / 2.355, 1 / 64)
        d = np.minimum(abs(ph - f["dip_phase"]), 1 - abs(ph - f["dip_phase"])) / sigma
        x, third = 2 * np.pi * ph, np.empty(len(t), int)
        third[by] = np.arange(len(t)) % 3
        one = np.ones(len(t))
        for column, design in (("wave_model_score", [one, np.sin(x), np.cos(x), np.sin(2 * x), np.cos(2 * x)]), ("dimming_model_score", [one, np.exp(-d * d / 2), np.exp(-d * d / 8)])):
            a = np.column_stack(design)
            missed = []
            for k in range(3):
                fit = np.linalg.lstsq(a[third != k], m[third != k], rcond=None)[0]
                missed.append(np.median(np.abs(m - a @ fit)[third == k] / e[third == k]))
            want = 1 / (1 + np.median(missed) + len(design) * np.log(len(t)) / len(t))
            assert f[column] == pytest.approx(want, rel=1e-6), (name, column)


def test_a_column_that_others_span_gets_nothing(spark):
    sums = spark.createDataFrame([(1, 4.0, 4.0, 8.0, 4.0, 8.0)], "k long, w_0_0 double, w_0_1 double, w_0_y double, w_1_1 double, w_1_y double")
    assert D.solved(sums, "w", 2, ["k"]).first()["w"] == [2.0, 0.0]


def evaluate(spark, values, use, kind="array<double>"):
    return spark.createDataFrame([(values,)], f"v {kind}").select(use(F.col("v")).alias("x")).first()["x"]


def test_circular_arrays(spark):
    v = [1.0, None, None, None, 3.0, None, None, None]
    assert evaluate(spark, v, lambda c: C.filled(c, 8)) == [1, 1.5, 2, 2.5, 3, 2.5, 2, 1.5] and evaluate(spark, [None] * 4, lambda c: C.filled(c, 4)) == [0.0] * 4
    r = np.random.default_rng(0)
    for _ in range(5):
        w = [None if r.random() < 0.6 else float(x) for x in r.normal(0, 1, 16)]
        assert evaluate(spark, w, lambda c: C.filled(c, 16)) == pytest.approx(plain_fill([math.nan if x is None else x for x in w]))
    for mask, want in (([1, 0, 0, 1, 1], 3), ([1] * 5, 5), ([0] * 5, 0), ([0, 1, 1, 0, 1], 2)):
        assert evaluate(spark, [bool(x) for x in mask], lambda c: C.longest_run(c, 5), "array<boolean>") == want
    a = [float(x) for x in np.sin(np.arange(16) / 16 * 2 * np.pi)]
    turned = evaluate(spark, a, lambda c: C.rolled(c, 5, 16))
    assert turned == list(np.roll(a, 5)) and evaluate(spark, a, lambda c: C.rolled(c, -3, 16)) == list(np.roll(a, -3)) and evaluate(spark, a, lambda c: C.rolled(c, 0, 16)) == a
    found = evaluate(spark, a, lambda c: C.best_shift(c, C.rolled(c, -5, 16), 16))
    assert found["shift"] == 5 and found["distance"] == pytest.approx(0)
    assert evaluate(spark, [3.0, None, 1.0, 2.0], lambda c: C.quantile(c, 0.25)) == 1.5 and evaluate(spark, [], C.middle) is None
    assert evaluate(spark, [1.0, 2.0, 9.0], C.mad) == pytest.approx(1.4826)
    assert evaluate(spark, [1.0, 2.0, 3.0, 5.0], lambda c: C.correlation(c, F.reverse(c))) == pytest.approx(np.corrcoef([1, 2, 3, 5], [5, 3, 2, 1])[0, 1])
    assert evaluate(spark, [1.0] * 6, lambda c: C.correlation(c, c)) is None and evaluate(spark, [1.0, 2.0, 3.0], lambda c: C.correlation(c, c)) is None
    assert evaluate(spark, a, lambda c: S.mirror_symmetry(c, F.lit(0.01), 16)) > 0.99


def test_power_matches_a_plain_sum(features, stars):
    t, m, _, _, _ = stars["sparse"]
    got = features["sparse"]
    y = m - np.median(m)
    powers, periods = [], np.geomspace(0.5, min(200, np.ptp(t) / 2), 3000)
    for x in periods:
        w = 2 * math.pi / x
        tau = math.atan2(sum(math.sin(2 * w * a) for a in t), sum(math.cos(2 * w * a) for a in t)) / (2 * w)
        c, s = [math.cos(w * (a - tau)) for a in t], [math.sin(w * (a - tau)) for a in t]
        yc, ys = sum(a * b for a, b in zip(y, c)), sum(a * b for a, b in zip(y, s))
        powers.append((yc**2 / sum(a * a for a in c) + ys**2 / sum(a * a for a in s)) / sum(a * a for a in y))
    k = int(np.argmax(powers))
    assert got["ls_peak_period_days"] == pytest.approx(periods[k]) and got["ls_peak_power"] == pytest.approx(powers[k], rel=1e-6)
    assert got["ls_peak_ratio"] == pytest.approx(powers[k] / median(powers), rel=1e-5)


def test_events_are_counted_as_by_hand(features):
    got = features["bright"]
    assert got["flare_event_count"] == 6 and got["dimming_event_count"] == 0 and got["flare_asymmetry"] == 1
    assert got["flare_primary_validation_pass"] == 1 and got["flare_leave_one_event_out_persistent"] == 1 and got["validated_flare_independent_nights"] == 6
    assert got["flare_duty_fraction"] == pytest.approx(18 / 400) and got["validated_flare_well_sampled_event_count"] == 6 and got["validated_flare_multi_point_fraction"] == 1
    flares = [x for x in got["events"] if x["event_type"] == "brightening"]
    assert [x["n_measurements"] for x in flares] == [3] * 6 and all(x["passes_quality_validation"] for x in flares)


def plain_dimming(t, m, e, section, period, origin, centre, width):
    phase = [(a - origin) / period % 1 for a in t]
    cycle = [math.floor((a - origin) / period) for a in t]
    inside = [min(abs(x - centre), 1 - abs(x - centre)) <= width / 2 for x in phase]
    scale = max(plain_spread(list(m)), median(e), 1e-6)
    contrasts, good, nights, parts = [], 0, set(), set()
    for k in sorted({c for c, i in zip(cycle, inside) if i}):
        dip = [j for j in range(len(t)) if cycle[j] == k and inside[j]]
        base = [m[j] for j in range(len(t)) if cycle[j] == k and not inside[j]]
        if not base:
            continue
        depth = median(m[j] for j in dip) - median(base)
        contrasts.append(depth / max(scale / math.sqrt(len(dip)), median(e[j] for j in dip)))
        if contrasts[-1] >= 1.5 and depth > 0:
            good += 1
            faint = [j for j in dip if m[j] > median(base)]
            nights |= {math.floor(t[j]) for j in faint}
            parts |= {section[j] for j in faint}
    return len(contrasts), good, len(nights), len(parts), median(contrasts)


def test_dimming_matches_a_plain_loop(spark, features, stars):
    got, (t, m, e, b, p) = features["loud"], stars["loud"]
    section = np.repeat(range(4), 100)
    want = plain_dimming(t, m, e, section, p, t[0], got["dip_phase"], min(max(got["dip_duty_cycle"], 0.02), 0.65))
    names = ("dip_covered_cycles", "dip_supporting_cycles", "dip_independent_nights", "dip_supporting_time_sections", "dip_local_contrast_sigma")
    assert tuple(got[n] for n in names) == pytest.approx(want)
    assert got["coherent_dimming_score"] > 0.5 and 0 <= got["phase_time_section_dependence"] < 0.3 and got["phase_coverage_near_dip"] > 0.9
    rows = [("s", i, *map(float, x), str(f), p) for i, (*x, f) in enumerate(zip(t, m, e, b))]
    points = spark.createDataFrame(rows, "source_id string, row_id long, time double, mag double, err double, filter string, period double")
    dip = spark.createDataFrame([("s", got["dip_phase"], got["dip_duty_cycle"])], "source_id string, dip_phase double, dip_duty_cycle double")
    row = M.cycle_dimming(points, dip).first()
    assert tuple(row[n] for n in names) == pytest.approx(want)


def test_sections_that_change(features):
    still, moving = features["wave"], features["evolving"]
    assert moving["evolution_raw_score"] > 1 > still["evolution_raw_score"] and moving["minimum_section_correlation"] < 0.25 < 0.9 < still["minimum_section_correlation"]
    assert moving["maximum_section_distance"] > 0.65 and still["sections_with_shape"] == 4


def test_other_folds_tell_harmonics(features):
    got = features["wave"]
    assert got["double_period_odd_even_difference"] < 0.25 and got["half_period_profile_distance"] > 0.2
    doubled = features["doubled"]
    assert doubled["half_period_profile_distance"] > 0.2 and "alias_possible" in doubled["diagnostic_tags"] and doubled["coherent_dimming_alias_penalty_component"] == 0.2


def test_families_of_made_stars(spark):
    """Every family is reached from light curves; sources without a period stay in."""
    rows = []
    kinds = {"wave": "wavelike", "dip": "transit", "flare": "flaring", "evolving": "irregular_variable", "none": "nonvar"}
    for s, kind in enumerate(kinds):
        t, m, e, b, p = star(kind, 10 + s, 600)
        rows += [(kind, i, *map(float, x), str(f), None if kind in ("none", "flare") else p) for i, (*x, f) in enumerate(zip(t, m, e, b))]
    points = spark.createDataFrame(rows, "source_id string, row_id long, time double, mag double, err double, filter string, period double")
    features = P.source_features(points)
    assert features.count() == 5 and P.event_table(features).where("source_id = 'flare' and event_type = 'brightening'").count() == 6
    periodic, transient = P.block_names()
    one = features.first()
    assert len(one["periodic_block"]) == len(periodic) == 32 + 1 + 42 and len(one["transient_block"]) == len(transient) == 8 + 4 + 24
    out = {r["source_id"]: r for r in K.classified(features.drop("events")).collect()}
    assert {k: out[k]["primary_tag"] for k in kinds} == kinds
    assert out["dip"]["secondary_tags"].startswith("narrow_eclipse") and "evolving_periodic" in out["evolving"]["secondary_tags"] and out["flare"]["score_flaring"] > 0.5
    with pytest.raises(ValueError, match="ls_peak_ratio"):
        K.category_scores(features.drop("ls_peak_ratio"))


def test_thin_and_odd_sources(spark):
    rows = [("a", 1, 1.0, 15.0, 0.1, "c", 3.0), ("b", 1, 1.0, 15.0, 0.1, "x", None), ("c", 1, 1.0, None, 0.1, "c", 2.0), (None, 1, 1.0, 15.0, 0.1, "c", 2.0)] + [("d", i, 5.0, 15.0, 0.0, "o", 2.0) for i in range(30)]
    points = spark.createDataFrame(rows, "source_id string, row_id long, time double, mag double, err double, filter string, period double")
    got = {r["source_id"]: r for r in P.source_features(points).collect()}
    assert set(got) == {"a", "b", "d"} and got["a"]["profile_chi2"] == 0 and got["d"]["n_points"] == 30 and got["b"]["recommended_period_days"] is None
    K.classified(P.source_features(points).drop("events")).collect()
    assert P.source_features(points.where("false")).count() == 0


def test_points_are_not_copied_for_each_fold(points):
    plan = O.profiles(O.in_sections(O.usable(points), 4))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Window") == 2  # the first time and the sections, both of plain points


def test_folds_of_odd_sources(spark):
    rows = [("none", i, float(i), 10.0 + i % 5, 0.1, "c", None) for i in range(9)] + [("two", i, float(i), 10.0, 0.1, "o", 3.0) for i in range(2)] + [("flat", i, float(i), 10.0, 0.1, "o", 3.0) for i in range(40)] + [("w", 1, 1.0, 1.0, 0.1, "w", 3.0)]
    p = spark.createDataFrame(rows, "source_id string, row_id long, time double, mag double, err double, filter string, period double")
    got = {(r["source_id"], r["fold"]): r for r in O.profiles(O.in_sections(O.usable(p), 2)).collect()}
    assert {k for k in got} == {("none", f) for f in ("whole", "section0", "section1")} | {("flat", f) for f in ("whole", "half", "double", "section0", "section1")}
    assert not got["none", "whole"]["folded"] and got["none", "whole"]["value"] is None and got["none", "whole"]["points"] == 9 and got["none", "whole"]["amplitude"] > 0
    assert got["flat", "whole"]["folded"] and set(got["flat", "whole"]["value"]) == {0.0} and sum(got["flat", "whole"]["n"]) == 40


@pytest.mark.parametrize("n, length, whole", [(300, 2500.0, False), (40, 12.0, False), (5000, 900.0, False), (60, 1e6, False), (200, 2000.0, True)])
def test_sampled_sums_match_plain_ones(n, length, whole):
    """Also a baseline too long for samples, and whole days, whose sines vanish at a period of a day."""
    r = np.random.default_rng(n)
    t = np.sort(r.uniform(58000, 58000 + length, n))
    t = np.floor(t) if whole else t
    y = np.sin(t * 0.7) + r.normal(0, 1, n)
    periods = np.geomspace(0.5, min(200, np.ptp(t) / 2), 700)
    periods = np.sort(np.append(periods[1:], [1.0, 2.0])) if whole else periods
    assert P.power(t, y, periods)[1:] == pytest.approx(P.block_power(t - t[0], y, periods)[1:], rel=1e-8, abs=1e-11, nan_ok=True)


def test_a_source_s_power_is_worked_out_inside_its_group(points):
    plan = P.diagnostic_power(points)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan and "Window" not in plan and plan.count("Repartition") == 1


def test_points_of_models_and_dips_are_dealt_once(spark, points):
    """All readers of the points share one exchange, and a model's solutions join by source alone."""
    q = O.in_sections(O.usable(points), 4).withColumn("dip_phase", F.lit(0.4)).withColumn("dip_duty_cycle", F.lit(0.1))
    shapes = spark.createDataFrame([("wave", 5.0, 0.1, False)], "source_id string, dip_significance double, out_of_dip_variation double, alias boolean")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        models, dips = (df._jdf.queryExecution().executedPlan().toString().splitlines() for df in (D.wave_or_dip(q), D.dip_evidence(q, shapes)))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    dealt = lambda plan: [x for x in plan if " Exchange hashpartitioning" in x]
    again = lambda plan: {x.split("[", 1)[1].count("#") for x in plan if "ReusedExchange [" in x}
    assert len([x for x in dealt(models) if "ReusedExchange" not in x]) == 1
    assert len([x for x in dips if "ReusedExchange [" in x]) == 5 and len(again(dips)) == 1  # readers of other columns would not share


def test_samples_of_long_baselines_come_from_a_transform(monkeypatch):
    """Two transforms give all samples, and the power is that of plain sums."""
    r = np.random.default_rng(6)
    t, y = np.sort(r.uniform(58000, 60500, 300)), r.normal(0, 1, 300)
    periods = np.geomspace(0.5, 200, 700)
    plain, asked = np.fft.ifft, []
    monkeypatch.setattr(np.fft, "ifft", lambda x, *a, **k: asked.append(np.size(x)) or plain(x, *a, **k))
    assert P.power(t, y, periods) == pytest.approx(P.block_power(t - t[0], y, periods), rel=1e-8, abs=1e-11) and len(asked) == 2
