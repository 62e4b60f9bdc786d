"""Queries over folds, shapes, models and dip evidence of light curves, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofold.config import MorphologyConfig
from chronofold.functions import tables
from chronofold.operators import evidence as D
from chronofold.operators import features as M
from chronofold.operators import folds as O
from chronofold.operators import measures as Q
from chronofold.operators import shapes as S
from chronofold.operators.graph import cut_lineage
from chronofold.plans.cleaning import _rounded
from chronofold.plans.morphology import EVENT_SIGMA, EVENTS_SQL, POINTS_SQL, points

SECTIONS, BINS = 4, 64


def _usable(spark, sf_dir):
    return O.in_sections(O.usable(points(spark, sf_dir)), SECTIONS)


def _folds(spark, sf_dir):
    return O.combined(cut_lineage(O.profiles(_usable(spark, sf_dir))))


def _sources(spark, sf_dir):
    periods = points(spark, sf_dir).groupBy("source_id").agg(F.first("period").alias("recommended_period_days"))
    return S.by_fold(_folds(spark, sf_dir)).join(periods, "source_id")


def _shapes(spark, sf_dir):
    whole = _folds(spark, sf_dir).where(F.col("fold") == O.WHOLE).select("source_id", "norm", "amplitude", F.col("typical").alias("bin_sigma"))
    return S.shape(whole, BINS)


def combined_profiles(spark, sf_dir):
    """The combined profile of every fold, bin by bin."""
    f = _folds(spark, sf_dir).select("source_id", "fold", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(BINS - 1)).alias("bin"), "value", "sigma")).alias("b"))
    return _rounded(f.select("source_id", "fold", "b.bin", "b.value", "b.sigma"))


def fold_numbers(spark, sf_dir):
    """Weights, shift and significance of every combined fold."""
    names = ["c_weight", "o_weight", "coverage", "median_error", "scatter_over_error", "over_scatter", "amplitude", "chi2", "snr"]
    return _rounded(_folds(spark, sf_dir).select("source_id", "fold", "shift", "points", *names), 9)


def period_alternatives(spark, sf_dir):
    names = ["half_period_profile_distance", "double_period_profile_distance", "double_period_odd_even_difference"]
    return _rounded(S.period_alternatives(_sources(spark, sf_dir), BINS).select("source_id", *names))


def section_evolution(spark, sf_dir):
    return _rounded(S.section_evolution(_sources(spark, sf_dir), SECTIONS).select("source_id", *Q.EVOLUTION))


def profile_shape(spark, sf_dir):
    names = [*Q.SHAPE, *Q.FOURIER, "profile_align_shift_bins", "dip_phase"]
    return _rounded(_shapes(spark, sf_dir).select("source_id", *names), 5)


def wave_or_dip(spark, sf_dir):
    dips = _shapes(spark, sf_dir).select("source_id", "dip_phase", "dip_duty_cycle")
    return _rounded(D.wave_or_dip(_usable(spark, sf_dir).join(dips, "source_id")))


def dip_evidence(spark, sf_dir):
    s = cut_lineage(_shapes(spark, sf_dir).select("source_id", "dip_phase", "dip_duty_cycle", "dip_significance", "out_of_dip_variation"))
    judged = s.select("source_id", "dip_significance", "out_of_dip_variation", F.lit(False).alias("alias"))
    q = _usable(spark, sf_dir).join(s.select("source_id", "dip_phase", "dip_duty_cycle"), "source_id")
    out = D.dip_evidence(q, judged, BINS).join(D.cycles_with_dip(q), "source_id")
    return _rounded(out)


def residual_events(spark, sf_dir):
    """Excursions of what is left once each band's clipped and filled fold is taken off, rejected ones included."""
    p = cut_lineage(_usable(spark, sf_dir))
    return _rounded(M.excursion_events(Q.residual_points(p, O.profiles(p), MorphologyConfig()), EVENT_SIGMA), 9)


def excursions_by_sql(spark, sf_dir):
    """Excursions by a SQL statement, through the table function."""
    p = cut_lineage(_usable(spark, sf_dir))
    tables.register(spark)
    Q.residual_points(p, O.profiles(p), MorphologyConfig()).createOrReplaceTempView("chronofold_residuals")
    return _rounded(spark.sql(f"SELECT * FROM excursions(TABLE(chronofold_residuals), {EVENT_SIGMA}D, 1D)"), 9)


QUERIES = {f.__name__: f for f in (combined_profiles, fold_numbers, period_alternatives, section_evolution, profile_shape, wave_or_dip, dip_evidence, residual_events, excursions_by_sql)}


# The SQL: rows where the operators have arrays, shifts and axes as joins.

_D = "CAST({} AS DOUBLE)".format
_Q = "quantile_cont({0}, {1})".format


def _span(x: str, low: float, high: float, over: str = "") -> str:
    return f"({_Q(x, high)}{over} - {_Q(x, low)}{over})"


_FOLD_ROWS = " UNION ALL ".join(
    f"SELECT source_id, {name} AS fold, filter, time, mag, err, origin, period * {_D(factor)} AS per FROM use WHERE filter IN ('c', 'o') AND err > 0"
    for name, factor in (("'whole'", 1), ("'half'", 0.5), ("'double'", 2), ("'section' || section", 1))
)
FOLDS_SQL = POINTS_SQL + f""",
use AS (SELECT source_id, row_id, time, mag, err, filter, period, ntile({SECTIONS}) OVER (PARTITION BY source_id ORDER BY time, row_id) - 1 AS section, min(time) OVER (PARTITION BY source_id) AS origin FROM pts),
fx AS ({_FOLD_ROWS}),
f1 AS (SELECT *, count(*) OVER k AS n, mag - median(mag) OVER k AS x, median(err) OVER k AS me FROM fx WINDOW k AS (PARTITION BY source_id, fold, filter)),
f2 AS (SELECT *, CASE WHEN n >= 8 THEN {_span("x", 0.16, 0.84, " OVER k")} / 2 ELSE {_D(1.4826)} * median(abs(x)) OVER k END AS lim FROM f1 WHERE n >= 3 WINDOW k AS (PARTITION BY source_id, fold, filter)),
f3 AS (SELECT *, count(*) FILTER (abs(x) <= 6 * lim) OVER (PARTITION BY source_id, fold, filter) AS nn FROM f2),
f4 AS (SELECT *, count(*) OVER k AS points, abs(x - median(x) OVER k) AS dev FROM f3 WHERE NOT (lim > 0 AND nn >= greatest(20, n // 2)) OR abs(x) <= 6 * lim WINDOW k AS (PARTITION BY source_id, fold, filter)),
f5 AS (SELECT *, CASE WHEN points >= 8 THEN {_span("x", 0.16, 0.84, " OVER k")} / 2 ELSE {_D(1.4826)} * median(dev) OVER k END AS scatter, {_D(1.4826)} * median(dev) OVER k AS own_mad,
        CAST(least(floor(((time - origin) / per - floor((time - origin) / per)) * {BINS}), {BINS - 1}) AS INTEGER) AS bin FROM f4 WINDOW k AS (PARTITION BY source_id, fold, filter)),
f6 AS (SELECT *, abs(x - median(x) OVER (PARTITION BY source_id, fold, filter, bin)) AS off FROM f5),
cell AS (SELECT source_id, fold, filter, bin, count(*) AS n, median(x) AS mid, any_value(points) AS points, any_value(scatter) AS scatter, any_value(own_mad) AS own_mad, any_value(me) AS me,
        CASE WHEN count(*) >= 8 THEN {_span("x", 0.16, 0.84)} / 2 WHEN count(*) > 3 THEN {_D(1.4826)} * median(off) END AS own, median(err) AS bin_err FROM f6 GROUP BY source_id, fold, filter, bin),
cell2 AS (SELECT *, greatest(CASE WHEN own > 0 THEN own ELSE bin_err END / sqrt(n), scatter / sqrt(n) / 2) AS seen FROM cell),
series AS (SELECT source_id, fold, filter, any_value(points) AS points, any_value(scatter) AS scatter, any_value(own_mad) AS own_mad, any_value(me) AS me, count(*) AS occupied, median(seen) AS typ FROM cell2 GROUP BY source_id, fold, filter),
grid AS (SELECT s.source_id, s.fold, s.filter, CAST(b AS INTEGER) AS bin, c.mid, c.seen, s.scatter FROM series s CROSS JOIN range({BINS}) t(b) LEFT JOIN cell2 c ON c.source_id = s.source_id AND c.fold = s.fold AND c.filter = s.filter AND c.bin = b),
ends AS (SELECT g.source_id, g.fold, g.filter, g.bin, coalesce(max(c.bin) FILTER (c.bin < g.bin), max(c.bin) - {BINS}) AS b0, coalesce(min(c.bin) FILTER (c.bin > g.bin), min(c.bin) + {BINS}) AS b1
        FROM grid g JOIN cell2 c USING (source_id, fold, filter) WHERE g.mid IS NULL GROUP BY g.source_id, g.fold, g.filter, g.bin),
fill AS (SELECT g.*, coalesce(g.mid, l.mid + (r.mid - l.mid) * (g.bin - b0) / (b1 - b0)) AS v FROM grid g LEFT JOIN ends e USING (source_id, fold, filter, bin)
        LEFT JOIN cell2 l ON l.source_id = g.source_id AND l.fold = g.fold AND l.filter = g.filter AND l.bin = (b0 + {BINS}) % {BINS}
        LEFT JOIN cell2 r ON r.source_id = g.source_id AND r.fold = g.fold AND r.filter = g.filter AND r.bin = b1 % {BINS}),
prof AS (SELECT source_id, fold, filter, bin, v - median(v) OVER (PARTITION BY source_id, fold, filter) AS v, seen, coalesce(seen, scatter) AS sigma FROM fill),
amp AS (SELECT source_id, fold, filter, {_span("v", 0.05, 0.95)} AS amplitude, avg((v / seen) * (v / seen)) FILTER (seen IS NOT NULL) AS chi FROM prof GROUP BY source_id, fold, filter),
band AS (SELECT *, CASE WHEN occupied >= 8 THEN chi END AS chi2, CASE WHEN occupied >= 8 THEN amplitude / greatest(typ, 1e-9) END AS snr, occupied / {_D(BINS)} AS coverage, own_mad / greatest(me, 1e-9) AS soe, amplitude / greatest(scatter, 1e-9) AS os
        FROM series JOIN amp USING (source_id, fold, filter)),
nrm AS (SELECT p.*, CASE WHEN amplitude > 1e-12 THEN v / amplitude ELSE 0 END AS u FROM prof p JOIN amp USING (source_id, fold, filter)),
live AS (SELECT source_id, fold, count(DISTINCT filter) AS k FROM nrm WHERE u <> 0 GROUP BY source_id, fold),
dist AS (SELECT c.source_id, c.fold, CAST(k AS INTEGER) AS k, sqrt(avg((c.u - o.u) * (c.u - o.u))) AS d FROM nrm c CROSS JOIN range({BINS}) t(k) JOIN nrm o ON o.source_id = c.source_id AND o.fold = c.fold AND o.filter = 'o' AND o.bin = (c.bin - k + {BINS}) % {BINS}
        WHERE c.filter = 'c' AND c.fold NOT LIKE 'section%' GROUP BY c.source_id, c.fold, k),
turn AS (SELECT source_id, fold, min_by(k, (d, k)) AS shift FROM dist JOIN (SELECT source_id, fold FROM live WHERE k = 2) USING (source_id, fold) GROUP BY source_id, fold),
wt AS (SELECT *, greatest(coalesce(chi2, 0), {_D(0.1)}) * sqrt(points) AS w FROM band),
pair AS (SELECT source_id, fold, coalesce(sum(w) FILTER (filter = 'c'), 0) / sum(w) AS wc, coalesce(sum(w) FILTER (filter = 'o'), 0) / sum(w) AS wo, count(*) AS nb, CAST(coalesce(any_value(shift), 0) AS INTEGER) AS shift,
        sum(points) AS points, max(coverage) AS coverage, {", ".join(f"sum(w * coalesce({c}, 0)) / sum(w) AS {c}" for c in ("me", "soe", "os"))}, max(amplitude) AS amp1, max(chi2) AS chi1, max(snr) AS snr1
        FROM wt LEFT JOIN turn USING (source_id, fold) GROUP BY source_id, fold),
mixed AS (SELECT source_id, fold, (bin + CASE WHEN filter = 'o' AND nb = 2 THEN shift ELSE 0 END) % {BINS} AS bin, any_value(nb) AS nb, sum(v * CASE filter WHEN 'c' THEN wc ELSE wo END) AS v, sqrt(sum(sigma * sigma * CASE filter WHEN 'c' THEN wc * wc ELSE wo * wo END)) AS s0
        FROM prof JOIN pair USING (source_id, fold) GROUP BY ALL),
comb AS (SELECT source_id, fold, CAST(bin AS INTEGER) AS bin, nb, CASE WHEN nb = 2 THEN v - median(v) OVER k ELSE v END AS v, CASE WHEN s0 > 0 THEN s0 ELSE coalesce(median(CASE WHEN s0 > 0 THEN s0 END) OVER k, 1e-6) END AS sigma FROM mixed WINDOW k AS (PARTITION BY source_id, fold)),
cstat AS (SELECT source_id, fold, {_span("v", 0.05, 0.95)} AS amplitude, avg((v / sigma) * (v / sigma)) AS chi2, median(sigma) AS typ FROM comb GROUP BY source_id, fold),
cfold AS (SELECT p.*, CASE WHEN nb = 2 THEN c.amplitude ELSE amp1 END AS amplitude, CASE WHEN nb = 2 THEN c.chi2 ELSE chi1 END AS chi2, CASE WHEN nb = 2 THEN c.amplitude / greatest(typ, 1e-9) ELSE snr1 END AS snr, typ FROM pair p JOIN cstat c USING (source_id, fold)),
unit AS (SELECT c.source_id, c.fold, c.bin, CASE WHEN amplitude > 1e-12 THEN c.v / amplitude ELSE 0 END AS u, c.v FROM comb c JOIN cfold USING (source_id, fold))"""

_NEAR = """{name}d AS (SELECT a.source_id, CAST(k AS INTEGER) AS k, sqrt(avg((a.u - b.u) * (a.u - b.u))) AS d FROM unit a CROSS JOIN range({bins}) t(k) JOIN unit b ON b.source_id = a.source_id AND b.fold = '{name}' AND b.bin = (a.bin - k + {bins}) % {bins}
        WHERE a.fold = 'whole' GROUP BY a.source_id, k),
{name}m AS (SELECT source_id, min(d) AS {name}_d FROM {name}d JOIN (SELECT source_id FROM unit WHERE u <> 0 AND fold IN ('whole', '{name}') GROUP BY source_id HAVING count(DISTINCT fold) = 2) USING (source_id) GROUP BY source_id)"""


def _harmonics(of: str) -> str:
    return ", ".join(f"2 * avg({of} * cos({_D(S.TAU)} * {h} / {BINS} * bin)) AS a{h}, 2 * avg({of} * sin({_D(S.TAU)} * {h} / {BINS} * bin)) AS b{h}" for h in S.HARMONICS)


_AT = f"a[(bin + {{0}} + {BINS}) % {BINS} + 1]".format
_AROUND = f"least(abs(bin - {{0}}), {BINS} - abs(bin - {{0}}))".format
SHAPE_SQL = FOLDS_SQL + f""",
v0 AS (SELECT source_id, bin, u AS v, median(u) OVER (PARTITION BY source_id) AS m FROM unit WHERE fold = 'whole' AND source_id IN (SELECT source_id FROM unit WHERE fold = 'whole' GROUP BY source_id HAVING max(u) > min(u))),
vs AS (SELECT v.source_id, any_value(m) AS m, {_Q("v", 0.98)} - any_value(m) AS dip, any_value(m) - {_Q("v", 0.02)} AS flare, CAST(min_by(bin, (-v, bin)) AS INTEGER) AS hi, CAST(min_by(bin, (v, bin)) AS INTEGER) AS lo, {_harmonics("v")},
        sqrt({_D(BINS)} * {BINS - 1}) / {BINS - 2} * (avg(v * v * v) - 3 * avg(v) * avg(v * v) + 2 * avg(v) * avg(v) * avg(v)) / pow(var_pop(v), 1.5) AS skew FROM v0 v GROUP BY v.source_id),
vt AS (SELECT vs.*, greatest(coalesce(amplitude, 0), 0) AS amp, greatest(coalesce(typ, 0), 1e-9) AS sg, greatest(coalesce(typ, 0), 1e-9) / greatest(abs(coalesce(amplitude, 0)), 1e-9) AS noise FROM vs JOIN cfold USING (source_id) WHERE fold = 'whole'),
runs AS (SELECT source_id, kind, least(coalesce(max(len), 0), {BINS}) AS width FROM (
        SELECT source_id, kind, g, count(*) AS len FROM (SELECT *, b - row_number() OVER (PARTITION BY source_id, kind ORDER BY b) AS g FROM (
            SELECT v0.source_id, kind, bin + {BINS} * t AS b FROM v0 JOIN vt USING (source_id) CROSS JOIN range(2) x(t) CROSS JOIN (VALUES ('d'), ('f')) y(kind)
            WHERE CASE kind WHEN 'd' THEN v - v0.m >= greatest(dip / 2, 1e-12) ELSE v0.m - v >= greatest(flare / 2, 1e-12) END)) GROUP BY source_id, kind, g) GROUP BY source_id, kind),
vw AS (SELECT vt.*, coalesce(d.width, 0) AS dw, coalesce(f.width, 0) AS fw, least(greatest(2, 2 * coalesce(d.width, 0) + 1), {max(2, BINS // 5)}) AS dr, least(greatest(2, 2 * coalesce(f.width, 0) + 1), {max(2, BINS // 5)}) AS fr
        FROM vt LEFT JOIN runs d ON d.source_id = vt.source_id AND d.kind = 'd' LEFT JOIN runs f ON f.source_id = vt.source_id AND f.kind = 'f'),
rest AS (SELECT source_id, count(*) FILTER ({_AROUND("hi")} > dr) AS nd, count(*) FILTER ({_AROUND("lo")} > fr) AS nf, max(v) FILTER ({_AROUND("hi")} > dr) AS v2, min_by(bin, (-v, bin)) FILTER ({_AROUND("hi")} > dr) AS second,
        quantile_cont(v, 0.9) FILTER ({_AROUND("hi")} > dr) - quantile_cont(v, 0.1) FILTER ({_AROUND("hi")} > dr) AS df, quantile_cont(v, 0.9) FILTER ({_AROUND("lo")} > fr) - quantile_cont(v, 0.1) FILTER ({_AROUND("lo")} > fr) AS ff FROM v0 JOIN vw USING (source_id) GROUP BY source_id),
sig AS ({" UNION ALL ".join(f"SELECT source_id, {h} AS h, a{h} AS a, b{h} AS b FROM vw WHERE sqrt(a{h} * a{h} + b{h} * b{h}) >= 3 * noise * sqrt({_D(2)} / {BINS})" for h in S.HARMONICS)}),
axes AS (SELECT source_id, k, sum(pow(a * cos(h * {_D(S.TAU)} * k / {4 * BINS}) + b * sin(h * {_D(S.TAU)} * k / {4 * BINS}), 2)) / sum(a * a + b * b) AS share FROM sig CROSS JOIN range({4 * BINS}) t(k) GROUP BY source_id, k),
mirror AS (SELECT source_id, max(share) AS mirror FROM axes GROUP BY source_id),
five AS (SELECT a.source_id, a.bin, any_value(a.v) AS v, sum(b.v - b.m) FILTER (least(abs(a.bin - b.bin), {BINS} - abs(a.bin - b.bin)) <= 2) / 5 AS s, sum(b.v) FILTER (least(abs(a.bin - b.bin), {BINS} - abs(a.bin - b.bin)) <= 1) / 3 AS three,
        max(abs(b.v - b.m)) AS top FROM v0 a JOIN v0 b USING (source_id) GROUP BY a.source_id, a.bin),
fives AS (SELECT source_id, list(s ORDER BY bin) AS a FROM five GROUP BY source_id),
peaks AS (SELECT source_id, count(*) FILTER (s >= {_AT(-1)} AND s >= {_AT(1)} AND s > {_AT(-2)} AND s > {_AT(2)} AND s / top >= greatest({_D(0.35)}, 4 * noise)) AS peaks, CAST(min_by(bin, (-({_D(0.8)} * v + {_D(0.2)} * three), bin)) AS INTEGER) AS turn
        FROM five JOIN vw USING (source_id) JOIN fives USING (source_id) GROUP BY source_id),
wav AS (SELECT source_id, v, v - a1 * cos({_D(S.TAU)} / {BINS} * bin) - b1 * sin({_D(S.TAU)} / {BINS} * bin) AS r FROM v0 JOIN vw USING (source_id)),
wdev AS (SELECT source_id, abs(v - median(v) OVER k) AS dv, abs(r - median(r) OVER k) AS dr FROM wav WINDOW k AS (PARTITION BY source_id)),
sinus AS (SELECT source_id, {_D(1.4826)} * median(dr) / greatest({_D(1.4826)} * median(dv), 1e-9) AS sinus FROM wdev GROUP BY source_id),
dips AS (SELECT w.source_id, coalesce(hi, 0) / {_D(BINS)} AS dip_phase, dw / {_D(BINS)} AS duty, dip * amp / sg AS significance, CASE WHEN nd >= 8 AND dip > 1e-9 THEN df / dip END AS off_dip FROM vw w LEFT JOIN rest USING (source_id))"""


def _size(h: int) -> str:
    return f"sqrt(a{h} * a{h} + b{h} * b{h})"


def _wrapped(h: int) -> str:
    d = f"(atan2(b{h}, a{h}) - {h} * atan2(b1, a1) + {_D(S.TAU / 2)})"
    return f"{d} - floor({d} / {_D(S.TAU)}) * {_D(S.TAU)} - {_D(S.TAU / 2)}"


_SHAPES = {
    "dip_depth_norm": "dip",
    "flare_depth_norm": "flare",
    "dip_duty_cycle": f"dw / {_D(BINS)}",
    "dip_width_bins": "CAST(dw AS DOUBLE)",
    "secondary_dip_depth_norm": "CASE WHEN nd > 0 THEN v2 - m ELSE 0 END",
    "secondary_dip_phase_separation": f"CASE WHEN nd > 0 THEN least(abs(second - hi), {BINS} - abs(second - hi)) / {_D(BINS)} ELSE 0 END",
    "out_of_dip_variation": "CASE WHEN nd >= 8 AND dip > 1e-9 THEN df / dip END",
    "out_of_flare_variation": "CASE WHEN nf >= 8 AND flare > 1e-9 THEN ff / flare END",
    "flare_dominance": "flare / greatest(dip, 1e-9)",
    "flare_duty_cycle": f"fw / {_D(BINS)}",
    "dip_dominance": "dip / greatest(flare, 1e-9)",
    "dip_significance": "dip * amp / sg",
    "mirror_symmetry": "mirror",
    "profile_peak_count": "CAST(peaks AS DOUBLE)",
    "sinusoid_residual_ratio": "sinus",
    "harmonic_energy_ratio": f"({' + '.join(f'{_size(h)} * {_size(h)}' for h in S.HARMONICS[1:])}) / greatest({' + '.join(f'{_size(h)} * {_size(h)}' for h in S.HARMONICS)}, 1e-12)",
    "skewness": "skew",
    **{f"fourier_h{h}_amplitude": _size(h) for h in S.HARMONICS},
    **{f"fourier_R{h}1": f"{_size(h)} / greatest({_size(1)}, 1e-12)" for h in S.HARMONICS[1:]},
    **{f"fourier_phi{h}1": _wrapped(h) for h in S.HARMONICS[1:]},
    "profile_align_shift_bins": "CAST(turn AS DOUBLE)",
    "dip_phase": f"hi / {_D(BINS)}",
}


def _eliminated(name: str, m: int) -> str:
    """The normal equations of ``name``, one step of the elimination after the other, in tables {name}0 to {name}m; the last has y0 to y(m-1)."""
    cell = lambda i, j: f"{name}_{min(i, j)}_{max(i, j)}" if j < m else f"{name}_{i}_y"
    parts = [f"{name}0 AS (SELECT source_id, third, {', '.join(f'{cell(i, j)} AS m_{i}_{j}' for i in range(m) for j in range(m + 1))}, {', '.join(f'{cell(i, i)} AS own_{i}' for i in range(m))} FROM others)"]
    for p in range(m):
        share = lambda j: f"coalesce(m_{p}_{j} / CASE WHEN m_{p}_{p} > 1e-10 * own_{p} THEN m_{p}_{p} END, 0)"  # noqa: E731, B023
        cells = [f"{share(j) if i == p else f'm_{i}_{j} - m_{i}_{p} * {share(j)}'} AS m_{i}_{j}" for i in range(m) for j in range(p + 1, m + 1)]
        parts.append(f"{name}{p + 1} AS (SELECT source_id, third, {', '.join(f'own_{i}' for i in range(m))}, {', '.join(cells)} FROM {name}{p})")
    return ", ".join(parts)


_BASES = {"w": ["1", "sin(x)", "cos(x)", "sin(2 * x)", "cos(2 * x)"], "d": ["1", "exp(-d * d / 2)", "exp(-d * d / 8)"]}
_PRODUCTS = {f"{n}_{i}_{'y' if j == len(cs) else j}": f"{n}{i} * {'y' if j == len(cs) else f'{n}{j}'}" for n, cs in _BASES.items() for i in range(len(cs)) for j in range(i, len(cs) + 1)}
_FITS = {n: " + ".join(f"{n}{i} * {n}f.m_{i}_{len(cs)}" for i in range(len(cs))) for n, cs in _BASES.items()}
_WIDTH = f"least(greatest(coalesce(duty, {_D(0.1)}), {_D(D.NARROWEST)}), {_D(D.WIDEST)})"
_AWAY = "least(abs(turn - floor(turn) - dip_phase), 1 - abs(turn - floor(turn) - dip_phase))"
MODELS_SQL = SHAPE_SQL + f""",
g0 AS (SELECT u.*, dip_phase, duty, (time - origin) / period AS turn, count(*) OVER (PARTITION BY source_id) AS n, row_number() OVER (PARTITION BY source_id ORDER BY time, row_id) AS i, mag - median(mag) OVER (PARTITION BY source_id) AS y FROM use u JOIN dips USING (source_id)),
g1 AS (SELECT source_id, (i - 1) % {D.FOLDS} AS third, n, y, greatest(err, 1e-6) AS e, {_D(S.TAU)} * (turn - floor(turn)) AS x, {_AWAY} / greatest({_WIDTH} / {_D(2.355)}, {_D(1)} / 64) AS d FROM g0 WHERE n >= {D.LEAST_POINTS}),
g2 AS (SELECT source_id, third, n, y, e, {", ".join(f"{c} AS {n}{i}" for n, cs in _BASES.items() for i, c in enumerate(cs))} FROM g1),
g3 AS (SELECT source_id, third, {", ".join(f"sum(CAST({v} AS DOUBLE)) AS {k}" for k, v in _PRODUCTS.items())} FROM g2 GROUP BY source_id, third),
others AS (SELECT source_id, third, {", ".join(f"sum({k}) OVER (PARTITION BY source_id) - {k} AS {k}" for k in _PRODUCTS)} FROM g3),
{_eliminated("w", 5)}, {_eliminated("d", 3)},
miss AS (SELECT source_id, third, n, abs(y - ({_FITS["w"]})) / e AS wm, abs(y - ({_FITS["d"]})) / e AS dm FROM g2 JOIN w5 wf USING (source_id, third) JOIN d3 df USING (source_id, third)),
mm AS (SELECT source_id, third, any_value(n) AS n, median(wm) AS wm, median(dm) AS dm FROM miss GROUP BY source_id, third),
ms AS (SELECT source_id, 1 / (1 + greatest(median(wm) + 5 * ln(any_value(n)) / any_value(n), 0)) AS w, 1 / (1 + greatest(median(dm) + 3 * ln(any_value(n)) / any_value(n), 0)) AS d FROM mm GROUP BY source_id)"""


def _unit(x: str) -> str:
    return f"greatest(0, least(1, {x}))"


_PARTS = {
    "folded_significance": "coalesce(significance, 0) / 12",
    "phase_concentration": "(gathered - width) / greatest(1 - width, 1e-9)",
    "cycle_support": f"supporting / {_D(3)}",
    "cycle_fraction": "fraction",
    "night_support": f"nights / {_D(3)}",
    "section_support": f"sections / {_D(2)}",
    "local_contrast": "contrast / 5",
    "outside_stability": f"1 - coalesce(off_dip, 1) / {_D(1.2)}",
    "coverage": "(near + far) / 2",
    "point_quality": "quality",
}
_SRC = "(PARTITION BY source_id)"
EVIDENCE_SQL = SHAPE_SQL + f""",
h0 AS (SELECT *, {_AWAY} AS away, floor(turn) AS cycle, turn - floor(turn) AS ph FROM (SELECT u.*, (time - origin) / period AS turn, dip_phase, duty, {_WIDTH} AS width FROM use u JOIN dips USING (source_id) WHERE err > 0)),
h1 AS (SELECT *, away <= width / 2 AS inside, count(*) OVER {_SRC} AS n, median(err) OVER {_SRC} AS typical, {_span("mag", 0.16, 0.84, f" OVER {_SRC}")} / 2 AS sp FROM h0),
h2 AS (SELECT *, count(*) FILTER (inside) OVER {_SRC} AS n_in, greatest(sp, typical, 1e-6) AS scale, coalesce(median(CASE WHEN NOT inside THEN mag END) OVER {_SRC}, median(mag) OVER {_SRC}) AS level, median(CASE WHEN NOT inside THEN mag END) OVER (PARTITION BY source_id, cycle) AS own FROM h1),
h3 AS (SELECT *, coalesce(own, CASE WHEN width >= {_D(D.BROAD)} THEN level END) AS base, least(floor(ph * {BINS}), {BINS - 1}) AS bin, least(floor(ph * 8), 7) AS octant, floor(time) AS night FROM h2 WHERE n >= 8 AND n_in >= 2),
cyc AS (SELECT source_id, cycle, median(mag) - any_value(base) AS depth, greatest(any_value(scale) / sqrt(count(*)), median(err), 1e-9) AS error FROM h3 WHERE inside AND base IS NOT NULL GROUP BY source_id, cycle),
cy2 AS (SELECT *, depth / error AS contrast, depth / error >= {D.CONTRAST} AND depth > 0 AS good, abs(depth / error - median(depth / error) OVER {_SRC}) AS dev FROM cyc),
bycyc AS (SELECT source_id, count(*) AS covered, count(*) FILTER (good) AS supporting, median(contrast) AS contrast, CASE WHEN count(*) >= 8 THEN {_span("contrast", 0.16, 0.84)} / 2 WHEN count(*) >= 3 THEN {_D(1.4826)} * median(dev) END AS uneven FROM cy2 GROUP BY source_id),
sup AS (SELECT h3.source_id, section, night FROM h3 JOIN cy2 USING (source_id, cycle) WHERE good AND inside AND base IS NOT NULL AND mag > base),
persec AS (SELECT source_id, supports, section, count(*) AS k FROM (SELECT source_id, section, 1 AS supports FROM sup UNION ALL SELECT source_id, section, 0 FROM h3 WHERE inside) GROUP BY source_id, supports, section),
conc AS (SELECT source_id, arg_max(alone, supports) AS alone FROM (SELECT source_id, supports, max(k) / sum(k) AS alone FROM persec GROUP BY source_id, supports) GROUP BY source_id),
supn AS (SELECT source_id, count(DISTINCT section) AS sections, count(DISTINCT night) AS nights FROM sup GROUP BY source_id),
bypt AS (SELECT source_id, any_value(width) AS width, count(DISTINCT bin) AS seen_bins, count(DISTINCT CASE WHEN NOT inside THEN bin END) AS rest_bins, avg(CASE WHEN inside THEN CAST(err <= 2 * greatest(typical, 1e-9) AS INT) END) AS quality,
        coalesce(avg(CASE WHEN mag > level + scale / 2 THEN CAST(inside AS INT) END), 0) AS gathered FROM h3 GROUP BY source_id),
mic AS (SELECT source_id, octant, section, count(*) AS k FROM h3 GROUP BY source_id, octant, section),
mit AS (SELECT *, k / sum(k) OVER {_SRC} AS j, sum(k) OVER (PARTITION BY source_id, octant) / sum(k) OVER {_SRC} AS po, sum(k) OVER (PARTITION BY source_id, section) / sum(k) OVER {_SRC} AS ps FROM mic),
dep AS (SELECT source_id, {_unit("sum(j * ln(j / (po * ps))) / greatest(-sum(j * ln(po)), 1e-9)")} AS dep FROM mit GROUP BY source_id),
ev AS (SELECT b.source_id, width, quality, gathered, dep, alone, significance, off_dip, coalesce(covered, 0) AS covered, coalesce(supporting, 0) AS supporting, coalesce(contrast, 0) AS contrast, coalesce(uneven, 0) AS uneven, coalesce(sections, 0) AS sections, coalesce(nights, 0) AS nights,
        coalesce(supporting / nullif(covered, 0), 0) AS fraction, least(1, seen_bins / greatest(1, ceil(least(1, 3 * width) * {BINS}))) AS near, least(1, rest_bins / greatest(1, {BINS} - greatest(1, ceil(width * {BINS})))) AS far
        FROM bypt b JOIN conc USING (source_id) LEFT JOIN supn USING (source_id) LEFT JOIN bycyc USING (source_id) JOIN dep USING (source_id) JOIN dips USING (source_id)),
ep AS (SELECT *, {", ".join(f"{_unit(x)} AS c_{n}" for n, x in _PARTS.items())}, {_unit(f"{_D(0.55)} * dep + {_D(0.45)} * greatest(0, alone - {_D(0.5)}) / {_D(0.5)}")} AS season FROM ev),
cw0 AS (SELECT *, median(mag) OVER {_SRC} AS mm, count(*) OVER {_SRC} AS nc, {_span("mag", 0.16, 0.84, f" OVER {_SRC}")} / 2 AS wide FROM (SELECT u.*, (time - origin) / period AS turn, dip_phase, duty FROM use u JOIN dips USING (source_id))),
cw1 AS (SELECT *, abs(mag - mm) AS dv, {_AWAY} <= greatest(coalesce(duty, {_D(0.1)}) / 2, {_D(1)} / 64) AS inside, floor(turn) AS cycle FROM cw0),
cw2 AS (SELECT *, greatest(CASE WHEN nc >= 8 THEN wide ELSE {_D(1.4826)} * median(dv) OVER {_SRC} END, 1e-9) AS sc FROM cw1),
cw AS (SELECT source_id, CASE WHEN count(*) FILTER (inside AND mag > mm + sc / 2) >= 3 THEN count(DISTINCT CASE WHEN inside AND mag > mm + sc / 2 THEN cycle END) ELSE count(DISTINCT CASE WHEN inside THEN cycle END) END AS cycles FROM cw2 GROUP BY source_id)"""


RESIDUAL_SQL = FOLDS_SQL + f""",
rs0 AS (SELECT source_id, row_id, time, filter, err, mag - median(mag) OVER (PARTITION BY source_id, filter) AS x, CAST(least(floor(((time - origin) / period - floor((time - origin) / period)) * {BINS}), {BINS - 1}) AS INTEGER) AS bin FROM use WHERE filter IN ('c', 'o')),
rs1 AS (SELECT r.*, x - coalesce(v, 0) AS r, count(*) OVER {_SRC} AS n FROM rs0 r LEFT JOIN (SELECT source_id, filter, bin, v FROM prof WHERE fold = 'whole') USING (source_id, filter, bin)),
rs2 AS (SELECT *, abs(r - median(r) OVER {_SRC}) AS dev FROM rs1),
zed AS (SELECT *, r / greatest(err, CASE WHEN n >= 8 THEN {_span("r", 0.16, 0.84, f" OVER {_SRC}")} / 2 ELSE {_D(1.4826)} * median(dev) OVER {_SRC} END, 1e-6) AS z FROM rs2),
exc AS""" + EVENTS_SQL.split("exc AS", 1)[1]
_EVENT = """SELECT source_id, event_type, event_number, round(event_time, 9) AS event_time, n_measurements, round(event_duration_days, 9) AS event_duration_days, represented_filters, round(peak, 9) AS peak_residual_significance,
        round(med, 9) AS median_residual_significance, round(mq, 9) AS median_quoted_uncertainty, round(lq, 9) AS minimum_quoted_uncertainty, round(hq, 9) AS maximum_quoted_uncertainty, multi AS is_multi_point,
        crossed AS has_cross_filter_support, multi OR crossed AS passes_quality_validation, CAST(floor(event_time) AS BIGINT) AS independent_observing_night, CASE WHEN multi OR crossed THEN '' ELSE 'single_point_excursion' END AS rejection_reason FROM evt"""


def _r(x: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({x} AS DOUBLE), {digits}) AS {name}"


_EVIDENCE = {
    "dip_supporting_cycles": "supporting", "dip_covered_cycles": "covered", "dip_cycle_support_fraction": "fraction", "dip_independent_nights": "nights", "dip_supporting_time_sections": "sections", "phase_time_section_dependence": "dep",
    "dip_section_concentration": "alone", "dip_single_section_fraction": "alone", "phase_coverage_near_dip": "near", "phase_coverage_outside_dip": "far", "dip_local_contrast_sigma": "contrast",
    "dip_cycle_contrast_scatter": "uneven / greatest(abs(contrast), 1e-9)", "dip_point_quality_fraction": "quality", **{f"coherent_dimming_{n}_component": f"c_{n}" for n in _PARTS},
    "coherent_dimming_seasonal_penalty_component": "season", "coherent_dimming_alias_penalty_component": "0",
    "coherent_dimming_score": _unit(f"({' + '.join(f'c_{n}' for n in _PARTS)}) / {len(_PARTS)} - {_D(0.35)} * season"),
    "cycles_with_dip": "cycles",
}

ORACLES = {
    "residual_events": f"WITH {RESIDUAL_SQL} {_EVENT}",
    "excursions_by_sql": f"""WITH {RESIDUAL_SQL} SELECT source_id, event_type, CAST(event_number AS INTEGER) AS event_number, CAST(count(*) AS INTEGER) AS n_measurements, round(min(time), 9) AS first_time, round(max(time), 9) AS last_time,
        round(max(abs(z)), 9) AS peak_significance FROM num GROUP BY source_id, event_type, event_number""",
    "feature_events": f"WITH {RESIDUAL_SQL} {_EVENT}",
    "combined_profiles": f"WITH {FOLDS_SQL} SELECT source_id, fold, bin, round(v, 6) AS value, round(sigma, 6) AS sigma FROM comb",
    "fold_numbers": f"""WITH {FOLDS_SQL} SELECT source_id, fold, shift, CAST(points AS BIGINT) AS points, {", ".join(_r(x, n, 9) for n, x in (("c_weight", "wc"), ("o_weight", "wo"), ("coverage", "coverage"), ("median_error", "me"), ("scatter_over_error", "soe"),
        ("over_scatter", "os"), ("amplitude", "amplitude"), ("chi2", "chi2"), ("snr", "snr")))} FROM cfold""",
    "period_alternatives": f"""WITH {FOLDS_SQL}, {", ".join(_NEAR.format(name=n, bins=BINS) for n in ("half", "double"))},
        odd AS (SELECT source_id, abs(max(u) FILTER (bin < {BINS // 2}) - max(u) FILTER (bin >= {BINS // 2})) AS odd FROM unit WHERE fold = 'double' GROUP BY source_id), every AS (SELECT DISTINCT source_id FROM unit)
        SELECT source_id, {_r("half_d", "half_period_profile_distance")}, {_r("double_d", "double_period_profile_distance")}, {_r("coalesce(odd, 0)", "double_period_odd_even_difference")}
        FROM every LEFT JOIN halfm USING (source_id) LEFT JOIN doublem USING (source_id) LEFT JOIN odd USING (source_id)""",
    "section_evolution": f"""WITH {FOLDS_SQL}, part AS (SELECT s.source_id, s.fold, count(*) AS k, CASE WHEN stddev_pop(s.u) > 0 AND stddev_pop(w.u) > 0 THEN corr(s.u, w.u) END AS likes FROM unit s JOIN unit w ON w.source_id = s.source_id AND w.bin = s.bin AND w.fold = 'whole' WHERE s.fold LIKE 'section%' GROUP BY s.source_id, s.fold),
        shaped AS (SELECT DISTINCT source_id, fold FROM unit WHERE u <> 0 AND fold LIKE 'section%'),
        far AS (SELECT source_id, max(d) AS d FROM (SELECT a.source_id, a.fold, b.fold AS g, sqrt(avg((a.u - b.u) * (a.u - b.u))) AS d FROM unit a JOIN unit b ON b.source_id = a.source_id AND b.bin = a.bin WHERE (a.source_id, a.fold) IN (SELECT (source_id, fold) FROM shaped) AND (b.source_id, b.fold) IN (SELECT (source_id, fold) FROM shaped) GROUP BY a.source_id, a.fold, b.fold) GROUP BY source_id),
        grown AS (SELECT source_id, CASE WHEN count(*) >= 2 THEN ln(max(amplitude) / greatest(min(amplitude), 1e-9)) ELSE 0 END AS g FROM cfold WHERE fold LIKE 'section%' AND amplitude > 0 GROUP BY source_id),
        e AS (SELECT c.source_id, min(likes) AS lo, max(likes) AS hi, count(*) FILTER (likes >= {_D(0.55)}) AS shaped, coalesce(any_value(far.d), 0) AS d, coalesce(any_value(g), 0) AS g FROM (SELECT DISTINCT source_id FROM cfold) c LEFT JOIN part USING (source_id) LEFT JOIN far USING (source_id) LEFT JOIN grown USING (source_id) GROUP BY c.source_id)
        SELECT source_id, {_r(f"d + {_D(0.5)} * greatest(0, 1 - coalesce(lo, 1)) + {_D(0.25)} * g", "evolution_raw_score")}, {_r("lo", "minimum_section_correlation")}, {_r("hi", "maximum_section_correlation")}, {_r("shaped", "sections_with_shape")}, {_r("d", "maximum_section_distance")}, {_r("g", "section_amplitude_log_range")} FROM e""",
    "profile_shape": f"""WITH {SHAPE_SQL} SELECT w.source_id, {", ".join(_r(x, n, 5) for n, x in _SHAPES.items())}
        FROM vw w LEFT JOIN rest USING (source_id) LEFT JOIN mirror USING (source_id) LEFT JOIN peaks USING (source_id) LEFT JOIN sinus USING (source_id)""",
    "wave_or_dip": f"WITH {MODELS_SQL} SELECT source_id, {_r('w', 'wave_model_score')}, {_r('d', 'dimming_model_score')}, {_r('d - w', 'wave_dimming_score_margin')} FROM ms",
    "dip_evidence": f"WITH {EVIDENCE_SQL} SELECT source_id, {', '.join(_r(x, n) for n, x in _EVIDENCE.items())} FROM ep JOIN cw USING (source_id)",
}
# Tables are used several times each: worked out once.
ORACLES = {k: v.replace(" AS (SELECT", " AS MATERIALIZED (SELECT") for k, v in ORACLES.items()}
