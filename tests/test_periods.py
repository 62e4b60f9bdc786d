"""Period search: relational and dense powers agree, injections are recovered, aliases and rules behave at their bounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.config import PeriodConfig
from chronofold.operators import aliases as A
from chronofold.operators import recommend as R
from chronofold.operators import series as S
from chronofold.operators import spectral as P


def curve(period, n=600, span=400.0, seed=3, second=0.0):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.uniform(58000, 58000 + span, n))
    x = 2 * np.pi * t / period
    return t, 0.3 * np.sin(x) + second * np.cos(x / 2) + rng.normal(0, 0.015, n), np.full(n, 0.015)


def prepared(spark, curves):
    rows = [(k, "o", i, float(a), "o", float(b), float(c)) for k, (t, y, e) in curves.items() for i, (a, b, c) in enumerate(zip(t, y, e))]
    return spark.createDataFrame(rows, "source_id string, series string, row_id long, mjd double, band string, y double, e double")


def weighted_power(t, y, e, f):
    w = 1 / e**2
    a = np.column_stack([np.ones_like(t), np.cos(2 * np.pi * f * t), np.sin(2 * np.pi * f * t)])
    coef = np.linalg.lstsq(a * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
    c0 = (w * (y - np.average(y, weights=w)) ** 2).sum()
    return 1 - (w * (y - a @ coef) ** 2).sum() / c0


def test_dense_power_is_least_squares():
    t, y, e = curve(12.7, 200)
    f0, df, n = P.frequency_grid(float(np.ptp(t)), 0.5, 100, 5)
    p = P.lomb_scargle(t, y, e, f0, df, n)
    for k in (0, 7, n // 2, n - 1):
        assert p[k] == pytest.approx(weighted_power(t, y, e, f0 + k * df), abs=1e-9)


def test_relational_power_is_dense_power(spark):
    t, y, e = curve(9.1, 150)
    freqs = [0.05 + 0.01 * i for i in range(20)]
    got = {r["frequency"]: r["power"] for r in P.ls_grid(prepared(spark, {"a": (t, y, e)}), freqs).collect()}
    want = P.lomb_scargle(t, y, e, 0.05, 0.01, 20)
    assert [got[f] for f in freqs] == pytest.approx(list(want), abs=1e-7)


def test_injections(spark):
    rows = prepared(spark, {"a": curve(12.7), "b": curve(3.3, seed=5)})
    out = {r["source_id"]: r for r in P.analyse(rows, with_bls=False).collect()}
    for k, want in (("a", 12.7), ("b", 3.3)):
        assert out[k]["status"] == "ok" and out[k]["raw_ls_best_period_days"] == pytest.approx(want, rel=1e-3) and out[k]["raw_ls_fap"] < 1e-6
    assert P.peak_table(P.analyse(rows, with_bls=False)).where("rank = 1").count() == 2


def test_box_is_found():
    rng = np.random.default_rng(1)
    t = np.sort(rng.uniform(0, 200, 600))
    y = rng.normal(0, 0.01, 600) - 0.2 * ((t % 5.3) < 0.4)
    period, sde = P.bls(t, y, np.full(600, 0.01), PeriodConfig(max_period=20))
    assert min(abs(period / 5.3 - k) for k in (1, 2, 0.5)) < 0.002 and sde > 6


def test_double_wave_is_supported_at_twice_the_period(spark):
    t = np.sort(np.random.default_rng(2).uniform(0, 400, 2400))
    x = 2 * np.pi * t / 14.2
    y = 0.5 * np.cos(2 * x) + 0.22 * np.cos(x)
    rows = prepared(spark, {"d": (t, y, np.full(2400, 0.015)), "s": (t, 0.3 * np.sin(2 * x), np.full(2400, 0.015))})
    periods = spark.createDataFrame([("d", 7.1), ("s", 7.1)], "source_id string, period double")
    got = {r["source_id"]: r["two_p_supported"] for r in S.odd_even(S.folded(rows, periods)).collect()}
    assert got == {"d": True, "s": False}


def test_broken_series_is_reported(spark):
    rows = spark.createDataFrame([("x", "o", 1, 5.0, "o", 1.0, 0.1)], "source_id string, series string, row_id long, mjd double, band string, y double, e double")
    assert P.analyse(rows).first()["status"] == "failed"


def peaks(spark, stars, series=("o", "c"), period=7.321):
    rows = [(str(i), s, 1, period, 1.0, 1.0, 12.0, 22.0, 0.0) for i in range(stars) for s in series] + [(str(i), s, 2, 1.0, 0.5, 0.5, 12.0, 22.0, 0.0) for i in range(stars) for s in series]
    return spark.createDataFrame(rows, "source_id string, series string, rank int, period_days double, power double, power_fraction_of_best double, ra_deg double, dec_deg double, raw_sampling_window_power double")


def test_alias_learning_counts_stars_once(spark):
    got = A.learn_inventory(peaks(spark, 8)).collect()
    assert len(got) == 1 and (got[0]["n_stars_hit"], got[0]["n_stars_in_field"], got[0]["hit_fraction"]) == (8, 8, 1.0)
    assert A.learn_inventory(peaks(spark, 4)).isEmpty()
    both = peaks(spark, 8).unionByName(peaks(spark, 8))
    assert A.learn_inventory(both).first()["n_stars_hit"] == 8
    mixed = peaks(spark, 8).unionByName(peaks(spark, 8, ("combined",), 11.0))
    assert [round(r["alias_period_days"], 3) for r in A.learn_inventory(mixed).collect()] == [11.0]


def test_alias_replacement(spark):
    rows = [("a", "o", 1, 1.0, 1.0, 1.0), ("a", "o", 2, 7.7, 0.5, 0.5), ("b", "o", 1, 1.0, 1.0, 1.0), ("b", "o", 2, 2.0001, 0.6, 0.6), ("b", "o", 3, 3.7, 0.1, 0.1), ("c", "o", 1, 5.5, 1.0, 1.0), ("c", "o", 2, 9.0, 0.9, 0.9)]
    p = spark.createDataFrame([(*r, 1.0, 1.0, 0.0) for r in rows], "source_id string, series string, rank int, period_days double, power double, power_fraction_of_best double, ra_deg double, dec_deg double, raw_sampling_window_power double")
    inv = spark.createDataFrame([], A.INVENTORY)
    got = {r["source_id"]: (r["recommended_series_period_days"], r["alias_correction_applied"], r["series_confidence_class"]) for r in A.replace(A.score(p, inv)).collect()}
    assert got == {"a": (7.7, True, "alias_corrected"), "b": (1.0, False, "alias_period_possible_true_or_artifact"), "c": (5.5, False, "non_alias_period")}


def series(spark, **change):
    base = dict(recommended_series_period_days=5.0, raw_ls_best_power=0.5, raw_ls_fap=1e-5, ls_peak_snr=10.0, raw_fold_amp_snr=10.0, raw_fold_scatter_reduction=0.5, best_to_second_power_ratio=2.0, best_to_fourth_power_ratio=2.5, raw_alias_score=0.0)
    base |= {k: v for k, v in change.items() if k in base}
    flags = dict(top4_flat=False, raw_is_alias_suspect=False, alias_correction_applied=False, two_p_supported=False, mh_2p_supported=False, top_peak_2p_present=False) | {k: v for k, v in change.items() if k not in base and k != "series"}
    kinds = ", ".join([f"{k} double" for k in base] + [f"{k} boolean" for k in flags])
    return spark.createDataFrame([("s", change.get("series", "o"), *base.values(), *flags.values(), None, None)], f"source_id string, series string, {kinds}, bls_best_period_days double, catalogue_period_days double")


@pytest.mark.parametrize(("fold", "peak", "ok"), [(2.99, 10.0, False), (3.0, 10.0, True), (10.0, 3.99, False), (10.0, 4.0, True), (None, 10.0, False)])
def test_single_filter_gates(spark, fold, peak, ok):
    r = R.recommend(series(spark, raw_fold_amp_snr=fold, ls_peak_snr=peak)).first()
    assert ("single_filter_below_snr_thresholds" in r["warning_flags"]) is not ok
    assert r["recommended_period_source"] == ("o_single_filter" if ok else "o_low_support")


def test_two_bands_agree_on_the_o_anchor(spark):
    both = series(spark, recommended_series_period_days=12.7).unionByName(series(spark, series="c", recommended_series_period_days=12.76))
    r = R.recommend(both).first()
    assert (r["recommended_period_days"], r["recommended_period_source"], r["confidence_class"]) == (12.7, "o_c_consensus", "secure_non_alias")
    both = series(spark, recommended_series_period_days=12.7).unionByName(series(spark, series="c", recommended_series_period_days=25.4))
    assert R.recommend(both).first()["recommended_period_days"] == 12.7


def test_missing_ratio_is_not_dominance(spark):
    row = R.evidence(series(spark, best_to_second_power_ratio=None, best_to_fourth_power_ratio=None)).first()
    assert not row["dominant"] and row["significant"]


def test_partitioning_does_not_matter(spark):
    rows = prepared(spark, {str(i): curve(4 + i, 100, seed=i) for i in range(5)})
    one = P.analyse(rows.coalesce(1), with_bls=False, partitions=1).orderBy("source_id").select("source_id", F.round("raw_ls_best_period_days", 9).alias("p")).collect()
    many = P.analyse(rows.repartition(7), with_bls=False, partitions=5).orderBy("source_id").select("source_id", F.round("raw_ls_best_period_days", 9).alias("p")).collect()
    assert one == many


def test_box_search_tells_short_durations_apart_at_long_periods():
    """A dip of 0.1 d every 31.7 d fills a twelfth of what a bin of P / 120 would make of it with its neighbours."""
    import numpy as np

    from chronofold.config import PeriodConfig
    from chronofold.operators import spectral

    rng = np.random.default_rng(8)
    span = 400.0
    period = 1 / (1 / 50 + 7 / (15 * span))  # on the search's own grid, which is coarser than a short dip at long periods
    t = np.sort(np.concatenate([[0.0, span], rng.uniform(0, span, 1500), *[k * period + 3 + rng.uniform(-0.25, 0.25, 30) for k in range(8)]]))
    y = rng.normal(0, 0.02, len(t)) - 0.1 * (np.abs((t - 3 + period / 2) % period - period / 2) < 0.05)
    best, sde = spectral.bls(t, y, np.full(len(t), 0.02), PeriodConfig())
    assert abs(best - period) / period < 1e-6


def test_period_queries_cover_every_gated_series(spark, tmp_path, monkeypatch):
    from chronofold.plans import periods

    rows = spark.createDataFrame([("a", s) for s in ("c", "o", "combined")], "source_id string, series string")
    seen = {}
    monkeypatch.setattr(periods, "prepared", lambda *_: rows)
    monkeypatch.setattr(periods.S, "gate", lambda r: r.selectExpr("*", "'ok' as status"))

    def analyse(r, **_):
        seen["series"] = {x["series"] for x in r.collect()}
        raise StopIteration

    monkeypatch.setattr(periods.P, "analyse", analyse)
    for query in (periods.bls, periods.ls_dense):
        with __import__("pytest").raises(StopIteration):
            query(spark, "")
        assert seen.pop("series") == {"c", "o", "combined"}


def test_fold_coherence_is_linear_in_points(spark):
    """Four times the points of one series take at most about four times as long, and the result is that of plain formulas."""
    import time

    from chronofold.operators.series import fold_coherence

    def timed(n):
        rows = spark.range(n).select(F.lit(1).alias("source_id"), F.lit("o").alias("series"), F.rand(1).alias("phase"), F.randn(2).alias("y"), F.lit(0.1).alias("e")).cache()
        rows.count()
        best = min(_elapsed(lambda: fold_coherence(rows).collect()) for _ in range(3))
        got, pdf = fold_coherence(rows).first(), rows.toPandas()
        rows.unpersist()
        return best, got, pdf

    def _elapsed(f):
        began = time.time()
        f()
        return time.time() - began

    few, _, _ = timed(10_000)
    many, got, pdf = timed(40_000)
    assert many < 5 * few + 1
    n_bins = PeriodConfig().fold_bins
    bins = np.minimum((pdf.phase * n_bins).astype(int), n_bins - 1)
    res = pdf.y - pdf.y.groupby(bins).transform("median")
    mad = lambda v: 1.4826 * np.median(np.abs(v - np.median(v)))
    assert got["fold_valid_bins"] == n_bins
    assert got["fold_scatter_reduction"] == pytest.approx((mad(pdf.y) - mad(res)) / mad(pdf.y), rel=1e-3)


def test_searches_are_dealt_to_many_tasks_after_a_join_by_their_key(spark):
    rows = prepared(spark, {f"s{i}": curve(5.0, 60, seed=i) for i in range(12)})
    gates = rows.select("source_id", "series").distinct().hint("merge")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = P.analyse(rows.join(gates, ["source_id", "series"], "left_semi"), with_bls=False)
        assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_fast_transform_is_the_sum_and_box_search_the_plain_search():
    t, y, e = curve(9.1, 150)
    t = t - t.min()
    weights = [1 / e**2 / (1 / e**2).sum(), y]
    for f0, df, n, most in ((0.005, 1 / (15 * t.max()), 20_001, 1e-11), (0.01, 2 / (15 * t.max()), 5_000, 1e-11), (0.3, 0.37, 4_500, 1e-8)):  # angles of the last are large
        for got, want in zip(P._sums(t, weights, f0, df, n), P._products(t, weights, f0, df, n)):
            assert np.abs(got - want).max() < most * np.abs(weights[1]).sum()
    cfg = PeriodConfig(max_period=20)
    span, w = t.max(), weights[0]
    f0, df, n = P.frequency_grid(span, 0.5, min(50, span / 3), cfg.samples_per_peak)
    wy, best = w * (y - (w * y).sum()), np.zeros(n)
    for i in range(n):
        first = f0 + df * (i // 256 * 256)
        f, bins = f0 + df * i, max(120, int(np.ceil(2 / (first * 0.05))))
        k = ((f * t - np.floor(f * t)) * bins).astype(int)
        r, s = (np.concatenate([[0], np.cumsum(np.tile(np.bincount(k, v, bins), 2))]) for v in (w, wy))
        for d in cfg.bls_durations:
            q = int(np.clip(np.round(d * f * bins), 1, bins // 2))
            rr, dip = r[q : q + bins] - r[:bins], np.minimum(s[q : q + bins] - s[:bins], 0)
            full = rr * (1 - rr) > 0
            best[i] = max(best[i], (np.abs(dip[full]) / np.sqrt((rr * (1 - rr))[full])).max(initial=0))
    period, _ = P.bls(t, y, e, cfg)
    assert period == pytest.approx(1 / (f0 + df * best.argmax()))
    assert P.bls(t, y, e, cfg)[1] == pytest.approx((best.max() - np.median(best)) / (1.4826 * np.median(np.abs(best - np.median(best)))))


def test_a_crowded_field_is_learnt_in_time(spark):
    """40,000 stars in one field near one period: a median of all members at each step took the square of that."""
    import time

    peaks = spark.range(40_000).select(
        F.col("id").cast("string").alias("source_id"), F.lit("combined").alias("series"), F.lit(1).alias("rank"),
        (7.3 + 0.01 * F.sin(F.col("id"))).alias("period_days"), F.lit(1.0).alias("ra_deg"), F.lit(1.0).alias("dec_deg"),
    )
    from chronofold.operators import aliases

    start = time.time()
    (row,) = aliases.learn_inventory(peaks).collect()
    assert row["n_stars_hit"] == row["n_stars_in_field"] == 40_000 and row["alias_period_days"] == pytest.approx(7.3, abs=1e-6)
    assert time.time() - start < 20


def test_rates_count_the_searchable_and_work_is_dealt(spark, tmp_path):
    from chronofold.operators import recommend
    from chronofold.sources.adapters import series_rows

    rows = [("o", "direct"), ("o", "mismatch"), ("o", "P/2"), ("o", "no_recovered_period"), ("o", "no_catalogue_period"), ("o", None), ("c", "no_catalogue_period"), ("c", None)]
    got = recommend.validation_rates(spark.createDataFrame(rows, "series string, match string"), "series", "match").collect()
    assert [tuple(r) for r in got] == [("o", 4, 0.25, 0.5)]
    spark.range(1, 4000).selectExpr("id p_partkey", "cast(id % 50 as int) p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    parts = series_rows(spark, str(tmp_path)).selectExpr("spark_partition_id() p").distinct().count()
    assert parts > spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("kind", ["dips", "outlier", "uneven", "flat"])
def test_few_boxes_are_met_in_double_precision_and_none_is_missed(kind, monkeypatch):
    """The result is that of all boxes in double precision, with a point far off, errors from 0.001 to 10, or no signal at all."""
    r = np.random.default_rng(5)
    t = np.sort(r.uniform(0, 300, 250))
    y, e = r.normal(0, 0.3, 250) - 0.5 * ((t % 7.7) < 0.4), np.full(250, 0.1)
    y[3] += 1000.0 * (kind == "outlier")
    y *= kind != "flat"
    e = 10.0 ** r.uniform(-3, 1, 250) if kind == "uneven" else e
    plain, asked = P._boxes, []
    monkeypatch.setattr(P, "_boxes", lambda sums, *a: asked.append(len(sums)) or plain(sums, *a))
    got = P.bls(t, y, e, PeriodConfig())
    n = P.frequency_grid(np.ptp(t), 0.5, 50.0, PeriodConfig().samples_per_peak)[2]
    assert sum(asked) < n / 10 if kind == "dips" else sum(asked) <= n
    monkeypatch.setattr(P, "_rough_boxes", plain)
    assert P.bls(t, y, e, PeriodConfig()) == pytest.approx(got, rel=1e-12, nan_ok=True)


def test_rough_boxes_keep_their_bound():
    """Also with shares of a billionth and boxes that hold all or nothing."""
    r = np.random.default_rng(2)
    for n in (30, 400):
        w = 10.0 ** r.uniform(-9, 0, n)
        w, y = w / w.sum(), r.normal(0, 1, n)
        y -= (w * y).sum()
        y /= np.abs(y).max()
        bins, f, t = 120, np.linspace(0.4, 0.5, 200), np.sort(r.uniform(0, 500, n))
        room = [np.empty((P.BINNED, n), k) for k in (float, float, np.int32, np.int64)]
        sums = P._binned(f, t, np.tile(w + 1j * w * y, (P.BINNED, 1)), bins, room, np.empty(len(f) * (bins + 1), complex))
        width = np.sort(r.integers(1, bins // 2, (4, len(f))), axis=1)
        held = np.empty((6, len(f) * (bins + bins // 2)), np.float32)
        assert np.abs(P._rough_boxes(sums, bins, width, held) - P._boxes(sums, bins, width, held)).max() < P.ROUGH


def test_long_grids_take_a_short_transform(monkeypatch):
    """A grid of 15 frequencies a turn of the baseline has a transform of some two a turn, and gives the sums of plain ones."""
    t, y, e = curve(9.1, 150)
    t = t - t.min()
    plain, asked = np.fft.ifft, []
    monkeypatch.setattr(np.fft, "ifft", lambda x, *a, **k: asked.append(np.size(x)) or plain(x, *a, **k))
    n, df = 20_001, 1 / (15 * t.max())
    (got,), (want,) = (f(t, [y], 0.005, df, n) for f in (P._sums, P._products))
    assert np.abs(got - want).max() < 1e-11 * np.abs(y).sum() and 0 < sum(asked) < n


def test_a_series_goes_to_python_as_arrow(spark):
    plan = P.analyse(prepared(spark, {"s": curve(5.0, 60)}), with_bls=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "InArrow" in plan and "InPandas" not in plan
