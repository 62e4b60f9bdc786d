"""Saved maps: fit, transform, relabel, families, neighbours, validation; receipts; the command line's settings."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold import __main__ as cli
from chronofold.config import MorphologyConfig, PeriodConfig, configured, overridden
from chronofold.functions.columns import mjd_to_utc, utc_to_mjd
from chronofold.operators import measures as P
from chronofold.operators import reports
from chronofold.plans import maps
from chronofold.plans.pipeline import RunConfig
from chronofold.sources import io
from test_measures import star

KINDS = ("wave", "dip", "none", "flare", "evolving")


@pytest.fixture(scope="module")
def features(spark, tmp_path_factory):
    rows = []
    for s in range(20):
        t, m, e, b, p = star(KINDS[s % 5], 50 + s, 300)  # enough points for waves to pass the periodic gate
        rows += [(f"s{s:02d}", i, *map(float, x), str(f), p) for i, (*x, f) in enumerate(zip(t, m, e, b))]
    points = spark.createDataFrame(rows, "source_id string, row_id long, time double, mag double, err double, filter string, period double")
    path = str(tmp_path_factory.mktemp("features"))
    P.source_features(points).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def saved(spark, features, tmp_path_factory):
    m = maps.Maps(spark, f"file://{tmp_path_factory.mktemp('maps')}/m")
    m.fit(features.where("source_id < 's15'"))
    return m


def placed(df):
    return {r["source_id"]: (r["combined_1"], r["combined_2"], r["evidence_1"]) for r in df.collect()}


def test_transform_leaves_saved_coordinates(spark, features, saved):
    before = placed(saved.read("catalogue"))
    assert len(before) == 15 and all(np.isfinite(v).all() for v in before.values()) and saved.generation() == 0
    after = saved.transform(features)
    now = placed(after)
    assert len(now) == 20 and {k: now[k] for k in before} == before and saved.generation() == 1
    assert {r["source_id"] for r in after.where("is_latest_batch").collect()} == {f"s{i}" for i in range(15, 20)}
    assert after.where("is_latest_batch and out_of_distribution_score is null").count() == 0
    assert placed(saved.transform(features)) == now and saved.generation() == 1  # nothing new
    with pytest.raises(ValueError):
        saved.transform(features, existing="error")
    with pytest.raises(ValueError, match="feature settings"):
        maps.Maps(spark, saved.root, MorphologyConfig(phase_bins=32)).transform(features)
    # A known source's place is that of the fit.
    again = saved._place(saved.read("features").where("source_id = 's03'"), "periodic").first()
    assert again["periodic_1"] == pytest.approx(saved.read("catalogue").where("source_id = 's03'").first()["periodic_1"])


def test_relabel_takes_thresholds_and_manual_labels(spark, features, saved):
    before = {r["source_id"]: r for r in saved.read("catalogue").collect()}
    manual = spark.createDataFrame([("s02", "main", "transit")], "source_id string, dataset string, manual_primary_tag string")
    strict = maps.Maps(spark, saved.root, dataclasses.replace(saved.cfg, thresholds={"periodic_chi2": 1e9}))
    after = {r["source_id"]: r for r in strict.relabel(manual).collect()}
    assert after["s02"]["final_primary_tag"] == "transit" and after["s02"]["label_source"] == "manual"
    waves = [k for k in before if before[k]["primary_tag"] == "wavelike"]
    assert waves and all(after[k]["primary_tag"] != "wavelike" for k in waves)  # no profile passes the stricter gate
    assert all(after[k]["combined_vector"] == before[k]["combined_vector"] and after[k]["profile_chi2"] == before[k]["profile_chi2"] for k in before)


def test_neighbours_and_validation(spark, saved):
    near = saved.neighbours("s00", 4)
    assert near.groupBy("space").count().where("count = 4").count() == 2
    with pytest.raises(ValueError):
        saved.neighbours("nobody")
    v = saved.validation()
    rows = v["sources"].collect()
    assert len(rows) == saved.read("catalogue").count() and all(0 <= r["agreement_at_5"] <= 1 and r["classification_score_margin"] >= 0 for r in rows)
    assert v["categories"].agg(F.sum("n_sources")).first()[0] == len(rows) and v["anchors"].where("rank > 5").isEmpty()
    assert maps.scalar_space(saved.read("catalogue")).where(F.size("v") != len(maps.SCALARS)).isEmpty()


@pytest.mark.parametrize("block", [1024, 7])
def test_typical_rows_are_medoids(spark, block):
    rng = np.random.default_rng(0)
    x, label = rng.normal(0, 1, (60, 3)), [f"k{i % 3}" for i in range(60)]
    df = spark.createDataFrame([(i, label[i], [float(a) for a in x[i]]) for i in range(60)], "id long, label string, v array<double>")
    got = {r["id"]: r["distance"] for r in maps.typical_distances(df, block).collect()}
    for name in set(label):
        own = [i for i in range(60) if label[i] == name]
        best = min(own, key=lambda i: sum(np.linalg.norm(x[i] - x[j]) for j in own))
        assert all(got[i] == pytest.approx(np.linalg.norm(x[i] - x[best])) for i in own)


def test_family_summary(spark):
    rows = [("main", "transit", 0.0, 0.0), ("main", "wavelike", 2.0, 4.0), ("main", "wavelike", 4.0, 2.0), ("family_1", "noisy", 9.0, 9.0)]
    got = {r["family"]: r for r in maps.family_summary(spark.createDataFrame(rows, "family string, final_primary_tag string, x double, y double"), "x", "y").collect()}
    assert (got["main"]["n_sources"], got["main"]["centroid_1"], got["main"]["minimum_2"], got["main"]["maximum_2"], got["main"]["dominant_category"]) == (3, 2.0, 0.0, 4.0, "wavelike")
    assert got["family_1"]["dominant_category"] == "noisy"


def test_sweep_and_trust(spark, features):
    rows = maps.weight_sweep(features, {"plain": {}, "amplitude": {"log_amplitude": 1e6}})
    assert {r["choice"] for r in rows} == {"plain", "amplitude"} and rows[0]["preserved"] >= rows[1]["preserved"]
    near = maps.E.nearest
    pts = spark.createDataFrame([(i, [float(i)]) for i in range(12)], "id long, v array<double>")
    swapped = pts.withColumn("v", F.array(F.when(F.col("id") == 0, F.lit(11.5)).otherwise(F.col("v")[0])))
    ranks = near(pts, pts, 11)
    assert maps.trustworthiness(near(pts, pts, 2), near(pts, pts, 2), ranks, 12, 2) == 1
    assert maps.trustworthiness(near(pts, pts, 2), near(swapped, swapped, 2), ranks, 12, 2) < 1


def test_reports_and_event_validation(spark, features, saved):
    table = saved.read("catalogue")
    events = P.event_table(features)
    known = reports.event_validation(events, table)
    assert known.count() == events.count() and known.where("final_primary_tag is null").isEmpty()
    earlier = known.where("source_id in ('s03', 's08')")
    both = reports.event_validation(events.where("source_id = 's03'"), table, earlier)
    assert both.count() == known.where("source_id in ('s03', 's08')").count()
    assert set(r["final_primary_tag"] for r in reports.transit_diagnostics(table).collect()) <= {"transit"}
    for f in (reports.transit_ambiguous, reports.seasonal_false_positives, reports.irregular_summary, reports.coverage_and_period_flags):
        assert f(table).columns[0] == "source_id" and f(table).count() <= table.count()


def test_settings_are_checked(tmp_path):
    for bad in ({"min_period": 0}, {"max_period": float("nan")}, {"min_period": 300.0}, {"fap_threshold": 2}, {"n_peaks": "many"}, {"bls_durations": []}):
        with pytest.raises(ValueError):
            configured(PeriodConfig, bad)
    with pytest.raises(ValueError):
        RunConfig.of({"morphology": {"preset": "other"}})
    assert overridden({"periods": {"n_peaks": 3}}, ["periods.n_peaks=5", "bls=false", "clean.bands=[\"c\"]"]) == {"periods": {"n_peaks": 5}, "bls": False, "clean": {"bands": ["c"]}}
    (tmp_path / "c.yaml").write_text("input: in\noutput: /out\nperiods: {n_peaks: 4}\n")
    got = cli.settings(str(tmp_path / "c.yaml"), ["periods.n_peaks=6"])
    assert got == {"input": str(tmp_path / "in"), "output": "/out", "periods": {"n_peaks": 6}}
    assert cli.parser().parse_args(["transform", "c.yaml", "--existing", "replace"]).existing == "replace"


def test_listing_digest_follows_the_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("MJD,F\n1,o\n")
    before = io.listing_digest(spark, str(tmp_path))
    assert before == io.listing_digest(spark, str(tmp_path))
    (tmp_path / "a.csv").write_text("MJD,F\n1,o\n2,o\n")
    assert before != io.listing_digest(spark, str(tmp_path))


def test_curves_are_parsed_in_the_executors(spark, tmp_path):
    (tmp_path / "gaia_77.csv").write_text('MJD,F,"uJy"\r\n59000.5,o,"1,5"\r\n\r\n59001.5,c,2\r\n')
    (tmp_path / "star.csv").write_text("mjd, filter\n59002.5,o,extra\n59003.5\n")
    got = io.read_curves(spark, str(tmp_path)).collect()
    assert sorted((r["source_id"], r["F"], r["uJy"], r["filter"]) for r in got if r["source_id"] == "77") == [("77", "c", "2", None), ("77", "o", "1,5", None)]
    assert sorted((r["source_id"], r["filter"] or "") for r in got if r["source_id"] == "star") == [("star", ""), ("star", "o")]
    assert {r["source_id"] for r in io.read_curves(spark, str(tmp_path), max_files=1).collect()} == {"77"}


def test_dates(spark):
    row = spark.sql("SELECT 59000.25D AS m, timestamp '2020-05-31 06:00:00' AS t").select(mjd_to_utc(F.col("m")).alias("u"), utc_to_mjd(F.col("t")).alias("d"), F.col("t")).first()
    assert row["u"] == row["t"] and row["d"] == 59000.25
