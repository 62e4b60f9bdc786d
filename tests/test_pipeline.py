"""The whole run on synthetic stars, restarts, streaming parity, readers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.operators import clean as C
from chronofold.operators import embed as E
from chronofold.operators import features as M
from chronofold.plans.pipeline import Run, RunConfig
from chronofold.sources import io
from chronofold.streaming import incremental


def stars(spark, n=6, points=360, seed=42):
    rng = np.random.default_rng(seed)
    rows, truth = [], {}
    for s in range(n):
        period = 8.3 + 1.7 * s
        t = np.sort(rng.uniform(58000, 59100, points))
        kind = ("wave", "dip", "none")[s % 3]
        ph = t / period % 1
        m = 15 + (0.25 * np.sin(2 * np.pi * ph) if kind == "wave" else 0.9 * np.exp(-0.5 * (np.minimum(abs(ph - 0.5), 1 - abs(ph - 0.5)) / 0.045) ** 2) if kind == "dip" else 0) + rng.normal(0, 0.025, points)
        truth[str(s)] = (period, kind)
        for i in range(points):
            f = 10 ** ((23.9 - m[i]) / 2.5)
            rows.append((str(s), s * 1000 + i, float(t[i]), "co"[i % 2], float(m[i]), 0.025, float(f), float(f * 0.025 / 1.0857), 0.0, 19.0, 19.0))
    return spark.createDataFrame(rows, "source_id string, row_id long, mjd double, band string, m double, dm double, ujy double, dujy double, err double, mag5sig double, sky double"), truth


def test_whole_run_recovers_periods_and_restarts(spark, tmp_path):
    obs, truth = stars(spark)
    cfg = RunConfig.of({"periods": {"max_period": 50.0, "samples_per_peak": 8}, "bls": False, "strict": True})
    run = Run(spark, f"file://{tmp_path}", cfg)
    out = {r["source_id"]: r for r in run.all(obs, "v1").collect()}
    assert run.ran == ["clean", "select", "periods", "morphology"] and set(out) == set(truth)
    found = {r["source_id"]: r for r in run.read("periods", "recommendations").collect()}
    for s, (period, kind) in truth.items():
        if kind == "wave":
            assert min(abs(found[s]["photometric_period_days"] / period - k) for k in (1, 2)) < 1e-3
            assert out[s]["primary_tag"] in ("wavelike", "transit")
        if kind == "none":
            assert out[s]["primary_tag"] not in ("transit", "flaring")
    again = Run(spark, f"file://{tmp_path}", cfg)
    again.all(obs, "v1")
    assert again.ran == []
    changed = Run(spark, f"file://{tmp_path}", RunConfig.of({"periods": {"max_period": 50.0, "samples_per_peak": 8}, "bls": False, "morphology": {"preset": "code"}}))
    changed.all(obs, "v1")
    assert changed.ran == ["morphology"]
    with pytest.raises(ValueError):
        RunConfig.of({"cleen": {}})


def test_stream_of_audits_is_the_batch(spark, tmp_path):
    obs, _ = stars(spark, 2, 60)
    obs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = incremental.audited(incremental.read_observations(spark, str(tmp_path / "in"), obs.schema, max_files=1))
    q = stream.select("source_id", "row_id", "standard_keep").writeStream.format("memory").queryName("audits").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = ["source_id", "row_id", "standard_keep"]
    assert sorted(map(tuple, spark.table("audits").collect())) == sorted(map(tuple, C.audit(obs).select(*key).collect()))


def test_stream_appends_only_new_keys(spark, tmp_path):
    known = spark.createDataFrame([(1, "old")], "k long, v string")
    spark.createDataFrame([(1, "new"), (2, "new"), (2, "new")], "k long, v string").write.parquet(str(tmp_path / "in"))
    stream = incremental.read_observations(spark, str(tmp_path / "in"), "k long, v string")
    q = incremental.append_new(stream, lambda: known, lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out")), ["k"], str(tmp_path / "c"))
    q.awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(2, "new")]


def test_alias_memory_grows_by_batches(spark, tmp_path):
    from chronofold.operators.aliases import INVENTORY, merge_memory

    rows = [(1, 2, "1_2", 1.0, 10, 5, 0.5), (1, 2, "1_2", 1.01, 10, 4, 0.4), (3, 4, "3_4", 2.0, 20, 8, 0.4)]
    src, root = str(tmp_path / "in"), f"file://{tmp_path}/memory"
    for i, r in enumerate(rows):
        spark.createDataFrame([r], INVENTORY).coalesce(1).write.parquet(f"{src}/{i}")
    stream = spark.readStream.schema(INVENTORY).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(src)
    incremental.alias_memory(stream, root, str(tmp_path / "c")).awaitTermination()
    got = sorted(tuple(r) for r in incremental.remembered(spark, root).collect())
    assert got == sorted(tuple(r) for r in merge_memory(spark.createDataFrame(rows, INVENTORY)).collect())
    assert incremental.remembered(spark, f"{root}-none") is None


def test_sessions_of_a_stream_are_the_batch_islands(spark, tmp_path):
    ts = lambda day, hour: f"2024-01-{day:02d} {hour:02d}:00:00"
    rows = [("a", ts(1, 1), 6.0), ("a", ts(1, 3), 7.0), ("a", ts(2, 2), 6.5), ("a", ts(9, 1), 8.0), ("b", ts(3, 20), 5.5), ("b", ts(3, 23), 9.0), ("a", ts(28, 1), 6.0)]
    df = spark.createDataFrame(rows, "source_id string, t string, value double").select("source_id", F.to_timestamp("t").alias("ts"), "value")
    df.write.parquet(str(tmp_path / "in"))
    stream = incremental.excursion_sessions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").outputMode("append").queryName("sessions").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["source_id"], r["start"], r["n"], r["peak"]) for r in spark.table("sessions").collect())
    p = df.select("source_id", F.unix_micros("ts").alias("row_id"), (F.unix_micros("ts") / F.lit(86400e6)).alias("time"), F.lit(0.1).alias("err"), F.lit("o").alias("filter"), F.col("value").alias("z"))
    want = M.excursion_events(p, sigma=5.0).select("source_id", "n_measurements", "peak_residual_significance").collect()
    # The last session stays open until the watermark passes it.
    assert sorted((s, n, x) for s, _, n, x in got) == sorted((r[0], r[1], r[2]) for r in want if (r[0], r[2]) != ("a", 6.0) or r[1] != 1)


def test_csv_curves_with_different_headers(spark, tmp_path):
    (tmp_path / "1234567890123456789.csv").write_text("###MJD,F,uJy,duJy\n59000.5,o,100,5\n")
    (tmp_path / "b.csv").write_text("MJD, F,m,dm\n59001.5,c,15,0.1\n")
    (tmp_path / "x_cleaned.csv").write_text("MJD,F\n1,o\n")
    rows = io.read_curves(spark, str(tmp_path)).collect()
    assert {r["source_id"] for r in rows} == {"1234567890123456789", "b"}


def test_events_and_profiles(spark):
    rows = [("s", i, 59000.0 + i * 0.01, 15.0, 0.02, "o", 3.0) for i in range(80)] + [("s", 100 + i, 59010.1 + 0.01 * i, 14.0, 0.02, "o", 3.0) for i in range(3)] + [("s", 200, 59020.95, 16.0, 0.02, "o", 3.0), ("s", 201, 59021.05, 16.0, 0.02, "o", 3.0)]
    p = spark.createDataFrame(rows, "source_id string, row_id long, time double, mag double, err double, filter string, period double").withColumn("z", (F.col("mag") - 15) / 0.02)
    got = sorted((r["event_type"], r["n_measurements"], r["passes_quality_validation"]) for r in M.excursion_events(p).collect())
    assert got == [("brightening", 3, True), ("dimming", 1, False), ("dimming", 1, False)]


def test_append_policies(spark):
    old, new = spark.createDataFrame([(1, "a")], "k long, v string"), spark.createDataFrame([(1, "b"), (2, "c")], "k long, v string")
    rows = lambda how: sorted(map(tuple, E.append(old, new, ["k"], how).collect()))
    assert rows("skip") == [(1, "a"), (2, "c")] and rows("replace") == [(1, "b"), (2, "c")]
    with pytest.raises(ValueError):
        E.append(old, new, ["k"], "error")


def test_families_of_two_blobs(spark):
    rng = np.random.default_rng(0)
    pts = [(i, [float(x), float(y)]) for i, (x, y) in enumerate(np.concatenate([rng.normal(0, 0.3, (150, 2)), rng.normal(20, 0.3, (60, 2))]))]
    got = E.density_families(spark.createDataFrame(pts, "id long, v array<double>"), least=20).groupBy("family").count().collect()
    sizes = {r["family"]: r["count"] for r in got}
    assert sizes["main"] > 130 and sizes["family_1"] > 45


def test_families_match_a_plain_search_and_need_few_plans(spark, monkeypatch):
    """Bodies of any shape, copies of one point and rims: the bodies of all pairs; no round of its own for each step of a long chain."""
    from chronofold.operators import graph

    r = np.random.default_rng(4)
    ring = np.linspace(0, 2 * np.pi, 240)
    v = np.concatenate([r.normal(0, 0.4, (200, 2)), np.stack([9 * np.cos(ring), 9 * np.sin(ring)], 1), np.full((150, 2), 3.5), r.uniform(-12, 12, (30, 2)), r.normal(30, 0.3, (40, 2))])
    ids = r.permutation(len(v))
    d = np.sqrt(((v[:, None] - v) ** 2).sum(2))
    kth = np.sort(d, axis=1)[:, 5]
    eps = np.quantile(kth, 0.95)
    core = kth <= eps
    body = np.where(core, ids, len(v))
    while True:
        new = np.where(core, np.where((d <= eps) & core, body, len(v)).min(1), len(v))
        if (new == body).all():
            break
        body = new
    body = np.where(core, body, np.where((d <= eps) & core, body, len(v)).min(1))
    kinds, n = np.unique(body[body < len(v)], return_counts=True)
    order = kinds[np.lexsort((kinds, -n))]
    want = {int(i): "none" for i in ids}
    for i, b in zip(ids, body):
        at = int(np.flatnonzero(order == b)[0]) if b < len(v) else None
        if at is not None and (at == 0 or n[kinds == b][0] >= 20):
            want[int(i)] = f"family_{at}" if at else "main"
    assert len(set(want.values())) >= 4 and not core.all()
    cut, seen = graph.cut_lineage, []
    monkeypatch.setattr(graph, "cut_lineage", lambda df: seen.append(1) or cut(df))
    points = spark.createDataFrame([(int(i), [float(a), float(b)]) for i, (a, b) in zip(ids, v)], "id long, v array<double>")
    for few, most in ((graph.FEW_LINKS, 8), (0, 99)):
        monkeypatch.setattr(graph, "FEW_LINKS", few)
        seen.clear()
        assert dict(E.density_families(points, least=20).collect()) == want
        assert len(seen) <= most
