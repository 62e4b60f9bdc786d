"""Table functions in SQL against the native forms."""

import numpy as np
import pytest

from chronofold.functions import tables
from chronofold.operators import features as M
from chronofold.operators import spectral as P


def test_peaks_of_a_table(spark):
    tables.register(spark)
    rng = np.random.default_rng(2)
    rows = [(f"s{i % 3}", "o" if i % 2 else "c", 0.05 + 0.01 * (i // 6), float(p)) for i, p in enumerate(rng.normal(0, 1, 600))]
    rows += [("flat", "c", 0.1 * k, 1.0) for k in range(1, 9)] + [("gap", "c", 0.1 * k, None if k == 4 else float(k % 3)) for k in range(1, 9)] + [("one", "c", 0.5, 1.0)]
    grid = spark.createDataFrame(rows, "source_id string, series string, frequency double, power double").repartition(5)
    grid.createOrReplaceTempView("test_grid")
    for n, separation in ((12, 0.02), (3, 0.3), (0, 0.02)):
        got = sorted(tuple(r) for r in spark.sql(f"SELECT * FROM spectral_peaks(TABLE(test_grid), {n}, {separation}D)").collect())
        want = sorted((r["source_id"], r["series"], r["rank"], r["period"], r["power"]) for r in P.top_peaks(grid, n, separation).collect())
        assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3:] for g in got], [w[3:] for w in want])
    with pytest.raises(Exception, match="lacks power"):
        spark.sql("SELECT * FROM spectral_peaks(TABLE(SELECT source_id, series, frequency FROM test_grid), 1, 0.1D)").collect()
    assert spark.sql("SELECT * FROM spectral_peaks(TABLE(SELECT * FROM test_grid WHERE false), 1, 0.1D)").count() == 0


def test_events_of_a_table(spark):
    tables.register(spark)
    rng = np.random.default_rng(3)
    rows = [(f"s{i % 2}", i, float(t), float(z), 0.1, "co"[i % 2]) for i, (t, z) in enumerate(zip(np.sort(rng.uniform(0, 40, 300)), rng.normal(0, 3, 300)))] + [("s0", 999, 5.0, None, 0.1, "c")]
    points = spark.createDataFrame(rows, "source_id string, row_id long, time double, z double, err double, filter string").repartition(4)
    points.createOrReplaceTempView("test_points")
    got = {(r["source_id"], r["event_type"], r["event_number"]): (r["n_measurements"], r["peak_significance"], r["last_time"] - r["first_time"]) for r in spark.sql("SELECT * FROM excursions(TABLE(test_points), 2D, 1D)").collect()}
    want = {(r["source_id"], r["event_type"], r["event_number"]): (r["n_measurements"], r["peak_residual_significance"], r["event_duration_days"]) for r in M.excursion_events(points, 2.0).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in got) and len(got) > 20
    with pytest.raises(Exception, match="lacks z"):
        spark.sql("SELECT * FROM excursions(TABLE(SELECT source_id, row_id, time FROM test_points), 2D, 1D)").collect()
