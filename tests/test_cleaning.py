"""Cleaning and selection: boundaries, precedence of reasons, absent columns."""

import pytest
from pyspark.sql import functions as F

from chronofold.config import CleanConfig, PeriodConfig, configured
from chronofold.operators import clean as C

GOOD = dict(mjd=59000.0, m=15.0, dm=0.05, ujy=100.0, dujy=5.0, band="o", err=0.0, x=500.0, y=500.0, maj=2.0, min=2.0, apfit=-0.5, mag5sig=19.0, sky=19.0)
CASES = [
    ("good", {}, True), ("no_time", {"mjd": None}, False), ("bright_bound", {"m": -5.0}, False), ("faint_bound", {"m": 30.0}, False), ("dm_zero", {"dm": 0.0}, False), ("dm_bound", {"dm": 5.0}, False), ("dujy_zero", {"dujy": 0.0}, False),
    ("dujy_bound", {"dujy": 10000.0, "ujy": 1e5}, False), ("flux_bound", {"ujy": 1e9}, False), ("band", {"band": "w"}, False), ("err", {"err": 1.0}, False), ("err_null", {"err": None}, False), ("x_low", {"x": 100.0}, False), ("x_high", {"x": 10460.0}, False),
    ("y_low", {"y": 100.0}, False), ("maj_low", {"maj": 1.6}, False), ("maj_high", {"maj": 5.0}, False), ("min_low", {"min": 1.6}, False), ("apfit_low", {"apfit": -1.0}, False), ("apfit_high", {"apfit": -0.1}, False), ("depth", {"mag5sig": 17.0}, False),
    ("hard_depth", {"mag5sig": 9.0}, False), ("sky", {"sky": 17.0}, False), ("snr_bound", {"m": None, "dm": None, "ujy": -25.0}, True), ("snr_below", {"m": None, "dm": None, "ujy": -25.1}, False), ("mild_negative", {"m": None, "dm": None, "ujy": -1.0}, True),
]


def frame(spark, cases):
    names = list(GOOD)
    kinds = ", ".join(f"`{n}` {'string' if n == 'band' else 'double'}" for n in names)
    return spark.createDataFrame([(k, i, *[{**GOOD, **c}[n] for n in names]) for i, (k, c, _) in enumerate(cases)], f"source_id string, row_id long, {kinds}")


def test_truth_table(spark):
    got = {r["source_id"]: r["final_keep"] for r in C.clean(frame(spark, CASES)).collect()}
    assert got == {k: want for k, _, want in CASES}


def test_reasons(spark):
    got = {r["source_id"]: r["reject_reason"] for r in C.clean(frame(spark, CASES)).collect()}
    assert got["good"] == "" and got["err"] == "fail_err==0" and got["band"] == "HARD_filter" and got["hard_depth"] == "HARD_mag5sig<10"
    assert got["dujy_zero"].startswith("HARD_invalid")


def test_absent_columns_skip_their_cuts(spark):
    rows = frame(spark, CASES[:1]).select("source_id", "row_id", "mjd", "band", "ujy", "dujy", "m", "dm")
    assert C.clean(rows).first()["final_keep"]


def test_standardise_makes_flux_and_nulls(spark):
    raw = spark.createDataFrame([("a", "1", "59000", "o", "15.0", "0.1"), ("a", "2", "x", "o", "nan", "inf")], "source_id string, row_id string, ` ###MJD` string, F string, m string, dm string")
    out = {r["row_id"]: r for r in C.standardise(raw).collect()}
    assert out["1"]["ujy"] == pytest.approx(10 ** ((23.9 - 15) / 2.5)) and out["2"]["mjd"] is None and out["2"]["m"] is None and out["2"]["dm"] is None
    with pytest.raises(ValueError):
        C.standardise(raw.drop("F"))


def test_rescue(spark):
    rows = [("s", i, 59000.0 + i, "o", 100.0 if i != 60 else 20.0, 2.0 if i != 60 else 10.0, 19.0 if i != 60 else 16.0) for i in range(120)]
    df = spark.createDataFrame(rows, "source_id string, row_id long, mjd double, band string, ujy double, dujy double, mag5sig double").withColumn("m", F.lit(None).cast("double")).withColumn("dm", F.lit(None).cast("double"))
    out = {r["row_id"]: r for r in C.clean(df, CleanConfig(rescue=True)).collect()}
    assert out[60]["rescued"] and out[60]["reject_reason"] == "fail_mag5sig>17;RESCUED_dip_candidate" and not out[59]["rescued"]


def test_selection(spark):
    rows = [(500, 100, 400, 1500.0, 0.9, 0.05, 0.03), (80, 20, 60, 1500.0, 0.9, 0.05, 0.03), (500, 10, 20, 1500.0, 0.9, 0.05, 0.03), (500, 100, 400, 100.0, 0.9, 0.05, 0.03), (600, 1, 599, 1000.0, 0.9, 0.01, 0.5)]
    df = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "source_id string, n_final_keep long, n_c_clean long, n_o_clean long, baseline_days_clean double, fraction_kept double, median_dm_c_clean double, median_dm_o_clean double")
    got = {r["source_id"]: r["selection_reasons"] for r in C.select_sources(df).collect()}
    assert got["0"] == "" and "fewer_than_100_points" in got["1"] and "no_band_with_30_points" in got["2"] and got["3"] == "baseline_under_365_days" and got["4"] == "median_uncertainty_over_0.2_mag"


def test_settings_reject_unknown_names():
    assert configured(PeriodConfig, {"min_points": 10}).min_points == 10
    with pytest.raises(ValueError):
        configured(PeriodConfig, {"min_pionts": 10})
