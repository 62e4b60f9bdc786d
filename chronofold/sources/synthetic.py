"""Synthetic light curves with known truth, generated in place (IO24): any number of sources, no driver data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("wave", "dip", "constant")


def _uniform(*parts) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53)))


def _normal(*parts) -> Column:
    a, b = _uniform(*parts, F.lit("a")), _uniform(*parts, F.lit("b"))
    return F.sqrt(-2 * F.log(1 - a)) * F.cos(2 * 3.141592653589793 * b)


def curves(
    spark: SparkSession,
    sources: int,
    points: int = 360,
    seed: int = 42,
    noise: float = 0.025,
    start: float = 58000.0,
    span: float = 1100.0,
) -> DataFrame:
    """Standard observations; source s has period 8.3 + 1.7 (s mod 24) and kind s mod 3."""
    r = spark.range(sources * points).select((F.col("id") / points).cast("long").alias("s"), F.col("id").alias("row_id"))
    r = r.withColumn(
        "mjd",
        start + span * _uniform(F.lit(seed), F.lit("t"), "row_id"),
    ).withColumn("period", 8.3 + 1.7 * (F.col("s") % 24)).withColumn("band", F.when(F.col("row_id") % 2 == 0, "c").otherwise("o"))
    ph = F.col("mjd") / F.col("period") - F.floor(F.col("mjd") / F.col("period"))
    d = F.least(F.abs(ph - 0.5), 1 - F.abs(ph - 0.5))
    signal = F.when(F.col("s") % 3 == 0, 0.25 * F.sin(2 * 3.141592653589793 * ph)).when(
        F.col("s") % 3 == 1,
        0.9 * F.exp(-0.5 * F.pow(d / 0.045, F.lit(2.0))),
    ).otherwise(0.0)
    r = r.withColumn("m", 15.0 + signal + noise * _normal(F.lit(seed), "row_id")).withColumn("dm", F.lit(noise))
    r = r.withColumn("ujy", F.pow(F.lit(10.0), (23.9 - F.col("m")) / 2.5)).withColumn("dujy", F.col("ujy") * F.col("dm") / 1.0857)
    return r.select(
        F.col("s").cast("string").alias("source_id"),
        "row_id",
        "mjd",
        "band",
        "m",
        "dm",
        "ujy",
        "dujy",
        F.lit(0.0).alias("err"),
        F.lit(19.0).alias("mag5sig"),
        F.lit(19.0).alias("sky"),
    )


def truth(spark: SparkSession, sources: int) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("id") % 3 + 1).cast("int"))
    return spark.range(sources).select(
        F.col("id").cast("string").alias("source_id"),
        (8.3 + 1.7 * (F.col("id") % 24)).alias("injected_period_days"),
        kind.alias("injected_shape"),
    )
