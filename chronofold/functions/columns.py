"""Column expressions shared by the operators. Missing is NULL everywhere; NaN and infinities never enter."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

MAD_SIGMA = 1.4826
ERR_PER_MAG = math.log(10.0) / 2.5


def number(c: Column) -> Column:
    """A text or number as a finite double, else NULL."""
    d = c.try_cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def clean_text(c: Column) -> Column:
    """Trimmed text; null-like words become empty."""
    t = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(F.lower(t).isin("", "nan", "none", "null", "<na>", "na"), "").otherwise(t)


def clean_id(c: Column) -> Column:
    """A catalogue id as text: no quotes, no trailing .0, scientific notation written out."""
    t = F.regexp_replace(clean_text(c), r"""^['"]+|['"]+$""", "")
    t = F.regexp_replace(t, r"^(\d+)\.0+$", "$1")
    sci = F.regexp_extract(t, r"^\d+(?:\.\d+)?[eE]\+?\d+$", 0) != ""
    return F.when(sci, t.try_cast("decimal(38,0)").cast("string")).otherwise(t)


def match_key(c: Column) -> Column:
    """A name for matching: case, spaces, underscores and dashes do not count."""
    return F.regexp_replace(F.lower(clean_text(c)), r"[\s_-]+", "")


def truth(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes", "y", "t")


def safe_name(c: Column, most: int = 80) -> Column:
    """A text as a file name; long ones end in a digest."""
    t = F.regexp_replace(clean_text(c), r"[^A-Za-z0-9._-]+", "_")
    return F.when(
        F.length(t) > most,
        F.concat(F.substring(t, 1, most - 11), F.lit("_"), F.substring(F.sha1(clean_text(c)), 1, 10)),
    ).otherwise(t)


def tags(c: Column) -> Column:
    """A ;-joined text as an array of distinct tags in order."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ";"), F.trim)
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def joined(a: Column) -> Column:
    return F.array_join(a, ";")


def numbers(c: Column) -> Column:
    """A ;-joined text as an array of doubles, unreadable parts left out."""
    return F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x).try_cast("double")), lambda x: x.isNotNull())


def flux_of(m: Column) -> Column:
    return F.pow(F.lit(10.0), (F.lit(23.9) - m) / 2.5)


def phase(t: Column, period: Column, t0: float = 0.0) -> Column:
    x = (t - t0) / period
    return x - F.floor(x)


def phase_distance(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    d = d - F.floor(d)
    return F.least(d, 1 - d)


def bin_of(ph: Column, n: int) -> Column:
    return F.least(F.floor(ph * n), F.lit(n - 1)).cast("int")


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def median(c: Column) -> Column:
    return F.percentile(c, F.lit(0.5))


def positive(c: Column) -> Column:
    return F.when(c > 0, c)


def robust_sigma(df: DataFrame, value: str, keys: list[str], name: str) -> DataFrame:
    """1.4826 times the median absolute deviation by ``keys``; the population standard deviation where that is 0; NULL where both are."""
    from pyspark.sql import Window

    w: WindowSpec = Window.partitionBy(*keys)
    dev = df.withColumn("__dev", F.abs(F.col(value) - median(F.col(value)).over(w)))
    mad = F.lit(MAD_SIGMA) * median(F.col("__dev")).over(w)
    return dev.withColumn(name, F.coalesce(positive(mad), positive(F.stddev_pop(value).over(w)))).drop("__dev")


def harmonic_relation(period: Column, reference: Column, order: int = 6, tolerance: float = 0.02) -> Column:
    """'direct', 'P/n' or 'nP' (the lowest n, fractions first), '' if unrelated or missing."""

    def name(ratio: Column) -> Column:
        out = F.when(F.abs(ratio - 1) <= tolerance, "direct")
        for n in range(2, order + 1):
            out = out.when(
                F.abs(ratio - 1.0 / n) / (1.0 / n) <= tolerance,
                f"P/{n}",
            ).when(F.abs(ratio - float(n)) / float(n) <= tolerance, f"{n}P")
        return F.coalesce(out, F.lit(""))

    return let(F.when((period > 0) & (reference > 0), period / reference), name)


def universal_alias(period: Column, tolerance: float = 0.015) -> Column:
    """The first cadence alias within ``tolerance``, or ''."""
    from chronofold.config import UNIVERSAL_ALIASES

    def named(p: Column) -> Column:
        out = None
        for name, days in UNIVERSAL_ALIASES:
            near = F.abs(p - days) / days <= tolerance
            out = F.when(near, name) if out is None else out.when(near, name)
        return F.coalesce(out, F.lit(""))

    return let(period, named)


def catalogue_match(period: Column, catalogue: Column, order: int = 6, tolerance: float = 0.03) -> Column:
    """How a recovered period relates to a catalogue period."""
    rel = harmonic_relation(period, catalogue, order, tolerance)
    return (
        F.when(
            ~F.coalesce(catalogue > 0, F.lit(False)),
            "no_catalogue_period",
        ).when(~F.coalesce(period > 0, F.lit(False)), "no_recovered_period").otherwise(let(rel, lambda r: F.when(r == "", "mismatch").otherwise(r)))
    )


def average_rank(value: str, partition: list[str] | None = None) -> Column:
    """Percentile rank with ties averaged, in (0, 1]."""
    from pyspark.sql import Window

    w = Window.partitionBy(*(partition or [F.lit(0)]))
    ties = Window.partitionBy(*(partition or []), value)
    return (F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(ties) - 1) / 2) / F.count(F.lit(1)).over(w)


def mjd_to_utc(mjd: Column) -> Column:
    """The timestamp of a modified Julian date, to the microsecond; leap seconds are not counted."""
    return F.timestamp_micros(F.round((mjd - F.lit(40587.0)) * F.lit(86400e6)).cast("long"))


def utc_to_mjd(ts: Column) -> Column:
    """The modified Julian date of a timestamp, whatever the session's time zone."""
    return F.unix_micros(ts).cast("double") / F.lit(86400e6) + F.lit(40587.0)


def mjd_window(days: float, now: Column | None = None) -> tuple[Column, Column]:
    """First and last modified Julian date of the ``days`` up to ``now``."""
    last = utc_to_mjd(F.current_timestamp() if now is None else now)
    return last - F.lit(float(days)), last


def let(value, use) -> Column:
    """``use(value)`` with the value worked out once: an expression inside a lambda is worked out anew for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def task_count(df: DataFrame) -> int:
    """Partitions for CPU-heavy groups: some for each core, and never the number of shuffle partitions.

    A repartition by columns into that number is left out of the plan if a join before it already deals by them,
    and adaptive execution then merges the join's small partitions into few tasks.
    """
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(usual, 4 * df.sparkSession.sparkContext.defaultParallelism) + 1
