"""Folded profiles of a source in its bands, alone and combined (M1, M2).

A point takes part in four folds of its source: at the period, at half and at twice
of it, and at the period within its section in time. Points are dealt by source and
sorted once; a small numpy helper folds a source's points, so no point is written or
sorted again for each fold. A profile is one row with arrays of ``phase_bins`` values;
all that is done to it are array expressions.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.config import MorphologyConfig
from chronofold.functions import circles as C
from chronofold.functions.columns import MAD_SIGMA, let, median

WHOLE, HALF, DOUBLE, SECTION = "whole", "half", "double", "section"
BANDS = ("c", "o")
KEY = ["source_id", "fold", "filter"]
#: Points past so many spreads are left out of a fold, if enough others are there.
CLIP = 6.0


def usable(points: DataFrame) -> DataFrame:
    """Points with a time, a magnitude and an error, with ``section``, ``origin`` (the source's first time) and ``turn`` (periods since then)."""
    src = W.partitionBy("source_id")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    p = points.where(finite("time") & finite("mag") & finite("err") & F.col("source_id").isNotNull())
    return p.withColumn("origin", F.min("time").over(src)).withColumn("turn", F.when(F.col("period") > 0, (F.col("time") - F.col("origin")) / F.col("period")))


def in_sections(points: DataFrame, k: int) -> DataFrame:
    """Adds ``section``: chronological parts of equal size, earlier ones take the remainder."""
    return points.withColumn("section", F.ntile(k).over(W.partitionBy("source_id").orderBy("time", "row_id")) - 1)


def spread_over(x: str, dev: str, n: Column, w) -> Column:
    """Half the span of the central 68 % over a window; the median deviation ``dev`` under eight values."""
    wide = (F.percentile(x, F.lit(0.84)).over(w) - F.percentile(x, F.lit(0.16)).over(w)) / 2
    return F.when(n >= 8, wide).otherwise(MAD_SIGMA * median(F.col(dev)).over(w))


def _at(ordered: np.ndarray, share: float) -> float:
    """The percentile of sorted values, in the steps of Spark's ``percentile``."""
    at = (len(ordered) - 1) * share
    low = int(at)
    x, y = ordered[low], ordered[min(low + 1, len(ordered) - 1)]
    return x if at == low or x == y else (low + 1 - at) * x + (at - low) * y


def _spread(x: np.ndarray, dev: np.ndarray) -> float:
    """As ``spread_over``, of sorted ``x`` and its sorted deviations."""
    return (_at(x, 0.84) - _at(x, 0.16)) / 2 if len(x) >= 8 else MAD_SIGMA * _at(dev, 0.5)


def _clipped(mag: np.ndarray, err: np.ndarray) -> tuple:
    """Places of the points that stay, their x (the magnitude less the median), and the fold's numbers ``WHOLE_FOLD``."""
    x = mag - _at(np.sort(mag), 0.5)
    limit = _spread(np.sort(x), np.sort(np.abs(x)))
    near = np.flatnonzero(np.abs(x) <= CLIP * limit)
    stay = near if limit > 0 and len(near) >= max(20, len(x) // 2) else np.arange(len(x))
    x = x[stay]
    ordered = np.sort(x)
    dev = np.sort(np.abs(x - _at(ordered, 0.5)))
    return stay, x, (len(x), _spread(ordered, dev), MAD_SIGMA * _at(dev, 0.5), _at(np.sort(err), 0.5), _at(ordered, 0.95) - _at(ordered, 0.05))


def _cells(bins: np.ndarray, x: np.ndarray, err: np.ndarray, scatter: np.ndarray) -> tuple:
    """Count, median and error of each bin of all folds (``scatter``: its fold's); NaN where it has no point."""
    n = np.bincount(bins, minlength=len(scatter))
    some = np.flatnonzero(n)
    k, first = n[some], (np.cumsum(n) - n)[some]

    def at(values: np.ndarray, share: float) -> np.ndarray:
        """``_at`` of every bin that has points; ``values`` are sorted within bins."""
        place = (k - 1) * share
        low = place.astype(np.int64)
        a, b = values[first + low], values[first + np.minimum(low + 1, k - 1)]
        return np.where((place == low) | (a == b), a, (low + 1 - place) * a + (place - low) * b)

    within = lambda values: values[np.lexsort((values, bins))]
    ordered, mid, sigma = within(x), np.full(len(n), np.nan), np.full(len(n), np.nan)
    mid[some] = at(ordered, 0.5)
    off = MAD_SIGMA * at(within(np.abs(x - mid[bins])), 0.5)
    wide = np.where(k >= 8, (at(ordered, 0.84) - at(ordered, 0.16)) / 2, np.where(k > 3, off, 0.0))
    root = np.sqrt(k)
    sigma[some] = np.maximum(np.where(wide > 0, wide, at(within(err), 0.5)) / root, scatter[some] / root / 2)
    return n, mid, sigma


#: Numbers of a fold that need no period, and its cells, as ``folded_cells`` gives them.
WHOLE_FOLD = ("points", "scatter", "own_mad", "median_error", "raw_amplitude")


def folded_cells(points: DataFrame, n_bins: int) -> DataFrame:
    """(KEY, ``WHOLE_FOLD``, folded, n, mid, seen): the folds of each source's bands, outliers left out, with arrays of the bins.

    A source's points are dealt and sorted once, as they are: folds are made inside the group, so no point is
    copied for each fold through sorts and windows.
    """

    def fold(t: pa.Table) -> pa.Table:
        band, section = t.column("filter").to_numpy(), t.column("section").to_numpy()
        time, mag, error, period = (t.column(c).to_numpy().astype(np.float64) for c in ("elapsed", "mag", "err", "period"))
        found, held = [], []
        with np.errstate(all="ignore"):
            for b in BANDS:
                every = np.flatnonzero(band == b)
                turning = every[~(period[every] <= 0)]
                folds = [(WHOLE, every, 1.0), (HALF, turning, 0.5), (DOUBLE, turning, 2.0)]
                folds += [(f"{SECTION}{s}", every[section[every] == s], 1.0) for s in np.unique(section[every])]
                known = {}
                for name, rows, factor in folds:
                    if len(rows) < 3:
                        continue
                    same = (name.startswith(SECTION) and name, len(rows))
                    if same not in known:
                        known[same] = _clipped(mag[rows], error[rows])
                    stay, x, numbers = known[same]
                    rows = rows[stay]
                    at = period[rows] * factor
                    on = ~(at <= 0)
                    turns = time[rows][on] / at[on]
                    bins = np.minimum(np.floor(np.nan_to_num((turns - np.floor(turns)) * n_bins)), n_bins - 1).astype(np.int64)
                    held.append((bins + n_bins * len(found), x[on], error[rows][on]))
                    found.append((name, b, *numbers, bool(on.any())))
            bins, x, err = (np.concatenate(c) for c in zip(*held)) if held else (np.empty(0, np.int64), np.empty(0), np.empty(0))
            cells = _cells(bins, x, err, np.repeat([f[3] for f in found], n_bins))
        columns = [list(c) for c in zip(*found)] or [[] for _ in range(8)]
        starts = pa.array(np.arange(len(found) + 1, dtype=np.int32) * n_bins)
        lists = [pa.ListArray.from_arrays(starts, pa.array(c, kind, from_pandas=True)) for c, kind in zip(cells, (pa.int32(), pa.float64(), pa.float64()))]
        own = t.column("source_id").slice(0, 1).take(pa.array([0] * len(found), pa.int64())).combine_chunks()
        kinds = [pa.string(), pa.string(), pa.int64(), *[pa.float64()] * 4, pa.bool_()]
        return pa.Table.from_arrays([own, *[pa.array(c, k) for c, k in zip(columns, kinds)], *lists], [*KEY, *WHOLE_FOLD, "folded", "n", "mid", "seen"])

    p = points.where(F.col("filter").isin(*BANDS) & (F.col("err") > 0)).select(
        "source_id", F.col("filter").cast("string").alias("filter"), F.col("section").cast("int").alias("section"), (F.col("time") - F.col("origin")).alias("elapsed"), "mag", "err",
        F.coalesce(F.col("period").cast("double"), F.lit(0.0)).alias("period"),
    )
    numbers = "fold string, filter string, points long, scatter double, own_mad double, median_error double, raw_amplitude double, folded boolean, n array<int>, mid array<double>, seen array<double>"
    schema = T.StructType([p.schema["source_id"], *T.DataType.fromDDL(numbers).fields])
    return p.groupBy("source_id").applyInArrow(fold, schema)


def profiles(points: DataFrame, cfg: MorphologyConfig = MorphologyConfig()) -> DataFrame:
    """One row a (source_id, fold, filter) with three points or more: value and sigma a bin, counts, and the fold's numbers. Without a period only the numbers that need none."""
    n_bins = cfg.phase_bins
    rows = folded_cells(points, n_bins)
    whole = list(WHOLE_FOLD)
    rows = rows.select(
        *KEY, *whole, "folded",
        "n", F.when(F.col("folded"), C.central(C.filled(F.col("mid"), n_bins))).alias("value"), "seen",
    )
    rows = rows.withColumn("sigma", F.when(F.col("folded"), let(F.struct("seen", "scatter"), lambda s: F.transform(s["seen"], lambda x: F.coalesce(x, s["scatter"])))))
    rows = rows.withColumn("occupied", F.size(C.known(F.col("seen")))).withColumn("amplitude", F.when(F.col("folded"), C.span(F.col("value"), 0.05, 0.95)).otherwise(F.col("raw_amplitude")))
    squares = F.zip_with("value", "seen", lambda v, s: (v / s) * (v / s))
    enough = F.col("folded") & (F.col("occupied") >= 8)
    return rows.select(
        *KEY, "points", "folded", "n", "value", "sigma", "amplitude", "median_error",
        F.when(F.col("folded"), F.col("occupied") / n_bins).otherwise(0.0).alias("coverage"),
        F.when(enough, C.mean(C.known(squares))).alias("chi2"),
        F.when(enough, F.col("amplitude") / F.greatest(C.middle(F.col("seen")), F.lit(1e-9))).alias("snr"),
        (F.col("own_mad") / F.greatest("median_error", F.lit(1e-9))).alias("scatter_over_error"),
        F.when(F.col("folded"), F.col("amplitude") / F.greatest("scatter", F.lit(1e-9))).alias("over_scatter"),
        normalised(F.when(F.col("folded"), F.col("value")), F.col("amplitude"), n_bins).alias("norm"),
    )


def normalised(value: Column, amplitude: Column, n: int) -> Column:
    """The profile over its amplitude; zeros where there is none."""
    scaled = let(F.struct(value.alias("v"), amplitude.alias("a")), lambda s: F.when(s["a"] > 1e-12, F.transform(s["v"], lambda x: x / s["a"])))
    return F.coalesce(scaled, F.array_repeat(F.lit(0.0), n))


def combined(bands: DataFrame, cfg: MorphologyConfig = MorphologyConfig()) -> DataFrame:
    """One row a (source_id, fold): the bands' profiles in one, weighted by significance and points; but for sections, o is turned to where it fits c best.

    With one band it is that band's profile. ``c_weight`` and ``o_weight`` tell which.
    """
    n = cfg.phase_bins
    parts = ["points", "folded", "n", "value", "sigma", "amplitude", "median_error", "coverage", "chi2", "snr", "scatter_over_error", "over_scatter", "norm"]
    both = bands.groupBy("source_id", "fold").agg(*[F.max(F.when(F.col("filter") == b, F.struct(*parts))).alias(b) for b in BANDS])
    weight = lambda b: F.greatest(F.coalesce(F.col(f"{b}.chi2"), F.lit(0.0)), F.lit(0.1)) * F.sqrt(F.col(f"{b}.points"))
    c, o = (F.coalesce(weight(b), F.lit(0.0)) for b in BANDS)
    both = both.withColumn("wc", c).withColumn("wo", o)
    both = both.withColumn("c_weight", F.col("wc") / (F.col("wc") + F.col("wo"))).withColumn("o_weight", F.col("wo") / (F.col("wc") + F.col("wo"))).drop("wc", "wo")
    turn = ~F.col("fold").startswith(SECTION) & C.any_nonzero(F.col("c.norm")) & C.any_nonzero(F.col("o.norm"))
    both = both.withColumn("shift", F.coalesce(F.when(turn, C.best_shift(F.col("c.norm"), F.col("o.norm"), n)["shift"]), F.lit(0)))
    two = F.col("c").isNotNull() & F.col("o").isNotNull()

    def joined(s):
        none = F.array_repeat(F.lit(0.0), n)
        value = F.zip_with(F.coalesce(s["c.value"], none), C.rolled(F.coalesce(s["o.value"], none), s["k"], n), lambda x, y: s["wc"] * x + s["wo"] * y)
        sigma = F.zip_with(F.coalesce(s["c.sigma"], none), C.rolled(F.coalesce(s["o.sigma"], none), s["k"], n), lambda x, y: F.sqrt(s["wc"] * s["wc"] * x * x + s["wo"] * s["wo"] * y * y))
        return F.struct(C.central(value).alias("value"), let(sigma, lambda e: let(F.struct(e.alias("e"), F.coalesce(C.middle(F.filter(e, lambda x: x > 0)), F.lit(1e-6)).alias("m")), lambda t: F.transform(t["e"], lambda x: F.when(x > 0, x).otherwise(t["m"])))).alias("sigma"))

    mix = let(
        F.struct(F.struct("c.value", "c.sigma").alias("c"), F.struct("o.value", "o.sigma").alias("o"), F.col("c_weight").alias("wc"), F.col("o_weight").alias("wo"), F.col("shift").alias("k")),
        lambda s: joined({"c.value": s["c"]["value"], "c.sigma": s["c"]["sigma"], "o.value": s["o"]["value"], "o.sigma": s["o"]["sigma"], "wc": s["wc"], "wo": s["wo"], "k": s["k"]}),
    )
    both = both.withColumn("mix", F.when(two, mix)).withColumn("one", F.when(~two, F.coalesce("c", "o")))
    sum_of = lambda name: F.col("c_weight") * F.coalesce(F.col(f"c.{name}"), F.lit(0.0)) + F.col("o_weight") * F.coalesce(F.col(f"o.{name}"), F.lit(0.0))
    pick = lambda name, mixed: F.when(two, mixed).otherwise(F.col(f"one.{name}")).alias(name)
    out = both.select(
        "source_id", "fold", "c_weight", "o_weight", "shift",
        F.col("c.chi2").alias("c_chi2"), F.col("o.chi2").alias("o_chi2"), F.col("c.norm").alias("c_norm"), F.col("o.norm").alias("o_norm"),
        pick("points", F.col("c.points") + F.col("o.points")), pick("folded", F.lit(True)),
        pick("value", F.col("mix.value")), pick("sigma", F.col("mix.sigma")),
        pick("coverage", F.greatest("c.coverage", "o.coverage")),
        *[pick(name, sum_of(name)) for name in ("median_error", "scatter_over_error", "over_scatter")],
        F.when(~two, F.struct(F.col("one.amplitude"), F.col("one.chi2"), F.col("one.snr"))).alias("own"), two.alias("two"),
    )
    out = out.withColumn("amplitude", F.when(F.col("two"), C.span(F.col("value"), 0.05, 0.95)).otherwise(F.col("own.amplitude"))).withColumn("typical", C.middle(F.col("sigma")))
    chi2 = C.mean(F.zip_with("value", "sigma", lambda v, s: (v / s) * (v / s)))
    out = out.withColumn("chi2", F.when(F.col("two"), chi2).otherwise(F.col("own.chi2"))).withColumn("snr", F.when(F.col("two"), F.col("amplitude") / F.greatest("typical", F.lit(1e-9))).otherwise(F.col("own.snr")))
    return out.withColumn("norm", normalised(F.when(F.col("folded"), F.col("value")), F.col("amplitude"), n)).drop("own", "two")
