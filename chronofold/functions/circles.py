"""Arrays as values: order statistics, and profiles whose last bin is next to their first (W13, array functions of §2.8).

Every function takes columns, gives a column and stays in the JVM. Arguments that are
used more than once are bound with ``let``, so callers may pass whole expressions.
Arrays hold doubles; ``n`` is their fixed length where a function goes around.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronofold.functions.columns import MAD_SIGMA, let, positive


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return let(a, lambda v: F.try_divide(total(v), F.size(v).cast("double")))


def known(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull())


def quantile(a: Column, q: float) -> Column:
    """The quantile of the values that are not null, between neighbours by proportion; null for none."""

    def of(s):
        at = (F.size(s) - 1) * F.lit(q)
        low = F.floor(at).cast("int")
        below = F.get(s, low)
        return F.when(F.size(s) > 0, below + (at - low) * (F.get(s, F.least(low + 1, F.size(s) - 1)) - below))

    return let(F.sort_array(known(a)), of)


def middle(a: Column) -> Column:
    return quantile(a, 0.5)


def span(a: Column, low: float, high: float) -> Column:
    return let(a, lambda v: quantile(v, high) - quantile(v, low))


def mad(a: Column) -> Column:
    """The median deviation from the median, as a standard deviation."""
    return let(F.struct(a.alias("v"), middle(a).alias("m")), lambda s: MAD_SIGMA * middle(F.transform(s["v"], lambda x: F.abs(x - s["m"]))))


def less(a: Column, c: Column) -> Column:
    """Every value less a number."""
    return let(F.struct(a.alias("v"), c.alias("c")), lambda s: F.transform(s["v"], lambda x: x - s["c"]))


def central(a: Column) -> Column:
    return let(a, lambda v: less(v, middle(v)))


def rms(a: Column, b: Column) -> Column:
    """Root mean square distance of two arrays."""
    return F.sqrt(mean(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def any_nonzero(a: Column) -> Column:
    return F.exists(a, lambda x: x != 0)


def first_max(a: Column) -> Column:
    """The place, from 0, of the largest value; the first of equal ones."""
    return let(a, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def correlation(a: Column, b: Column, least: int = 4) -> Column:
    """Pearson's, over places where both have values; null under ``least`` places or where one is constant."""

    def of(p):
        mx, my = mean(F.transform(p, lambda s: s["x"])), mean(F.transform(p, lambda s: s["y"]))
        return let(F.struct(p.alias("p"), mx.alias("mx"), my.alias("my")), about)

    def about(s):
        part = lambda f: total(F.transform(s["p"], f))
        dx, dy = (lambda q: q["x"] - s["mx"]), (lambda q: q["y"] - s["my"])
        xx, yy = positive(part(lambda q: dx(q) * dx(q))), positive(part(lambda q: dy(q) * dy(q)))
        return F.when(F.size(s["p"]) >= least, part(lambda q: dx(q) * dy(q)) / F.sqrt(xx) / F.sqrt(yy))

    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return let(F.filter(pairs, lambda s: s["x"].isNotNull() & s["y"].isNotNull()), of)


# Around the circle.


def around(i: Column, centre: Column, n: int) -> Column:
    """How many bins apart, the shorter way."""
    d = F.abs(i - centre)
    return F.least(d, n - d)


def rolled(a: Column, by: Column | int, n: int) -> Column:
    """The array turned so that its first value comes to place ``by``."""
    return let(F.struct(a.alias("v"), F.pmod(F.lit(by), F.lit(n)).cast("int").alias("k")), lambda s: F.concat(F.slice(s["v"], n - s["k"] + 1, s["k"]), F.slice(s["v"], 1, n - s["k"])))


def filled(a: Column, n: int) -> Column:
    """Nulls by proportion between the nearest known bins on both sides, around the circle; zeros if none is known."""

    def of(s):
        v, at = s["v"], s["at"]
        first, last = F.array_min(at), F.array_max(at)

        def one(x, i):
            before = F.coalesce(F.array_max(F.filter(at, lambda j: j < i)), last - n)
            after = F.coalesce(F.array_min(F.filter(at, lambda j: j > i)), first + n)
            left, right = F.get(v, F.pmod(before, F.lit(n))), F.get(v, F.pmod(after, F.lit(n)))
            return F.when(first.isNull(), 0.0).when(x.isNotNull(), x).otherwise(left + (right - left) * (i - before) / (after - before))

        return F.transform(v, one)

    at = lambda v: F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(v, i).isNotNull())
    return let(a, lambda v: let(F.struct(v.alias("v"), at(v).alias("at")), of))


def best_shift(a: Column, b: Column, n: int) -> Column:
    """struct(distance, shift): the turn of ``b`` that is nearest to ``a`` in root mean square; the smallest of equal ones."""

    def of(s):
        shifts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(rms(s["a"], rolled(s["b"], k, n)).alias("distance"), k.alias("shift")))
        return F.array_min(shifts)

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def longest_run(mask: Column, n: int) -> Column:
    """The longest run of true values around the circle."""
    step = lambda s, x: let(F.when(x, s["run"] + 1).otherwise(0), lambda r: F.struct(r.alias("run"), F.greatest(s["best"], r).alias("best")))
    return F.least(F.aggregate(F.concat(mask, mask), F.struct(F.lit(0).alias("run"), F.lit(0).alias("best")), step)["best"], F.lit(n))


def harmonic(a: Column, h: int, n: int) -> tuple[Column, Column]:
    """Cosine and sine amplitudes of the ``h``-th harmonic."""
    turn = 2 * 3.141592653589793 * h / n
    part = lambda f: 2.0 / n * total(F.transform(a, lambda x, i: x * f(turn * i)))
    return part(F.cos), part(F.sin)
