"""Column expressions over series held as arrays: no shuffle, no Python.

These serve a handful of kernels at a time; the whole bank goes through
``operators.transform`` instead, since thousands of such expressions would not
fit a generated method.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def diff(x: Column) -> Column:
    """x[t+1] - x[t]."""
    n = F.size(x)
    return F.zip_with(F.slice(x, 2, n - 1), F.slice(x, 1, n - 1), lambda b, a: b - a)


def zero_pad(x: Column, n: int) -> Column:
    zeros = F.array_repeat(F.lit(0.0), n)
    return F.concat(zeros, x, zeros) if n else x


def convolve(x: Column, taps: tuple[int, int, int], dilation: int) -> Column:
    """Same-length convolution with a kernel of 2 at ``taps`` and -1 elsewhere.

    Written as three times the taps minus the sum of all nine.  The padded series
    is bound once, as the variable of a one-element transform; named inside the
    inner lambda it would be built again for every tap of every timepoint.
    """
    d = dilation
    i0, i1, i2 = taps

    def whole(padded: Column) -> Column:
        def at(t: Column) -> Column:
            three = padded[t + i0 * d] + padded[t + i1 * d] + padded[t + i2 * d]
            nine = padded[t]
            for k in range(1, 9):
                nine = nine + padded[t + k * d]
            return 3 * three - nine

        return F.transform(F.sequence(F.lit(0), F.size(padded) - 1 - 8 * d), at)

    return F.transform(F.array(zero_pad(x, 4 * d)), whole)[0]


def active(c: Column, bias: Column) -> Column:
    """1 where the convolution exceeds the bias, else 0."""
    return F.transform(c, lambda v: F.when(v > bias, 1).otherwise(0))


def pool(c: Column, bias: Column) -> Column:
    """struct(ppv, mpv, mipv, lspv) of a convolution, in one pass.

    ppv: share of values above the bias; mpv: their mean excess, else 0; mipv:
    their mean position, else -1; lspv: the longest run of them.
    """
    state = F.struct(
        F.lit(0).alias("t"),
        F.lit(0).alias("n"),
        F.lit(0.0).alias("s"),
        F.lit(0.0).alias("p"),
        F.lit(0).alias("run"),
        F.lit(0).alias("best"),
    )

    def step(a: Column, v: Column) -> Column:
        hit = v > bias
        run = F.when(hit, a["run"] + 1).otherwise(0)
        return F.struct(
            (a["t"] + 1).alias("t"),
            F.when(hit, a["n"] + 1).otherwise(a["n"]).alias("n"),
            F.when(hit, a["s"] + (v - bias)).otherwise(a["s"]).alias("s"),
            F.when(hit, a["p"] + a["t"]).otherwise(a["p"]).alias("p"),
            run.alias("run"),
            F.greatest(a["best"], run).alias("best"),
        )

    def end(a: Column) -> Column:
        return F.struct(
            (a["n"] / a["t"]).alias("ppv"),
            F.when(a["n"] > 0, a["s"] / a["n"]).otherwise(0.0).alias("mpv"),
            F.when(a["n"] > 0, a["p"] / a["n"]).otherwise(-1.0).alias("mipv"),
            a["best"].cast("long").alias("lspv"),
        )

    return F.aggregate(c, state, step, end)


def pool_normalized(c: Column, bias: Column) -> Column:
    """The explorer's variant: plain mean, position and run as shares."""
    n = F.size(c)
    p = pool(c, bias)
    above = F.filter(c, lambda v: v > bias)
    mean = F.when(F.size(above) > 0, F.aggregate(above, F.lit(0.0), lambda s, v: s + v) / F.size(above)).otherwise(0.0)
    return F.struct(
        p["ppv"].alias("ppv"),
        mean.alias("mpv"),
        F.when(p["mipv"] >= 0, p["mipv"] / (n - 1)).otherwise(0.0).alias("mipv"),
        (p["lspv"] / n).alias("lspv"),
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
