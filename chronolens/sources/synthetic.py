"""Generators of labelled series, all inside Spark (``range`` and seeded draws)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _unit(*parts: Column | str | int) -> Column:
    """A number in (0, 1) that is a function of its parts: recomputed equal."""
    h = F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) * (2.0**-53)


def _normal(*parts) -> Column:
    """Standard normal from two such numbers (Box-Muller)."""
    return F.sqrt(-2 * F.log(_unit(*parts, 1))) * F.cos(2 * F.pi() * _unit(*parts, 2))


def bumps(
    spark: SparkSession,
    n_samples: int = 5000,
    n_timepoints: int = 100,
    centers: Sequence[int] = (25, 50, 75),
    amplitudes: float | Sequence[float] | None = None,
    sigma: float = 5.0,
    noise_std: float = 1.0,
    seed: int = 42,
) -> DataFrame:
    """One Gaussian bump a class at its centre, in noise."""
    k = len(centers)
    if amplitudes is None:
        amps = [1.0] * k
    elif isinstance(amplitudes, (int, float)):
        amps = [float(amplitudes)] * k
    else:
        amps = [float(a) for a in amplitudes]
        if len(amps) != k:
            raise ValueError("amplitudes and centers differ in number")
    y = F.floor(_unit(seed, F.col("id"), 7) * k).cast("int")
    base = spark.range(n_samples).withColumn("y", y)
    c = F.array(*[F.lit(float(v)) for v in centers])[F.col("y")]
    a = F.array(*[F.lit(v) for v in amps])[F.col("y")]
    x = F.transform(
        F.sequence(F.lit(0), F.lit(n_timepoints - 1)),
        lambda t: (a * F.exp(-0.5 * ((t - c) / sigma) * ((t - c) / sigma)) + noise_std * _normal(seed, F.col("id"), t)).cast("float"),
    )
    return base.select("id", x.alias("x"), "y")


def single_bump(spark: SparkSession, n_samples: int = 200, n_timepoints: int = 200, center: float = 100, width: float = 20, amplitude: float = 2.0, noise_std: float = 1.0, seed: int = 42) -> DataFrame:
    """Two balanced classes; class 1 has a bump of this full width at half height."""
    s = width / 2.355
    y = (F.col("id") % 2).cast("int")
    x = F.transform(
        F.sequence(F.lit(0), F.lit(n_timepoints - 1)),
        lambda t: (noise_std * _normal(seed, F.col("id"), t) + F.when(y == 1, amplitude * F.exp(-0.5 * ((t - center) / s) * ((t - center) / s))).otherwise(0.0)).cast("float"),
    )
    return spark.range(n_samples).select("id", x.alias("x"), y.alias("y"))


def multichannel(spark: SparkSession, n_samples: int = 200, n_channels: int = 8, n_timepoints: int = 128, informative: Sequence[int] = (1, 4), noise_std: float = 0.5, seed: int = 42) -> DataFrame:
    """(id, channel, x, y): three classes told apart on the informative channels."""
    rows = spark.range(n_samples).withColumn("y", (F.col("id") % 3).cast("int"))
    rows = rows.withColumn("channel", F.explode(F.array(*[F.lit(c) for c in range(n_channels)])))
    c = (F.col("y") + 1) * (n_timepoints / 4.0)
    bump = F.col("channel").isin(*informative)
    x = F.transform(
        F.sequence(F.lit(0), F.lit(n_timepoints - 1)),
        lambda t: (noise_std * _normal(seed, F.col("id"), F.col("channel"), t) + F.when(bump, 3 * F.exp(-0.5 * ((t - c) / 6) * ((t - c) / 6))).otherwise(0.0)).cast("float"),
    )
    return rows.select("id", "channel", x.alias("x"), "y")


def steps(spark: SparkSession, n_per_class: int = 200, n_timepoints: int = 200, noise_std: float = 0.3, seed: int = 42) -> DataFrame:
    """Three classes, each raised by 1.5 on its own interval."""
    y = (F.col("id") % 3).cast("int")
    lo, hi = F.array(F.lit(30), F.lit(100), F.lit(160))[y], F.array(F.lit(50), F.lit(120), F.lit(180))[y]
    x = F.transform(
        F.sequence(F.lit(0), F.lit(n_timepoints - 1)),
        lambda t: (noise_std * _normal(seed, F.col("id"), t) + F.when((t >= lo) & (t < hi), 1.5).otherwise(0.0)).cast("float"),
    )
    return spark.range(3 * n_per_class).select("id", x.alias("x"), y.alias("y"))


def regression(spark: SparkSession, n_samples: int = 400, n_timepoints: int = 200, seed: int = 42) -> DataFrame:
    """A target that depends on the height of [80, 100) and, less, of [140, 160)."""
    a, b = _unit(seed, F.col("id"), 11) * 2, _unit(seed, F.col("id"), 13) * 2
    x = F.transform(
        F.sequence(F.lit(0), F.lit(n_timepoints - 1)),
        lambda t: (0.3 * _normal(seed, F.col("id"), t) + F.when((t >= 80) & (t < 100), a).when((t >= 140) & (t < 160), b).otherwise(0.0)).cast("float"),
    )
    y = 2.0 * a + 0.5 * b + 0.2 * _normal(seed, F.col("id"), 17)
    return spark.range(n_samples).select("id", x.alias("x"), y.alias("y"))


def sample_signals(spark: SparkSession, n_timepoints: int = 128) -> DataFrame:
    """Three named signals: a bump, two peaks, an oscillation."""
    n = float(n_timepoints)
    t_axis = F.sequence(F.lit(0), F.lit(n_timepoints - 1))

    def peak(t, c, w):
        return F.exp(-0.5 * ((t - c * n) / (w * n)) * ((t - c * n) / (w * n)))

    forms = [
        ("bump", lambda t: peak(t, 0.5, 0.08)),
        ("two_peaks", lambda t: peak(t, 0.3, 0.05) + 0.7 * peak(t, 0.7, 0.05)),
        ("oscillation", lambda t: F.sin(2 * F.pi() * 5 * t / n)),
    ]
    one = spark.range(1)
    out = None
    for name, f in forms:
        row = one.select(F.lit(name).alias("name"), F.transform(t_axis, f).cast("array<float>").alias("x"))
        out = row if out is None else out.unionByName(row)
    return out


def bayes_error(spark: SparkSession, n_timepoints: int = 100, centers: Sequence[int] = (25, 50, 75), amplitude: float = 1.0, sigma: float = 5.0, noise_std: float = 1.0, draws: int = 50_000, seed: int = 42) -> DataFrame:
    """One row (error, accuracy, draws): the best classifier's Monte-Carlo error.

    The class with the largest ``x . m - |m|^2 / 2`` is taken.  With equal noise
    the products with the class means are all that matters, so their joint normal
    law is drawn instead of whole series: exact, and a hundred times less work.
    """
    import numpy as np

    t = np.arange(n_timepoints)
    means = np.array([amplitude * np.exp(-0.5 * ((t - c) / sigma) ** 2) for c in centers])
    gram = means @ means.T
    root = np.linalg.cholesky(gram + 1e-12 * np.eye(len(centers))) * noise_std
    k = len(centers)
    rows = spark.range(draws).withColumn("y", F.floor(_unit(seed, F.col("id"), 5) * k).cast("int"))
    z = [_normal(seed, F.col("id"), 100 + j) for j in range(k)]
    rows = rows.select("y", *[z[j].alias(f"z{j}") for j in range(k)])
    g = [[F.lit(float(v)) for v in row] for row in gram]
    scores = []
    for i in range(k):
        noise = sum((float(root[i, j]) * F.col(f"z{j}") for j in range(i + 1)), F.lit(0.0))
        scores.append(F.array(*g[i])[F.col("y")] + noise - 0.5 * float(gram[i, i]))
    s = F.array(*scores)
    pred = F.array_position(s, F.array_max(s)) - 1
    return rows.select((pred != F.col("y")).cast("int").alias("e")).agg(F.avg("e").alias("error"), (1 - F.avg("e")).alias("accuracy"), F.count("*").alias("draws"))


def noise_for_error(spark: SparkSession, target: float, tolerance: float = 0.005, steps_: int = 25, **kwargs) -> float:
    """Noise level at which the best classifier's error is ``target`` (bisection)."""
    lo, hi = 0.01, 20.0
    mid = (lo + hi) / 2
    for _ in range(steps_):
        mid = (lo + hi) / 2
        e = bayes_error(spark, noise_std=mid, **kwargs).first()["error"]
        if abs(e - target) < tolerance:
            break
        lo, hi = (mid, hi) if e < target else (lo, mid)
    return mid


def calibration(spark: SparkSession, noises: Sequence[float] = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 6.0, 8.0), draws: int = 20_000) -> DataFrame:
    """(noise_std, error, difficulty) for a row of noise levels."""
    out = None
    for n in noises:
        row = bayes_error(spark, noise_std=n, draws=draws).select(F.lit(float(n)).alias("noise_std"), "error")
        out = row if out is None else out.union(row)
    d = F.when(F.col("error") < 0.02, "trivial").when(F.col("error") < 0.08, "easy").when(F.col("error") < 0.15, "moderate")
    d = d.when(F.col("error") < 0.25, "hard").when(F.col("error") < 0.33, "very hard").otherwise("extreme")
    return out.withColumn("difficulty", d)
