"""What the model looks at, and when: activations of chosen features over time.

Each query here takes ``chosen``: a small list of ``Feature`` (tens at most), and
builds one array expression for each; rows are exploded only after filters, and
sums meet in two steps, per (feature, class, t) and then per t.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolens.functions import arrays
from chronolens.functions.plan import KERNELS


@dataclass(frozen=True)
class Feature:
    feature_index: int
    representation: str
    dilation: int
    kernel_index: int
    bias: float
    importance: float = 1.0

    @property
    def taps(self) -> tuple[int, int, int]:
        return KERNELS[self.kernel_index]


def from_importance(top: DataFrame) -> list[Feature]:
    """The rows of a (bounded) ranking as features."""
    return [Feature(r["feature_index"], r["representation"], r["dilation"], r["kernel_index"], r["bias"], r["importance"]) for r in top.collect()]


def _convolved(f: Feature, x: Column) -> Column:
    return arrays.convolve(x if f.representation == "raw" else arrays.diff(x), f.taps, f.dilation)


def convolution_rows(series: DataFrame, chosen: Sequence[Feature]) -> DataFrame:
    """(columns, feature_index, importance, representation, bias, c): a row each."""
    rest = [c for c in series.columns if c != "x"]
    each = F.array(
        *[
            F.struct(
                F.lit(f.feature_index).alias("feature_index"),
                F.lit(f.importance).alias("importance"),
                F.lit(f.representation).alias("representation"),
                F.lit(f.dilation).alias("dilation"),
                F.lit(f.kernel_index).alias("kernel_index"),
                F.lit(f.bias).alias("bias"),
                _convolved(f, F.col("x")).alias("c"),
            )
            for f in chosen
        ]
    )
    return series.select(*rest, F.explode(each).alias("_f")).select(*rest, "_f.*")


def activation_map(series: DataFrame, chosen: Sequence[Feature], shift_diff: bool = False) -> DataFrame:
    """(columns, feature_index, importance, t, c, act) for each timepoint.

    With ``shift_diff`` a difference at t counts for t + 1.
    """
    rows = convolution_rows(series, chosen)
    rest = [c for c in rows.columns if c != "c"]
    long = rows.select(*rest, F.posexplode("c").alias("t", "c"))
    if shift_diff:
        long = long.withColumn("t", F.when(F.col("representation") == "diff", F.col("t") + 1).otherwise(F.col("t")))
    return long.withColumn("act", F.when(F.col("c") > F.col("bias"), 1).otherwise(0))


def pooled(series: DataFrame, chosen: Sequence[Feature], variant: str = "core") -> DataFrame:
    """(columns, feature_index, ppv, mpv, mipv, lspv)."""
    rows = convolution_rows(series, chosen)
    f = arrays.pool if variant == "core" else arrays.pool_normalized
    rest = [c for c in series.columns if c != "x"]
    return rows.select(*rest, "feature_index", f(F.col("c"), F.col("bias")).alias("_p")).select(*rest, "feature_index", "_p.*")


def class_means(series: DataFrame, *keys: str) -> DataFrame:
    """(keys, y, t, mean): class prototypes."""
    long = series.select(*keys, "y", F.posexplode("x").alias("t", "v"))
    return long.groupBy(*keys, "y", "t").agg(F.avg("v").alias("mean"))


def class_mean_series(series: DataFrame) -> DataFrame:
    """(y, x): class means as series (classes rows)."""
    m = class_means(series).groupBy("y").agg(F.array_sort(F.collect_list(F.struct("t", "mean"))).alias("p"))
    return m.select("y", F.col("p.mean").alias("x"))


def activation_rate(series: DataFrame, chosen: Sequence[Feature], shift_diff: bool = True, *keys: str) -> DataFrame:
    """(feature_index, importance, keys or y, t, rate): share of rows active."""
    keys = keys or ("y",)
    a = activation_map(series, chosen, shift_diff)
    return a.groupBy("feature_index", "importance", *keys, "t").agg(F.avg("act").alias("rate"))


def differential(rates: DataFrame) -> DataFrame:
    """(feature_index, importance, t, diff): spread of rates between classes."""
    return rates.groupBy("feature_index", "importance", "t").agg((F.max("rate") - F.min("rate")).alias("diff"))


def temporal_importance(series: DataFrame, chosen: Sequence[Feature], length: int) -> DataFrame:
    """(t, importance): weighted spread between classes, as a share of the largest."""
    d = differential(activation_rate(series, chosen)).groupBy("t").agg(F.sum(F.col("importance") * F.col("diff")).alias("v"))
    return _profile(d, length)


def _profile(d: DataFrame, length: int) -> DataFrame:
    """(t, importance) of all timepoints from (t, v); missing ones 0.  At most
    ``length`` rows."""
    spark = d.sparkSession
    every = spark.range(length).select(F.col("id").cast("int").alias("t")).join(d, "t", "left")
    v = F.coalesce("v", F.lit(0.0))
    top = F.max(v).over(Window.partitionBy())
    return every.select("t", F.when(top > 0, v / top).otherwise(v).alias("importance"))


def class_temporal_importance(series: DataFrame, chosen: Sequence[Feature]) -> DataFrame:
    """(y, t, importance): rates weighted by importance and spread, per class."""
    r = activation_rate(series, chosen)
    spread = differential(r).select("feature_index", "t", "diff")
    return r.join(spread, ["feature_index", "t"]).groupBy("y", "t").agg(F.sum(F.col("importance") * F.col("rate") * F.col("diff")).alias("importance"))


def center_importance(series: DataFrame, chosen: Sequence[Feature], length: int) -> DataFrame:
    """(t, importance): importance of every firing, summed where it fires."""
    a = activation_map(series, chosen, True).where("act = 1")
    return _profile(a.groupBy("t").agg(F.sum("importance").alias("v")), length)


def regression_importance(series: DataFrame, chosen: Sequence[Feature], length: int) -> DataFrame:
    """(t, importance): absolute correlation of convolution and target, weighted."""
    r = correlation_by_time(series, chosen)
    return _profile(r.groupBy("t").agg(F.sum(F.col("importance") * F.abs("r")).alias("v")), length)


def correlation_by_time(series: DataFrame, chosen: Sequence[Feature]) -> DataFrame:
    """(feature_index, importance, t, r): 0 under three rows or without spread."""
    a = activation_map(series, chosen, True)
    flat = (F.count("*") < 3) | (F.stddev_pop("c") == 0) | (F.stddev_pop("y") == 0)
    return a.groupBy("feature_index", "importance", "t").agg(F.when(flat, 0.0).otherwise(F.corr("c", F.col("y").cast("double"))).alias("r"))


def outcome_maps(series: DataFrame, predictions: DataFrame, chosen: Sequence[Feature]) -> DataFrame:
    """(y, correct, t, activation): mean weighted activation, right and wrong apart.

    ``predictions`` has (id, pred) and is joined by id.
    """
    s = series.join(predictions.select("id", "pred"), "id").withColumn("correct", F.col("pred") == F.col("y")).drop("pred")
    sizes = s.groupBy("y", "correct").agg(F.count("*").alias("n"))
    a = activation_map(s, chosen, True).groupBy("y", "correct", "t").agg(F.sum(F.col("importance") * F.col("act")).alias("s"))
    return a.join(F.broadcast(sizes), ["y", "correct"]).select("y", "correct", "t", (F.col("s") / F.col("n")).alias("activation"))  # two rows a class


def receptive_fields(series: DataFrame, chosen: Sequence[Feature], length: int) -> DataFrame:
    """(feature_index, peak, lo, hi): where each feature tells class means apart.

    The peak is the centre of mass of the spread between classes' activations on
    class means; without any spread the place of the largest absolute convolution
    of the mean of means.
    """
    means = class_mean_series(series)
    a = activation_map(means, chosen, True)
    spread = a.groupBy("feature_index", "dilation", "t").agg((F.max("act") - F.min("act")).alias("d"))
    mass = spread.groupBy("feature_index", "dilation").agg(F.sum("d").alias("m"), F.sum(F.col("t") * F.col("d")).alias("w"))
    mean = means.select(F.posexplode("x").alias("t", "v")).groupBy("t").agg(F.avg("v").alias("v"))
    whole = mean.agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("p")).select(F.col("p.v").alias("x"))
    top = activation_map(whole, chosen, True).groupBy("feature_index").agg(F.max_by("t", F.struct(F.round(F.abs("c"), 9), -F.col("t"))).alias("f"))
    peak = F.when(F.col("m") > 0, F.bround(F.col("w") / F.col("m"), 0)).otherwise(F.coalesce("f", F.lit(length // 2)))
    half = F.floor((1 + 8 * F.col("dilation")) / 2)
    out = mass.join(top, "feature_index", "left").select("feature_index", "dilation", F.greatest(F.lit(0), F.least(F.lit(length - 1), peak)).cast("int").alias("peak"))
    return out.select(
        "feature_index",
        "peak",
        F.greatest(F.lit(0), F.col("peak") - half).cast("int").alias("lo"),
        F.least(F.lit(length - 1), F.col("peak") + half).cast("int").alias("hi"),
    )


def class_mean_activation(series: DataFrame, chosen: Sequence[Feature], rank: int = 0) -> DataFrame:
    """(y, t, c, act) of the rank-th feature on class means."""
    if not 0 <= rank < len(chosen):
        raise ValueError(f"rank {rank} of {len(chosen)} features")
    return activation_map(class_mean_series(series), [chosen[rank]]).select("y", "t", "c", "act")


def multi_kernel_summary(series: DataFrame, chosen: Sequence[Feature]) -> DataFrame:
    """(feature_index, t, fires): whether a feature fires on any class mean."""
    a = activation_map(class_mean_series(series), chosen)
    return a.groupBy("feature_index", "t").agg(F.max("act").alias("fires"))


def aggregate_activation(series: DataFrame, chosen: Sequence[Feature]) -> DataFrame:
    """(y, t, activation): weighted mean activation of features on class means."""
    a = activation_map(class_mean_series(series), chosen)
    return a.groupBy("y", "t").agg((F.sum(F.col("act") * F.col("importance")) / len(chosen)).alias("activation"))


def activation_series(series: DataFrame, kernels: Sequence[Feature], length: int, bias: float = 0.0) -> DataFrame:
    """(columns, representation, dilation, kernel_index, t, activation) before
    pooling; the bias is added.  Differences are aligned left: their last point
    stays 0.  Channels (rows that share id and kernel) are to be summed by the
    caller."""
    rows = convolution_rows(series, kernels)
    rest = [c for c in series.columns if c != "x"]
    filled = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda t: F.when(t < F.size("c"), F.get("c", t) + bias).otherwise(0.0))
    return rows.select(*rest, "representation", "dilation", "kernel_index", F.posexplode(filled).alias("t", "activation"))


def by_frequency(activations: DataFrame, srate: float, precision: int = 1) -> DataFrame:
    """(id, frequency, t, activation): mean of kernels of one rounded frequency."""
    f = F.bround(F.lit(float(srate)) / (8 * F.col("dilation")), precision)
    return activations.withColumn("frequency", f).groupBy("id", "frequency", "t").agg(F.avg("activation").alias("activation"))


def histogram(rows: DataFrame, keys: Sequence[str], bins: int = 30) -> DataFrame:
    """(keys, bin, n, density) of ``value`` over its whole range; the last bin is closed."""
    lo, hi = rows.agg(F.min("value"), F.max("value")).first()
    if lo is None:
        return rows.select(*keys).limit(0).withColumn("bin", F.lit(0)).withColumn("n", F.lit(0)).withColumn("density", F.lit(0.0))
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.lit(bins - 1), F.floor((F.col("value") - lo) / width)).cast("int")
    counts = rows.withColumn("bin", b).groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("density", F.col("n") / (total * width))


def trend(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, slope, intercept, r) of y on value; null without spread."""
    return rows.groupBy(*keys).agg(F.regr_slope("y", "value").alias("slope"), F.regr_intercept("y", "value").alias("intercept"), F.corr("y", "value").alias("r"))


def correlations(long: DataFrame) -> DataFrame:
    """(a, b, r) of every pair a < b of chosen features over (id, feature_index, value).

    The self-join meets on id and yields pairs of the chosen features only.
    """
    x = long.select("id", F.col("feature_index").alias("a"), F.col("value").alias("u"))
    y = long.select("id", F.col("feature_index").alias("b"), F.col("value").alias("v"))
    return x.join(y, "id").where("a < b").groupBy("a", "b").agg(F.corr("u", "v").alias("r"))


def edges(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(feature_index, degree) at abs(r) above the threshold."""
    both = pairs.select(F.col("a").alias("feature_index"), "r").union(pairs.select(F.col("b").alias("feature_index"), "r"))
    return both.groupBy("feature_index").agg(F.sum(F.when(F.abs("r") > threshold, 1).otherwise(0)).alias("degree"))
