"""Ranking of saliency maps by what happens when their peaks are perturbed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .model import Model, predict
from .ranking import auc

FRACTIONS = tuple(round(0.05 * k, 2) for k in range(1, 11))


def random_saliency(spark: SparkSession, length: int, seed: int = 42) -> DataFrame:
    """(t, value): uniform numbers as a share of the largest."""
    v = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11).cast("double") + 0.5) * (2.0**-53)
    r = spark.range(length).select(F.col("id").cast("int").alias("t"), v.alias("v"))
    return r.select("t", (F.col("v") / F.max("v").over(Window.partitionBy())).alias("value"))


def inverse_saliency(saliency: DataFrame) -> DataFrame:
    """(t, value): 1 - value as a share of the largest."""
    r = saliency.select("t", (1 - F.col("value")).alias("v"))
    top = F.max("v").over(Window.partitionBy())  # a row for each timepoint
    return r.select("t", F.when(top > 0, F.col("v") / top).otherwise(F.col("v")).alias("value"))


def resampled(saliency: DataFrame, length: int) -> DataFrame:
    """(t, value) on ``length`` points, by linear interpolation on [0, 1]."""
    n = saliency.count()
    if n == length:
        return saliency.select("t", "value")
    w = Window.partitionBy().orderBy("t")
    s = saliency.select("t", "value", F.lead("value").over(w).alias("next"))
    spark = saliency.sparkSession
    pos = F.col("id") * F.lit((n - 1) / max(1, length - 1))
    grid = spark.range(length).select(F.col("id").cast("int").alias("u"), pos.alias("p")).withColumn("t", F.least(F.lit(n - 1), F.floor("p")).cast("int"))
    v = F.col("value") + (F.col("p") - F.col("t")) * (F.coalesce("next", "value") - F.col("value"))
    return grid.join(s, "t").select(F.col("u").alias("t"), v.alias("value"))


def top_times(saliency: DataFrame, fractions: Sequence[float], length: int, *keys: str) -> DataFrame:
    """(keys, fraction, times): the max(1, int(fraction * length)) largest."""
    w = Window.partitionBy(*keys).orderBy(F.desc("value"), "t")
    ranked = saliency.select(*keys, "t", F.row_number().over(w).alias("_r"))
    grid = ranked.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    k = F.greatest(F.lit(1), F.floor(F.col("fraction") * length + 1e-9))
    return grid.where(F.col("_r") <= k).groupBy(*keys, "fraction").agg(F.sort_array(F.collect_list("t")).alias("times"))


def _uniform(*parts) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) * (2.0**-53)


def zero(x: Column, hit: Callable[[Column], Column], mean: Column, std: Column) -> Column:
    return F.transform(x, lambda v, t: F.when(hit(t), 0.0).otherwise(v))


def global_mean(x: Column, hit, mean: Column, std: Column) -> Column:
    return F.transform(x, lambda v, t: F.when(hit(t), mean).otherwise(v))


def noise(x: Column, hit, mean: Column, std: Column) -> Column:
    def draw(t):
        return mean + std * F.sqrt(-2 * F.log(_uniform(F.lit(1), F.col("id"), t))) * F.cos(2 * F.pi() * _uniform(F.lit(2), F.col("id"), t))

    return F.transform(x, lambda v, t: F.when(hit(t), draw(t)).otherwise(v))


def row_mean(x: Column, hit, mean: Column, std: Column) -> Column:
    """The mean of the row's points that are not perturbed."""
    kept = F.filter(x, lambda v, t: ~hit(t))
    m = F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda s, v: s + v) / F.size(kept)).otherwise(0.0)
    return F.transform(x, lambda v, t: F.when(hit(t), m).otherwise(v))


#: name -> f(x, hit(t), mean, std) -> x: callers may add their own.
PERTURBATIONS: dict[str, Callable] = {"zero": zero, "mean": global_mean, "noise": noise, "inverse": row_mean}


def perturb(series: DataFrame, times: Column, method: str, stats: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """``series`` with the points in the array ``times`` perturbed."""
    if method not in PERTURBATIONS:
        raise ValueError(f"perturbation is one of {sorted(PERTURBATIONS)}")
    x = F.col("x").cast("array<double>")
    return series.withColumn("x", PERTURBATIONS[method](x, lambda t: F.array_contains(times, t), F.lit(stats[0]), F.lit(stats[1])))


def value_stats(series: DataFrame) -> tuple[float, float]:
    """Mean and population deviation of all values."""
    v = series.select(F.explode("x").alias("v")).agg(F.avg("v"), F.stddev_pop("v")).first()
    return float(v[0] or 0.0), float(v[1] or 0.0)


def accuracy_drops(series: DataFrame, model: Model, saliency: DataFrame, fractions: Sequence[float] = FRACTIONS, perturbations: Sequence[str] | None = None) -> DataFrame:
    """(name, perturbation, fraction, drop); saliency: (name, t, value).

    Explainers, perturbations, fractions and rows make one table that goes through
    the model in one stage.
    """
    names = list(perturbations or PERTURBATIONS)
    stats = value_stats(series)
    length = model.bank.plan.length
    grid = top_times(saliency, fractions, length, "name")
    base = predict(series, model).agg(F.avg((F.col("pred") == F.col("y")).cast("double")).alias("base"))
    rows = series.select("id", "y", "x").crossJoin(F.broadcast(grid))  # explainers times fractions rows
    parts = None
    for p in names:
        one = perturb(rows, F.col("times"), p, stats).drop("times").withColumn("perturbation", F.lit(p))
        parts = one if parts is None else parts.unionByName(one)
    acc = predict(parts, model).groupBy("name", "perturbation", "fraction").agg(F.avg((F.col("pred") == F.col("y")).cast("double")).alias("acc"))
    return acc.crossJoin(F.broadcast(base)).select("name", "perturbation", "fraction", (F.col("base") - F.col("acc")).alias("drop"))  # one-row table


def evaluate(drops: DataFrame) -> DataFrame:
    """(name, perturbation, auc)."""
    return auc(drops, "name", "perturbation")


def rank(aucs: DataFrame) -> DataFrame:
    """(name, mean_auc, rank), best first."""
    m = aucs.groupBy("name").agg(F.avg("auc").alias("mean_auc"))
    return m.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_auc"), "name")))  # a row an explainer


def mean_absolute(attributions: DataFrame) -> DataFrame:
    """(t, value): mean absolute attribution as a share of the largest."""
    m = attributions.groupBy("t").agg(F.avg(F.abs("v")).alias("v"))
    top = F.max("v").over(Window.partitionBy())
    return m.select("t", F.when(top > 0, F.col("v") / top).otherwise(F.col("v")).alias("value"))


#: Rows a Shapley background may have.
MAX_BACKGROUND = 100


def shapley_windows(series: DataFrame, model: Model, background: DataFrame, window: int | None = None, stride: int | None = None, permutations: int = 16, mode: str = "confidence", target=None, seed: int = 42) -> DataFrame:
    """(id, t, v): Shapley values of windows, spread over their points.

    Windows are players; a player left out takes its points from a background row.
    Values are estimated over seeded permutations: each player's gain when it
    joins those before it.  ``background`` is a bounded table (tens of rows); one
    of more than MAX_BACKGROUND rows is an error, not cut.
    """
    from .transform import _rows, bank_features

    if mode not in ("confidence", "target"):
        raise ValueError("mode is 'confidence' or 'target'")
    if mode == "target" and target not in (model.classes or []):
        raise ValueError("target is one of the model's classes")
    length = model.bank.plan.length
    w = window or max(5, length // 10)
    s = stride or max(1, w // 3)
    starts = list(range(0, max(1, length - w + 1), s))
    rows = background.select("x").limit(MAX_BACKGROUND + 1).collect()
    if len(rows) > MAX_BACKGROUND:
        raise ValueError(f"background has more than {MAX_BACKGROUND} rows")
    base = np.array([r[0] for r in rows], np.float64)
    sent = series.sparkSession.sparkContext.broadcast((model, base, starts))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("t", T.IntegerType()), T.StructField("v", T.DoubleType())])

    def explain(batches):
        model, base, starts = sent.value

        def value(x):
            sc = model.ridge.scores(bank_features(x, model.bank.plan, model.bank.biases))
            if mode == "target":
                return sc[:, model.classes.index(target)] if sc.shape[1] > 1 else sc[:, 0] * (1 if model.classes.index(target) else -1)
            return sc.max(1) if sc.shape[1] > 1 else sc[:, 0]

        for batch in batches:
            x = _rows(batch.column(batch.schema.get_field_index("x")), length)
            for i, key in enumerate(batch.column(batch.schema.get_field_index("id")).to_pylist()):
                rng = np.random.Generator(np.random.PCG64([seed, int(key) & 0x7FFFFFFF]))
                phi = np.zeros(len(starts))
                for _ in range(permutations):
                    row = base[rng.integers(len(base))].copy()
                    steps = [row.copy()]
                    order = rng.permutation(len(starts))
                    for j in order:
                        row[starts[j] : starts[j] + w] = x[i, starts[j] : starts[j] + w]
                        steps.append(row.copy())
                    phi[order] += np.diff(value(np.array(steps)))
                phi /= permutations
                total, count = np.zeros(length), np.zeros(length)
                for j, a in enumerate(starts):
                    total[a : a + w] += phi[j]
                    count[a : a + w] += 1
                v = total / np.maximum(count, 1)
                yield pa.RecordBatch.from_arrays([pa.array([key] * length, pa.int64()), pa.array(np.arange(length, dtype=np.int32)), pa.array(v)], names=["id", "t", "v"])

    return series.select("id", "x").mapInArrow(explain, schema)


def predict_column(model: Model, mode: str = "confidence", target=None) -> Callable[[DataFrame], DataFrame]:
    """A function from series to (columns, value): confidence, a class's score or
    the label."""
    from .model import decision

    if mode not in ("confidence", "target", "predict"):
        raise ValueError("mode is 'confidence', 'target' or 'predict'")
    if mode == "target" and target not in (model.classes or []):
        raise ValueError("target is one of the model's classes")

    def apply(series: DataFrame) -> DataFrame:
        d = decision(series, model)
        if mode == "predict":
            v = F.col("pred").cast("double")
        elif mode == "target":
            at = model.classes.index(target)
            v = F.get("scores", F.lit(at)) if len(model.classes) > 2 else F.get("scores", F.lit(0)) * (1 if at else -1)
        else:
            v = F.array_max("scores")
        return d.withColumn("value", v)

    return apply
