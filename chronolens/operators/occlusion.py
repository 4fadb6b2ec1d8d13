"""Occlusion: how scores change when a window of a series is set to zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .model import Model, decision
from .ranking import first_per_group, spread_by_target


def window_defaults(length: int, window: int | None = None, stride: int | None = None) -> tuple[int, int]:
    w = window or max(3, length // 20)
    return w, stride or max(1, w // 2)


def windows(rows: DataFrame, length: int, window: int, stride: int) -> DataFrame:
    """``rows`` times window starts ``pos``: 0, stride, ... up to length - window.

    The tail may stay uncovered; its sensitivity is 0.
    """
    return rows.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(length - window), F.lit(stride))))


def blank(x: Column, pos: Column, window: int) -> Column:
    """x with zeros in [pos, pos + window)."""
    return F.transform(x, lambda v, t: F.when((t >= pos) & (t < pos + window), F.lit(0.0).cast("double")).otherwise(v.cast("double")))


def spread_over_time(impacts: DataFrame, length: int, window: int, *keys: str) -> DataFrame:
    """(keys, t, sensitivity): mean impact of the windows over each timepoint."""
    covered = impacts.withColumn("t", F.explode(F.sequence("pos", F.col("pos") + window - 1)))
    per = covered.groupBy(*keys, "t").agg(F.avg("impact").alias("sensitivity"))
    every = impacts.select(*keys).distinct().withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    return every.join(per, [*keys, "t"], "left").select(*keys, "t", F.coalesce("sensitivity", F.lit(0.0)).alias("sensitivity"))


def pick_rows(series: DataFrame, n: int, regression: bool = False) -> DataFrame:
    """n rows: one of each class, then the lowest ids; or spread over the target."""
    total = series.count()
    n = min(n, total)
    if regression:
        return spread_by_target(series, n, total)
    first = first_per_group(series, "y", 1).withColumn("_o", F.lit(0))
    rest = series.join(first.select("id"), "id", "left_anti").orderBy("id").limit(n).withColumn("_o", F.lit(1))
    return first.unionByName(rest).orderBy("_o", "id").limit(n).drop("_o")


def occlusion(series: DataFrame, model: Model, mask=None, window: int | None = None, stride: int | None = None) -> DataFrame:
    """(id, y, t, sensitivity) of the given rows.

    Rows times windows go through the transform in one stage; of the bank only
    what the mask needs is computed.
    """
    length = model.bank.plan.length
    w, s = window_defaults(length, window, stride)
    base = decision(series.select("id", "y", "x"), model, mask).select("id", F.col("scores").alias("_s"))
    shown = windows(series.select("id", "y", "x"), length, w, s).withColumn("x", blank(F.col("x"), F.col("pos"), w))
    hidden = decision(shown, model, mask)
    both = hidden.join(base, "id")
    impact = F.aggregate(F.zip_with("scores", "_s", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, v: a + v)
    return spread_over_time(both.select("id", "y", "pos", impact.alias("impact")), length, w, "id", "y")


def aggregate_occlusion(series: DataFrame, model: Model, mask=None, window: int | None = None, stride: int | None = None) -> DataFrame:
    """(y, t, mean, sem, differential) over all rows."""
    o = occlusion(series, model, mask, window, stride)
    m = o.groupBy("y", "t").agg(F.avg("sensitivity").alias("mean"), (F.stddev_pop("sensitivity") / F.sqrt(F.count("*"))).alias("sem"))
    w = Window.partitionBy("t")
    return m.withColumn("differential", F.max("mean").over(w) - F.min("mean").over(w))


def occlusion_saliency(series: DataFrame, model: Model, mask=None, rows: int = 50) -> DataFrame:
    """(t, value): mean sensitivity of at most ``rows`` rows, as a share of the largest."""
    o = occlusion(pick_rows(series, rows, model.classes is None), model, mask).groupBy("t").agg(F.avg("sensitivity").alias("v"))
    top = F.max("v").over(Window.partitionBy())  # a row for each timepoint
    return o.select("t", F.when(top > 0, F.col("v") / top).otherwise(F.col("v")).alias("value"))
