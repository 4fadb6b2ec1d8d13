"""Rankings, elbows and schedules.  Ties go to the smaller index throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_features(importance: DataFrame, n: int = 20) -> DataFrame:
    """The n most important rows; the plan is a bounded top-k, not a sort."""
    return importance.orderBy(F.desc("importance"), "feature_index").limit(n)


def bottom_features(importance: DataFrame, n: int = 20) -> DataFrame:
    return importance.orderBy("importance", F.desc("feature_index")).limit(n)


def distinct_kernels(importance: DataFrame, n: int, candidates: int = 4) -> DataFrame:
    """Best feature of each (representation, kernel, dilation) among the top
    ``candidates * n``, at most n."""
    top = top_features(importance, candidates * n)
    w = Window.partitionBy("representation", "kernel_index", "dilation").orderBy(F.desc("importance"), "feature_index")
    best = top.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return top_features(best, n)


def first_per_group(rows: DataFrame, group: str, n: int, order: str = "id") -> DataFrame:
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def spread_by_target(rows: DataFrame, n: int, total: int) -> DataFrame:
    """Every (total // n)-th row in order of the target, at most n.

    Ranges of the target between approximate quantiles are counted first; only
    those that hold a wanted place are sorted, each by itself.
    """
    step = max(1, total // n)
    cuts = rows.select(F.percentile_approx("y", [i / 256 for i in range(1, 256)]).alias("c")).first()["c"] or []
    at = F.array(*[F.lit(c) for c in sorted(set(cuts))])
    # null targets come first, as in the order
    bucket = F.when(F.col("y").isNull(), -1).otherwise(F.size(F.filter(at, lambda c: c <= F.col("y"))) if cuts else F.lit(0))
    keyed = rows.withColumn("_b", bucket)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # 257 rows at most
    per = keyed.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    first = F.ceil(F.col("_o") / step) * step  # the first wanted place at or beyond the offset
    per = per.where((first < F.col("_o") + F.col("_n")) & (first < n * step)).select("_b", "_o")
    w = Window.partitionBy("_b").orderBy("y", "id")
    found = keyed.join(F.broadcast(per), "_b").withColumn("_r", F.row_number().over(w) - 1 + F.col("_o"))
    return found.where((F.col("_r") % step == 0) & (F.col("_r") < n * step)).orderBy("_r").limit(n).select(*rows.columns)


def normalised(value: Column, *partition: str) -> Column:
    """value over its maximum if that is positive."""
    top = F.max(value).over(Window.partitionBy(*partition))
    return F.when(top > 0, value / top).otherwise(value)


def kneedle(curve: DataFrame, *keys: str) -> DataFrame:
    """(keys, knee): index of the largest distance from the chord.

    ``curve`` has (keys, i, v); under three points the knee is 0.
    """
    w = Window.partitionBy(*keys)
    o = w.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = curve.select(
        *keys,
        "i",
        F.count("*").over(w).alias("n"),
        ((F.col("v") - F.min("v").over(w)) / (F.max("v").over(w) - F.min("v").over(w) + 1e-15)).alias("u"),
    )
    c = c.withColumn("a", F.first("u").over(o)).withColumn("b", F.last("u").over(o))
    d = F.abs(F.col("u") - (F.col("a") + (F.col("b") - F.col("a")) * F.col("i") / (F.col("n") - 1)))
    d = F.when(F.col("n") < 3, 0.0).otherwise(d)
    best = F.max_by(F.col("i"), F.struct(F.round(d, 12), -F.col("i")))
    return c.groupBy(*keys).agg(F.when(F.max("n") < 3, 0).otherwise(best).cast("int").alias("knee"))


def elbow(values: DataFrame, *keys: str) -> DataFrame:
    """(keys, elbow): the point farthest from the line through first and last.

    ``values`` has (keys, i, v) with i from 0; up to two points: the last one.
    """
    w = Window.partitionBy(*keys)
    o = w.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = values.select(*keys, "i", "v", F.count("*").over(w).alias("n"), F.first("v").over(o).alias("a"), F.last("v").over(o).alias("b"))
    dx, dy = F.col("n") - 1, F.col("b") - F.col("a")
    d = F.abs(dy * F.col("i") - dx * (F.col("v") - F.col("a"))) / F.sqrt(dx * dx + dy * dy)
    best = F.max_by(F.col("i"), F.struct(F.round(d, 12), -F.col("i")))
    return c.groupBy(*keys).agg(F.when(F.max("n") <= 2, F.max("n") - 1).otherwise(best).cast("int").alias("elbow"))


def elimination_schedule(total: int, drop: float = 0.05, steps: int = 150) -> list[int]:
    """Distinct feature counts, falling, of a recursive elimination."""
    if not 0 < drop < 1:
        raise ValueError("drop is a share between 0 and 1")
    return sorted({int(total * (1 - drop) ** k) for k in range(steps)} - {0}, reverse=True)


def auc(curve: DataFrame, *keys: str) -> DataFrame:
    """(keys, auc): trapezoids over (fraction, drop), from the point (0, 0)."""
    w = Window.partitionBy(*keys).orderBy("fraction")
    before_f, before_d = F.lag("fraction", 1, 0.0).over(w), F.lag("drop", 1, 0.0).over(w)
    area = 0.5 * (F.col("drop") + before_d) * (F.col("fraction") - before_f)
    return curve.withColumn("_a", area).groupBy(*keys).agg(F.sum("_a").alias("auc"))
