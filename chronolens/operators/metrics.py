"""Metrics as aggregations over (y, pred)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(predictions: DataFrame, *keys: str) -> DataFrame:
    """(keys, y, pred, n): counts on the grid of all classes, zeros included."""
    return full_grid(predictions.groupBy(*keys, "y", "pred").agg(F.count("*").alias("n")), *keys)


def full_grid(counts: DataFrame, *keys: str) -> DataFrame:
    """Counts (keys, y, pred, n) with the zeros of all pairs of classes."""
    classes = counts.select(F.col("y").alias("c")).union(counts.select(F.col("pred").alias("c"))).distinct()
    grid = classes.select(F.col("c").alias("y")).crossJoin(classes.select(F.col("c").alias("pred")))  # classes squared
    if keys:
        grid = counts.select(*keys).distinct().crossJoin(grid)
    return grid.join(counts, [*keys, "y", "pred"], "left").select(*keys, "y", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def _log(base: float) -> Column:
    return F.log(F.lit(base))


def mutual_information(cm: DataFrame, *keys: str, base: float = 2.0) -> DataFrame:
    """(keys, mi) of a confusion table; 0 if it is empty."""
    from pyspark.sql import Window

    row, col, all_ = Window.partitionBy(*keys, "y"), Window.partitionBy(*keys, "pred"), Window.partitionBy(*keys)
    p = cm.select(*keys, "n", F.sum("n").over(row).alias("r"), F.sum("n").over(col).alias("c"), F.sum("n").over(all_).alias("t"))
    term = F.when(F.col("n") > 0, F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("r") * F.col("c"))) / _log(base)).otherwise(0.0)
    return p.groupBy(*keys).agg(F.sum(term).alias("mi")) if keys else p.agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("mi"))


def classification(predictions: DataFrame, *keys: str) -> DataFrame:
    """(keys, accuracy, balanced_accuracy, f1_macro, f1_weighted, mcc, mutual_info)."""
    return of_confusion(confusion(predictions, *keys), *keys)


def of_confusion(cm: DataFrame, *keys: str) -> DataFrame:
    """The same metrics from a full confusion table."""
    on = list(keys)
    true = cm.groupBy(*on, F.col("y").alias("k")).agg(F.sum("n").alias("t"), F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    pred = cm.groupBy(*on, F.col("pred").alias("k")).agg(F.sum("n").alias("p"))
    per = true.join(pred, [*on, "k"])
    f1 = F.when(F.col("t") + F.col("p") > 0, 2 * F.col("tp") / (F.col("t") + F.col("p"))).otherwise(0.0)
    n = F.sum("t")
    spread = F.sqrt((n * n - F.sum(F.col("p") * F.col("p"))) * (n * n - F.sum(F.col("t") * F.col("t"))).cast("double"))
    out = per.groupBy(*on).agg(
        (F.sum("tp") / n).alias("accuracy"),
        F.avg(F.when(F.col("t") > 0, F.col("tp") / F.col("t"))).alias("balanced_accuracy"),
        F.avg(f1).alias("f1_macro"),
        (F.sum(f1 * F.col("t")) / n).alias("f1_weighted"),
        F.when(spread > 0, (F.sum("tp") * n - F.sum(F.col("p") * F.col("t"))) / spread).otherwise(0.0).alias("mcc"),
    )
    mi = mutual_information(cm, *keys).withColumnRenamed("mi", "mutual_info")
    return out.join(mi, on) if on else out.crossJoin(mi)  # one row each


def regression(predictions: DataFrame, *keys: str) -> DataFrame:
    """(keys, r2, mse, rmse, mae, explained_variance, pearson_r) in one pass."""
    e = F.col("y") - F.col("pred")
    mse = F.avg(e * e)
    constant = (F.stddev_pop("y") == 0) | (F.stddev_pop("pred") == 0)
    return predictions.groupBy(*keys).agg(
        (1 - F.sum(e * e) / (F.var_pop("y") * F.count("*"))).alias("r2"),
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (1 - F.var_pop(e) / F.var_pop("y")).alias("explained_variance"),
        F.when((F.count("*") <= 1) | constant, 0.0).otherwise(F.corr("y", "pred")).alias("pearson_r"),
    )


def summarise(values: DataFrame, *keys: str) -> DataFrame:
    """(keys, mean, std, n) of ``value``; population deviation."""
    return values.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n"))
