"""Ranking and selection of channels of multichannel series (id, channel, x, y)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .attribution import class_means
from .ranking import elbow


def prototypes(series: DataFrame) -> DataFrame:
    """(channel, y, t, mean)."""
    return class_means(series, "channel")


def euclidean(protos: DataFrame) -> DataFrame:
    """(channel, distance): summed over class pairs; tables of class means only."""
    a = protos.select("channel", "t", F.col("y").alias("a"), F.col("mean").alias("u"))
    b = protos.select("channel", "t", F.col("y").alias("b"), F.col("mean").alias("v"))
    pairs = a.join(b, ["channel", "t"]).where("a < b")
    per = pairs.groupBy("channel", "a", "b").agg(F.sqrt(F.sum((F.col("u") - F.col("v")) * (F.col("u") - F.col("v")))).alias("d"))
    return per.groupBy("channel").agg(F.sum("d").alias("distance"))


def warping_distance(a: np.ndarray, b: np.ndarray) -> float:
    """Unconstrained dynamic time warping: squared cost, root at the end."""
    m = len(b)
    last = np.full(m + 1, np.inf)
    last[0] = 0.0
    for v in a:
        cost = (v - b) ** 2
        now = np.full(m + 1, np.inf)
        best = np.minimum(last[1:], last[:-1])
        run = np.inf
        for j in range(m):
            run = cost[j] + min(best[j], run)
            now[j + 1] = run
        last = now
    return float(np.sqrt(last[m]))


def warped(protos: DataFrame) -> DataFrame:
    """(channel, distance) by time warping; classes squared times channels rows."""
    p = protos.groupBy("channel", "y").agg(F.array_sort(F.collect_list(F.struct("t", "mean"))).alias("p")).select("channel", "y", F.col("p.mean").alias("x"))
    pairs = p.alias("a").join(p.alias("b"), F.expr("a.channel = b.channel AND a.y < b.y")).select("a.channel", F.col("a.x").alias("u"), F.col("b.x").alias("v"))

    @F.pandas_udf("double")
    def dtw(u: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([warping_distance(np.asarray(x, float), np.asarray(y, float)) for x, y in zip(u, v)], dtype=float)

    return pairs.select("channel", dtw("u", "v").alias("d")).groupBy("channel").agg(F.sum("d").alias("distance"))


def distances(series: DataFrame, distance: str = "euclidean") -> DataFrame:
    if distance not in ("euclidean", "dtw"):
        raise ValueError("distance is 'euclidean' or 'dtw'")
    p = prototypes(series)
    return euclidean(p) if distance == "euclidean" else warped(p)


def _ranked(d: DataFrame) -> DataFrame:
    w = Window.orderBy(F.desc("distance"), "channel")  # a row for each channel
    return d.withColumn("rank", F.row_number().over(w) - 1)


def select_elbow(series: DataFrame, distance: str = "euclidean") -> DataFrame:
    """(channel, distance, rank) of the channels up to the elbow."""
    r = _ranked(distances(series, distance))
    e = elbow(r.select(F.col("rank").alias("i"), F.col("distance").alias("v")))
    return r.crossJoin(F.broadcast(e)).where("rank <= elbow").drop("elbow")  # one-row table


def select_top(series: DataFrame, k: int | None = None, fraction: float = 0.5, distance: str = "euclidean") -> DataFrame:
    """(channel, distance, rank) of the k best; k = max(1, int(fraction * channels))."""
    r = _ranked(distances(series, distance))
    if k is not None:
        return r.where(F.col("rank") < k)
    n = F.count("*").over(Window.partitionBy())
    return r.withColumn("_n", n).where(F.col("rank") < F.greatest(F.lit(1), F.floor(F.col("_n") * fraction))).drop("_n")


def select(series: DataFrame, method: str = "elbow", **kwargs) -> DataFrame:
    if method not in ("elbow", "top"):
        raise ValueError("method is 'elbow' or 'top'")
    return (select_elbow if method == "elbow" else select_top)(series, **kwargs)


def flatten(series: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """(id, y, x): channels joined end to end, in order of selection."""
    if selected is None:
        s = series.withColumn("rank", F.col("channel"))
    else:
        s = series.join(F.broadcast(selected.select("channel", "rank")), "channel")  # a row for each channel
    g = s.groupBy("id", "y").agg(F.array_sort(F.collect_list(F.struct("rank", "x"))).alias("p"))
    return g.select("id", "y", F.flatten(F.col("p.x")).alias("x"))


def channel_sum(activations: DataFrame, *keys: str) -> DataFrame:
    """Activations summed over channels."""
    return activations.groupBy(*keys, "t").agg(F.sum("activation").alias("activation"))
