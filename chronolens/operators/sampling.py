"""Deterministic sampling: order by a digest of seed, tag and id.

The same rows are drawn on every run, in every engine that has MD5, and after
every lost task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def digest(seed: int | Column, tag: str, *parts: str) -> Column:
    s = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat_ws(":", s.cast("string"), F.lit(tag), *[F.col(p).cast("string") for p in parts]))


#: Hex digits of a digest that name its bucket: 4,096 buckets.
BUCKET_DIGITS = 3


def ranked(rows: DataFrame, keys: list[str], bucket: Column, *order) -> DataFrame:
    """``rows`` with ``_r``, their place from 1 in each group of ``keys``.

    ``bucket`` must not fall along the order.  A window counts places inside a
    bucket, sums of the buckets' counts give what lies before it; so a task
    sorts a bucket, whatever the size of a group.  Null keys are a group.
    """
    b = rows.withColumn("_b", bucket)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = b.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))  # groups times buckets
    names = [*keys, "_b"]
    per = per.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(names)], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    placed = b.withColumn("_w", F.row_number().over(Window.partitionBy(*names).orderBy(*order)))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(names)]
    return placed.join(per, same).withColumn("_r", F.col("_w") + F.col("_o")).select(*rows.columns, "_r")


def by_digest(rows: DataFrame, keys: list[str], key: Column) -> DataFrame:
    """``rows`` with their place in the order of the digest ``key``, then of id."""
    r = ranked(rows.withColumn("_d", key), keys, F.substring("_d", 1, BUCKET_DIGITS), "_d", "id")
    return r.drop("_d")


def by_id(rows: DataFrame) -> DataFrame:
    """``rows`` with their place in the order of id.

    Buckets of numbers lie between approximate quantiles, a table of fixed size
    that any error leaves exact; ids of other types are one bucket.
    """
    if not isinstance(rows.schema["id"].dataType, T.NumericType):
        return ranked(rows, [], F.lit(0), "id")
    share = [i / 256 for i in range(1, 256)]
    cuts = rows.select(F.percentile_approx("id", share).alias("c")).first()["c"] or []
    at = F.array(*[F.lit(c) for c in sorted(set(cuts))])
    return ranked(rows, [], F.size(F.filter(at, lambda c: c <= F.col("id"))) if cuts else F.lit(0), "id")


def _repeated(rows: DataFrame, name: str, times: int) -> DataFrame:
    return rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def stratified_folds(rows: DataFrame, repeats: int, folds: int, seed: int = 42) -> DataFrame:
    """(id, y, repeat, fold): classes dealt out evenly, anew in each repeat."""
    r = by_digest(_repeated(rows.select("id", "y"), "repeat", repeats), ["repeat", "y"], digest(F.col("repeat") + seed, "fold", "id"))
    return r.select("id", "y", "repeat", ((F.col("_r") - 1) % folds).cast("int").alias("fold"))


def plain_folds(rows: DataFrame, repeats: int, folds: int, seed: int = 42) -> DataFrame:
    """(id, repeat, fold) without strata."""
    r = by_digest(_repeated(rows.select("id"), "repeat", repeats), ["repeat"], digest(F.col("repeat") + seed, "fold", "id"))
    return r.select("id", "repeat", ((F.col("_r") - 1) % folds).cast("int").alias("fold"))


def stratified_split(rows: DataFrame, test: float = 0.3, seed: int = 42) -> DataFrame:
    """(id, y, part): the first floor(test * n) of each class by digest test."""
    n = rows.groupBy("y").agg(F.count("*").alias("_n")).withColumnRenamed("y", "_y")
    r = by_digest(rows.select("id", "y"), ["y"], digest(seed, "split", "id")).join(n, F.col("y").eqNullSafe(F.col("_y")))
    return r.select("id", "y", F.when(F.col("_r") <= F.floor(F.col("_n") * test), "test").otherwise("train").alias("part"))


def match_trials(rows: DataFrame, condition: str, reps: int = 20, frac: float = 0.8, seed: int = 42) -> DataFrame:
    """(rep, condition, id): equally many rows of each condition in each repetition,
    ``int(frac * smallest)``, without replacement."""
    n = rows.groupBy(condition).count().agg(F.floor(F.min("count") * frac).alias("_n"))
    r = by_digest(_repeated(rows.select("id", condition), "rep", reps), ["rep", condition], digest(F.col("rep") + seed, "match", "id"))
    return r.crossJoin(F.broadcast(n)).where("_r <= _n").select("rep", condition, "id")  # one-row table


def permuted_labels(rows: DataFrame, permutations: int, seed: int = 42) -> DataFrame:
    """(permutation, id, y): labels joined by rank of id with rank of digest."""
    a = _repeated(by_id(rows.select("id")), "permutation", permutations)
    b = _repeated(rows.select("id", "y"), "permutation", permutations)
    b = by_digest(b, ["permutation"], digest(F.col("permutation") + seed, "permute", "id")).select("permutation", "y", "_r")
    return a.join(b, ["permutation", "_r"]).select("permutation", "id", "y")
