"""The whole kernel bank over series: bias fitting and the bulk transform.

The transform is one narrow Arrow stage: rows in, feature arrays out.  Nine
shifted copies of a batch give each dilation's 84 convolutions by additions (the
sum of nine is shared), and all biases of a kernel are compared at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolens.functions.plan import KERNELS, BankPlan, quantile

#: Rows that biases are drawn from: a bound, whatever the table's size.
POOL_ROWS = 2000
#: Rows drawn for each kernel and dilation.
DRAWS = 100


def convolutions(x: np.ndarray, dilation: int):
    """Yields (kernel, convolution of every row); x: rows x time, float64."""
    n, length = x.shape
    d = dilation
    padded = np.zeros((n, length + 8 * d))
    padded[:, 4 * d : 4 * d + length] = x
    shifted = [padded[:, k * d : k * d + length] for k in range(9)]
    total = shifted[0].copy()
    for s in shifted[1:]:
        total += s
    three = [3 * s for s in shifted]
    for k, (a, b, c) in enumerate(KERNELS):
        yield k, three[a] + three[b] + three[c] - total


def longest_runs(hit: np.ndarray) -> np.ndarray:
    """Longest run of True along the last axis."""
    n = hit.shape[-1]
    at = np.arange(1, n + 1)
    gap = np.where(hit, 0, at)
    last = np.maximum.accumulate(gap, axis=-1)
    return np.where(hit, at - last, 0).max(-1)


def pooled(c: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """rows x biases x 4: ppv, mpv, mipv, lspv."""
    hit = c[:, None, :] > bias[None, :, None]
    n = hit.sum(-1)
    some = np.maximum(n, 1)
    t = np.arange(c.shape[1], dtype=np.float64)
    above = (hit * c[:, None, :]).sum(-1) - n * bias[None, :]
    out = np.empty((*n.shape, 4))
    out[..., 0] = n / c.shape[1]
    out[..., 1] = np.where(n > 0, above / some, 0.0)
    out[..., 2] = np.where(n > 0, (hit @ t) / some, -1.0)
    out[..., 3] = longest_runs(hit)
    return out


def bank_features(x: np.ndarray, plan: BankPlan, biases: np.ndarray, needed: set[int] | None = None) -> np.ndarray:
    """rows x features of the whole bank; of ``needed`` biases only, if given
    (others stay 0)."""
    out = np.zeros((len(x), plan.width), np.float32)
    at = 0
    for rep, _, dilations, counts in plan.parts():
        data = x if rep == "raw" else np.diff(x, axis=1)
        for d, n in zip(dilations, counts):
            first = at
            at += len(KERNELS) * n
            if needed is not None and not any(b in needed for b in range(first, at)):
                continue
            for k, c in convolutions(data, d):
                b = first + k * n
                if needed is not None and not any(i in needed for i in range(b, b + n)):
                    continue
                out[:, 4 * b : 4 * (b + n)] = pooled(c, biases[b : b + n]).reshape(len(x), -1)
    return out


def draw_pool(series: DataFrame, seed: int, rows: int = POOL_ROWS) -> np.ndarray:
    """At most ``rows`` series, those with the least digests of seed and id."""
    key = F.md5(F.concat_ws(":", F.lit(seed), F.lit("pool"), F.col("id")))
    picked = series.select("id", "x", key.alias("k")).orderBy("k", "id").limit(rows).select("x").toArrow()
    return np.array(picked.column("x").to_pylist(), np.float64)


def fit_biases(series: DataFrame, plan: BankPlan, seed: int = 0) -> np.ndarray:
    """Bias of each place of the bank, from order statistics of convolutions.

    For each dilation and kernel DRAWS rows are drawn anew, with replacement,
    from a pool of bounded size; the i-th bias overall is the value at place
    floor(q_i (m - 1)) of their m sorted values.
    """
    pool = draw_pool(series, seed)
    if not len(pool):
        raise ValueError("no series to fit biases on")
    out = np.empty(plan.width // 4)
    at = 0
    for r, (rep, _, dilations, counts) in enumerate(plan.parts()):
        data = pool if rep == "raw" else np.diff(pool, axis=1)
        slot = 0
        for d, n in zip(dilations, counts):
            rng = np.random.Generator(np.random.PCG64([seed + r, d]))
            take = rng.integers(0, len(data), (len(KERNELS), min(len(data), DRAWS)))
            for k, c in convolutions(data, d):
                values = np.sort(c[take[k]], axis=None)
                for _ in range(n):
                    q = np.float32(quantile(slot))
                    out[at] = values[min(len(values) - 1, int(q * (len(values) - 1)))]
                    at += 1
                    slot += 1
    return out


@dataclass(frozen=True)
class Bank:
    """A plan with its biases."""

    plan: BankPlan
    biases: np.ndarray


def fit_bank(series: DataFrame, num_features: int = 10000, max_dilations: int = 16, seed: int = 0) -> Bank:
    length = series.select(F.size("x").alias("n")).first()["n"]
    plan = BankPlan(length, num_features, max_dilations)
    return Bank(plan, fit_biases(series, plan, seed))


def _rows(column: pa.Array, length: int) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    x = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)
    if x.shape[1] != length or np.isnan(x).any():
        raise ValueError("series row is null, ragged or holds NaN")
    return x


def bound_batches(spark, size: int) -> None:
    """Bounds Arrow batches by bytes, unless the session has a bound."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(size))


#: Feature values that one step of the bulk stage holds.
STEP_VALUES = 2_000_000


def map_features(series: DataFrame, bank: Bank, function, schema: T.StructType, needed: set[int] | None = None) -> DataFrame:
    """Applies ``function(features, batch) -> columns`` next to the transform.

    What is made from the features leaves the stage, not the features: a model's
    scores are a few numbers a row where features are thousands.
    """
    sent = series.sparkSession.sparkContext.broadcast((bank.plan, bank.biases))

    def run(batches):
        plan, biases = sent.value
        step = max(1, STEP_VALUES // plan.width)
        for batch in batches:
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                x = _rows(part.column(part.schema.get_field_index("x")), plan.length)
                columns = function(bank_features(x, plan, biases, needed), part)
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return series.mapInArrow(run, schema)


def transform(series: DataFrame, bank: Bank) -> DataFrame:
    """(all columns but x, features ARRAY<FLOAT>)."""
    carried = [f for f in series.schema.fields if f.name != "x"]
    schema = T.StructType([*carried, T.StructField("features", T.ArrayType(T.FloatType()))])

    def pack(features, part):
        flat = pa.array(features.ravel(), pa.float32())
        offsets = pa.array(np.arange(0, features.size + 1, features.shape[1], dtype=np.int32))
        return [*[part.column(part.schema.get_field_index(f.name)) for f in carried], pa.ListArray.from_arrays(offsets, flat)]

    return map_features(series, bank, pack, schema)


def features_long(features: DataFrame) -> DataFrame:
    """(columns, feature_index, value)."""
    rest = [c for c in features.columns if c != "features"]
    return features.select(*rest, F.posexplode("features").alias("feature_index", "value"))


def oversample(series: DataFrame, seed: int = 0) -> DataFrame:
    """Random oversampling of every class to the largest class's size.

    Copy c of a row is a draw: row number ``hash(seed, y, c) mod n_y`` of the
    class.  Only counts meet across rows; a class is never gathered in a task.
    """
    from pyspark.sql import Window

    counts = series.groupBy("y").count()
    most = counts.agg(F.max("count")).first()[0]
    if most is None:
        return series
    # ranks by hash bucket: counts of buckets give offsets, so no global sort
    buckets = 64
    keyed = series.withColumn("_b", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(buckets)).cast("int"))
    per = keyed.groupBy("y", "_b").count()
    offset = F.sum("count").over(Window.partitionBy("y").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    per = per.withColumn("_o", F.coalesce(offset, F.lit(0))).select("y", "_b", "_o")  # classes x 64 rows
    ranked = keyed.join(F.broadcast(per), ["y", "_b"]).withColumn(
        "_r", F.row_number().over(Window.partitionBy("y", "_b").orderBy("id")) - 1 + F.col("_o")
    )
    wanted = counts.where(F.col("count") < most).select("y", F.col("count").alias("_n"))
    draws = wanted.select("y", "_n", F.explode(F.sequence(F.lit(0), F.lit(most) - F.col("_n") - 1)).alias("_c"))
    draws = draws.select("y", F.pmod(F.xxhash64(F.lit(seed), "y", "_c"), "_n").alias("_r"))
    extra = ranked.join(draws, ["y", "_r"]).select(*series.columns)
    return series.unionByName(extra)


