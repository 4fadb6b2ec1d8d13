"""Sharding: a uniform shuffle into shards of exact size.

A hypergeometric communication matrix says how many rows each source partition
sends to each shard.  Row sums are the partitions' sizes, column sums the shards'
exact sizes, and the matrix has the law that a uniform permutation of all rows
would give it.  Every partition permutes its rows and deals them out by its row of
the matrix; after the exchange every shard permutes its rows again, in ranges of a
random key, which gives the slots.

No matrix is ever held: a task draws only its own row, going down a binary tree
over the partitions whose nodes have fixed seeds of their own, so each task (and
each retry) finds the same numbers.  What is broadcast is one count for a
partition.  Ranges hold about RANGE_BYTES, whatever the rows' sizes.

Defined results
  * null ids or texts are rows like any other; repeated rows are dealt out one
    by one; extra columns are kept; helper columns take names that do not clash;
  * very long texts weigh like any other row: sizes are counts of rows;
  * an empty table gives an empty result with all columns;
  * shard sizes differ by at most one; the first ``rows mod shards`` are larger;
  * slots of a shard are 0 .. size - 1, each once;
  * the method knows no groups: equal texts are dealt out one by one, since a
    group with a third of all rows could not lie in one shard of equal size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import bound_batches, fresh, stage

SHARDS = 16
#: Bytes of a slot range: the unit of the second permutation.
RANGE_BYTES = 4 << 20

#: NumPy's sampler takes populations below this.
_NUMPY_MAX = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Number of good ones among n drawn without replacement; any size."""
    if n <= 0 or good <= 0:
        return 0
    if bad <= 0 or n >= good + bad:
        return min(n, good)
    if good + bad < _NUMPY_MAX:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    lo, hi = max(0, n - bad), min(n, good)
    mode = min(hi, max(lo, (n + 1) * (good + 1) // (total + 2)))
    sd = (n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))) ** 0.5
    a, b = max(lo, mode - int(14 * sd) - 40), min(hi, mode + int(14 * sd) + 40)
    k = np.arange(a, b, dtype=np.float64)  # ratio p(k+1) / p(k)
    ratio = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    log_p = np.concatenate([[0.0], np.cumsum(ratio)])
    p = np.exp(log_p - log_p.max())
    c = np.cumsum(p)
    return a + int(np.searchsorted(c, rng.random() * c[-1], "right"))


def split_counts(rng: np.random.Generator, cells: np.ndarray, n: int) -> np.ndarray:
    """How many of n drawn items fall in each cell (multivariate hypergeometric)."""
    out = np.zeros_like(cells)
    left = int(cells.sum())
    for i in np.flatnonzero(cells):
        c = int(cells[i])
        left -= c
        got = hypergeometric(rng, c, left, n)
        out[i] = got
        n -= got
        if n == 0:
            break
    return out


def matrix_row(seed: int, counts: np.ndarray, cells: np.ndarray, row: int) -> np.ndarray:
    """Row ``row`` of the communication matrix; counts: rows of each partition."""
    ends = np.concatenate([[0], np.cumsum(counts)])
    lo, hi = 0, len(counts)
    cells = cells.astype(np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.Generator(np.random.PCG64([seed, 0, lo, hi]))
        left = split_counts(rng, cells, int(ends[mid] - ends[lo]))
        if row < mid:
            cells, hi = left, mid
        else:
            cells, lo = cells - left, mid
    return cells


def deal_rows(seed: int, counts: np.ndarray, sizes: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and order key of each row of partition i: its local permutation."""
    rng = np.random.Generator(np.random.PCG64([seed, 1, i]))
    mine = matrix_row(seed, counts, sizes, i)
    labels = np.repeat(np.arange(len(mine), dtype=np.int32), mine)
    rng.shuffle(labels)
    return labels, rng.integers(0, 2**63 - 1, len(labels), dtype=np.int64, endpoint=True)


def shard(
    df: DataFrame,
    shards: int = SHARDS,
    seed: int = 0,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """``df`` with ``shard`` (int) and ``slot`` (long), uniformly shuffled.

    The input is staged once with its partition and row number, so that counts
    and deals rest on the same files even if an executor is lost.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    spark = df.sparkSession
    bound_batches(spark)
    drop = [c for c in df.columns if c.lower() in ("shard", "slot")]
    df = df.drop(*drop)
    part, row, rank, key, offset = fresh(df, "_part", "_row", "_range", "_key", "_offset")
    numbered = df.withColumn(row, F.monotonically_increasing_id())
    numbered = numbered.withColumn(part, F.shiftright(row, 33).cast("int"))
    staged = stage(numbered.withColumn(row, F.col(row).bitwiseAND((1 << 33) - 1)), "shards")

    counted = {r[0]: r[1] for r in staged.groupBy(part).count().toLocalIterator()}
    names = np.array(sorted(counted), np.int64)
    counts = np.array([counted[p] for p in names.tolist()], np.int64)
    total = int(counts.sum())
    sizes = np.full(shards, total // shards, np.int64)
    sizes[: total % shards] += 1
    size = int(str(staged._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # of its files
    ranges = max(1, min(-(-size // shards // range_bytes), total // shards))
    sent = spark.sparkContext.broadcast((names, counts, sizes))  # 16 bytes a partition

    def deal(batches):
        names, counts, sizes = sent.value
        at, labels, keys = None, None, None
        for batch in batches:
            parts = batch.column(batch.schema.get_field_index(part)).to_numpy(zero_copy_only=False)
            rows = batch.column(batch.schema.get_field_index(row)).to_numpy(zero_copy_only=False)
            label, order = np.empty(len(rows), np.int32), np.empty(len(rows), np.int64)
            for p in np.unique(parts):
                if p != at:
                    labels, keys = deal_rows(seed, counts, sizes, int(np.searchsorted(names, p)))
                    at = p
                m = parts == p
                label[m], order[m] = labels[rows[m]], keys[rows[m]]
            of = ((order >> 31) * ranges >> 32).astype(np.int32)  # ranges of the key, in its order
            keep = [batch.column(k) for k, name in enumerate(batch.schema.names) if name != part]
            named = [name for name in batch.schema.names if name != part]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(label), pa.array(of), pa.array(order)], names=[*named, "shard", rank, key])

    added = [T.StructField("shard", T.IntegerType()), T.StructField(rank, T.IntegerType()), T.StructField(key, T.LongType())]
    out = staged.mapInArrow(deal, T.StructType([*df.schema.fields, T.StructField(row, T.LongType()), *added]))
    slim = staged.select(part, row).mapInArrow(deal, T.StructType([T.StructField(row, T.LongType()), *added]))
    # where each range begins in its shard
    begins = slim.groupBy("shard", rank).count()
    before = Window.partitionBy("shard").orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    begins = begins.select("shard", rank, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(offset))
    if shards * ranges <= 100_000:  # 16 bytes a range; beyond that a shuffled join
        begins = F.broadcast(begins)
    slot = F.row_number().over(Window.partitionBy("shard", rank).orderBy(key, row)) - 1
    slotted = out.withColumn("slot", slot.cast("long")).join(begins, ["shard", rank])
    return slotted.select(*[F.col(f"`{c}`") for c in df.columns], "shard", (F.col("slot") + F.col(offset)).alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard(docs).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


ORACLE = None
