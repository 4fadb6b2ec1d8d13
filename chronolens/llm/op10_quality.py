"""Quality rules and a hashed n-gram likelihood ratio.

Base rules come from exact counts of each text.  The verdict of the rest is the
log-likelihood ratio between two multinomials over hashed byte n-grams, one of
trusted documents and one of the whole corpus, divided by the number of n-grams.
A document is kept if that ratio reaches a threshold which almost every trusted
document reaches.  Nothing is drawn at random: equal input gives equal verdicts.

Steps: (1) one pass counts the n-grams of all documents, and of the trusted
ones, into two tables of fixed size; (2) one pass computes counts and ratios of
all documents; (3) the threshold is a quantile of the trusted documents' ratios.
Trusted documents are all rows that a label calls good.  Their texts meet the
labels in a shuffle, which a bit table of fixed size keeps most other texts out
of; neither ids nor scores are gathered, and the quantile is exact.

Defined results
  * null or empty text: all counts 0, base_failed, not kept;
  * very long texts are counted whole, in pieces;
  * ties: a ratio equal to the threshold is kept;
  * no trusted document: the ratio is 0 for all and everything that passes the
    base rules is kept;
  * repeated rows are judged one by one; extra columns are kept, columns that
    have the result's names are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import bound_batches, fresh, stage
from ._words import SEPARATOR, grams, slices, words_of

TABLE_BITS = 16
#: Bits of the table that tells most other ids from trusted ones (the join is exact).
SIEVE_BITS = 24
#: Keys a rank is looked up among on the driver; above, their bits are counted.
HELD = 1 << 14
#: Share of the trusted documents that may lie below the threshold.
TRUSTED_LOSS = 0.002
#: Distance kept below that quantile, in nats for an n-gram.
MARGIN = 0.15
WINDOW = 5

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def gram_ids(b: np.ndarray) -> np.ndarray:
    """Table places of the byte trigrams of one text."""
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    x = b.astype(np.uint32)
    v = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
    return (v * np.uint32(0x9E3779B1)) >> np.uint32(32 - TABLE_BITS)


def _bytes(raw, offsets, i):
    return raw[offsets[i] : offsets[i + 1]]


def trusted_ids(labels: DataFrame, kind: T.DataType) -> DataFrame:
    """(doc_id) of every trusted document, once."""
    good = labels.where("quality = 1").select(F.col("doc_id").cast(kind).alias("doc_id"))
    return stage(good.where("doc_id IS NOT NULL").distinct(), "trusted")


def _trusted_rows(df: DataFrame, trusted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text) of the rows whose id is in ``trusted``."""
    word, bits = fresh(df, "_word", "_bits")
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << SIEVE_BITS))
    bit = lambda c: F.pmod(place(c), F.lit(64)).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("doc_id")))
    sieve = trusted.groupBy(F.shiftright(place(F.col("doc_id")), 6).alias(word)).agg(F.bit_or(mask).alias(bits))
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    near = rows.join(F.broadcast(sieve), F.shiftright(place(F.col("doc_id")), 6) == F.col(word))  # at most 2**SIEVE_BITS / 64 rows
    near = near.where(F.call_function("getbit", F.col(bits), bit(F.col("doc_id"))) == 1).select("doc_id", "text")
    return near.join(trusted.hint("shuffle_hash"), "doc_id")  # a semi join would be moved below the sieve


def gram_counts(df: DataFrame, text: str = "text") -> np.ndarray:
    """n-gram counts of all texts: a table of 2**TABLE_BITS numbers."""

    def count(batches):
        every = np.zeros(1 << TABLE_BITS, np.int64)
        for batch in batches:
            for part, raw, offsets in slices(batch, text):
                for i in range(part.num_rows):
                    if offsets[i + 1] - offsets[i] >= 3:
                        c = np.bincount(gram_ids(_bytes(raw, offsets, i)), minlength=1)
                        every[: len(c)] += c
        size = 1 << 12
        for k in range(0, 1 << TABLE_BITS, size):
            e = every[k : k + size]
            if e.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([e.tobytes()])], names=["k", "e"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, e in zip(*[c.to_pylist() for c in batch.columns]):
                sums[k] = sums.get(k, 0) + np.frombuffer(e, np.int64)
        for k, e in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([e.tobytes()])], names=["k", "e"])

    parts = df.select(text).mapInArrow(count, "k int, e binary")
    summed = parts.repartition(1 << (TABLE_BITS - 12), "k").mapInArrow(add, "k int, e binary")
    every = np.zeros(1 << TABLE_BITS, np.int64)
    for r in summed.collect():  # a table of fixed size
        e = np.frombuffer(r["e"], np.int64)
        every[r["k"] : r["k"] + len(e)] += e
    return every


def corpus_counts(df: DataFrame, trusted: DataFrame | set[int], doc_id: str = "doc_id", text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(all, trusted) n-gram counts; ``trusted`` holds distinct ids."""
    if not isinstance(trusted, DataFrame):
        trusted = df.sparkSession.createDataFrame([(i,) for i in trusted if i is not None], T.StructType([T.StructField("doc_id", df.schema[doc_id].dataType)]))
    return gram_counts(df, text), gram_counts(_trusted_rows(df, trusted, doc_id, text))


def log_ratio(every: np.ndarray, good: np.ndarray) -> np.ndarray:
    """log p(trusted) - log p(corpus) of each place, with add-one smoothing."""
    if not good.sum():
        return np.zeros(len(every), np.float64)
    p = (good + 1.0) / (good.sum() + len(good))
    q = (every + 1.0) / (every.sum() + len(every))
    return np.log(p) - np.log(q)


def _repeat_words(w) -> np.ndarray:
    """Words of each row that lie in a WINDOW-word run found twice or more."""
    runs, first = grams(w, WINDOW)
    n = len(w.first) - 1
    out = np.zeros(n, np.int64)
    counts = np.diff(w.first)
    for i in np.flatnonzero(counts > WINDOW).tolist():
        h = runs[first[i] : first[i + 1]]
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = s[1:] == s[:-1]
        if not same.any():
            continue
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(len(h) + WINDOW, np.int32)
        at = np.flatnonzero(twice)
        edge[at] += 1
        edge[at + WINDOW] -= 1
        out[i] = int((np.cumsum(edge) > 0).sum())
    return out


def _dup_lines(b: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b.count(b"\n") == 0:
        return 0
    seen, n = set(), 0
    for line in b.split(b"\n"):
        if line.strip(b" \t\n\x0b\x0c\r"):
            if line in seen:
                n += 1
            else:
                seen.add(line)
    return n


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_counts(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The exact counts of the rows of a slice."""
    w = words_of(raw, offsets)
    lo, hi = int(offsets[0]), int(offsets[-1])
    b = raw[lo:hi]
    at = offsets - lo

    def summed(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return np.diff(total[at])

    return {
        "n_words": np.diff(w.first).astype(np.int64),
        "word_chars": summed(~SEPARATOR[b] & ((b & 0xC0) != 0x80)),
        "n_symbols": summed(SYMBOLS[b]),
        "n_dup_lines": np.array([_dup_lines(raw[offsets[i] : offsets[i + 1]].tobytes()) for i in range(len(offsets) - 1)], np.int64),
        "n_repeat_words": _repeat_words(w),
    }


def measure(df: DataFrame, ratio: np.ndarray, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with the base counts, base_failed and the length-normalised ratio."""
    made = [*BASE, "base_failed", "score"]
    carried = [f for f in df.schema.fields if f.name not in made and (keep_text or f.name != text)]
    schema = T.StructType(
        [*carried, *[T.StructField(n, T.LongType()) for n in BASE], T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType())]
    )
    table = df.sparkSession.sparkContext.broadcast(ratio)  # 8 << TABLE_BITS bytes

    def run(batches):
        weights = table.value
        for batch in batches:
            for part, raw, offsets in slices(batch, text):
                c = base_counts(raw, offsets)
                failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
                score = np.zeros(part.num_rows)
                for i in range(part.num_rows):
                    g = gram_ids(_bytes(raw, offsets, i))
                    if len(g):
                        score[i] = weights[g].mean()
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(part.schema.get_field_index(f.name)) for f in carried], *[pa.array(c[n]) for n in BASE], pa.array(failed), pa.array(score)],
                    names=[f.name for f in schema.fields],
                )

    return df.mapInArrow(run, schema)


def _keys(scores: DataFrame) -> DataFrame:
    """(k): whole numbers in the order of the one column's doubles."""

    def run(batches):
        for batch in batches:
            i = np.asarray(batch.column(0)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(i < 0, i ^ np.int64(2**63 - 1), i))], names=["k"])

    return scores.mapInArrow(run, "k long")


def _nth(keys: DataFrame, rank: int) -> float:
    """The double of that rank, from 0: 16 bits more with each pass."""
    for shift in (48, 32, 16, 0):
        place = F.shiftright("k", shift)
        for key, n in sorted(map(tuple, keys.groupBy(place).count().collect())):  # 2**16 places at most
            if rank < n:
                break
            rank -= n
        keys = keys.where(place == key)
        if n <= HELD:
            key = sorted(r[0] for r in keys.collect())[rank]
            break
    i = np.array([key], np.int64)
    return float(np.where(i < 0, i ^ np.int64(2**63 - 1), i).view(np.float64)[0])


def quantile(scores: DataFrame, share: float) -> float | None:
    """``np.quantile`` of the one column of doubles, exact, without gathering it."""
    n = scores.count()
    if not n:
        return None
    keys, at = _keys(scores), share * (n - 1)
    low = min(int(at), n - 1)
    return float(np.quantile([_nth(keys, low), _nth(keys, min(low + 1, n - 1))], at - low))


def quality(df: DataFrame, labels: DataFrame, loss: float = TRUSTED_LOSS, keep_text: bool = True) -> DataFrame:
    """``df`` (doc_id, text, ...) with counts, score, base_failed and kept."""
    bound_batches(df.sparkSession)
    trusted = trusted_ids(labels, df.schema["doc_id"].dataType)
    every, good = corpus_counts(df, trusted)
    weights = log_ratio(every, good)
    measured = measure(df, weights, keep_text=keep_text)
    slim = stage(measured, "quality")
    threshold = float("-inf")
    if good.sum():
        of = slim.where("NOT base_failed").select("doc_id", "score").join(trusted, "doc_id", "left_semi")
        least = quantile(stage(of.groupBy("doc_id").agg(F.min("score").alias("score")).select("score"), "scores"), loss)
        if least is not None:
            threshold = least - MARGIN
    return slim.drop("kept").withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out = quality(docs, labels, keep_text=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


ORACLE = None
