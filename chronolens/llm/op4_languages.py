"""Language identification by multilingual mixture inference.

A text's byte n-grams are explained by a mixture of languages whose proportions
expectation-maximisation estimates.  The set of languages grows one at a time:
a language enters if the log-likelihood gained exceeds a penalty for its
proportion.  The prediction is the language with the largest proportion, the
score that proportion.

The multinomials are learned from the rows with a language whose
``crc32(doc_id) mod 5`` is not 0, all of them, in one pass that yields a table of
fixed size for each language.

Defined results
  * null text or text without a letter: ``und`` with score 0;
  * a text without an n-gram of letters takes the language most frequent in the
    training rows, with the score of its share;
  * ties between languages go to the one first in order of code points;
  * no training row: every text is ``und`` with score 0;
  * null ids are never held out and never learned from; repeated rows are
    predicted one by one; extra columns are kept, columns with the result's
    names are replaced;
  * very long texts are read whole.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import bound_batches
from ._words import slices

TABLE_BITS = 16
FOLDS = 5
SMOOTHING = 0.5
#: Nats that a language must gain for each proportion added: a BIC-like penalty,
#: half the logarithm of the n-grams times this factor (n-grams overlap).
PENALTY = 6.0
EM_STEPS = 60
EM_STOP = 1e-6

UNKNOWN = "und"

# Bytes as seen by the n-grams: A-Z as a-z, bytes above 127 as they are, all
# others as one gap.
_SEEN = np.zeros(256, np.uint32)
for _i in range(256):
    _c = chr(_i)
    _SEEN[_i] = _i if _i >= 128 else (ord(_c.lower()) if _c.isalpha() else 32)

_ASCII_LETTER = np.array([chr(i).isalpha() and i < 128 for i in range(256)])
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(b: np.ndarray) -> bool:
    """Whether UTF-8 bytes hold a letter (a code point of Unicode's class L)."""
    if _ASCII_LETTER[b].any():
        return True
    return bool((b >= 128).any()) and _LETTER.search(b.tobytes().decode("utf-8", "replace")) is not None


def gram_ids(b: np.ndarray) -> np.ndarray:
    """Table places of the trigrams, without those that are mostly gap."""
    if not len(b):
        return np.zeros(0, np.uint16)
    x = np.empty(len(b) + 2, np.uint32)
    x[0] = x[-1] = 32
    x[1:-1] = _SEEN[b]
    v = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
    v = v[x[1:-1] != 32]
    return ((v * np.uint32(0x9E3779B1)) >> np.uint32(32 - TABLE_BITS)).astype(np.uint16)


def held_out(key: int | None) -> bool:
    return key is not None and zlib.crc32(str(key).encode()) % FOLDS == 0


def learn(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and their n-gram counts, from all training rows."""
    bound_batches(df.sparkSession)

    def count(batches):
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, raw, offsets in slices(batch, text):
                keys = part.column(part.schema.get_field_index(doc_id)).to_pylist()
                langs = part.column(part.schema.get_field_index(lang)).to_pylist()
                for i, (k, l) in enumerate(zip(keys, langs)):
                    if k is None or l is None or held_out(k):
                        continue
                    t = tables.get(l)
                    if t is None:
                        t = tables[l] = np.zeros(1 << TABLE_BITS, np.int64)
                    g = gram_ids(raw[offsets[i] : offsets[i + 1]])
                    if len(g):
                        c = np.bincount(g)
                        t[: len(c)] += c
        size = 1 << 12
        for l, t in tables.items():
            for k in range(0, 1 << TABLE_BITS, size):
                if t[k : k + size].any():
                    yield pa.RecordBatch.from_arrays([pa.array([l]), pa.array([k], pa.int32()), pa.array([t[k : k + size].tobytes()])], names=["l", "k", "c"])

    def add(batches):
        sums: dict = {}
        for batch in batches:
            for l, k, c in zip(*[x.to_pylist() for x in batch.columns]):
                sums[l, k] = sums.get((l, k), 0) + np.frombuffer(c, np.int64)
        for (l, k), c in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([l]), pa.array([k], pa.int32()), pa.array([c.tobytes()])], names=["l", "k", "c"])

    schema = "l string, k int, c binary"
    rows = df.select(F.col(doc_id).alias(doc_id), F.col(text).alias(text), F.col(lang).alias(lang))
    summed = rows.mapInArrow(count, schema).repartition("l", "k").mapInArrow(add, schema)
    tables: dict[str, np.ndarray] = {}
    for r in summed.collect():  # a table of fixed size for each language
        t = tables.setdefault(r["l"], np.zeros(1 << TABLE_BITS, np.int64))
        t[r["k"] : r["k"] + (1 << 12)] += np.frombuffer(r["c"], np.int64)
    names = sorted(tables)
    return names, np.array([tables[n] for n in names]) if names else np.zeros((0, 1 << TABLE_BITS), np.int64)


def probabilities(counts: np.ndarray) -> np.ndarray:
    """p(n-gram | language), smoothed; one row for each language."""
    if not len(counts):
        return counts.astype(np.float64)
    c = counts + SMOOTHING
    return c / c.sum(1, keepdims=True)


def em(p: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions and log-likelihood of the mixture; p: languages x n-grams."""
    k = len(p)
    if k == 1:
        return np.ones(1), float(c @ np.log(p[0]))
    w = np.full(k, 1.0 / k)
    total = c.sum()
    for _ in range(EM_STEPS):
        mixed = w @ p
        new = w * (p @ (c / mixed)) / total
        done = np.abs(new - w).max() < EM_STOP
        w = new
        if done:
            break
    return w, float(c @ np.log(w @ p))


def infer(p: np.ndarray, logs: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(languages, proportions) of a text with n-grams ``g``."""
    c = np.bincount(g, minlength=0)
    at = np.flatnonzero(c)
    c = c[at].astype(np.float64)
    q = p[:, at]
    single = logs[:, at] @ c
    chosen = [int(np.argmax(single))]
    w, like = np.ones(1), float(single[chosen[0]])
    penalty = 0.5 * PENALTY * np.log(max(2.0, c.sum()))
    while len(chosen) < len(p):
        # what a small share of each other language would gain
        mixed = w @ q[chosen]
        best = None
        rest = [j for j in range(len(p)) if j not in chosen]
        slope = q[rest] @ (c / mixed) - c.sum()
        for j in [rest[i] for i in np.argsort(-slope, kind="stable") if slope[i] > 0]:
            trial = sorted([*chosen, j])
            tw, tl = em(q[trial], c)
            if tl - like > penalty and (best is None or tl > best[2]):
                best = (trial, tw, tl)
        if best is None:
            break
        chosen, w, like = best
    return np.array(chosen), w


def identify(df: DataFrame, model: tuple[list[str], np.ndarray], doc_id: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with held_out, lang_pred, score and the mixture (proportions)."""
    bound_batches(df.sparkSession)
    names, counts = model
    made = {"held_out", "lang_pred", "score", "mixture"}
    carried = [f for f in df.schema.fields if f.name not in made and (keep_text or f.name != text)]
    schema = T.StructType(
        [
            *carried,
            T.StructField("held_out", T.BooleanType()),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("mixture", T.MapType(T.StringType(), T.DoubleType())),
        ]
    )
    p = probabilities(counts)
    share = counts.sum(1) / max(1, counts.sum()) if len(names) else np.zeros(0)
    sent = df.sparkSession.sparkContext.broadcast((names, p.astype(np.float64), share))  # 8 << TABLE_BITS bytes a language

    def run(batches):
        names, p, share = sent.value
        logs = np.log(p) if len(names) else p
        for batch in batches:
            for part, raw, offsets in slices(batch, text):
                keys = part.column(part.schema.get_field_index(doc_id)).to_pylist()
                out, pred, score, mixture = [], [], [], []
                for i, k in enumerate(keys):
                    out.append(held_out(k))
                    b = raw[offsets[i] : offsets[i + 1]]
                    if not names or not has_letter(b):
                        pred.append(UNKNOWN)
                        score.append(0.0)
                        mixture.append([])
                        continue
                    g = gram_ids(b)
                    if len(g):
                        which, w = infer(p, logs, g)
                    else:
                        which, w = np.arange(len(names)), share
                    top = int(np.argmax(w))
                    pred.append(names[which[top]])
                    score.append(float(min(1.0, max(0.0, w[top]))))
                    mixture.append([(names[a], float(x)) for a, x in zip(which, w)])
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(part.schema.get_field_index(f.name)) for f in carried],
                        pa.array(out, pa.bool_()),
                        pa.array(pred, pa.string()),
                        pa.array(score, pa.float64()),
                        pa.array(mixture, pa.map_(pa.string(), pa.float64())),
                    ],
                    names=[f.name for f in schema.fields],
                )

    return df.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs)
    return identify(docs.select("doc_id", "text"), model, keep_text=False).select("doc_id", "held_out", "lang_pred", "score")


ORACLE = None
