"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are normalised: lower case, every run of other characters than
letters, digits and underscores one space.  An item with an error budget of k is
split into k + 1 pieces; a passage within k edits of it holds one of the pieces
unchanged.  An automaton over all pieces finds such hits in each text; around
each hit a count of trigrams rules out most chance hits, and Myers' bit-parallel
algorithm gives the distance of the rest.

Items are read in blocks of bounded size.  One block is sent to the executors at a
time and held against every text; texts are never shuffled while one block holds
all items.  With more, each block's matches are written as a table of text numbers
before the next block is read, and joined to the texts at the end.

Defined results
  * null or empty text: no match; null items, and items without a letter or digit:
    never match; items of fewer than ``min_chars`` normalised characters don't
    either (none by default), and a warning gives their number;
  * items of fewer than SHORT normalised characters have no error budget and match
    whole words only, since chance would match their parts;
  * equal items each match under their own id; an item id that repeats gives one
    match for each row of it, a null one is reported as null;
  * for each text and item the best passage is reported, the first of equals;
    repeated texts are searched one by one;
  * very long texts are searched whole; extra columns are kept, columns with the
    result's names are replaced.
"""

from __future__ import annotations

import itertools
import re
import warnings

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import bound_batches, fresh, stage

RATE = 0.08
MIN_CHARS = 1
#: Normalised characters below which an item must occur unchanged, as whole words.
SHORT = 20
#: Characters of items in one block.
BLOCK_CHARS = 1_000_000

_other = re.compile(r"\W+")


def normal(text: str | None) -> str:
    return _other.sub(" ", text.lower()).strip() if text else ""


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """The item cut into k + 1 parts of nearly equal length, with their places."""
    cuts = [len(item) * j // (k + 1) for j in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(least distance of pattern to a part of text, first end of such a part)."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    plus, minus, score = full, 0, m
    best, end = m, 0
    get = masks.get
    for i, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(xh | plus))
        down = plus & xh
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best, end = score, i + 1
        up <<= 1
        plus = (down << 1 | ~(xv | up)) & full
        minus = up & xv & full
    return best, end


def passage(pattern: str, text: str) -> tuple[int, int, int]:
    """(distance, start, end) of the part of text nearest to pattern."""
    d, end = myers(pattern, text)
    _, back = myers(pattern[::-1], text[:end][::-1])
    return d, end - back, end


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        import ahocorasick

        self.items = []
        found: dict[str, list] = {}
        for item_id, text in items:
            k = int(rate * len(text)) if len(text) >= SHORT else 0
            at = len(self.items)
            self.items.append((item_id, text, k, {text[i : i + 3] for i in range(len(text) - 2)}))
            for offset, piece in pieces(text, k):
                found.setdefault(piece, []).append((at, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[object, int, int, int, int]]:
        """(item, distance, budget, start, end) of each item that occurs."""
        if not text or not self.items:
            return []
        starts: dict[int, set[int]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for at, offset in places:
                starts.setdefault(at, set()).add(end + 1 - size - offset)
        out = []
        for at in sorted(starts):
            item_id, item, k, grams = self.items[at]
            if len(item) < SHORT:
                for s in sorted(starts[at]):
                    e = s + len(item)
                    if (s == 0 or text[s - 1] == " ") and (e == len(text) or text[e] == " "):
                        out.append((item_id, 0, 0, s, e))
                        break
                continue
            best = None
            lo = hi = None
            spans = []
            for s in sorted(starts[at]):  # windows that overlap are searched once
                a, b = max(0, s - k), min(len(text), s + len(item) + k)
                if hi is not None and a <= hi and b - lo <= 4 * len(item):
                    hi = max(hi, b)
                else:
                    if hi is not None:
                        spans.append((lo, hi))
                    lo, hi = a, b
            spans.append((lo, hi))
            for a, b in spans:
                window = text[a:b]
                # an edit takes away three trigrams at most
                if len(grams.difference([window[i : i + 3] for i in range(len(window) - 2)])) > 3 * k:
                    continue
                d, end = myers(item, window)
                if d <= k and (best is None or d < best[0]):
                    best = (d, a, window, end)
            if best is not None:
                d, a, window, end = best
                _, back = myers(item[::-1], window[:end][::-1])
                out.append((item_id, d, k, a + end - back, a + end))
        return out


def item_blocks(benchmark: DataFrame, item_id: str, text: str, min_chars: int):
    """Lists of (id, normalised text) of BLOCK_CHARS characters or little more."""
    block, size, short = [], 0, 0
    for r in benchmark.select(item_id, text).toLocalIterator():
        t = normal(r[1])
        if len(t) < max(1, min_chars):
            short += bool(t)
            continue
        block.append((r[0], t))
        size += len(t)
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if short:
        warnings.warn(f"{short} benchmark items of fewer than {min_chars} normalised characters are not searched", stacklevel=2)
    if block:
        yield block


def find_leaks(
    df: DataFrame,
    benchmark: DataFrame,
    rate: float = RATE,
    min_chars: int = MIN_CHARS,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    keep_text: bool = True,
) -> DataFrame:
    """``df`` with ``leaks``: the items found in each text.

    Places are in the normalised text.
    """
    spark = df.sparkSession
    bound_batches(spark)
    kind = benchmark.schema[item_id].dataType
    match = T.StructType(
        [
            T.StructField("item_id", kind),
            T.StructField("distance", T.IntegerType()),
            T.StructField("budget", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
        ]
    )
    df = df.drop(*[c for c in df.columns if c.lower() == "leaks"])

    def search(df: DataFrame, block: list, carried: list, always: bool) -> DataFrame:
        """``carried`` columns and the leaks of one block, for texts with some or for all."""
        sent = spark.sparkContext.broadcast((block, rate))  # BLOCK_CHARS characters
        schema = T.StructType([*carried, T.StructField("leaks", T.ArrayType(match))])

        def run(batches):
            from pyspark.sql.pandas.types import to_arrow_type

            matcher = Matcher(*sent.value)
            leak_type = to_arrow_type(T.ArrayType(match))
            for batch in batches:
                leaks = [[dict(zip(match.names, m)) for m in matcher.find(normal(x.as_py()))] for x in batch.column(batch.schema.get_field_index(text))]
                out = [*[batch.column(batch.schema.get_field_index(f.name)) for f in carried], pa.array(leaks, leak_type)]
                found = pa.RecordBatch.from_arrays(out, names=schema.names)
                yield found if always else found.filter(pa.array([bool(x) for x in leaks]))

        return df.mapInArrow(run, schema)

    carried = [f for f in df.schema.fields if keep_text or f.name != text]
    blocks = item_blocks(benchmark, item_id, item_text, min_chars)
    first = next(blocks, [])
    second = next(blocks, None)
    if second is None:
        return search(df, first, carried, True)
    row, more = fresh(df, "_row", "_leaks")
    staged = stage(df.withColumn(row, F.monotonically_increasing_id()), "texts")
    slim = staged.select(row, text)
    found = None
    for block in itertools.chain([first, second], blocks):
        part = stage(search(slim, block, [slim.schema[row]], False), "leaks")
        found = part if found is None else found.union(part)
    found = found.groupBy(row).agg(F.flatten(F.collect_list("leaks")).alias(more))  # at most one match for an item
    joined = staged.join(found, row, "left")
    none = F.array().cast(T.ArrayType(match))
    return joined.select(*[F.col(f"`{f.name}`") for f in carried], F.coalesce(more, none).alias("leaks"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_leaks(docs, benchmark, keep_text=False)
    return found.select("doc_id", F.explode("leaks").alias("m")).select("doc_id", "m.item_id", "m.distance", "m.budget", "m.start", "m.end")


ORACLE = None
