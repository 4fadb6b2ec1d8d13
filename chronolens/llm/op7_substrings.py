"""Substring deduplication by relative Lempel-Ziv parsing.

A duplicate window of WINDOW words occurs in a document with a smaller id.
Documents are factored against an index of all documents' text, dealt out over
blocks of references by what the text holds:

1. every window names an anchor, the least hash among the ANCHOR-word runs in it.
   Equal windows have equal anchors, and there are some twenty times fewer
   anchors than windows.  A pass over the corpus counts the anchors; bit tables
   keep those of two documents or more, and those that are hot;
2. consecutive windows with one anchor are a unit, 50 to some 90 words of text.
   A unit goes to the reference block that holds its anchor, once for each block
   of documents; units whose anchor occurs in one document go nowhere;
3. a reference block is indexed by a suffix array over its words (dictionary
   codes, so words are compared, not hashes).  Each unit is parsed from left to
   right against the units of smaller ids: the longest match at a word is a
   factor if it has WINDOW words at least; at its end, the windows that reach
   over the boundary are checked, and the next of them that matches begins the
   next factor.  A factor knows the document and word it was found at;
4. factors return to their documents, where units meet: factors that go on in the
   same source become one, the words they cover are removed.

Hot anchors (more than HOT occurrences) would fill a block with one passage.
Their windows are indexed one by one, by 128 bits of hash, and answered by a
window function over (hash, block) rows; their factors arise in step 4.

Defined results
  * null or empty text: no words, nothing removed, kept is empty;
  * texts under WINDOW words are left alone;
  * a null id is never smaller and has no smaller one: such rows are left alone
    and refer to nothing; rows that share an id don't refer to one another;
  * windows are judged on the input, not on what is left; words are compared
    unchanged;
  * very long texts are taken whole, a block of documents of their own;
  * extra columns are kept; columns with the result's names are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _bits
from ._store import bound_batches, fresh, stage
from ._words import Words, hash_runs, mix, slices, text_buffers, words_of

WINDOW = 50
ANCHOR = 10
#: Bytes of text in a block of documents; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Occurrences of an anchor above which its windows are indexed one by one.
HOT = 256
#: Windows of a unit at most (periodic text has one anchor throughout).
UNIT_WINDOWS = 64
#: Words of a reference block; a block ends with an anchor's last unit.
INDEX_WORDS = 400_000

_U = np.uint64
_NONE = np.iinfo(np.int64).min


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Least of every n consecutive values."""
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def anchors(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window inside a row: row, first word, anchor."""
    counts = np.maximum(0, np.diff(w.first) - WINDOW + 1)
    row = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + w.first[:-1][row]
    if not len(row):
        return row, at, np.zeros(0, np.uint64)
    return row, at, sliding_min(hash_runs(w.hash, ANCHOR), WINDOW - ANCHOR + 1)[at]


def _ids(column) -> tuple[np.ndarray, np.ndarray]:
    """Ids as int64, and which rows have one."""
    known = np.asarray(column.is_valid().to_numpy(zero_copy_only=False), bool)
    return np.asarray(column.fill_null(0).to_numpy(zero_copy_only=False), np.int64), known


def _column(part: pa.RecordBatch, name: str):
    return part.column(part.schema.get_field_index(name))


def deal_blocks(df: DataFrame, text: str, block: str, row: str) -> DataFrame:
    """``df`` with a row number and the block of documents it lies in."""

    def deal(batches):
        task = TaskContext.get().partitionId()
        n = size = 0
        for batch in batches:
            _, offsets = text_buffers(_column(batch, text))
            starts = offsets[:-1] - offsets[0] + 64 * np.arange(batch.num_rows)
            made = [(task << 32) + (size + starts) // BLOCK_BYTES, (task << 33) + n + np.arange(batch.num_rows)]
            size += int(offsets[-1] - offsets[0]) + 64 * batch.num_rows
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, made)], names=[*batch.schema.names, block, row])

    return df.mapInArrow(deal, T.StructType([*df.schema.fields, T.StructField(block, T.LongType()), T.StructField(row, T.LongType())]))


def shared_anchors(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(h, hot): anchors that lie in two documents or more."""

    def find(batches):
        held: list[np.ndarray] = []
        size = 0

        def flush():
            x = np.concatenate(held, axis=1)
            order = np.argsort(x[0], kind="stable")
            h, d = x[0][order], x[1][order]
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            n = np.diff(np.append(at, len(h)))
            made = [h[at], np.minimum.reduceat(d, at), np.maximum.reduceat(d, at), n]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in made], names=["h", "lo", "hi", "n"])

        for batch in batches:
            for part, raw, offsets in slices(batch, text):
                ids, known = _ids(_column(part, doc_id))
                row, _, anchor = anchors(words_of(raw, offsets))
                first = np.ones(len(row), bool)
                first[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
                at = np.flatnonzero(first & known[row])
                if len(at):
                    held.append(np.stack([anchor[at].view(np.int64), ids[row[at]]]))
                    size += len(at)
                    if size > 500_000:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    found = df.select(doc_id, text).mapInArrow(find, "h long, lo long, hi long, n long")
    summed = found.groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    return summed.where("lo < hi").select("h", (F.col("n") > HOT).alias("hot"))


class Units:
    """What the rows of one block of documents ask of the index.

    ``row``, ``start`` and ``words`` place each unit, ``key`` is its anchor and
    ``text`` its words joined by one space; ``hot`` are (row, first word, two
    hashes) of the windows under hot anchors.
    """

    def __init__(self, w: Words, known: np.ndarray, tables: tuple[np.ndarray, np.ndarray, int]):
        shared, much, bits = tables
        row, at, anchor = anchors(w)
        ask = _bits.hit(shared, anchor, bits) & known[row]
        row, at, anchor = row[ask], at[ask], anchor[ask]
        hot = _bits.hit(much, anchor, bits)
        self.hot = (np.zeros(0, np.int64),) * 4
        if hot.any():
            h1 = hash_runs(w.hash, WINDOW, 1)[at[hot]]
            h2 = hash_runs(w.hash, WINDOW, 2)[at[hot]]
            self.hot = row[hot], at[hot] - w.first[:-1][row[hot]], h1.view(np.int64), h2.view(np.int64)
        row, at, anchor = row[~hot], at[~hot], anchor[~hot]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
        run = np.flatnonzero(new)
        place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
        first = np.flatnonzero(place % UNIT_WINDOWS == 0)
        self.row, self.key = row[first], anchor[first].view(np.int64)
        self.start = at[first] - w.first[:-1][self.row]
        self.words = np.diff(np.append(first, len(at))) + WINDOW - 1
        # the words of all rows, joined by one space
        size = w.end - w.start
        ends = np.cumsum(size + 1)
        joined = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
        lead = ends - size - 1
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        joined[np.repeat(lead, size) + inner] = w.raw[np.repeat(w.start, size) + inner]
        blob = joined.tobytes()
        a = at[first]
        self.text = [blob[x:y] for x, y in zip(lead[a].tolist(), (ends[a + self.words - 1] - 1).tolist())]


def _slices(raw: np.ndarray, offsets: np.ndarray, size: int = 1 << 20):
    """(first row, offsets) of parts with about ``size`` bytes, a row at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1))
        yield at, offsets[at : to + 1]
        at = to


ASKED = "k long, b long, p long, q long, id long, t binary"
#: p, q: row and word of a unit, or the hashes of a window under a hot anchor.
REPLY = "b long, p long, q long, m long, o long, f binary"


def ask(df: DataFrame, block: str, row: str, sent, doc_id: str, text: str, hot: bool) -> DataFrame:
    """What each block of documents asks: its units, or its windows under hot anchors.

    Each distinct text is asked for once, at its place under the least id.
    """

    def run(batches):
        tables = sent.value
        now, units, least = None, {}, []

        def flush():
            if units:
                keys, texts = zip(*units)
                p, q, d = zip(*units.values())
                cols = [pa.array(keys, pa.int64()), pa.array([now] * len(keys), pa.int64()), *[pa.array(c, pa.int64()) for c in (q, d, p)], pa.array(texts, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["k", "b", "p", "q", "id", "t"])
            if least:
                h1, h2, d, q = [np.concatenate(c) for c in zip(*least)]
                order = np.lexsort((q, d, h2, h1))
                h1, h2, d, q = h1[order], h2[order], d[order], q[order]
                at = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))
                made = [h1[at], h2[at], np.full(len(at), now), d[at], q[at]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in made], names=["h1", "h2", "b", "d", "q"])

        for batch in batches:
            blocks = _column(batch, block).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]])) if len(blocks) else []
            for a, z in zip(cuts, [*cuts[1:], len(blocks)]):
                if blocks[a] != now:
                    yield from flush()
                    now, units, least = int(blocks[a]), {}, []
                part = batch.slice(a, z - a)
                raw, offsets = text_buffers(_column(part, text))
                ids, known = _ids(_column(part, doc_id))
                rows = _column(part, row).to_numpy(zero_copy_only=False)
                for i, off in _slices(raw, offsets):
                    u = Units(words_of(raw, off), known[i : i + len(off) - 1], tables)
                    if hot:
                        r, q, h1, h2 = u.hot
                        if len(r):
                            least.append((h1, h2, ids[i + r], q))
                        continue
                    for key, t, d, r, q in zip(u.key.tolist(), u.text, ids[i + u.row].tolist(), rows[i + u.row].tolist(), u.start.tolist()):
                        held = units.get((key, t))
                        if held is None or (d, r, q) < held:
                            units[key, t] = (d, r, q)
        yield from flush()

    return df.select(block, row, doc_id, text).mapInArrow(run, "h1 long, h2 long, b long, d long, q long" if hot else ASKED)


def earlier_windows(asked: DataFrame) -> DataFrame:
    """Replies for windows under hot anchors that occur elsewhere under a smaller id."""
    least = F.min(F.struct("d", "q")).over(Window.partitionBy("h1", "h2"))
    found = asked.withColumn("least", least).where("least.d < d")
    return found.select("b", F.col("h1").alias("p"), F.col("h2").alias("q"), F.col("least.d").alias("m"), F.col("least.q").alias("o"), F.lit(None).cast("binary").alias("f"))


# -- the index of a reference block -------------------------------------------


class SuffixArray:
    """Suffixes of several word sequences, sorted by their first 128 words.

    ``codes``: the words of all sequences, one after another; ``sizes``: words of
    each.  Prefix doubling keeps the ranks of all lengths 1, 2, 4 ... 64, by which
    the common length of any two suffixes is found.
    """

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        self.sizes = sizes
        self.begin = np.cumsum(sizes + 1) - sizes - 1  # a sentinel of its own ends each
        n = int((sizes + 1).sum())
        self.owner = np.repeat(np.arange(len(sizes)), sizes + 1)
        r = np.empty(n, np.int64)
        ends = self.begin + sizes
        inside = np.ones(n, bool)
        inside[ends] = False
        r[inside] = codes
        r[ends] = int(codes.max(initial=-1)) + 1 + np.arange(len(sizes))
        self.ranks = []
        for k in range(7):
            self.ranks.append(r.astype(np.int32))
            after = np.zeros(n, np.int64)
            if 1 << k < n:
                after[: n - (1 << k)] = r[1 << k :] + 1
            _, r = np.unique(r * (n + len(codes) + 2) + after, return_inverse=True)
        self.order = np.argsort(r, kind="stable")

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that suffixes i and j share at their begins, 127 at most."""
        n = len(self.owner)
        out = np.zeros(len(i), np.int64)
        for k in range(6, -1, -1):
            a, b = i + out, j + out
            ok = np.maximum(a, b) < n
            r = self.ranks[k]
            ok[ok] = r[a[ok]] == r[b[ok]]
            out[ok] += 1 << k
        return out

    def longest_before(self, age: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, source, words): longest match of each suffix with a suffix of
        a sequence of smaller ``age``, where it has WINDOW words at least.

        In the sorted order the longest match is the next suffix above or below
        with a smaller age; both are found by following pointers, all at once.
        """
        left = self.begin[self.owner] + self.sizes[self.owner] - np.arange(len(self.owner))
        at = self.order[left[self.order] >= WINDOW]
        if not len(at):
            return at, at, at
        r, d = self.ranks[5], WINDOW - 32
        same = (r[at[1:]] == r[at[:-1]]) & (r[at[1:] + d] == r[at[:-1] + d])
        group = np.concatenate([[0], np.cumsum(~same)])
        old = age[self.owner[at]]
        best = np.zeros(len(at), np.int64)
        source = np.full(len(at), -1)
        for step in (-1, 1):
            to = np.arange(len(at)) + step
            open_ = np.ones(len(at), bool)
            while True:
                i = np.flatnonzero(open_)
                t = to[i]
                inside = (t >= 0) & (t < len(at))
                inside[inside] = group[t[inside]] == group[i[inside]]
                to[i[~inside]] = -1
                i, t = i[inside], t[inside]
                open_[:] = False
                more = i[old[t] >= old[i]]
                if not len(more):
                    break
                to[more] = to[to[more]]
                open_[more] = True
            i = np.flatnonzero(to >= 0)
            size = self.common(at[i], at[to[i]])
            longer = size > best[i]
            best[i[longer]], source[i[longer]] = size[longer], at[to[i[longer]]]
        hit = np.flatnonzero(source >= 0)
        hit = hit[np.argsort(at[hit])]
        return at[hit], source[hit], best[hit]


def parse(at: list[int], size: list[int]) -> list[int]:
    """The greedy parse of one sequence: indexes of the matches that are factors.

    ``at``: where matches of WINDOW words or more begin, in order; ``size``: words
    of each.  After a factor come the windows that reach over its end.
    """
    out, i = [], 0
    while i < len(at):
        out.append(i)
        i = max(i + 1, bisect_left(at, at[i] + size[i] - WINDOW + 1))
    return out


def index_block(b, p, q, ids, texts: pa.Array) -> pa.RecordBatch | None:
    """Replies to the units of one reference block."""
    found = texts.dictionary_encode()
    cls = found.indices.to_numpy()
    order = np.lexsort((q, p, ids, cls))
    first = order[np.flatnonzero(np.concatenate([[True], cls[order][1:] != cls[order][:-1]]))]
    m, o = ids[first], q[first]  # least id of each text, and the word it begins at there
    raw, offsets = text_buffers(found.dictionary)
    w = words_of(raw, offsets, hashed=False)
    size = w.end - w.start
    ends = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    inner = np.arange(int(ends[-1])) - np.repeat(ends[:-1], size)
    data = raw[np.repeat(w.start, size) + inner]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    index = SuffixArray(words.dictionary_encode().indices.to_numpy().astype(np.int64), np.diff(w.first))
    at, source, length = index.longest_before(m)
    factors: dict[int, bytes] = {}
    if len(at):
        owner, other = index.owner[at], index.owner[source]
        table = np.stack([at - index.begin[owner], length, m[other], o[other] + source - index.begin[other]], 1)
        cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)]):
            chosen = parse(table[a:z, 0].tolist(), table[a:z, 1].tolist())
            factors[int(owner[a])] = table[a:z][chosen].tobytes()
    to = np.flatnonzero((m[cls] < ids) | np.isin(cls, list(factors)))
    if not len(to):
        return None
    c = cls[to]
    made = [pa.array(x) for x in (b[to], p[to], q[to], m[c], o[c])]
    return pa.RecordBatch.from_arrays([*made, pa.array([factors.get(x, b"") for x in c.tolist()], pa.binary())], names=["b", "p", "q", "m", "o", "f"])


def answers(asked: DataFrame, ranges: int) -> DataFrame:
    """Replies to units that occur, whole or in part, under a smaller id."""

    def run(batches):
        held, words = [], 0

        def flush():
            cols = [np.concatenate([h[i] for h in held]) for i in range(4)]
            return index_block(*cols, pa.concat_arrays([h[4] for h in held]))

        last = None
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5)]
            text = batch.column(5)
            size = np.cumsum(np.diff(text_buffers(text)[1])) // 6
            at, n = 0, len(key)
            while at < n:
                # up to the end of the anchor with which the block is full
                full = int(np.searchsorted(size, INDEX_WORDS - words + (int(size[at - 1]) if at else 0)))
                if words >= INDEX_WORDS:
                    to = at + int(np.argmax(key[at:] != last)) if (key[at:] != last).any() else n
                elif full >= n:
                    to = n
                else:
                    other = key[full:] != key[full]
                    to = full + int(np.argmax(other)) if other.any() else n
                if to > at:
                    held.append([*[c[at:to] for c in cols], text.slice(at, to - at)])
                    words += int(size[to - 1]) - (int(size[at - 1]) if at else 0)
                    last = key[to - 1]
                if to < n and words >= INDEX_WORDS:
                    found = flush()
                    if found is not None:
                        yield found
                    held, words = [], 0
                at = to
        if held:
            found = flush()
            if found is not None:
                yield found

    return asked.repartition(ranges, "k").sortWithinPartitions("k").mapInArrow(run, REPLY)


# -- documents ----------------------------------------------------------------


def cover(ids, known, rows, raw, offsets, replies: pa.Table, tables) -> tuple[np.ndarray, np.ndarray, list[list[tuple]]]:
    """Of a block of documents: words of each row, which of all words go, factors.

    A factor: (first word, words, source's id, source's first word).
    """
    n = len(offsets) - 1
    counts = np.zeros(n, np.int64)
    told, windows = {}, None
    if replies.num_rows:
        unit = replies.column("f").is_valid().to_numpy()
        p, q, m, o = [replies.column(c).to_numpy() for c in ("p", "q", "m", "o")]
        f = replies.column("f").to_pylist()
        for i in np.flatnonzero(unit).tolist():
            told[int(p[i]), int(q[i])] = (int(m[i]), int(o[i]), f[i])
        x = np.flatnonzero(~unit)
        if len(x):
            x = x[np.lexsort((q[x], p[x]))]
            windows = p[x], q[x], m[x], o[x]
    # occurrences of each text in the block
    classes: dict[tuple, list] = {}
    hot = []
    for i, off in _slices(raw, offsets):
        w = words_of(raw, off)
        k = len(off) - 1
        counts[i : i + k] = np.diff(w.first)
        u = Units(w, known[i : i + k], tables)
        for key, t, r, s, z in zip(u.key.tolist(), u.text, (i + u.row).tolist(), u.start.tolist(), u.words.tolist()):
            classes.setdefault((key, t), []).append((r, s, z))
        if len(u.hot[0]):
            hot.append((i + u.hot[0], *u.hot[1:]))
    base = np.cumsum(counts) - counts
    total = int(counts.sum())
    src, off_ = np.full(total, _NONE), np.zeros(total, np.int64)

    def put(at: int, words: int, m: int, o: int):
        span = words - WINDOW + 1
        src[at : at + span] = m
        off_[at : at + span] = np.arange(o, o + span)

    for places in classes.values():
        m, o, f = min((int(ids[r]), s, b"") for r, s, _ in places)
        for r, s, _ in places:
            reply = told.get((int(rows[r]), s))
            if reply is not None:
                m, o, f = reply
                break
        if len(places) == 1 and not f and m == ids[places[0][0]]:
            continue
        parts = np.frombuffer(f, np.int64).reshape(-1, 4).tolist() if f else ()
        for r, s, z in places:
            if m < ids[r]:
                put(int(base[r]) + s, z, m, o)
            else:
                for a, size, pm, po in parts:
                    put(int(base[r]) + s + a, size, pm, po)
    if hot:
        r, s, h1, h2 = [np.concatenate(c) for c in zip(*hot)]
        d = ids[r]
        order = np.lexsort((s, d, h2, h1))
        new = np.ones(len(order), bool)
        a, b = h1[order], h2[order]
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        at = np.flatnonzero(new)
        least, where = d[order][at].copy(), s[order][at].copy()
        if windows is not None:  # both sides are in order of (h1, h2): merge them
            p, q, m, o = windows
            both = np.lexsort((np.concatenate([np.zeros(len(at), np.int8), np.ones(len(p), np.int8)]), np.concatenate([b[at], q]), np.concatenate([a[at], p])))
            x, y = both[:-1], both[1:]
            pair = (x < len(at)) & (y >= len(at))
            x, y = x[pair], y[pair] - len(at)
            equal = (a[at][x] == p[y]) & (b[at][x] == q[y])
            x, y = x[equal], y[equal]
            least[x], where[x] = m[y], o[y]
        of = np.cumsum(new) - 1
        i = np.flatnonzero(least[of] < d[order])
        to = base[r[order[i]]] + s[order[i]]
        src[to], off_[to] = least[of[i]], where[of[i]]
    # windows that go on in the same source are one factor
    hit = np.flatnonzero(src != _NONE)
    factors: list[list[tuple]] = [[] for _ in range(n)]
    gone = np.zeros(total + 1, np.int32)
    if len(hit):
        row = np.searchsorted(base + counts, hit, "right")
        new = np.ones(len(hit), bool)
        new[1:] = (hit[1:] != hit[:-1] + 1) | (row[1:] != row[:-1]) | (src[hit[1:]] != src[hit[:-1]]) | (off_[hit[1:]] != off_[hit[:-1]] + 1)
        at = np.flatnonzero(new)
        words = np.diff(np.append(at, len(hit))) + WINDOW - 1
        first = hit[at]
        np.add.at(gone, first, 1)
        np.add.at(gone, first + words, -1)
        for r, f, z, m, o in zip(row[at].tolist(), (first - base[row[at]]).tolist(), words.tolist(), src[first].tolist(), off_[first].tolist()):
            factors[r].append((f, z, m, o))
    return counts, np.cumsum(gone[:-1]) > 0, factors


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("words", T.LongType())])
_FACTOR = T.StructType([*_SPAN.fields, T.StructField("source_id", T.LongType()), T.StructField("source_start", T.LongType())])


def spans_of(gone: np.ndarray) -> list[tuple[int, int]]:
    """(first word, words) of each run of words that go."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist()))


def substring_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with n_words, n_removed, spans (first word, words), factors (first
    word, words, source's id and first word; they may overlap) and kept."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = df.sparkSession
    bound_batches(spark)
    df = df.drop(*[c for c in df.columns if c.lower() in ("n_words", "n_removed", "spans", "factors", "kept")])
    block, row = fresh(df, "_block", "_row")
    staged = stage(deal_blocks(df, text, block, row), "substrings")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = _bits.bits_for(staged.select(block).distinct().count() * BLOCK_BYTES // 8)
    shared = stage(shared_anchors(staged, doc_id, text), "anchors")
    tables = (_bits.build(shared.select("h"), bits=bits), _bits.build(shared.where("hot").select("h"), bits=bits), bits)
    sent = spark.sparkContext.broadcast(tables)  # 2**bits / 4 bytes: 128 MB at most
    replied = answers(ask(staged, block, row, sent, doc_id, text, False), ranges)
    if not shared.where("hot").isEmpty():
        replied = replied.union(earlier_windows(ask(staged, block, row, sent, doc_id, text, True)))
    made = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("spans", T.ArrayType(_SPAN)), ("factors", T.ArrayType(_FACTOR)), ("kept", T.StringType())]
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in made]])
    names = df.columns
    arrow = {n: to_arrow_type(t) for n, t in made}

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        raw, offsets = text_buffers(left.column(text))
        ids, known = _ids(left.column(doc_id))
        counts, gone, factors = cover(ids, known, left.column(row).to_numpy(), raw, offsets, right, sent.value)
        ends = np.cumsum(counts)
        out: dict[str, list] = {n: [] for n in arrow}
        for i, f in enumerate(factors):
            words = raw[offsets[i] : offsets[i + 1]].tobytes().split()
            mine = gone[ends[i] - counts[i] : ends[i]]
            spans = spans_of(mine) if f else []
            out["n_words"].append(len(words))
            out["n_removed"].append(sum(z for _, z in spans))
            out["spans"].append([dict(zip(_SPAN.names, s)) for s in spans])
            out["factors"].append([dict(zip(_FACTOR.names, x)) for x in f])
            out["kept"].append(b" ".join(compress(words, (~mine).tolist()) if f else words).decode())
        return pa.Table.from_arrays([*[left.column(c) for c in names], *[pa.array(out[n], t) for n, t in arrow.items()]], names=schema.names)

    return staged.groupBy(block).cogroup(replied.groupBy("b")).applyInArrow(apply, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)),
least_of AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, j FROM (
  SELECT doc_id, unnest(range(i, i + 50)) AS j FROM win JOIN least_of USING (h) WHERE m < doc_id)),
marks AS (SELECT doc_id, list(j) AS g, count(*) AS n FROM gone GROUP BY doc_id),
each AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM words),
left_over AS (SELECT e.doc_id, string_agg(x, ' ' ORDER BY e.j) AS t
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.j = g.j WHERE g.j IS NULL GROUP BY e.doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN marks USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""
