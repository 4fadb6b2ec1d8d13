"""N-gram Jaccard join: documents whose shingle sets are similar.

A document's set holds its distinct 5-word shingles (A-Z lower-cased; the whole
sequence if it has fewer words).  Two documents link when
``100 * |A & B| >= 75 * |A | B|``.  The result names each document's component.

Copies are one class, known by 128 bits of the set.  Classes meet in tiles, one
for each shingle and band of sizes: a tile holds the classes that have the shingle
among the rarest quarter of their sets and whose sizes lie in its band or the
next.  Bands grow by 4/3, the ratio of sizes up to which sets can link, and linked
sets share such a shingle (prefix filter), so every link lies in a tile.  Rarity is
read from a table of counts over the whole corpus; it only decides the order,
never the result.

Inside a tile each class is compared with the tile's hub (the least class of its
own band), not with all others.  A pair is first bounded from above by the bit counts of hashed
bitmaps, then its sorted arrays are intersected exactly.  Tiles whose classes then
form one component are settled.  In the others, every pair from different
components that size and position allow is compared as well; so all links
between components are found, but not all pairs of a group are made.

Defined results
  * null text, or text without words: an empty set; n_shingles 0, linked with
    nothing, component is its own id;
  * equal sets are linked; repeated rows are documents of their own;
  * null ids: never the smallest of a component; a component of null ids only
    has a null component_id;
  * very long texts are shingled whole; the width of a bitmap goes by the set's size;
  * extra columns are kept, columns with the result's names are replaced;
  * shingles are compared by 64 bits of hash, copies by 128 bits of the set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _bits
from ._graph import components
from ._store import bound_batches, fresh, new_path, remove, scratch, stage
from ._words import grams, mix, slices, words_of

SHINGLE = 5
#: |A & B| >= 3/7 (|A| + |B|) is the threshold 0.75 in whole numbers.
NUM, DEN = 3, 7
#: Places of the table of shingle counts: by the input's size, between these bounds.
COUNT_BITS = (21, 24)
#: Entries of a hash range, on average, and of what a task holds before it sends.
RANGE_ENTRIES = 400_000
HELD_ENTRIES = 300_000
#: Places of one piece of it.
PIECE_BITS = 14
#: Longs of a bitmap signature.
SIGNATURE = 16
#: Shingles above which a set has a wider one too.
WIDE = 512

_U = np.uint64


def sets_of(raw, offsets, seed: int = 0) -> list[np.ndarray]:
    """Sorted shingle hashes of each row of a slice."""
    g, first = grams(words_of(raw, offsets, lower=True), SHINGLE)
    if seed:
        g = mix(g + _U(seed))
    return [np.unique(g[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def class_of(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    a = int(np.add.reduce(mix(s ^ _U(0xA5A5F00DCAFE1234)), dtype=np.uint64))
    b = int(np.bitwise_xor.reduce(mix(s + _U(0x0123456789ABCDEF))))
    x = mix(np.array([a, b ^ len(s)], np.uint64)).view(np.int64)
    return int(x[0]), int(x[1])


def prefix_length(n):
    """Shingles of the prefix: n - ceil(3 n / 4) + 1."""
    return n - (3 * n + 3) // 4 + 1


#: Least size of each band: whole numbers that grow by 4/3, so that sets which can link lie in one band or two neighbours.
BANDS = [1]
while BANDS[-1] < 1 << 40:
    BANDS.append(4 * BANDS[-1] // 3 + 1)
BANDS = np.array(BANDS, np.int64)


def band(n):
    """Band of a size."""
    return np.searchsorted(BANDS, n, "right") - 1


def may_link(n1, n2):
    """Whether sizes allow a link: the smaller has 3/4 of the larger at least."""
    return 4 * np.minimum(n1, n2) >= 3 * np.maximum(n1, n2)


def signature(s: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Parity bitmaps: each shingle flips one bit; unequal bits <= unequal shingles.

    Sets of more than WIDE shingles have a wider one too, of twice their size in
    bits at least: its width goes by the band of sizes (a power of two).  The
    narrow one is the wide one folded.
    """
    bits = 64 * SIGNATURE
    width = bits if len(s) <= WIDE else 1 << (2 * len(s) - 1).bit_length()
    at = (mix(s) & _U(width - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=width) & 1).astype(np.uint8)
    narrow = np.bitwise_xor.reduce(odd.reshape(-1, bits), axis=0)
    return np.packbits(narrow).view(np.int64), np.packbits(odd).view(np.int64) if width > bits else None


def count_bits(df: DataFrame) -> int:
    """Bits of the count table, by Spark's estimate of the input's bytes."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least, most = COUNT_BITS
    return min(most, max(least, (size // 256).bit_length()))


def describe(df: DataFrame, text: str, seed: int, names: list[str], bits: int) -> DataFrame:
    """Each row's size and class, and pieces of the count table, staged.

    ``names``: columns for size, two halves of the class, place and counts.  Rows
    of the table have a place and counts; all others are documents.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    carried = [f for f in df.schema.fields if f.name != text]
    kinds = [T.LongType(), T.LongType(), T.LongType(), T.IntegerType(), T.BinaryType()]
    fields = [T.StructField(f.name, f.dataType, True) for f in carried] + [T.StructField(a, k) for a, k in zip(names, kinds)]
    labels = [f.name for f in fields]
    types = [to_arrow_type(f.dataType) for f in carried]

    def run(batches):
        table = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for part, raw, offsets in slices(batch, text):
                found = sets_of(raw, offsets, seed)
                np.add.at(table, (np.concatenate(found) >> _U(64 - bits)).astype(np.int64), 1)
                classes = [class_of(s) if len(s) else (None, None) for s in found]
                n = part.num_rows
                made = [
                    pa.array([len(s) for s in found], pa.int64()),
                    pa.array([c[0] for c in classes], pa.int64()),
                    pa.array([c[1] for c in classes], pa.int64()),
                    pa.nulls(n, pa.int32()),
                    pa.nulls(n, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(f.name)) for f in carried], *made], names=labels)
        step = 1 << PIECE_BITS
        blank = [pa.nulls(1, t) for t in types] + [pa.nulls(1, pa.int64())] * 3
        for k in range(0, 1 << bits, step):
            t = table[k : k + step]
            if t.any():
                small = np.minimum(t, 65535).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([*blank, pa.array([k], pa.int32()), pa.array([small.tobytes()])], names=labels)

    return stage(df.mapInArrow(run, T.StructType(fields)), "jaccard")


def ranks(described: DataFrame, place: str, counts: str, bits: int) -> np.ndarray:
    """Rarity rank of each table place: a byte that grows with the count."""

    def add(batches):
        sums: dict = {}
        for batch in batches:
            for k, c in zip(*[x.to_pylist() for x in batch.columns]):
                sums[k] = sums.get(k, 0) + np.frombuffer(c, np.uint16).astype(np.int64)
        for k, c in sums.items():
            rank = np.minimum(255, np.floor(10 * np.log2(1.0 + c))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([rank.tobytes()])], names=["k", "r"])

    parts = described.where(F.col(place).isNotNull()).select(place, counts)
    out = np.zeros(1 << bits, np.uint8)
    for r in parts.repartition(F.col(place)).mapInArrow(add, "k int, r binary").collect():  # fixed size
        out[r["k"] : r["k"] + (1 << PIECE_BITS)] = np.frombuffer(r["r"], np.uint8)
    return out


_TILE = np.dtype([("tile", "<u4"), ("node", "<i8"), ("n", "<u4"), ("q", "u1")])
_KEY = np.dtype([("key", "<u4"), ("more", "u1"), ("node", "<i8"), ("n", "<u4"), ("q", "u1")])


def keys(df: DataFrame, text: str, seed: int, rank: np.ndarray, ranges: int) -> DataFrame:
    """(range, entries): prefix shingles of each class, once for each task."""
    sent = df.sparkSession.sparkContext.broadcast(rank)  # 16 MB at most

    def run(batches):
        table = sent.value
        shift = _U(65 - len(table).bit_length())
        seen: set[int] = set()
        held: list[np.ndarray] = []
        goes: list[np.ndarray] = []
        size = 0

        def flush():
            x, to = np.concatenate(held), np.concatenate(goes)
            order = np.argsort(to, kind="stable")
            x, to = x[order], to[order]
            cuts = np.searchsorted(to, np.arange(ranges + 1))
            full = np.flatnonzero(np.diff(cuts))
            return pa.RecordBatch.from_arrays(
                [pa.array(full.astype(np.int32)), pa.array([x[cuts[k] : cuts[k + 1]].tobytes() for k in full], pa.binary())], names=["k", "e"]
            )

        for batch in batches:
            for _, raw, offsets in slices(batch, text):
                for s in sets_of(raw, offsets, seed):
                    n = len(s)
                    if not n:
                        continue
                    c = class_of(s)[0]
                    if c in seen:
                        continue
                    seen.add(c)
                    p = prefix_length(n)
                    r = table[(s >> shift).astype(np.int64)]
                    order = np.argsort(r, kind="stable")[:p]  # by (rank, hash): s is sorted
                    x = np.empty(p, _KEY)
                    h = mix(s[order])  # 40 bits tell shingles of a range apart, 24 others choose the range
                    x["key"] = (h >> _U(32)).astype(np.uint32)
                    x["more"] = (h >> _U(24)).astype(np.uint8)
                    goes.append(((h & _U(0xFFFFFF)) % _U(ranges)).astype(np.int32))
                    x["node"], x["n"] = c, n
                    x["q"] = np.arange(p) * 255 // n
                    held.append(x)
                    size += p
                if size > HELD_ENTRIES:
                    yield flush()
                    held, goes, size = [], [], 0
        if held:
            yield flush()

    return df.select(text).mapInArrow(run, "k int, e binary")


def least_position(n, q):
    """A lower bound of the position that q (255ths of n, rounded down) stands for."""
    return -(-(q.astype(np.int64) * n.astype(np.int64)) // 255)


def position_allows(n1, q1, n2, q2):
    """Whether sets that share a shingle at these prefix positions may link."""
    n1, n2 = n1.astype(np.int64), n2.astype(np.int64)
    most = np.minimum(n1 - least_position(n1, q1), n2 - least_position(n2, q2))
    return DEN * most >= NUM * (n1 + n2)


def tiles(dealt: DataFrame) -> DataFrame:
    """Of each range: pairs (hub, other) and the tiles of three classes or more.

    Rows: (k, pairs binary, tiles binary): pairs as int64 couples; tiles as _TILE
    entries whose ``tile`` counts tiles in the range; a tile's own band comes
    first, the hub at its head, then the next band.
    """

    def work(k, blobs):
        x = np.concatenate([np.frombuffer(b, _KEY) for b in blobs])
        key = x["key"].astype(np.int64) << 8 | x["more"]
        order = np.lexsort((x["node"], band(x["n"]), key))
        x, key = x[order], key[order]
        new = np.ones(len(x), bool)
        new[1:] = (key[1:] != key[:-1]) | (x["node"][1:] != x["node"][:-1])
        x, key = x[new], key[new]
        size = band(x["n"])
        begin = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (size[1:] != size[:-1])]))
        own = np.diff(np.append(begin, len(x)))
        more = np.zeros(len(begin), bool)
        more[:-1] = (key[begin[1:]] == key[begin[:-1]]) & (size[begin[1:]] == size[begin[:-1]] + 1)
        count = own + np.where(more, np.append(own[1:], 0), 0)
        pairs = []
        two = begin[count == 2]
        a, b = x[two], x[two + 1]
        ok = may_link(a["n"].astype(np.int64), b["n"].astype(np.int64)) & position_allows(a["n"], a["q"], b["n"], b["q"])
        p = np.stack([a["node"][ok], b["node"][ok]], 1)
        p.sort(axis=1)
        pairs.append(p)
        big = np.flatnonzero(count >= 3)
        kept = []
        if len(big):
            tile = np.repeat(np.arange(len(big)), count[big])
            at = np.repeat(begin[big], count[big]) + (np.arange(len(tile)) - np.repeat(np.cumsum(count[big]) - count[big], count[big]))
            m = x[at]
            hub = x[np.repeat(begin[big], count[big])]  # the least class of its band: nodes are sorted
            other = m["node"] != hub["node"]
            near = other & may_link(m["n"].astype(np.int64), hub["n"].astype(np.int64))
            p = np.stack([hub["node"][near], m["node"][near]], 1)
            p.sort(axis=1)
            pairs.append(p)
            y = np.empty(len(m), _TILE)
            y["tile"], y["node"], y["n"], y["q"] = tile, m["node"], m["n"], m["q"]
            kept.append(y)
        p = np.unique(np.concatenate(pairs), axis=0) if sum(map(len, pairs)) else np.zeros((0, 2), np.int64)
        t = np.concatenate(kept) if kept else np.zeros(0, _TILE)
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([p.tobytes()]), pa.array([t.tobytes()])], names=["k", "pairs", "tiles"])

    def run(batches):
        now, held = None, []
        for batch in batches:
            for k, e in zip(*[c.to_pylist() for c in batch.columns]):
                if k != now and held:
                    yield work(now, held)
                    held = []
                now = k
                held.append(e)
        if held:
            yield work(now, held)

    return dealt.mapInArrow(run, "k int, pairs binary, tiles binary")


def _deal(k: np.ndarray, rows: np.ndarray, ranges: int, kind: int) -> pa.RecordBatch:
    """Rows of an int64 table packed by range: (k, kind, rows)."""
    order = np.argsort(k, kind="stable")
    rows = rows[order]
    cuts = np.searchsorted(k[order], np.arange(ranges + 1))
    full = np.flatnonzero(np.diff(cuts))
    blobs = [rows[cuts[i] : cuts[i + 1]].tobytes() for i in full]
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), kind, np.int32)), pa.array(blobs, pa.binary())], names=["k", "kind", "rows"])


_DEALT = "k int, kind int, rows binary"


def _range(node: np.ndarray, ranges: int) -> np.ndarray:
    return (mix(np.ascontiguousarray(node).view(np.uint64)) % _U(ranges)).astype(np.int64)


def _table(blobs: list[bytes], width: int) -> np.ndarray:
    return np.concatenate([np.frombuffer(b, np.int64).reshape(-1, width) for b in blobs]) if blobs else np.zeros((0, width), np.int64)


def _by_range(dealt: DataFrame, work, schema: str) -> DataFrame:
    """``work(rows of kind 0, rows of kind 1)`` for each range; packed rows in."""

    def run(batches):
        now, held = None, ([], [])
        for batch in batches:
            for k, kind, rows in zip(*[c.to_pylist() for c in batch.columns]):
                if k != now:
                    if now is not None:
                        yield from work(*held)
                    now, held = k, ([], [])
                held[kind].append(rows)
        if now is not None:
            yield from work(*held)

    tasks = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, "k").sortWithinPartitions("k").mapInArrow(run, schema)


def least_hubs(found: DataFrame, ranges: int) -> DataFrame:
    """(a, b): of each class b the least hub a among its tiles."""

    def least(p):
        p = p[np.lexsort((p[:, 0], p[:, 1]))]
        return p[np.concatenate([[True], p[1:, 1] != p[:-1, 1]])] if len(p) else p

    def deal(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                p = least(_table([blob], 2))
                if len(p):
                    yield _deal(_range(p[:, 1], ranges), p, ranges, 1)

    def once(_, blobs):
        p = least(_table(blobs, 2))
        yield pa.RecordBatch.from_arrays([pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], names=["a", "b"])

    return _by_range(found.select("pairs").mapInArrow(deal, _DEALT), once, "a long, b long")


def pairs_apart(found: DataFrame, labels: DataFrame, ranges: int) -> DataFrame:
    """(a, b): the tiles' pairs whose classes have different labels.

    A join of pairs with labels on either side, on packed rows.
    """

    def pack(batches):
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)
            if len(x):
                yield _deal(_range(x[:, 0], ranges), x, ranges, 0)

    def deal(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                p = _table([blob], 2)
                if len(p):
                    yield _deal(_range(p[:, 0], ranges), p, ranges, 1)

    def look_up(known, nodes):
        known = known[np.argsort(known[:, 0], kind="stable")]
        at = np.minimum(np.searchsorted(known[:, 0], nodes), max(0, len(known) - 1))
        return np.where(known[at, 0] == nodes, known[at, 1], nodes) if len(known) else nodes

    def first(known, pairs):
        p = np.unique(_table(pairs, 2), axis=0)
        if len(p):
            p = np.column_stack([p, look_up(_table(known, 2), p[:, 0])])
            yield _deal(_range(p[:, 1], ranges), p, ranges, 1)

    def second(known, pairs):
        p = _table(pairs, 3)
        p = p[look_up(_table(known, 2), p[:, 1]) != p[:, 2]]
        p = np.unique(p[:, :2], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], names=["a", "b"])

    known = labels.select("node", "label").mapInArrow(pack, _DEALT)
    half = _by_range(found.select("pairs").mapInArrow(deal, _DEALT).union(known), first, _DEALT)
    return _by_range(half.union(known), second, "a long, b long")


def class_arrays(df: DataFrame, text: str, seed: int, wanted: np.ndarray) -> DataFrame:
    """(node, n, sig, wide, arr) of the classes that may be in a pair, staged."""
    sent = df.sparkSession.sparkContext.broadcast(wanted)  # 64 MB at most

    def run(batches):
        table = sent.value
        seen: set[int] = set()
        for batch in batches:
            for _, raw, offsets in slices(batch, text):
                out = [[], [], [], [], []]
                for s in sets_of(raw, offsets, seed):
                    if not len(s):
                        continue
                    c = class_of(s)[0]
                    if c in seen or not _bits.hit(table, np.array([c], np.int64), (8 * len(table)).bit_length() - 1)[0]:
                        continue
                    seen.add(c)
                    out[0].append(c)
                    out[1].append(len(s))
                    narrow, wide = signature(s)
                    out[2].append(narrow)
                    out[3].append(wide)
                    out[4].append(s.tobytes())
                if out[0]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), *[pa.array(x, pa.list_(pa.int64())) for x in out[2:4]], pa.array(out[4], pa.binary())],
                        names=["node", "n", "sig", "wide", "arr"],
                    )

    return stage(df.select(text).mapInArrow(run, "node long, n long, sig array<long>, wide array<long>, arr binary"), "arrays")


def verify(pairs: DataFrame, arrays: DataFrame) -> DataFrame:
    """The pairs (a, b) that link: bit counts first, then exact intersection."""

    def side(c: str, *extra: str) -> DataFrame:
        one = arrays.groupBy("node").agg(*[F.first(x).alias(x + c) for x in extra])
        return one.withColumnRenamed("node", c)

    def unequal(x: str, y: str):
        return F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda t, u: t + u)

    near = pairs.join(side("a", "n", "sig"), "a").join(side("b", "n", "sig"), "b")
    near = near.where((4 * F.least("na", "nb") >= 3 * F.greatest("na", "nb")) & (F.col("na") + F.col("nb") >= DEN * unequal("siga", "sigb")))
    near = stage(near.select("a", "b", "na", "nb"), "near")

    # large sets: their wide bitmaps, the wider one folded to the other's width
    def folded(x: str, y: str):
        m = F.size(y)
        half = F.zip_with(F.slice(x, 1, m), F.slice(x, m + 1, m), lambda u, v: u.bitwiseXOR(v))
        return F.when(F.size(x) == 2 * m, half).otherwise(F.col(x))

    def wide(c: str) -> DataFrame:
        some = arrays.where("wide IS NOT NULL").groupBy("node").agg(F.first("wide").alias("wide" + c))
        return some.withColumnRenamed("node", c)

    large = near.where(F.least("na", "nb") > WIDE).join(wide("a"), "a").join(wide("b"), "b")
    large = large.withColumn("x", folded("widea", "wideb")).withColumn("y", folded("wideb", "widea"))
    large = large.where((F.size("x") != F.size("y")) | (F.col("na") + F.col("nb") >= DEN * unequal("x", "y")))
    near = stage(near.where(F.least("na", "nb") <= WIDE).select("a", "b").union(large.select("a", "b")), "near")

    bits = _bits.bits_for(16 * near.count())

    def blocks(c: str) -> DataFrame:
        """Arrays of the classes on one side of the pairs: others stay unmoved."""
        table = arrays.sparkSession.sparkContext.broadcast(_bits.build(near.select(c), bits=bits))  # 64 MB at most

        def keep(batches):
            for batch in batches:
                yield batch.filter(pa.array(_bits.hit(table.value, batch.column(0).to_numpy(zero_copy_only=False), bits)))

        some = arrays.select("node", "arr").mapInArrow(keep, "node long, arr binary")
        return some.groupBy("node").agg(F.first("arr").alias("arr" + c)).withColumnRenamed("node", c)

    full = near.join(blocks("b"), "b").join(blocks("a"), "a").select("a", "b", "arra", "arrb")

    def exact(batches):
        for batch in batches:
            last, x = None, None
            ok = []
            a = batch.column(0).to_pylist()
            for i, (m, s, t) in enumerate(zip(a, batch.column(2), batch.column(3))):
                if m != last:
                    last, x = m, np.frombuffer(s.as_py(), np.uint64)
                y = np.frombuffer(t.as_py(), np.uint64)
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())  # both sorted, no value twice
                ok.append(DEN * common >= NUM * (len(x) + len(y)))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return stage(full.mapInArrow(exact, "a long, b long"), "links")


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(np.ascontiguousarray(a).view(np.uint64) ^ mix(np.ascontiguousarray(b).view(np.uint64))).view(np.int64)


def open_pairs(found: DataFrame, apart: DataFrame, labels: DataFrame, arrays: DataFrame) -> DataFrame:
    """Pairs of unsettled tiles that lie in different components.

    A tile is unsettled if its hub and some member lie apart after the first
    steps (``apart`` has such pairs).  Only those tiles' members are listed one
    by one.
    """
    bits = _bits.bits_for(16 * apart.count())
    table = _bits.build(apart.select("a", "b"), lambda x: pair_hash(*[c.to_numpy(zero_copy_only=False) for c in x.columns]), bits=bits)
    sent = found.sparkSession.sparkContext.broadcast(table)  # 64 MB at most

    def members(batches):
        table = sent.value
        for batch in batches:
            for k, blob in zip(*[c.to_pylist() for c in batch.columns]):
                x = np.frombuffer(blob, _TILE)
                if not len(x):
                    continue
                begin = np.flatnonzero(np.concatenate([[True], x["tile"][1:] != x["tile"][:-1]]))
                count = np.diff(np.append(begin, len(x)))
                hub = np.repeat(x[begin], count)
                ends = np.sort(np.stack([hub["node"], x["node"]], 1), axis=1)
                unsettled = _bits.hit(table, pair_hash(ends[:, 0].copy(), ends[:, 1].copy()), bits)
                unsettled |= ~may_link(hub["n"].astype(np.int64), x["n"].astype(np.int64))
                unsettled &= hub["node"] != x["node"]
                open_ = np.repeat(np.add.reduceat(unsettled.astype(np.int64), begin) > 0, count)
                x, own = x[open_], (band(x["n"]) == band(hub["n"]))[open_]
                columns = [np.full(len(x), k, np.int32), x["tile"].astype(np.int64), np.ascontiguousarray(x["node"]), x["n"].astype(np.int64)]
                place = least_position(x["n"], x["q"])
                yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in columns], pa.array(place), pa.array(own.astype(np.int64))], names=["k", "t", "node", "n", "p", "own"])

    rows = found.select("k", "tiles").mapInArrow(members, "k int, t long, node long, n long, p long, own long")
    rows = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rows = stage(rows.join(arrays.select("node", "sig").dropDuplicates(["node"]), "node"), "members")
    # a large tile is cut into blocks; each pair of blocks is a tile of its own
    counts = rows.groupBy("k", "t").agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("g"), F.count_distinct("label").alias("l"))
    cut = rows.join(counts.where("l > 1"), ["k", "t"]).withColumn("i", F.pmod(F.xxhash64("node"), "g").cast("int"))
    cut = cut.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    cut = cut.select("k", "t", F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v"), F.col("i").alias("w"), "node", "n", "p", "label", "own", "sig")
    dealt = cut.repartition("k", "t", "u", "v").sortWithinPartitions("k", "t", "u", "v")
    return dealt.mapInArrow(_compare_tiles, "a long, b long").distinct().join(apart, ["a", "b"], "left_anti")


#: Classes of a tile, or of a block of a large one.
TILE_ROWS = 1024


def _compare_tiles(batches):
    """Pairs of each tile that sizes, positions and bit counts allow to link.

    Two blocks meet as rows of one tile with different ``w``; classes of one
    block meet where u = v.
    """

    def compare(x):
        order = np.argsort(x[2], kind="stable")
        w, node, n, p, label, own, sig = [c[order] for c in x]
        mixed = (w != w[0]).any()
        out = []
        for i in np.flatnonzero(own).tolist():  # pairs of the next band lie in that band's tile
            to = np.searchsorted(n, 4 * n[i] // 3, "right")  # sizes that allow a link
            j = np.arange(i + 1, to)
            if not len(j):
                continue
            ok = label[j] != label[i]
            if mixed:
                ok &= w[j] != w[i]
            total = n[j] + n[i]
            ok &= DEN * np.minimum(n[j] - p[j], n[i] - p[i]) >= NUM * total
            j = j[ok]
            if len(j):
                unequal = np.bitwise_count(sig[j] ^ sig[i]).sum(1, dtype=np.int64)
                j = j[n[j] + n[i] >= DEN * unequal]
                if len(j):
                    out.append(np.stack([np.full(len(j), node[i]), node[j]], 1))
        if out:
            e = np.concatenate(out)
            e.sort(axis=1)
            e = np.unique(e, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy())], names=["a", "b"])

    held: list = []
    now = None

    def flush():
        if held:
            yield from compare([np.concatenate(c) for c in zip(*held)])

    for batch in batches:
        if not batch.num_rows:
            continue
        c = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        key = np.stack([c[x].to_numpy(zero_copy_only=False).astype(np.int64) for x in ("k", "t", "u", "v")], 1)
        sig = c["sig"].flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(batch.num_rows, -1)  # bits, not signs
        data = [c[x].to_numpy(zero_copy_only=False).astype(np.int64) for x in ("w", "node", "n", "p", "label", "own")]
        begin = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
        for a, z in zip(begin, [*begin[1:], len(key)]):
            k = tuple(key[a].tolist())
            if k != now:
                yield from flush()
                held.clear()
                now = k
            held.append([*[d[a:z] for d in data], sig[a:z]])
    yield from flush()


def jaccard_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` without ``text``, with n_shingles (long) and component_id (long).

    The result is staged, and what led to it is removed.
    """
    spark = df.sparkSession
    bound_batches(spark)
    result = new_path(spark, "components")
    with scratch() as made:
        try:
            found = _components(df, doc_id, text)
            found.write.parquet(result)
            schema = found.schema
        finally:
            remove(spark, made)
    return spark.read.schema(schema).parquet(result)


def _components(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    spark = df.sparkSession
    df = df.drop(*[c for c in df.columns if c.lower() in ("n_shingles", "component_id")])
    names = fresh(df, "_n", "_c1", "_c2", "_place", "_counts")
    size, c1, c2, place, counts = names
    tasks, bits = int(spark.conf.get("spark.sql.shuffle.partitions")), count_bits(df)

    for seed in range(8):
        described = describe(df, text, seed, names, bits)
        docs = described.where(F.col(place).isNull()).drop(place, counts)
        classes = docs.where(F.col(size) > 0).groupBy(c1, c2).agg(F.min(doc_id).alias("_least"), F.max(size).alias("_size"))
        classes = stage(classes, "classes")
        # a class goes by the first half of its 128 bits; if two share it, hash anew
        if classes.groupBy(c1).count().where("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("hashes of sets collide")

    rank = ranks(described, place, counts, bits)
    known = classes.agg(F.count("*").alias("n"), F.sum(F.expr("_size - (3 * _size + 3) div 4 + 1")).alias("entries")).first()
    ranges = min(1 << 22, max(tasks, (known["entries"] or 0) // RANGE_ENTRIES))
    dealt = keys(df, text, seed, rank, ranges).repartition(tasks, "k").sortWithinPartitions("k")
    found = stage(tiles(dealt), "tiles")

    def nodes(batch):
        x = [np.frombuffer(p, np.int64) for p in batch.column(0).to_pylist()]
        return np.concatenate([*x, *[np.frombuffer(t, _TILE)["node"] for t in batch.column(1).to_pylist()]])

    arrays = class_arrays(df, text, seed, _bits.build(found.select("pairs", "tiles"), nodes, bits=_bits.bits_for(16 * known["n"])))
    # each class with its least hub; then what those links leave apart
    links = verify(stage(least_hubs(found, ranges), "pairs"), arrays)
    labels = stage(components(links), "labels")
    second = stage(pairs_apart(found, labels, ranges), "pairs")
    apart = second
    if not second.isEmpty():
        links = links.union(verify(second, arrays))
        labels = stage(components(links), "labels")
        apart = stage(pairs_apart(found, labels, ranges), "pairs")
    third = stage(open_pairs(found, apart, labels, arrays), "pairs")
    if not third.isEmpty():
        labels = components(links.union(verify(third, arrays)))

    # label of each class, and the least id of each component
    labels = labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    of = classes.join(labels, F.col(c1) == F.col("_node"), "left").withColumn("_label", F.coalesce("_label", c1))
    least = of.groupBy("_label").agg(F.min("_least").alias("_component"))
    of = of.join(least, "_label").select(F.col(c1).alias("_k1"), F.col(c2).alias("_k2"), "_component")
    joined = docs.join(of, (F.col(c1) == F.col("_k1")) & (F.col(c2) == F.col("_k2")), "left")
    component = F.when(F.col(size) > 0, F.col("_component")).otherwise(F.col(doc_id))
    kept = [F.col(f"`{c}`") for c in df.columns if c != text]
    return joined.select(*kept, F.col(size).alias("n_shingles"), component.cast("long").alias("component_id"))


def drop_ids(df: DataFrame, gone: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``df`` without the rows whose id is in ``gone`` (one column of ids).

    A bit table lets rows that surely stay pass by; only the others, with their
    texts, are shuffled to the exact anti-join.  Rows without an id stay.
    """
    bound_batches(df.sparkSession)
    name = gone.columns[0]
    size = _bits.bits_for(16 * gone.count())

    def hashes(ids: pa.Array) -> np.ndarray:
        return mix(np.asarray(ids.fill_null(0).to_numpy(zero_copy_only=False), np.int64).view(np.uint64))

    bits = _bits.build(gone.where(F.col(name).isNotNull()).select(F.col(name).cast("long")), lambda batch: hashes(batch.column(0)), bits=size)
    sent = df.sparkSession.sparkContext.broadcast(bits)  # 64 MB at most
    at = df.columns.index(doc_id)

    def pick(hit: bool):
        def run(batches):
            for batch in batches:
                ids = batch.column(at)
                found = _bits.hit(sent.value, hashes(ids), size) & np.asarray(ids.is_valid().to_numpy(zero_copy_only=False), bool)
                yield batch.filter(pa.array(found == hit))

        return df.mapInArrow(run, df.schema)

    return pick(False).unionByName(pick(True).join(gone.select(F.col(name).alias(doc_id)).distinct(), doc_id, "left_anti").select(*df.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END AS s FROM words),
sets AS (SELECT doc_id, list_distinct(s) AS s, len(list_distinct(s)) AS n FROM runs),
each AS (SELECT doc_id, n, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM each a JOIN each b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * k >= 75 * (na + nb - k)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(d, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.d, sym.b FROM reach JOIN sym ON reach.r = sym.a)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, min(r.r) AS component_id
FROM sets s JOIN reach r ON s.doc_id = r.d GROUP BY 1, 2
"""
