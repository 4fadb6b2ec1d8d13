"""Sets of 64-bit hashes as bit tables, built by Spark.

A table answers "maybe in the set" or "surely not".  Its size goes by the number
of hashes, up to 2**29 bits, so it may be broadcast whatever the set's size; a
full table only lets more rows through to the exact step that follows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Parts of a table: places travel in packed rows, one for each task and part.
PARTS = 64


def bits_for(n: int, least: int = 20, most: int = 29) -> int:
    """Bits of a table for up to n hashes: 2**most / 8 bytes (64 MB) at most."""
    return min(most, max(least, int(n).bit_length()))


def places(h: np.ndarray, bits: int) -> np.ndarray:
    """Bit of each hash (int64 or uint64, already well mixed)."""
    return (np.ascontiguousarray(h).view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def column(i: int = 0) -> Callable[[pa.RecordBatch], np.ndarray]:
    return lambda batch: batch.column(i).to_numpy(zero_copy_only=False)


def build(df: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray] = column(), *, bits: int) -> np.ndarray:
    """The table of the hashes that ``hashes`` finds in each batch of ``df``."""
    size = 1 << bits
    each = size // PARTS

    def find(batches):
        held, n = [], 0

        def flush():
            p = np.unique(np.concatenate(held))
            cuts = np.searchsorted(p, np.arange(PARTS + 1) * each)
            full = np.flatnonzero(np.diff(cuts))
            blobs = [(p[cuts[k] : cuts[k + 1]] - k * each).astype(np.int32).tobytes() for k in full]
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(blobs, pa.binary())], names=["k", "p"])

        for batch in batches:
            h = hashes(batch)
            if len(h):
                held.append(places(h, bits))
                n += len(h)
                if n > 500_000:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    def join(batches):
        now, t = None, np.zeros(each, np.uint8)

        def packed():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(t, bitorder="little").tobytes()])], names=["k", "p"])

        for batch in batches:
            for k, p in zip(*[c.to_pylist() for c in batch.columns]):
                if k != now:
                    if now is not None:
                        yield packed()
                    now = k
                    t[:] = 0
                t[np.frombuffer(p, np.int32)] = 1
        if now is not None:
            yield packed()

    schema = "k int, p binary"
    out = np.zeros(size // 8, np.uint8)
    for r in df.mapInArrow(find, schema).repartition("k").sortWithinPartitions("k").mapInArrow(join, schema).collect():  # size / 8 bytes in all
        out[r["k"] * each // 8 : (r["k"] + 1) * each // 8] = np.frombuffer(r["p"], np.uint8)
    return out


def hit(table: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes may be in the set."""
    at = places(h, bits)
    return ((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
