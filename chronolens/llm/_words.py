"""Vectorised tokenisation of Arrow string batches.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.  All of those
are ASCII, so the runs are the same on UTF-8 bytes as on code points.  A word's
64-bit hash chains its 8-byte lanes through a bijective mixer, for all words of a
batch at once (equal in size and up to 8 bytes: no collisions at all); words of
more than LONG bytes are hashed by XXH3.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes hashed at once: bounds the work arrays (8 bytes each for a byte).
PIECE = 1 << 20

#: Bytes of a word up to which it is hashed by lanes.
LONG = 256

_U = np.uint64
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit (splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def mix1(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], np.uint64))[0])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


class Words:
    """Words of the rows of one slice: row i has words[first[i]:first[i + 1]]."""

    __slots__ = ("start", "end", "hash", "first", "offsets", "raw")

    def __init__(self, raw, offsets, start, end, hashes, first):
        self.raw, self.offsets, self.start, self.end, self.hash, self.first = raw, offsets, start, end, hashes, first


def hash_words(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word b[start:end]."""
    size = end - start
    lanes = np.ndarray(len(b) + 1, "<u8", np.concatenate([b, np.zeros(8, np.uint8)]), strides=(1,))
    h = mix(size.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + _U(0xD1B54A32D192ED03))
    h = mix(h ^ (lanes[start] & _MASK[np.minimum(size, 8)]))
    at, k = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(at):
        h[at] = mix(h[at] ^ (lanes[start[at] + k] & _MASK[np.minimum(size[at] - k, 8)]))
        k += 8
        at = at[size[at] > k]
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxh3_64_intdigest(b[start[i] : end[i]].tobytes())
    return h


def _piece(b: np.ndarray, cuts: np.ndarray, hashed: bool):
    """Words of bytes ``b``; ``cuts``: positions in b where a row begins."""
    word = ~SEPARATOR[b]
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    before[cuts] = False
    start = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1] = False
    after[:-1] = word[1:]
    after[cuts[cuts > 0] - 1] = False
    end = np.flatnonzero(word & ~after) + 1
    return start, end, hash_words(b, start, end) if hashed else None


def words_of(raw: np.ndarray, offsets: np.ndarray, lower: bool = False, hashed: bool = True) -> Words:
    """Words of all rows.  Long input is hashed in pieces cut at white space."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    starts, ends, hashes = [], [], []
    at = lo
    while at < hi:
        to = min(hi, at + PIECE)
        if to < hi:
            # go back to white space or a row's begin, else on to the next one
            row = int(offsets[np.searchsorted(offsets, to, "right") - 1])
            back = raw[max(at, row) : to]
            sep = np.flatnonzero(SEPARATOR[back[::-1][: 1 << 16]])
            if row > at:
                to = row
            elif len(sep):
                to -= int(sep[0])
            else:
                end_row = int(offsets[np.searchsorted(offsets, to, "left")])
                while to < end_row:
                    ahead = np.flatnonzero(SEPARATOR[raw[to : min(end_row, to + (1 << 16))]])
                    if len(ahead):
                        to += int(ahead[0])
                        break
                    to = min(end_row, to + (1 << 16))
        b = raw[at:to]
        if lower:
            b = LOWER[b]
        i, j = np.searchsorted(offsets, at, "left"), np.searchsorted(offsets, to, "left")
        cuts = np.unique(offsets[i:j]) - at
        s, e, h = _piece(b, cuts, hashed)
        starts.append(s + at)
        ends.append(e + at)
        hashes.append(h)
        at = to
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    h = (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)) if hashed else None
    return Words(raw, offsets, start, end, h, np.searchsorted(start, offsets, "left"))


def slices(batch: pa.RecordBatch, text: str, size: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with about ``size`` bytes of text, at least a row each."""
    raw, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        to = min(to, n)
        yield batch.slice(at, to - at), raw, offsets[at : to + 1]
        at = to


def hash_runs(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of every n consecutive word hashes, by doubling; each step is mixed."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    total = len(h) - n + 1

    def join(a, b):
        return mix(a * _U(0xD6E8FEB86659FD93) + b)

    x, width, out, covered = mix(h ^ _U(0x9E3779B97F4A7C15 * seed & 2**64 - 1)), 1, None, 0
    while True:
        if n & width:
            y = x[covered : covered + total]
            out = y if out is None else join(out, y)
            covered += width
        if 2 * width > n:
            return out
        x = join(x[:-width], x[width:])
        width *= 2


_gram = [pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(64)]


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of n words of a row, and per row the first one's index.

    A row with 1 to n-1 words has one run: the whole sequence.
    """
    h, first = w.hash, w.first
    counts = np.diff(first)
    out_counts = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    out_first = np.concatenate([[0], np.cumsum(out_counts)])
    total = len(h)
    if total >= n:
        every = np.zeros(total - n + 1, np.uint64)
        for k in range(n):
            every += h[k : total - n + 1 + k] * _U(_gram[k])
    else:
        every = np.zeros(0, np.uint64)
    out = np.empty(int(out_first[-1]), np.uint64)
    full = counts >= n
    # positions of the full rows' runs
    keep = np.zeros(max(total, 1) + 1, np.int64)
    np.add.at(keep, first[:-1][full], 1)
    np.add.at(keep, first[:-1][full] + counts[full] - n + 1, -1)
    at = np.flatnonzero(np.cumsum(keep)[: len(every)]) if len(every) else np.zeros(0, np.int64)
    where = np.zeros(len(out), bool)
    short = np.flatnonzero((counts > 0) & ~full)
    where[out_first[short]] = True
    out[~where] = mix(every[at])
    for i in short:
        s = n * 0x51ED270B
        for k, x in enumerate(h[first[i] : first[i + 1]].tolist()):
            s += x * _gram[k]
        out[out_first[i]] = mix1(s + int(counts[i]))
    return out, out_first


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
