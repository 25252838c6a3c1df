"""Text primitives on whole Arrow batches: UTF-8 buffers in, numpy arrays out, no per-row Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once, so that the numpy temporaries stay small; one longer text is handled alone.
SLICE_BYTES = 512 << 10
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

WORD = np.zeros(256, bool)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_":
    WORD[_c] = True
WORD[128:] = True


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    p = _powers.get(base)
    if p is None or len(p) < n:
        a = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        a[0] = 1
        p = _powers[base] = np.multiply.accumulate(a)
    return p[:n]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h + np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and the n + 1 offsets; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    big = pa.types.is_large_string(texts.type)
    _, off, data = texts.buffers()
    o = np.frombuffer(off, np.int64 if big else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return b, o - o[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most `limit` bytes in the column, or one longer row."""
    i = batch.schema.get_field_index(column)
    n = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(i)).to_numpy(zero_copy_only=False).astype(float)))
    at = 0
    while at < batch.num_rows:
        before = n[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(n, before + limit, "right")))
        yield batch.slice(at, end - at)
        at = end
    # what Arrow keeps of this batch's copies would add up over a worker's life
    pa.default_memory_pool().release_unused()


def words(b: np.ndarray, off: np.ndarray, table: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes within each text, and how many each text has."""
    w = table[b]
    n = len(b)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off) - 1, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    s, e = w.copy(), w.copy()
    s[1:] &= ~w[:-1] | edge[1:n]
    e[:-1] &= ~w[1:] | edge[1:n]
    starts, ends = np.flatnonzero(s), np.flatnonzero(e) + 1
    return starts, ends, np.diff(np.searchsorted(starts, off))


def prefix(b: np.ndarray) -> np.ndarray:
    """Running polynomial sums, for span_hash."""
    p = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(b)), out=p[1:])
    return p


def span_hash(p: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of b[s:e] for each span, the same wherever the span lies."""
    return mix((p[ends] - p[starts]) * powers(_INV, len(p))[starts])


def hash_words(ws: list[str]) -> np.ndarray:
    """The span hashes of whole strings."""
    b, off = raw(pa.array(ws, pa.string()))
    return span_hash(prefix(b), off[:-1], off[1:])


class Lookup:
    """Sorted 64-bit keys with a bit table in front, for many probes of which few hit."""

    def __init__(self, keys: np.ndarray, bits: int = 20):
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[(self.keys >> self.shift).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h that are keys, and which key (index in the keys as given)."""
        at = np.flatnonzero(self.table[(h >> self.shift).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        j = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        ok = self.keys[j] == h[at]
        return at[ok], self.order[j[ok]]


def char_starts(b: np.ndarray) -> np.ndarray:
    """For each byte offset 0..n, the number of characters that begin before it."""
    n = np.zeros(len(b) + 1, np.int64)
    np.cumsum((b & 0xC0) != 0x80, out=n[1:])
    return n
