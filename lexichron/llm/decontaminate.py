"""Benchmark passages in documents, whole items with few edits, by q-gram filtering.

An item of m characters that occurs with at most k edits shares at least m - q + 1 - k q of its q-grams with the text, all on k + 1
neighbouring diagonals (Ukkonen 1992, Jokinen & Ukkonen 1991). Shared q-grams are counted in overlapping diagonal bands; bands that meet the bound are
verified by banded alignment. Texts are compared as lower-cased letters and digits with one space between words."""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .common import shared_dir

Q, BUDGET = 11, 0.06
#: Items of fewer characters are looked for without any edit, those of fewer than Q only as the whole of a text.
SHORTEST = 40
#: Items of more characters are looked for in parts, equally long and no longer than this.
LONGEST = 4096
#: Characters of benchmark that a task holds at once; a larger benchmark is looked for pass by pass.
PASS_CHARS = 2_000_000
#: Cells of the alignments done together.
CELLS = 1 << 21
#: Bytes of text handled at once: the arrays of one step stay in a core's cache.
SLICE_BYTES = 256 << 10
_A = tuple(np.uint32(x | 1) for x in (0x9E3779B9, 0xC2B2AE3D, 0x165667B1, 0x27D4EB2F))


_WORD = np.ones(0x3004, bool)
_WORD[:0xC0] = False
_WORD[[ord(x) for x in "0123456789abcdefghijklmnopqrstuvwxyz"]] = True
_WORD[0x2000:0x2070] = _WORD[0x3000:0x3003] = False


def normal(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts, normalised, end to end; where each text begins; and each one's place among the characters of all texts as they are."""
    b, off = vec.raw(texts)
    lower, loff = vec.raw(pc.utf8_lower(texts))
    chars = np.frombuffer(lower.tobytes().decode("utf8", "replace").encode("utf-32-le", "replace"), np.uint32)
    at = vec.char_starts(lower)[loff]
    # as many characters in lower case: utf8_lower maps one to one
    word = _WORD[np.minimum(chars, len(_WORD) - 1)]
    first = np.zeros(len(chars) + 1, bool)
    first[at] = True
    keep = word.copy()
    keep[1:] |= word[:-1]  # the first of a run of separators is the space between two words
    keep &= word | ~first[:-1]
    place = np.flatnonzero(keep)
    return np.where(word[place], chars[place], 32).astype(np.uint32), np.searchsorted(place, at), place


def qgrams(c: np.ndarray) -> np.ndarray:
    """A 32-bit hash of c[i:i+11] for every i; two q-grams that share one only let more through the filter."""
    n = len(c) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    h2 = c[:-1] * _A[0] + c[1:]
    h4 = h2[:-2] * _A[1] + h2[2:]
    h = h4[:n] * _A[2]
    h += h4[4 : 4 + n]
    h *= _A[3]
    h += h2[8 : 8 + n] * _A[2]
    h += c[10 : 10 + n]
    h ^= h >> np.uint32(15)
    h *= _A[0]
    return h


class Items:
    """The benchmark's q-grams and bounds."""

    def __init__(self, ids: list[int], texts: list[str]):
        c, off, _ = normal(pa.array(texts, pa.string()))
        # without a space at the end
        size = np.diff(off) - np.array([o1 > o0 and c[o1 - 1] == 32 for o0, o1 in zip(off[:-1], off[1:])], int)
        #: Items too short for a q-gram, by their characters.
        self.whole: dict[bytes, list[int]] = {}
        own: list[int] = []
        self.chars: list[np.ndarray] = []
        for i, (at, n) in enumerate(zip(off[:-1].tolist(), size.tolist())):
            if 0 < n < Q:
                self.whole.setdefault(c[at : at + n].tobytes(), []).append(ids[i])
            elif n >= Q:
                for part in np.array_split(c[at : at + n], -(-n // LONGEST)):
                    own.append(ids[i])
                    self.chars.append(part)
        self.ids = np.array(own, np.int64)
        self.size = np.array([len(x) for x in self.chars], np.int64)
        self.edits = np.where(self.size < SHORTEST, 0, (self.size * BUDGET).astype(np.int64))
        self.least = np.maximum(1, self.size - Q + 1 - self.edits * Q)
        grams = [qgrams(x) for x in self.chars]
        h = np.concatenate(grams) if grams else np.zeros(0, np.uint32)
        owner = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g), dtype=np.int32) for g in grams]) if grams else np.zeros(0, np.int32)
        order = np.argsort(h, kind="stable")
        self.keys, first = np.unique(h[order], return_index=True)
        self.first = np.append(first, len(h)).astype(np.int32)
        self.owner, self.place = owner[order], place[order]
        self._tabulate()

    def _tabulate(self) -> None:
        bits = min(28, max(16, int(np.log2(len(self.keys) + 1)) + 4))
        self.shift, self.table = np.uint32(32 - bits), np.zeros(1 << bits, bool)
        self.table[self.keys >> self.shift] = True

    def __getstate__(self) -> dict:
        # the bit table is larger than what it is made from
        return {k: v for k, v in self.__dict__.items() if k != "table"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._tabulate()

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h that are q-grams of the items, and which of the keys."""
        at = np.flatnonzero(self.table[h >> self.shift])
        if not len(self.keys):
            return at[:0], at[:0]
        j = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        ok = self.keys[j] == h[at]
        return at[ok], j[ok]


def candidates(c: np.ndarray, off: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, lowest and highest diagonal) of the bands with enough shared q-grams; a diagonal is place in c less place in the item."""
    none = (np.zeros(0, np.int64),) * 4
    at, key = items.find(qgrams(c))
    if not len(at):
        return none
    text = np.searchsorted(off, at, "right") - 1
    ok = at + Q <= off[text + 1]
    at, key, text = at[ok], key[ok], text[ok]
    n = items.first[key + 1] - items.first[key]
    n = n.astype(np.int64)
    i = np.repeat(items.first[key], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at, text, item = np.repeat(at, n), np.repeat(text, n), items.owner[i].astype(np.int64)
    diagonal = at - items.place[i]
    # bands of 2 (k + 1) diagonals, half of each shared with the next: any k + 1 neighbours lie within one
    width = items.edits[item] + 1
    base = diagonal - off[text] + items.size[item]  # not negative
    band = base // width
    # each q-gram counts in its own half band and in the band that begins one before
    group = item * len(off) + text
    span = int(band.max()) + 3
    half, count = np.unique(group * span + band + 1, return_counts=True)
    # a band is two neighbouring halves
    nxt = np.searchsorted(half, half + 1)
    nxt_count = np.where((nxt < len(half)) & (half[np.minimum(nxt, len(half) - 1)] == half + 1), count[np.minimum(nxt, len(half) - 1)], 0)
    enough = count + nxt_count >= items.least[half // span // len(off)]
    g, k = half[enough] // span, half[enough] % span - 1
    # a pair whose lower half is empty is the single half
    lone = ~np.isin(half - 1, half) & (count >= items.least[half // span // len(off)]) & ~enough
    g, k = np.concatenate([g, half[lone] // span]), np.concatenate([k, half[lone] % span - 1])
    item, text = g // len(off), g % len(off)
    width = items.edits[item] + 1
    low = k * width + off[text] - items.size[item]
    return text, item, low, low + 2 * width - 1


def align(items: Items, found: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each (text, item, window, places, first, last) of candidates the fewest edits of the item within its band, and where in the
    window the earliest such occurrence begins and ends. The window is the text from the band's lowest diagonal on; only
    its places first to last belong to the text."""
    item = np.array([f[1] for f in found])
    n, size = len(found), items.size[item]
    width, rows = max(len(f[2]) - int(items.size[f[1]]) for f in found) + 1, int(size.max())
    pattern, window = np.zeros((n, rows), np.uint32), np.zeros((n, rows + width), np.uint32)
    for j, f in enumerate(found):
        pattern[j, : size[j]] = items.chars[f[1]]
        window[j, : len(f[2])] = f[2]
    lo, hi = np.array([f[4] for f in found])[:, None], np.array([f[5] for f in found])[:, None]
    column, big, shift = np.arange(width)[None, :], np.int64(1) << 40, np.int64(1 << 20)
    edits, start, end = np.full(n, 1 << 20), np.zeros(n, np.int64), np.zeros(n, np.int64)
    # edits, then the diagonal it began on
    d = np.where((column >= lo) & (column <= hi), column, big).astype(np.int64)
    up = np.full_like(d, big)
    for i in range(1, rows + 1):
        where = column + i - 1  # the character of the text that this step reads
        step = d + np.where(window[:, i - 1 : i - 1 + width] == pattern[:, i - 1 : i], 0, shift)
        step[(where < lo) | (where >= hi)] = big
        up[:, :-1] = d[:, 1:] + shift
        d = np.minimum(step, up)
        # characters of the text that the item lacks
        d = np.minimum.accumulate(d - column * shift, axis=1) + column * shift
        d[(where + 1 > hi) | (where + 1 < lo)] = big
        ends = np.flatnonzero(size == i)
        if len(ends):
            best = d[ends].argmin(1)
            v = d[ends, best]
            edits[ends] = np.minimum(v >> 20, 1 << 20)
            start[ends], end[ends] = v & (shift - 1), best + i
    return edits, start, end


def scan(texts: pa.Array, items: Items) -> list[tuple[int, int, int, int, int]]:
    """(text, item_id, start, end, edits), in characters of the text; of overlapping occurrences of one item the best."""
    found, hits = [], set()
    for part in vec.slices(pa.RecordBatch.from_arrays([texts, pa.array(np.arange(len(texts)))], names=["text", "row"]), "text", SLICE_BYTES):
        c, off, place = normal(part.column(0))
        text, item, low, high = candidates(c, off, items)
        short = np.flatnonzero((np.diff(off) > 0) & (np.diff(off) <= Q)) if items.whole else text[:0]
        if not len(text) and not len(short):
            continue
        b, boff = vec.raw(part.column(0))
        chars = vec.char_starts(b)[boff]
        row = part.column(1).to_numpy()
        for t in short.tolist():
            own = c[off[t] : off[t + 1] - (c[off[t + 1] - 1] == 32)]
            for i in items.whole.get(own.tobytes(), []):
                hits.add((int(row[t]), i, 0, int(place[off[t]] - chars[t]), int(place[off[t] + len(own) - 1] - chars[t]) + 1))
        # an occurrence may stray by k diagonals from the ones it shares q-grams on
        low, high = low - items.edits[item], high + items.edits[item]
        for t, i, x, y in zip(text.tolist(), item.tolist(), low.tolist(), high.tolist()):
            y += int(items.size[i])
            x0, y0 = max(x, 0), min(y, len(c))
            pad = x0 - x
            found.append((int(row[t]), i, np.concatenate([np.zeros(pad, np.uint32), c[x0:y0], np.zeros(y - y0, np.uint32)]), place[x0:y0] - chars[t], int(off[t]) - x, int(off[t + 1]) - x, pad))
    found.sort(key=lambda f: int(items.size[f[1]]))
    at = 0
    while at < len(found):
        # as many as fit in CELLS, by the size of the last and longest
        n = 1
        while at + n < min(len(found), at + 256) and (n + 1) * (len(found[at + n][2]) + 1) <= CELLS:
            n += 1
        group, at = found[at : at + n], at + n
        for f, e, s, t in zip(group, *map(np.ndarray.tolist, align(items, group))):
            if e <= items.edits[f[1]]:
                hits.add((f[0], int(items.ids[f[1]]), e, int(f[3][s - f[6]]), int(f[3][t - 1 - f[6]]) + 1))
    out, taken = [], {}
    for t, i, edits, start, end in sorted(hits):
        if any(start < e and s < end for s, e in taken.get((t, i), [])):
            continue
        taken.setdefault((t, i), []).append((start, end))
        out.append((t, i, start, end, edits))
    return sorted(out)


def prepared(benchmark: DataFrame) -> list[str]:
    """Files in the shared folder, each with the Items of about PASS_CHARS characters of the benchmark; one part at a time is on the driver."""
    b = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    n = -(-int(b.agg(F.sum(F.length("text"))).first()[0] or 0) // PASS_CHARS)
    folder = f"{shared_dir(benchmark.sparkSession)}/benchmark-{uuid.uuid4().hex}"
    system, at = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))
    out = []
    for k in range(n):
        part = b.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).distinct().orderBy("item_id", "text").collect()
        if part:
            system.create_dir(at, recursive=True)
            with system.open_output_stream(f"{at}/{k}") as f:
                f.write(pickle.dumps(Items([r.item_id for r in part], [r.text for r in part])))
            out.append(f"{folder}/{k}")
    return out


_loaded: dict[str, Items] = {}


def loaded(path: str) -> Items:
    """What prepared() wrote; a worker keeps the last one."""
    if path not in _loaded:
        system, at = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
        with system.open_input_file(at) as f:
            data = f.read()
        _loaded.clear()
        _loaded[path] = pickle.loads(data)
    return _loaded[path]


def scan_all(texts: pa.Array, paths: list[str]) -> list[tuple[int, int, int, int, int]]:
    """scan() of every pass."""
    return sorted(h for p in paths for h in scan(texts, loaded(p)))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_char, end_char, edits) of every occurrence of a benchmark item in a document with at most BUDGET
    edits a character, counted on the normalised texts.

    Of overlapping occurrences of one item the one with fewest edits, then the first, is given. Whole texts are searched for whole items: a part of an
    item, or one with more edits, is no occurrence. Items of fewer than SHORTEST normalised characters have to occur without any edit, those of fewer than Q only match a
    text that is nothing else; of an item of more than LONGEST each of its equal parts counts as the item. Null and empty texts and items match nothing; a null
    doc_id is kept as null; repeated rows are searched each, repeated items once; empty tables give an empty result; other columns are not read."""
    schema = "doc_id long, item_id long, start_char long, end_char long, edits long"
    paths = prepared(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in vec.slices(batch, "text", 16 << 20):
                hits = scan_all(part.column(1), paths)
                cols = list(zip(*hits)) if hits else [()] * 5
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(x, pa.int64()) for x in cols[1:])], names=["doc_id", "item_id", "start_char", "end_char", "edits"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, in which no benchmark item occurs (as contaminated() has it); nothing is shuffled. Null and empty
    texts stay, whatever the other columns hold; repeated rows stay or go together; without items all rows stay."""
    paths = prepared(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in vec.slices(batch, "text", 16 << 20):
                clean = np.ones(part.num_rows, bool)
                clean[[h[0] for h in scan_all(part.column(part.schema.get_field_index("text")), paths)]] = False
                yield part.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
