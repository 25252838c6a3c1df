"""Passages of at least LEAST words that occur in more than one document, by fixed-block anchors.

Every document is cut into non-overlapping blocks of BLOCK words, the index. Every rolling window of BLOCK words of every document probes it.
As LEAST >= 2 BLOCK - 1, any repeat holds a whole block of each document it is in, so a block that equals a window of
another document is an anchor. Around the anchors, windows of LEAST words are compared across documents; their union
is the maximal exact repeats. Windows travel packed by hash bucket, about six bytes each, never as rows.

What many documents share is settled where it is read: within a pack of texts a block that another document of the pack has is an
anchor at once, and of all windows with one hash only two go on, from different documents, so that other packs learn of them. A
passage in a third of all documents thus adds two entries a pack to its bucket, not one a document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec

LEAST = 50
BLOCK = (LEAST + 1) // 2
#: Text whose windows are packed together, and text of one group of documents in the second step.
PACK_BYTES, GROUP_BYTES = 8 << 20, 16 << 20
LEAST_GROUPS = 64
#: Windows of one group of documents that are settled at once.
SETTLE_ROWS = 1 << 20
_BASE = 0xD6E8FEB86659FD93
_INV = pow(_BASE, -1, 1 << 64)
PACKED = "bucket int, ids binary, counts binary, gaps binary, extra binary, key binary"


def packed(n_buckets: int, bucket: np.ndarray, ids: np.ndarray, doc: np.ndarray, pos: np.ndarray, key: np.ndarray, extra: np.ndarray | None = None) -> pa.RecordBatch:
    """Entries (document ids[doc], pos, key, extra), in order of doc and pos, as one row a bucket."""
    order = np.argsort(bucket.astype(np.uint16) if n_buckets < 65536 else bucket, kind="stable")
    bucket, doc, pos, key = bucket[order], doc[order], pos[order], key[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (bucket[1:] != bucket[:-1])
    gap = pos.copy()
    gap[1:] -= np.where(new[1:], 0, pos[:-1])
    runs = np.flatnonzero(new)
    counts = np.diff(np.append(runs, len(doc)))
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, int)
    out: list[list] = [[] for _ in range(6)]
    for lo, hi in zip(cuts, np.append(cuts[1:], len(bucket))):
        a, b = np.searchsorted(runs, (lo, hi))
        own = ids[doc[runs[a:b]]]
        g = gap[lo:hi]
        row = (
            int(bucket[lo]),
            np.diff(own, prepend=0).astype(np.int64).tobytes(),
            counts[a:b].astype(np.uint32).tobytes(),
            g.astype(np.uint16 if g.max() < 65536 else np.uint32).tobytes(),
            b"" if extra is None else extra[order[lo:hi]].astype(np.uint32).tobytes(),
            key[lo:hi].tobytes(),
        )
        for c, v in zip(out, row):
            c.append(v)
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], names=["bucket", "ids", "counts", "gaps", "extra", "key"])


def unpacked(t: pa.Table, key: type) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_id, pos, key, extra) of the entries of some rows."""
    ids, pos, keys, extra = [], [], [], []
    for i, c, g, x, k in zip(*(t.column(n).to_pylist() for n in ("ids", "counts", "gaps", "extra", "key"))):
        c = np.frombuffer(c, np.uint32).astype(np.int64)
        n = int(c.sum())
        gap = np.frombuffer(g, np.uint16 if len(g) == 2 * n else np.uint32).astype(np.int64)
        p = np.cumsum(gap)
        first = np.cumsum(c) - c
        p -= np.repeat(p[first] - gap[first], c)
        ids.append(np.repeat(np.cumsum(np.frombuffer(i, np.int64)), c))
        pos.append(p)
        keys.append(np.frombuffer(k, key))
        extra.append(np.frombuffer(x, np.uint32))
    join = lambda a, kind: np.concatenate(a) if a else np.zeros(0, kind)
    return join(ids, np.int64), join(pos, np.int64), join(keys, key), join(extra, np.uint32)


class Windows:
    """The words of some texts, and hashes of any windows of them."""

    def __init__(self, texts: pa.Array):
        b, off = vec.raw(pc.utf8_lower(texts))
        self.s, self.e, n = vec.words(b, off)
        h = vec.span_hash(vec.prefix(b), self.s, self.e)
        self.first = np.cumsum(n) - n
        self.doc = np.repeat(np.arange(len(n)), n)
        self.n = n
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * vec.powers(_BASE, len(h)), out=self.sums[1:])

    def starts(self, size: int) -> np.ndarray:
        """All words at which a window of so many words begins, in documents of at least LEAST words."""
        i = np.arange(len(self.doc))
        return i[(i + size <= (self.first + self.n)[self.doc]) & (self.n >= LEAST)[self.doc]]

    def hash(self, i: np.ndarray, size: int) -> np.ndarray:
        return vec.mix((self.sums[i + size] - self.sums[i]) * vec.powers(_INV, len(self.sums))[i])


def spread(h: np.ndarray, n: int) -> np.ndarray:
    """A bucket from the upper bits; the lower ones stay to tell apart what is in it."""
    return ((h >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


def shared(doc: np.ndarray, key: np.ndarray, needed: np.ndarray | None = None) -> np.ndarray:
    """Which entries have a key that is in two documents (and, if given, on an entry that is marked)."""
    if needed is not None and len(key):
        # only keys of marked entries matter: a bit table leaves few others to sort
        seen = np.zeros(1 << 22, bool)
        seen[(key[needed] & 0x3FFFFF).astype(np.int64)] = True
        maybe = np.flatnonzero(seen[(key & 0x3FFFFF).astype(np.int64)])
    else:
        maybe = np.arange(len(key))
    k, d = key[maybe], doc[maybe]
    order = np.argsort(k, kind="stable")
    k, d = k[order], d[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, int)
    if not len(first):
        return maybe
    ok = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
    if needed is not None:
        ok &= np.logical_or.reduceat(needed[maybe[order]], first)
    return np.sort(maybe[order[np.repeat(ok, np.diff(np.append(first, len(k))))]])


def summary(ids: np.ndarray, key: np.ndarray, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries of one pack: which ones ask and have a key that another document has too, and which ones have to be told to other packs: of a
    key in several documents two from different ones, of one in a single document those that ask, or else any one."""
    order = np.argsort(key, kind="stable")
    k, d, a = key[order], ids[order], asks[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, int)
    if not len(first):
        return first, first
    size = np.diff(np.append(first, len(k)))
    low, high, any_asks = np.minimum.reduceat(d, first), np.maximum.reduceat(d, first), np.logical_or.reduceat(a, first)
    many = low != high
    group = np.repeat(np.arange(len(first)), size)
    settled = a & many[group]
    tell = a & ~many[group]
    tell[first[~many & ~any_asks]] = True
    # the first entry of a key, and the first that is from another document
    tell[first[many]] = True
    other = np.flatnonzero(many[group] & (d != d[first][group]))
    if len(other):
        tell[other[np.append(True, group[other][1:] != group[other][:-1])]] = True
    return np.sort(order[settled]), np.sort(order[tell])


def table_of(batch: pa.RecordBatch) -> pa.Table:
    return pa.Table.from_batches([batch])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start_char, end_char): the maximal runs of each document that are covered by passages of LEAST words or more which another
    document has too, word for word.

    Words are runs of letters, digits and underscores, compared in lower case, whatever stands between them; a document is all rows of one doc_id; what a
    document only repeats within itself doesn't count. Texts that are null, empty or of fewer than LEAST words, and rows with a null doc_id, have
    no passages; an empty table gives an empty result; other columns are not read."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    size = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    n = max(LEAST_GROUPS, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // GROUP_BYTES)) | 1

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in vec.slices(batch, "text", PACK_BYTES):
                ids = part.column(0).to_numpy()
                parts, at = [], 0
                for piece in vec.slices(part, "text"):
                    w = Windows(piece.column(1))
                    i = w.starts(BLOCK)
                    parts.append((w.hash(i, BLOCK), w.doc[i] + at, i - w.first[w.doc[i]]))
                    at += piece.num_rows
                h, doc, pos = (np.concatenate(x) for x in zip(*parts))
                if len(h):
                    settled, tell = summary(ids[doc], h, pos % BLOCK == 0)
                    yield packed(n, spread(h[tell], n), ids, doc[tell], pos[tell], h[tell].astype(np.uint32))
                    if len(settled):
                        yield grouped(ids[doc[settled]], pos[settled], np.zeros(len(settled), np.uint32), n)

    def passed(t: pa.Table) -> pa.Table | None:
        # buckets from n on hold what is settled, by document
        if t.num_rows and t.column("bucket")[0].as_py() >= n:
            return t.set_column(t.schema.get_field_index("bucket"), "bucket", pc.subtract(t.column("bucket"), pa.scalar(n, pa.int32())))
        return None

    def anchors(t: pa.Table) -> pa.Table:
        if (done := passed(t)) is not None:
            return done
        doc, pos, key, _ = unpacked(t, np.uint32)
        at = shared(doc, key, pos % BLOCK == 0)
        at = at[pos[at] % BLOCK == 0]
        return table_of(grouped(doc[at], pos[at], np.zeros(len(at), np.uint32)))

    def grouped(doc: np.ndarray, pos: np.ndarray, extra: np.ndarray, beyond: int = 0) -> pa.RecordBatch:
        order = np.lexsort((pos, doc))
        doc, pos, extra = doc[order], pos[order], extra[order]
        ids, d = np.unique(doc, return_inverse=True)
        return packed(2 * n, doc % n + beyond, ids, d, pos, np.zeros(len(d), np.uint8), extra)

    def extend(texts: pa.Table, hits: pa.Table) -> pa.Table:
        doc, pos, _, _ = unpacked(hits, np.uint8)
        out: list[pa.RecordBatch] = []
        found: list[tuple[np.ndarray, ...]] = []

        def settle() -> None:
            own, start, h, size = (np.concatenate(x) for x in zip(*found))
            found.clear()
            done, tell = summary(own, h, np.ones(len(h), bool))
            if len(done):
                out.append(grouped(own[done], start[done], size[done].astype(np.uint32), n))
            # what is settled is told without its size
            size[done] = 0
            order = tell[np.lexsort((start[tell], own[tell]))]
            ids, d = np.unique(own[order], return_inverse=True)
            out.append(packed(n, spread(h[order], n), ids, d, start[order], h[order], size[order]))

        order = np.lexsort((pos, doc))
        doc, pos = doc[order], pos[order]
        keep = texts.filter(pc.is_in(texts.column("doc_id"), pa.array(np.unique(doc)))).combine_chunks()
        for batch in keep.to_batches():
            for part in vec.slices(batch, "text"):
                ids = part.column(part.schema.get_field_index("doc_id")).to_numpy()
                text = part.column(part.schema.get_field_index("text"))
                w = Windows(text)
                lo, hi = np.searchsorted(doc, ids, "left"), np.searchsorted(doc, ids, "right")
                own = np.repeat(np.arange(len(ids)), hi - lo)
                p = pos[np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo) + np.arange(len(own))]
                ok = p + BLOCK <= w.n[own]
                p = p[ok] + w.first[own[ok]]
                # every window of LEAST words around an anchor
                mark = np.zeros(len(w.doc) + 2, np.int64)
                np.add.at(mark, np.maximum(p - (LEAST - BLOCK), w.first[own[ok]]), 1)
                np.add.at(mark, p + 1, -1)
                i = w.starts(LEAST)
                i = i[np.cumsum(mark)[i] > 0]
                h = w.hash(i, LEAST)
                lower, loff = vec.raw(pc.utf8_lower(text))
                chars = vec.char_starts(lower)
                d = w.doc[i]
                start = chars[w.s[i]] - chars[loff[d]]
                end = chars[w.e[i + LEAST - 1]] - chars[loff[d]]
                if len(i):
                    found.append((ids[d], start, h, end - start))
                    if sum(len(x[1]) for x in found) > SETTLE_ROWS:
                        settle()
        if found:
            settle()
        return pa.Table.from_batches(out, schema=packed(n, *(np.zeros(0, np.int64),) * 5).schema)

    def repeats(t: pa.Table) -> pa.Table:
        if (done := passed(t)) is not None:
            return done
        doc, pos, key, extra = unpacked(t, np.uint64)
        at = shared(doc, key)
        at = at[extra[at] > 0]
        return table_of(grouped(doc[at], pos[at], extra[at]))

    def join(t: pa.Table) -> pa.Table:
        doc, start, _, size = unpacked(t, np.uint8)
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        end = start + size[order]
        # the farthest end so far within the document
        base = np.unique(doc, return_inverse=True)[1] << 34
        reach = np.maximum.accumulate(end + base)
        new = np.ones(len(doc), bool)
        new[1:] = (start + base)[1:] > reach[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(doc)) - 1
        return pa.table({"doc_id": doc[first], "start_char": start[first], "end_char": (reach - base)[last]}, schema=pa.schema([("doc_id", pa.int64()), ("start_char", pa.int64()), ("end_char", pa.int64())]))

    hits = docs.mapInArrow(probe, PACKED).groupBy("bucket").applyInArrow(anchors, PACKED)
    texts = docs.withColumn("bucket", F.pmod("doc_id", F.lit(n)).cast("int"))
    found = texts.groupBy("bucket").cogroup(hits.groupBy("bucket")).applyInArrow(extend, PACKED)
    whole = found.groupBy("bucket").applyInArrow(repeats, PACKED)
    return whole.groupBy("bucket").applyInArrow(join, "doc_id long, start_char long, end_char long")


def sql() -> str:
    word = r"[0-9a-z_\x{80}-\x{10ffff}]+"
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{word}') AS ws, regexp_split_to_array(lower(text), '{word}') AS ps FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
u AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w, unnest(ps[1:len(ws)]) AS p FROM d WHERE len(ws) >= {LEAST}),
c AS (SELECT doc_id, i, w, CAST(sum(length(p) + length(w)) OVER o AS BIGINT) AS e FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
g AS (SELECT doc_id, e - length(w) AS s, lead(e, {LEAST - 1}) OVER (PARTITION BY doc_id ORDER BY i) AS e, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {LEAST - 1} FOLLOWING) AS k FROM c),
h AS (SELECT k FROM g WHERE e IS NOT NULL GROUP BY k HAVING min(doc_id) <> max(doc_id)),
x AS (SELECT doc_id, s, e FROM g JOIN h USING (k) WHERE e IS NOT NULL),
y AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM x),
z AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS j FROM y)
SELECT doc_id, min(s) AS start_char, max(e) AS end_char FROM z GROUP BY doc_id, j"""
