"""SimHash near-duplicates by an exact search of all pairs of fingerprints.

A fingerprint has 256 bits in four words. Two documents match if the first words differ in at most RADIUS bits and all
four in at most TOTAL. The bits are cut into parts, of which one at least differs in no more than its share of TOTAL; over each part
lie masks of which one at least leaves out whichever so few bits differ (covering codes, Pagh 2016). So two that match are alike
under some mask: fingerprints are sorted under each mask in turn, and those alike are compared in full. Few or closely alike
fingerprints, for which this takes longer, are compared pair by pair in tiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .common import components, cut

RADIUS, TOTAL = 16, 48
#: Rows of a block at most; two blocks are searched together, in UNITS shares at least, and one share for each UNIT_ROWS of them.
BLOCK_ROWS, UNITS, UNIT_ROWS = 1 << 21, 12, 1 << 20
#: Partitions of units at most.
PARTITIONS = 1024
#: Costs of a row under a mask, of a mask, and of a pair alike under a mask, in comparisons of a pair in tiles.
ROW_COST, MASK_COST, PAIR_COST = 5, 50_000, 15
#: Most bits that a part may differ in, about so many fingerprints from which pairs alike are estimated, and rows handled at a time, which fit in a core's cache.
MOST_BITS, SAMPLE, STRETCH = 14, 1500, 1 << 15
#: Rows and columns of a tile: its exclusive-ors fit in a core's cache.
TILE, WIDE = 128, 1024
#: Words of weight 8 at most whose counters fit in a byte.
FEW = 31
WORDS = ("h0", "h1", "h2", "h3")


def fingerprint_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    b, off = vec.raw(pc.utf8_lower(batch.column(1)))
    s, e, n = vec.words(b, off)
    h = vec.span_hash(vec.prefix(b), s, e)
    size = e - s
    doc = np.repeat(np.arange(len(n)), n)
    # long words tell documents apart; those of up to three bytes are in all texts, so each counts together with the word after it
    weight = np.clip(size - 3, 1, 8).astype(np.uint8)
    follow = np.zeros(len(h), np.uint64)
    if len(h):
        follow[:-1] = np.where(doc[1:] == doc[:-1], h[1:], np.uint64(0))
    h = np.where(size <= 3, vec.mix(h + follow * np.uint64(3), 7), h)
    have, first = np.unique(doc, return_index=True)
    cols = [batch.column(0).take(pa.array(have))]
    if len(have):
        half = np.add.reduceat(weight.astype(np.int64), first)[:, None]
        # eight counters of a byte each are added as one number, over so few words that none overflows
        starts = np.flatnonzero((np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))) % FEW == 0)
        own = np.searchsorted(starts, first)
        lanes = weight.astype(np.uint64)[:, None]
    for k in range(4):
        if not len(have):
            cols.append(pa.array([], pa.int64()))
            continue
        bits = np.unpackbits(vec.mix(h, k + 1).view(np.uint8).reshape(-1, 8), axis=1).view(np.uint64)
        bits *= lanes
        few = np.add.reduceat(bits, starts, axis=0).view(np.uint8)
        sums = np.add.reduceat(few, own, axis=0, dtype=np.uint32)
        cols.append(pa.array(np.packbits(2 * sums.astype(np.int64) > half, axis=1).view(np.int64).ravel()))
    return pa.RecordBatch.from_arrays(cols, names=["doc_id", *WORDS])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, h0..h3) of each document with at least one word; null, empty and wordless texts have no fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in vec.slices(batch, "text", 1 << 20):
                yield fingerprint_batch(part)

    return docs.select("doc_id", "text").where("text is not null and doc_id is not null").mapInArrow(run, "doc_id long, h0 long, h1 long, h2 long, h3 long")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the graph with edges (a, b), each node joined to the least of its component."""
    nodes, x = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = x[: len(a)], x[len(a) :]
    label = np.arange(len(nodes))
    while True:
        m = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], m)
        np.minimum.at(new, label[b], m)
        new = new[new]
        if (new == label).all():
            break
        label = new
    rest = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[rest], nodes[label[rest]]


def compare(ida: np.ndarray, ha: np.ndarray, idb: np.ndarray, hb: np.ndarray, same: bool, radius: int = RADIUS, total: int = TOTAL) -> tuple[np.ndarray, np.ndarray]:
    """The edges of a spanning forest of the matches between two blocks: (n,), (n, 4) each; same: b is a again."""

    def lay(ids, h):
        # in order of the bit count of the first word, then of the other words together
        p = np.bitwise_count(h).astype(np.int16)
        order = np.lexsort((p[:, 1:].sum(1), p[:, 0]))
        return ids[order], h[order], p[order]

    ida, ha, pa_ = lay(ida, ha)
    idb, hb, pb_ = (ida, ha, pa_) if same else lay(idb, hb)
    starts_a, starts_b = range(0, len(ida), TILE), range(0, len(idb), WIDE)
    low = [pb_[j : j + WIDE].min(0) for j in starts_b]
    high = [pb_[j : j + WIDE].max(0) for j in starts_b]
    out_a, out_b = [], []
    xor, count = np.empty((TILE, WIDE), np.uint64), np.full((TILE, WIDE), 255, np.uint8)
    for i in starts_a:
        x = ha[i : i + TILE]
        m = len(x)
        lo, hi = pa_[i : i + TILE].min(0), pa_[i : i + TILE].max(0)
        for t, j in enumerate(starts_b):
            if same and j + WIDE <= i:
                continue
            gap = np.maximum(0, np.maximum(low[t] - hi, lo - high[t]))
            if gap[0] > radius or gap.sum() > total:
                continue
            y = hb[j : j + WIDE]
            n = len(y)
            np.bitwise_xor(x[:, 0][:, None], y[:, 0][None, :], out=xor[:m, :n])
            np.bitwise_count(xor[:m, :n], out=count[:m, :n])
            near = count[:m] <= radius
            near[:, n:] = False
            # eight flags at a time: hits are rare
            at = np.flatnonzero(near.view(np.uint64).ravel())
            if not len(at):
                continue
            at = (at[:, None] * 8 + np.arange(8)).ravel()
            r, s = np.divmod(at[near.ravel()[at]], WIDE)
            if same:
                ok = i + r < j + s
                r, s = r[ok], s[ok]
            ok = np.bitwise_count(x[r] ^ y[s]).sum(1, dtype=np.int16) <= total
            if ok.any():
                out_a.append(ida[i + r[ok]])
                out_b.append(idb[j + s[ok]])
        if sum(map(len, out_a)) > 1 << 20:
            f = forest(np.concatenate(out_a), np.concatenate(out_b))
            out_a, out_b = [f[0]], [f[1]]
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(np.concatenate(out_a), np.concatenate(out_b))


@cache
def covering(width: int, bits: int, seed: int) -> np.ndarray:
    """2^(bits + 1) - 1 masks over this many bits (64 at most): whichever `bits` of them differ, one mask leaves them all out.

    Each bit has a vector of bits + 1 bits, each mask another, and keeps the bits whose vectors have an odd product with its own. The vectors of `bits` bits
    don't span the space, so a mask's is orthogonal to them all. Of some drawn at random, those count under whose masks the fewest pairs are alike by chance."""
    rng = np.random.default_rng(seed)
    own = np.arange(1, 1 << (bits + 1), dtype=np.uint64)[:, None]
    least, masks = np.inf, own[:, 0]
    for _ in range(60):
        kept = np.bitwise_count(own & rng.integers(1, 1 << (bits + 1), width).astype(np.uint64)) & 1
        if (alike := np.exp2(-kept.sum(1, dtype=float)).sum()) < least:
            least, masks = alike, np.left_shift(kept.astype(np.uint64), np.arange(width, dtype=np.uint64)).sum(1, dtype=np.uint64)
    return masks


def cuts(parts: int, total: int) -> list[tuple[int, int, int]]:
    """(begin, end, bits) of parts of the 256 bits: if at most `total` bits differ, some part differs in at most its own number, as these and one for each part add up to total + 1."""
    spare = total + 1 - parts
    return [(256 * p // parts, 256 * (p + 1) // parts, spare * (p + 1) // parts - spare * p // parts) for p in range(parts)]


def plan(n: int, sample: np.ndarray, total: int = TOTAL) -> list[tuple[int, int, np.ndarray]]:
    """(begin, end, masks) of each part, in the number of parts that costs least for n fingerprints at the distances found in the sample, (m, 4); none where tiles cost less."""
    hist = np.zeros(257)
    for i in range(0, len(sample), TILE):
        d = np.bitwise_count(sample[i : i + TILE, None] ^ sample[None]).sum(2, dtype=np.int16)
        hist += np.bincount(d.ravel(), minlength=257)
    hist[: total + 1] = 0
    share = 1 - np.arange(257) / 256
    best, least = [], n * n / 2
    for parts in range(4, min(32, total + 1) + 1):
        own = cuts(parts, total)
        if max(r for _, _, r in own) > MOST_BITS:
            continue
        masks = sum((2 << r) - 1 for _, _, r in own)
        # a mask keeps about half of its part's bits
        alike = sum((2 << r) * (hist * share ** ((e - b) / 2)).sum() for b, e, r in own) / max(1, len(sample) ** 2)
        cost = masks * (ROW_COST * n + MASK_COST) + alike * n * n / 2 * PAIR_COST
        if cost < least:
            best, least = own, cost
    return [(b, e, covering(e - b, r, k)) for k, (b, e, r) in enumerate(best)]


def search(h: list[np.ndarray], parts: list[tuple[int, int, np.ndarray]], share: int, shares: int, radius: int = RADIUS, total: int = TOTAL) -> tuple[np.ndarray, np.ndarray]:
    """The edges, by place, of a spanning forest of those matches among fingerprints (four arrays) that are alike under every shares-th mask from this share on."""
    n = len(h[0])
    low = np.uint64((1 << max(1, (n - 1).bit_length())) - 1)
    key, x = np.empty(n, np.uint64), np.empty(n, np.uint64)
    place, work = np.arange(min(n, STRETCH), dtype=np.uint64), np.empty(min(n, STRETCH), np.uint64)
    stretches = [slice(i, min(n, i + STRETCH)) for i in range(0, n, STRETCH)]
    label = np.arange(n, dtype=np.int32)
    out_a, out_b, new = [], [], 0

    def pair(at: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
        return (key[at] & low).view(np.int64), (key[at + gap] & low).view(np.int64)

    def test(at: np.ndarray, gap: int) -> np.ndarray:
        """Which of the pairs of keys (at, at + gap) are not yet known to be connected; those that match are noted."""
        nonlocal new
        a, b = pair(at, gap)
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        d = np.bitwise_count(h[0][a] ^ h[0][b])
        ok = d <= radius
        a, b, d = a[ok], b[ok], d[ok].astype(np.int16)
        for w in h[1:]:
            d += np.bitwise_count(w[a] ^ w[b])
        ok = d <= total
        if ok.any():
            out_a.append(a[ok])
            out_b.append(b[ok])
            new += len(out_a[-1])
        return apart

    def connect() -> None:
        nonlocal label, new
        if new:
            a, b = forest(label[np.concatenate(out_a)], label[np.concatenate(out_b)])
            to = np.arange(n, dtype=np.int32)
            to[a] = b
            label = to[label]
            out_a.clear()
            out_b.clear()
            new = 0

    for begin, end, masks in parts:
        w, s = divmod(begin, 64)
        np.right_shift(h[w], np.uint64(s), out=x)
        if end > 64 * (w + 1):
            for i in stretches:
                x[i] |= h[w + 1][i] << np.uint64(64 - s)
        for mask in masks[share::shares]:
            for i in stretches:
                # hashes in the upper bits, places in the lower; hashes that clash only add pairs to compare
                k = np.bitwise_and(x[i], mask, out=key[i])
                k *= np.uint64(0x9E3779B97F4A7C15)
                k &= ~low
                k |= np.add(place[: len(k)], np.uint64(i.start), out=work[: len(k)])
            key.sort()
            at = []
            for i in stretches:
                k = key[i.start + 1 : i.stop + 1]
                at.append(np.flatnonzero(np.bitwise_xor(k, key[i.start : i.start + len(k)], out=work[: len(k)]) <= low) + i.start)
            at = np.concatenate(at)
            if not len(at):
                continue
            apart = np.concatenate([test(at[i : i + STRETCH], 1) for i in range(0, len(at), STRETCH)])
            if new > max(256, n >> 10):
                connect()
                a, b = pair(at, 1)
                apart = label[a] != label[b]
            # a run of equal keys all of one component holds nothing new; of any other all pairs are compared
            run = np.cumsum(np.diff(at, prepend=-2) != 1) - 1
            mixed = np.zeros(run[-1] + 1, bool)
            mixed[run[apart]] = True
            at, gap = at[mixed[run]], 2
            while len(at := at[: np.searchsorted(at, n - gap)]) and len(at := at[(key[at] ^ key[at + gap]) <= low]):
                for i in range(0, len(at), STRETCH):
                    test(at[i : i + STRETCH], gap)
                    if new > max(1 << 16, n >> 6):
                        connect()
                gap += 1
    connect()
    a = np.flatnonzero(label != np.arange(n))
    return a, label[a].astype(np.int64)


def tiles(ids: np.ndarray, h: np.ndarray, share: int, shares: int, radius: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for this share of all pairs: every shares-th row with itself and with half of the other such sets, in a circle."""
    own = slice(share, None, shares)
    found = [compare(ids[own], h[own], ids[own], h[own], True, radius, total)]
    for step in range(1, shares // 2 + 1):
        if 2 * step < shares or share < step:
            other = slice((share + step) % shares, None, shares)
            found.append(compare(ids[own], h[own], ids[other], h[other], False, radius, total))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def edges(prints: DataFrame, radius: int = RADIUS, total: int = TOTAL) -> DataFrame:
    """(a, b): for each component of the match graph over (doc_id, h0..h3), edges that connect it."""
    n = prints.count()
    if not n:
        return prints.sparkSession.createDataFrame([], "a long, b long")
    blocks = -(-n // BLOCK_ROWS)
    # two blocks are searched as one; one alone is a pair by itself
    pairs, rows = max(1, blocks * (blocks - 1) // 2), -(-n * min(2, blocks) // blocks)
    shares = max(-(-UNITS // pairs), -(-rows // UNIT_ROWS)) if rows > WIDE else 1
    near = F.xxhash64(*WORDS)
    sample = prints.where(F.pmod(near, F.lit(-(-n // SAMPLE))) == 0).select(*WORDS).collect()
    parts = plan(rows, np.array(sample, np.int64).reshape(-1, 4).view(np.uint64), total)
    laid = prints.withColumn("k", F.pmod(F.shiftright(near, 32), F.lit(blocks))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    first = F.expr(f"(greatest(j, k) * (greatest(j, k) - 1) div 2 + least(j, k)) * {shares}")
    units = laid.where("j <> k" if blocks > 1 else "true").select(F.explode(F.sequence(first, first + (shares - 1))).alias("unit"), "doc_id", *WORDS)
    units = units.repartitionById(min(PARTITIONS, pairs * shares), F.pmod("unit", F.lit(PARTITIONS)).cast("int"))
    if pairs * shares > PARTITIONS:
        units = units.sortWithinPartitions("unit")

    def matches(unit: int, held: list[list[np.ndarray]]) -> pa.RecordBatch:
        cols = []
        for x in held:
            cols.append(np.concatenate(x))
            x.clear()
        ids, h = cols[0], [x.view(np.uint64) for x in cols[1:]]
        if parts:
            a, b = (ids[x] for x in search(h, parts, unit % shares, shares, radius, total))
        else:
            a, b = tiles(ids, np.stack(h, 1), unit % shares, shares, radius, total)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(a, b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, [[] for _ in range(5)]
        for batch in batches:
            unit = batch.column(0).to_numpy()
            at = [0, *(np.flatnonzero(np.diff(unit)) + 1), len(unit)]
            for i, j in zip(at, at[1:]):
                if i == j:
                    continue
                if last not in (None, unit[i]):
                    yield matches(int(last), held)
                last = unit[i]
                for x, col in zip(held, batch.columns[1:]):
                    x.append(col.slice(i, j - i).to_numpy().copy())
        if last is not None:
            yield matches(int(last), held)

    return units.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, total: int = TOTAL) -> DataFrame:
    """(doc_id, kept_id) for every document that is a near copy, directly or through others, of one with a lower id.

    kept_id is the least doc_id of the group. Texts that are null, empty or without a word match nothing; rows with a null
    doc_id are ignored; rows of one doc_id are one document, which matches with any of their texts and is no copy of itself;
    an empty table gives an empty result; other columns of docs are not read.

    Equal fingerprints are one to the comparison, however many documents have them: they are counted before they are exchanged, and
    only the join that gives them back their documents has keys of many rows, which adaptive execution splits."""
    prints = cut(fingerprints(docs).distinct())
    least = cut(prints.groupBy(*WORDS).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    groups = components(edges(least.select(F.col("rep").alias("doc_id"), *WORDS), radius, total))
    same = prints.join(least.where("n > 1").drop("n"), list(WORDS)).select("doc_id", "rep")
    # a document of several texts may be least of several fingerprints, and then ties these together
    links = groups.select(F.col("node").alias("doc_id"), F.col("group").alias("rep"))
    several = prints.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if several.isEmpty():
        found = same.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("group", "rep").alias("kept_id"))
        found = found.unionAll(links.withColumnRenamed("rep", "kept_id"))
    else:
        found = components(same.unionAll(links).toDF("a", "b")).toDF("doc_id", "kept_id")
    return found.where("doc_id <> kept_id").groupBy("doc_id").agg(F.min("kept_id").alias("kept_id"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, but for the documents that near_duplicates lists: one document of each group stays, and all without a
    group. Rows with a null doc_id or text stay; repeated rows of one doc_id stay or go together; an empty table gives an empty result."""
    return docs.join(near_duplicates(docs).select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
