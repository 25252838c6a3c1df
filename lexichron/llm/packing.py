"""Best-fit packing of documents into sequences of fixed capacity by linear grouping (Fernandez de la Vega & Lueker 1981).

Only the histogram of lengths, at most one number for each length up to the capacity, comes to the driver. There, large lengths are rounded up within
groups of equal cardinality, configurations of the few sizes left are optimised by column generation, actual lengths take
the places of the rounded ones, and the small ones are best-fitted into what is left. The plan is a table of ranges (the i-th to j-th
document of a length go to these bins), whose size depends on the capacity, not on the number of documents."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

CAPACITY = 4096
#: Lengths above this share of the capacity are large; so many groups of equal cardinality.
LARGE, GROUPS = 1 / 8, 24
BYTES_PER_TOKEN = 4
#: Steps of column generation in a row without any gain, after which it ends.
CIRCLES = 1000
#: Pieces of one length that are numbered together, and equal rows that are written out together.
SLOT_ROWS, COPIES = 1 << 20, 1 << 16


def estimated_tokens(text: str | Column = "text") -> Column:
    """Four bytes of UTF-8 a token, rounded up."""
    return F.ceil(F.octet_length(F.col(text) if isinstance(text, str) else text) / BYTES_PER_TOKEN).cast("long")


def knapsack(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity."""
    best = np.zeros(capacity + 1)
    took: list[np.ndarray] = []
    for _ in range(capacity // min(sizes)):
        new, pick = best.copy(), np.full(capacity + 1, -1)
        for k, s in enumerate(sizes):
            v = best[: capacity + 1 - s] + values[k]
            better = v > new[s:] + 1e-12
            new[s:][better], pick[s:][better] = v[better], k
        took.append(pick)
        if (new == best).all():
            break
        best = new
    a, c = np.zeros(len(sizes)), capacity
    for pick in reversed(took):
        if pick[c] >= 0:
            a[pick[c]] += 1
            c -= sizes[pick[c]]
    return float(best[capacity]), a


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """(how many of each size, how many bins) so that every demand is met: Gilmore-Gomory columns, rounded down, the rest first-fit."""
    n = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    d = np.array(demand, float)
    x = np.linalg.solve(basis, d)
    best, since = x.sum(), 0
    # it ends where no column improves the bound; degenerate steps that change nothing could go in circles, and after CIRCLES of them in a row the columns so far serve
    while since < CIRCLES:
        y = np.linalg.solve(basis.T, np.ones(n))
        value, a = knapsack(sizes, y, capacity)
        if value <= 1 + 1e-7:
            break
        u = np.linalg.solve(basis, a)
        ratio = np.where(u > 1e-10, x / np.where(u > 1e-10, u, 1), np.inf)
        basis[:, int(ratio.argmin())] = a
        x = np.linalg.solve(basis, d)
        best, since = (x.sum(), 0) if x.sum() < best - 1e-9 else (best, since + 1)
    out = [(basis[:, i].astype(int), int(x[i] + 1e-9)) for i in range(n) if int(x[i] + 1e-9) > 0]
    left = d.astype(int) - sum((a * m for a, m in out), np.zeros(n, int))
    while (left > 0).any():
        a, room = np.zeros(n, int), capacity
        for k in np.argsort([-s for s in sizes]):
            a[k] = min(max(left[k], 0), room // sizes[k])
            room -= a[k] * sizes[k]
        m = max(1, int(min(left[k] // a[k] for k in range(n) if a[k])))
        out.append((a, m))
        left = left - a * m
    return out


def plan(hist: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, last rank + 1, first bin, documents a bin, tokens before) and the number of bins."""
    rows: list[tuple[int, int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # bins (from, to) by the room they have
    bins = 0
    if full := hist.get(capacity):
        rows.append((capacity, 0, full, 0, 1, 0))
        bins = full
    large = sorted((s for s in hist if capacity * LARGE < s < capacity and hist[s]), reverse=True)
    total = sum(hist[s] for s in large)
    # groups of equal cardinality, each a list of [length, from rank, to rank]
    groups: dict[int, list[list[int]]] = {}
    at, k, size = 0, -1, 0
    for s in large:
        done = 0
        while done < hist[s]:
            g = at * GROUPS // total
            if g != k:
                k = g
                size = s if s not in groups else size
                groups.setdefault(s, [])
                size = s
            n = min(hist[s] - done, -(-(g + 1) * total // GROUPS) - at)
            groups[size].append([s, done, done + n])
            done += n
            at += n
    if groups:
        sizes = list(groups)
        for a, m in configurations(sizes, [sum(e - b for _, b, e in groups[s]) for s in sizes], capacity):
            pieces = [(bins, bins + m, 0)]
            bins += m
            for k, s in enumerate(sizes):
                for _ in range(a[k]):
                    new, queue = [], groups[s]
                    for lo, hi, used in pieces:
                        while lo < hi and queue:
                            length, b, e = queue[0]
                            n = min(hi - lo, e - b)
                            rows.append((length, b, b + n, lo, 1, used))
                            new.append((lo, lo + n, used + length))
                            lo += n
                            queue[0][1] += n
                            if queue[0][1] == e:
                                queue.pop(0)
                        if lo < hi:
                            new.append((lo, hi, used))
                    pieces = new
            for lo, hi, used in pieces:
                free[capacity - used].append((lo, hi))
    room = np.zeros(capacity + 1, bool)
    room[[r for r in free if r]] = True
    for s in sorted((s for s in hist if 0 < s <= capacity * LARGE), reverse=True):
        rank, n = 0, hist[s]
        while rank < n:
            r = s + int(room[s:].argmax())
            if not room[r]:
                r = capacity
                new = -(-(n - rank) // (r // s))
                free[r].append((bins, bins + new))
                bins += new
            lo, hi = free[r].pop()
            room[r] = bool(free[r])
            q = r // s
            take = min(hi - lo, (n - rank) // q)
            if take:
                rows.append((s, rank, rank + take * q, lo, q, capacity - r))
                rank += take * q
                free[r - q * s].append((lo, lo + take))
                room[r - q * s] = r > q * s
            elif rank < n:  # fewer left than one bin takes
                take, rest = 1, n - rank
                rows.append((s, rank, n, lo, rest, capacity - r))
                rank = n
                free[r - rest * s].append((lo, lo + 1))
                room[r - rest * s] = True
            if lo + take < hi:
                free[r].append((lo + take, hi))
                room[r] = True
    return np.array(sorted(rows), np.int64).reshape(-1, 6), bins


def pack(docs: DataFrame, capacity: int = CAPACITY, length: Column | None = None) -> DataFrame:
    """(bin_id, position, doc_id, piece, start, length): every document laid into bins of `capacity` tokens.

    `length` is a document's size in tokens, by default estimated_tokens(). A document longer than the capacity is cut into pieces that each fill
    a bin and a rest; start is a piece's first token in its document, position in its bin. Null and empty texts take no room
    and get no row; a repeated row is laid twice; pieces of one length are taken in the order of their slot (by a hash; one for SLOT_ROWS pieces), then of
    doc_id (null first) and piece; an empty table gives an empty result; other columns are not read.

    Equal rows are counted before the exchange and written out at the end, and the many pieces of one length (all full ones, say) are numbered
    slot by slot, so no task has a whole length to sort. One row a slot comes to the driver, at most a row for SLOT_ROWS pieces and one a length."""
    spark = docs.sparkSession
    size = (estimated_tokens() if length is None else length).cast("long")
    sized = docs.select("doc_id", size.alias("size")).where("size > 0")
    whole = sized.select("doc_id", "size", F.posexplode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / capacity))).alias("piece", "n"))
    pieces = whole.select("doc_id", F.col("piece").cast("long").alias("piece"), (F.col("n") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("n") * capacity).alias("length"))
    pieces = cut(pieces.groupBy("doc_id", "piece", "start", "length").agg(F.count("*").alias("n")))
    lengths = pieces.groupBy("length").agg(F.sum("n").alias("total"), F.max("n").alias("most")).collect()
    table, _ = plan({int(r.length): int(r.total) for r in lengths}, capacity)
    slots = F.broadcast(spark.createDataFrame([(int(r.length), -(-int(r.total) // SLOT_ROWS)) for r in lengths], "length long, slots long"))
    slotted = pieces.join(slots, "length").withColumn("slot", F.pmod(F.xxhash64("doc_id", "piece"), F.col("slots")))
    base, at = [], {}
    for r in sorted(slotted.groupBy("length", "slot").agg(F.sum("n").alias("n")).collect(), key=lambda r: (r.length, r.slot)):
        base.append((r.length, r.slot, at.get(r.length, 0)))
        at[r.length] = at.get(r.length, 0) + r.n
    before = F.sum("n").over(Window.partitionBy("length", "slot").orderBy("doc_id", "piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    first = slotted.withColumn("before", before).join(F.broadcast(spark.createDataFrame(base, "length long, slot long, base long")), ["length", "slot"])
    copies = first.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))))
    if max((r.most for r in lengths), default=0) > COPIES:
        copies = copies.repartition("doc_id", "piece", "c")
    copies = copies.withColumn("c", F.explode(F.sequence("c", F.least(F.col("c") + COPIES, F.col("n")) - 1)))
    ranked = copies.select("doc_id", "piece", "start", "length", (F.col("base") + F.col("before") + F.col("c")).alias("rank"))
    # ranges in order of (length, first rank); lengths are at most the capacity, so one key tells both
    span = max((r.total for r in lengths), default=0) + 1
    keys = table[:, 0] * span + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            size, rank = x.column(3).to_numpy(), x.column(4).to_numpy().astype(np.int64)
            t = table[np.searchsorted(keys, size * span + rank, "right") - 1]
            i = rank - t[:, 1]
            yield pa.RecordBatch.from_arrays([pa.array(t[:, 3] + i // t[:, 4]), pa.array(t[:, 5] + i % t[:, 4] * size), *x.columns[:4]], names=["bin_id", "position", "doc_id", "piece", "start", "length"])

    return ranked.mapInArrow(run, "bin_id long, position long, doc_id long, piece long, start long, length long")
