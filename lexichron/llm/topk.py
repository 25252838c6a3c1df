"""Exact top-k by inner product with norm-bucketed pruning (after LEMP, Teflioudi, Gemulla & Mykytiuk 2015).

Vectors are sorted by length and cut into buckets. For a query and a bucket the product can only exceed the query's
threshold if the cosine exceeds threshold / (|q| longest |x|): above 1 the bucket is skipped; where it is high, the query's largest
coordinates bound the candidates' coordinates (coordinate pruning); else only their length does (length pruning). What is left
is verified by its full product."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

K = 10
#: The query op9_topk asks for each vector whose id is divisible by this.
QUERY_STEP = 100
#: Vectors pruned together; vectors (and coordinates) of a block, which is one task's share of them.
BUCKET, BLOCK_ROWS, BLOCK_NUMBERS, LEAST_BLOCKS = 512, 1 << 14, 1 << 22, 6
#: Vectors that give the first thresholds, of so many dimensions (those with most vectors).
SEEDS, SEEDED = 512, 8
#: From this local cosine on, coordinates prune better than they cost.
COORDINATE_COSINE, FOCUS = 0.9, 3
#: Products are compared to this many decimals; equal ones rank by id.
DECIMALS = 9


def pruned(q: np.ndarray, qn: np.ndarray, theta: np.ndarray, x: np.ndarray, xn: np.ndarray) -> np.ndarray:
    """[query, vector] of one bucket that may reach the thresholds; x in order of falling length."""
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(qn > 0, theta / (qn * xn[0]), np.where(theta > 0, np.inf, -np.inf)) if xn[0] > 0 else np.where(theta > 0, np.inf, -np.inf)
        # length pruning: |x| >= theta / |q|
        keep = np.where(qn[:, None] > 0, xn[None, :] >= (theta / qn)[:, None] * (1 - 1e-9), theta[:, None] <= 0)
    keep[local > 1 + 1e-9] = False
    rows = np.flatnonzero((local >= COORDINATE_COSINE) & (local <= 1 + 1e-9))
    if len(rows):
        u, unit = q[rows] / qn[rows, None], x / np.where(xn > 0, xn, 1)[:, None]
        c = np.minimum(local[rows], 1.0)
        focus = np.argsort(-np.abs(u), axis=1)[:, :FOCUS]
        for f in range(FOCUS):
            at = focus[:, f]
            v = u[np.arange(len(rows)), at]
            # cos >= c means |x_f| lies where u_f x_f + sqrt(1 - u_f^2) sqrt(1 - x_f^2) >= c
            w = np.sqrt(np.maximum(0, (1 - v * v) * (1 - c * c)))
            low, high = np.where(v * c - w > -1, v * c - w, -1.0), v * c + w
            low, high = np.where(c < -v, -1.0, low), np.where(c < v, 1.0, high)
            keep[rows] &= (unit[:, at].T >= low[:, None] - 1e-9) & (unit[:, at].T <= high[:, None] + 1e-9)
    return keep


def search(qid: np.ndarray, q: np.ndarray, theta: np.ndarray, xid: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of x for each query, itself aside, among products of at least theta."""
    xn = np.sqrt((x * x).sum(1))
    order = np.lexsort((xid, -xn))
    xid, x, xn = xid[order], x[order], xn[order]
    qn = np.sqrt((q * q).sum(1))
    theta = theta.copy()
    best_p = np.full((len(q), k), -np.inf)
    best_i = np.full((len(q), k), np.iinfo(np.int64).max)
    for at in range(0, len(xid), BUCKET):
        b = slice(at, at + BUCKET)
        # a rounded product may be half a unit above the true one
        keep = pruned(q, qn, theta - 10.0**-DECIMALS, x[b], xn[b])
        rows = np.flatnonzero(keep.any(1))
        if not len(rows):
            continue
        p = np.round(q[rows] @ x[b].T, DECIMALS) + 0.0
        keep = keep[rows] & (p >= theta[rows, None]) & (qid[rows][:, None] != xid[b][None, :])
        # only what reaches a query's threshold is ranked against what it has
        i, c = np.nonzero(keep)
        if not len(i):
            continue
        some = np.unique(i)
        old = np.repeat(rows[some], k)
        row = np.concatenate([old, rows[i]])
        value = np.concatenate([best_p[rows[some]].ravel(), p[i, c]])
        ident = np.concatenate([best_i[rows[some]].ravel(), xid[b][c]])
        order = np.lexsort((ident, -value, row))
        row, value, ident = row[order], value[order], ident[order]
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        take = first[:, None] + np.arange(k)
        best_p[rows[some]], best_i[rows[some]] = value[take], ident[take]
        theta[rows[some]] = np.maximum(theta[rows[some]], best_p[rows[some], -1])
    r, c = np.nonzero(best_p > -np.inf)
    return pd.DataFrame({"query_id": qid[r], "match_id": best_i[r, c], "product": best_p[r, c]})


def flat(t: pa.Table, width: int) -> np.ndarray:
    """The vectors of some rows, which all have so many coordinates, as a matrix."""
    v = t.column("v").combine_chunks()
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def seeds(laid: DataFrame, dims: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and coordinates of the SEEDS longest vectors of each of these dimensions."""
    by = Window.partitionBy("dim").orderBy(F.desc("norm"), "vec_id")
    rows = laid.where(F.col("dim").isin(dims)).withColumn("n", F.row_number().over(by)).where(F.col("n") <= SEEDS).select("dim", "vec_id", "v").collect()
    out = {}
    for d in dims:
        own = sorted((r.vec_id, r.v) for r in rows if r.dim == d)
        out[d] = np.array([i for i, _ in own], np.int64), np.array([x for _, x in own], np.float64)
    return out


def top_k(vectors: DataFrame, k: int = K, every: int = 1) -> DataFrame:
    """(query_id, rank, match_id, product): for each vector whose vec_id is divisible by `every` the k others with the largest inner product, of all
    vectors, exactly.

    Products are rounded to DECIMALS; of equal ones the lower vec_id comes first. Vectors are compared with those of their own dimension only. Null and
    empty vectors, vectors with a null, NaN or infinite coordinate or whose squared length is beyond a double, and rows with a null vec_id are
    ignored; of repeated rows of one vec_id the first by coordinates counts; with fewer than k others there are fewer rows; an empty table gives an
    empty result; other columns are not read.

    Vectors are laid out once, by dimension and falling length, in buckets; a query has its first threshold from the longest vectors and goes only
    to the buckets that its threshold and length allow, and a bucket only to blocks of queries of which one needs it."""
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType.simpleString()
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind if kind == "array<float>" else "array<double>").alias("v"))
    v = v.where("vec_id is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    n, numbers = v.agg(F.count("*"), F.sum(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, match_id long, product double")
    blocks = max(LEAST_BLOCKS, -(-n // BLOCK_ROWS), -(-numbers // BLOCK_NUMBERS))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    v = v.groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v", F.size("v").alias("dim"), norm.alias("norm")).where("norm < double('infinity')")
    laid = cut(v.repartitionByRange(blocks, "dim", F.desc("norm"), F.xxhash64("vec_id")).withColumn("block", F.spark_partition_id()))
    # one row a bucket: the vectors of one dimension in one block
    buckets = laid.groupBy("dim", "block").agg(F.max("norm").alias("longest"), F.count("*").alias("n")).orderBy("dim", F.desc("longest"), "block").collect()
    if not buckets:
        return spark.createDataFrame([], "query_id long, rank int, match_id long, product double")
    lengths = {d: np.array([b.longest for b in buckets if b.dim == d]) for d in {b.dim for b in buckets}}
    begin = {d: next(i for i, b in enumerate(buckets) if b.dim == d) for d in lengths}
    count = {d: sum(b.n for b in buckets if b.dim == d) for d in lengths}
    seed = seeds(laid, sorted(count, key=lambda d: (-count[d], d))[:SEEDED])

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the first threshold of each query, and how many buckets may reach it
        for batch in batches:
            ids, dim, qn = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("vec_id", "dim", "norm"))
            theta, need = np.full(len(ids), -np.inf), np.zeros(len(ids), np.int32)
            for d in np.unique(dim).tolist():
                at = np.flatnonzero(dim == d)
                if d in seed and len(seed[d][0]) >= k:
                    first = np.round(flat(pa.Table.from_batches([batch.take(pa.array(at))]), d) @ seed[d][1].T, DECIMALS)
                    first[ids[at][:, None] == seed[d][0][None, :]] = -np.inf
                    theta[at] = np.partition(first, -k, axis=1)[:, -k]
                # a rounded product may be half a unit above the true one
                reach = qn[at][:, None] * lengths[d][None, :] * (1 + 1e-9) >= (theta[at] - 10.0**-DECIMALS)[:, None]
                need[at] = np.where(reach.any(1), len(lengths[d]) - reach[:, ::-1].argmax(1), 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("vec_id", "v", "dim")), pa.array(theta), pa.array(need)], names=["vec_id", "v", "dim", "theta", "need"])

    asked = laid.where(F.pmod("vec_id", F.lit(every)) == 0)
    m = asked.count()
    groups = max(1, -(-m // BLOCK_ROWS), -(-(m * numbers // n) // BLOCK_NUMBERS))
    asked = asked.select("vec_id", "v", "dim", "norm").mapInArrow(start, f"vec_id long, v {laid.schema['v'].dataType.simpleString()}, dim int, theta double, need int").where("need > 0")
    # queries that need equally many buckets together
    asked = cut(asked.repartitionByRange(groups, "dim", "need", F.xxhash64("vec_id")).withColumn("i", F.spark_partition_id()))
    most = asked.groupBy("dim", "i").agg(F.max("need").alias("need")).collect()
    # as a table, one row a bucket and block of queries that need it in part
    links = [(b.dim, b.block, j, sorted(q.i for q in most if q.dim == b.dim and q.need > j - begin[b.dim])) for j, b in enumerate(buckets)]
    links = spark.createDataFrame(links, "dim int, block int, j int, to array<int>").where("size(to) > 0")
    first = F.element_at(F.create_map(*(F.lit(x) for d, j in begin.items() for x in (d, j))), F.col("dim"))
    q = asked.select("i", F.explode(F.sequence(first, first + F.col("need") - 1)).alias("j"), F.lit(True).alias("query"), "theta", "vec_id", "v", "dim")
    x = laid.join(F.broadcast(links), ["dim", "block"]).select(F.explode("to").alias("i"), "j", F.lit(False).alias("query"), F.lit(0.0).alias("theta"), "vec_id", "v", "dim")

    def run(t: pa.Table) -> pa.Table:
        is_q = t.column("query").to_numpy()
        qs, xs = t.filter(pa.array(is_q)), t.filter(pa.array(~is_q))
        out = []
        if qs.num_rows and xs.num_rows:
            width = t.column("dim")[0].as_py()
            qid, theta, xid, x = qs.column("vec_id").to_numpy(), qs.column("theta").to_numpy(), xs.column("vec_id").to_numpy(), flat(xs, width)
            for at in range(0, len(qid), 2048):
                out.append(search(qid[at : at + 2048], flat(qs.slice(at, 2048), width), theta[at : at + 2048], xid, x, k))
        names = ("query_id", "match_id", "product")
        kinds = (np.int64, np.int64, np.float64)
        return pa.table({c: np.concatenate([np.zeros(0, t), *(o[c] for o in out)]).astype(t) for c, t in zip(names, kinds)})

    found = q.unionAll(x).groupBy("i", "j").applyInArrow(run, "query_id long, match_id long, product double")
    order = Window.partitionBy("query_id").orderBy(F.desc("product"), "match_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "match_id", "product")


def sql(k: int = K, every: int = QUERY_STEP) -> str:
    return f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.vec_id AS query_id, b.vec_id AS match_id, round(list_inner_product(a.v, b.v), {DECIMALS}) + 0.0 AS product FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {every} = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY product DESC, match_id) AS INTEGER) AS rank, match_id, product FROM p)
SELECT query_id, rank, match_id, product FROM r WHERE rank <= {k}"""
