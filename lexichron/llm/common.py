"""What the operators share: connected components, and from the rest of the library cutting lineage and reading tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut, shared_dir, table

__all__ = ["components", "cut", "shared_dir", "table"]


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): m is the least v of u. The minimum is taken before the exchange; of the join, adaptive execution splits keys of many rows."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, group): the connected components of edges (a, b), group being the least node of each.

    Alternates large-star and small-star (Kiveris et al. 2014) until nothing changes; every round is linear in the edges
    and no node's neighbours are ever held together."""
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        low = _with_least(cut(large.where("u <> v").distinct()))
        small = low.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        e = cut(small.where("a <> b").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            return e.select(F.col("a").alias("node"), F.col("b").alias("group"))
        last = now
