"""Term statistics and TF-IDF by group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import normal_pdf, smooth_idf
from ..sources.places import BROADCAST_ROWS, with_places
from ..sources.shared import cut
from . import bags

ALL = "all"
DECIMALS = 9
#: The density magnifies the last digits of mean and deviation, which depend on the order of summation.
DENSITY_DECIMALS = 6


def term_counts(tokens: DataFrame, *keys: str) -> DataFrame:
    """(keys..., term, tf)."""
    # what a join would add to one of its readers only would keep them from sharing the exchange
    return tokens.where("term is not null").groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def with_all(counts: DataFrame, group: str) -> DataFrame:
    """Every row once in its own group and once in the group of all; counts, not texts, are doubled. A null group counts in all only."""
    groups = F.when(F.col(group).isNull(), F.array(F.lit(ALL))).otherwise(F.array(F.col(group), F.lit(ALL)))
    return counts.withColumn(group, F.explode(groups))


def group_statistics(counts: DataFrame, group: str, doc: str) -> DataFrame:
    """(group, term, docf, count): in how many documents a term is, and how often."""
    return counts.groupBy(group, "term").agg(F.count("*").alias("docf"), F.sum("tf").alias("count"))


def weighted(counts: DataFrame, group: str, doc: str, norm: str | None = "l1") -> DataFrame:
    """(group, doc, term, tf, docf, count, idf, weight): TF-IDF with smoothed IDF in each group, normalised by document.

    N is the number of documents of the group that have a token. One exchange by document and term feeds both the
    statistics and the join with them."""
    # the filter keeps tf in the plan, so that this reads the same exchange as the rest
    n = counts.groupBy(group, doc).agg(F.sum("tf").alias("size")).where("size > 0").groupBy(group).agg(F.count("*").alias("n"))
    stats = group_statistics(counts, group, doc).join(n, group).withColumn("idf", smooth_idf(F.col("n"), F.col("docf"))).drop("n")
    # exploded tokens are far larger than the scan they are estimated by: never broadcast them
    w = counts.hint("merge").join(stats, [group, "term"]).withColumn("w", F.col("tf") * F.col("idf"))
    by = Window.partitionBy(group, doc)
    size = {"l1": F.sum("w").over(by), "l2": F.sqrt(F.sum(F.col("w") * F.col("w")).over(by)), None: F.lit(1.0)}[norm]
    return w.withColumn("weight", F.col("w") / size).drop("w")


def tfidf(tokens: DataFrame, group: str, doc: str, norm: str | None = "l1", all_group: bool = True) -> DataFrame:
    """tfidf_of() tokens (doc, group, term), which meet by document first."""
    return tfidf_of(tokens.groupBy(doc, group).agg(F.collect_list("term").alias("tokens")), F.col("tokens"), group, doc, norm, all_group)


def tfidf_of(docs: DataFrame, tokens: Column, group: str, doc: str, norm: str | None = "l1", all_group: bool = True) -> DataFrame:
    """(group, term, docf, count, idf, tf-idf, normdis, rank) of every term of every group and, if wanted, of all groups together. tokens is an array
    or lower-cased text, as for bags.by_document().

    tf-idf is the sum over the group's documents of TF-IDF with smoothed IDF, normalised by document; normdis its density under a normal distribution with the mean and
    population deviation of the group's scores; rank numbers the terms by falling score (rounded to nine decimals), then by term. A null group counts in all only.

    Counts stay in chunks of documents: the statistics are summed from a row for each term of a chunk, the IDFs come back to it, and sums of weights go out."""
    chunks = bags.by_document(docs, tokens, doc, group)
    names, kind = docs.schema[group].name, docs.schema[group].dataType
    flat = bags.terms_of(chunks)
    # a group that has the name of all counts twice in it, as in with_all()
    times = F.when(F.col("group") == ALL, 2).otherwise(1)
    n = chunks.select("chunk", F.explode(F.arrays_zip(F.col("names").alias("group"), F.col("members").alias("n"))).alias("x")).groupBy("x.group").agg(F.sum("x.n").alias("n"))
    sizes = n.where("group is not null" + (f" and `group` <> '{ALL}'" if all_group else ""))
    if all_group:
        # a document counts once, in however many groups it lies
        sizes = sizes.unionAll(chunks.agg(F.sum(F.length("docs") / 4).cast("long").alias("n")).select(F.lit(ALL).alias("group"), "n").where("n > 0"))
    sizes = cut(sizes)
    few = F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes
    by, by_group = Window.partitionBy("term"), Window.partitionBy("term", "group")
    found = flat.join(few, "group", "left").withColumn("idf", smooth_idf(F.col("n"), F.sum("docf").over(by_group)))
    if all_group:
        everything = sizes.where(F.col("group") == ALL).select(F.col("n").alias("n_all"))
        found = found.crossJoin(F.broadcast(everything)).withColumn("idf_all", smooth_idf(F.col("n_all"), F.sum(F.col("docf") * times).over(by)))
    else:
        found = found.withColumn("idf_all", F.lit(None).cast("double"))
    found = found.select(F.col("chunk").alias("of"), "j", "idf", "idf_all")

    def score(c: pa.Table, idf: pa.Table) -> pa.Table:
        ids, tf, size = bags.numbers(c, "ids", np.int32), bags.numbers(c, "n", np.int32).astype(np.float64), len(c.column("terms")[0])
        groups, terms, docf, counts = (c.column(x).combine_chunks().flatten() for x in ("groups", "terms", "docf", "counts"))
        at = idf.column("j").to_numpy()
        # where a group is that of all, or null, its documents are only there
        outside = pc.is_null(groups).to_numpy(zero_copy_only=False)
        twice = pc.fill_null(pc.equal(groups, ALL), False).to_numpy(zero_copy_only=False)
        length = bags.numbers(c, "sizes", np.int32)
        both = np.add.reduceat(length, np.cumsum(d := bags.numbers(c, "docs", np.int32)) - d)
        out = []
        for column, spans, own in (("idf", length, True), ("idf_all", both, False)):
            if not own and not all_group:
                continue
            value = np.zeros(size)
            value[at] = np.nan_to_num(idf.column(column).to_numpy())
            m = np.where(twice, 2.0, 1.0) if all_group and not own else np.ones(size)
            w = tf * value[ids]
            if norm is not None:
                by_doc = np.add.reduceat(m[ids] * (w if norm == "l1" else w * w), np.cumsum(spans) - spans)
                with np.errstate(invalid="ignore", divide="ignore"):
                    w = w / np.repeat(by_doc if norm == "l1" else np.sqrt(by_doc), spans)
            s = np.bincount(ids, m[ids] * w, size)
            keep = ~(outside | (twice & all_group)) if own else np.ones(size, bool)
            k = pa.array(keep)
            name = groups if own else pa.array([ALL] * size, pa.string())
            out.append(pa.table([name.filter(k), terms.filter(k), pa.array((docf.to_numpy() * m)[keep].astype(np.int64)), pa.array((counts.to_numpy() * m)[keep].astype(np.int64)), pa.array(s[keep])], names=["group", "term", "docf", "count", "s"]))
        return pa.concat_tables(out)

    parts = chunks.select("chunk", "groups", "terms", "docf", "counts", "ids", "n", "sizes", "docs").groupBy("chunk").cogroup(found.groupBy("of")).applyInArrow(score, "group string, term string, docf long, count long, s double")
    scored = parts.groupBy("group", "term").agg(F.sum("docf").alias("docf"), F.sum("count").alias("count"), F.round(F.sum("s"), DECIMALS).alias("tf-idf"))
    scored = scored.join(few, "group").withColumn("idf", smooth_idf(F.col("n"), F.col("docf"))).drop("n")
    spread = with_places(scored, "rank", F.desc("tf-idf"), "term", group="group", moments="tf-idf")
    return spread.select(F.col("group").cast("string" if all_group else kind).alias(names), "term", "docf", "count", F.round("idf", DECIMALS).alias("idf"), "tf-idf", F.round(normal_pdf(F.col("tf-idf"), F.col("mu"), F.col("sd")), DENSITY_DECIMALS).alias("normdis"), "rank")


def statistics_of(docs: DataFrame, tokens: Column, group: str, doc: str) -> DataFrame:
    """(group, term, docf, count): in how many documents of the group a term is, and how often; tokens as for tfidf_of()."""
    terms = bags.terms_of(bags.by_document(docs, tokens, doc, group))
    return terms.groupBy("group", "term").agg(F.sum("docf").alias("docf"), F.sum("count").alias("count")).withColumn("group", F.col("group").cast(docs.schema[group].dataType)).withColumnRenamed("group", group)


def idf_of(docs: DataFrame, tokens: Column, doc: str) -> DataFrame:
    """(term, idf): smoothed IDF over all documents that have a token, rounded."""
    chunks = bags.by_document(docs, tokens, doc)
    n = chunks.agg(F.sum(F.length("docs") / 4).cast("long").alias("n"))
    return bags.terms_of(chunks).groupBy("term").agg(F.sum("docf").alias("df")).crossJoin(F.broadcast(n)).select("term", F.round(smooth_idf(F.col("n"), F.col("df")), DECIMALS).alias("idf"))
