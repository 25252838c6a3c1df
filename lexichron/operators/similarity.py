"""How alike the periods of a corpus are: resampling, four kinds of vectors, cosine, mean and deviation over replicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import cosine
from ..sources.places import BROADCAST_ROWS
from ..sources.shared import cut, unused
from .weights import term_counts, weighted

DECIMALS = 9


def group_sizes(docs: DataFrame, group: str = "year") -> DataFrame:
    return docs.groupBy(group).agg(F.count("*").alias("n"))


def clamped(docs: DataFrame, n: int, group: str = "year") -> DataFrame:
    """(n): the sample size, at most the size of the smallest group; no row for no group."""
    return group_sizes(docs, group).agg(F.min("n").alias("m")).where("m is not null").select(F.least(F.lit(n).cast("long"), F.col("m")).alias("n"))


def sample_groups(docs: DataFrame, n: int, replicates: int, group: str = "year", doc: str = "doc_id", seed: str = "") -> DataFrame:
    """(rep, columns...): in every replicate n documents of each group without replacement, n at most the size of the smallest group. Which ones
    depends on a hash of replicate and document only, so the sample is the same on every run and cluster."""
    size = clamped(docs, n, group).first()
    reps = docs.sparkSession.range(replicates).select(F.col("id").alias("rep"))
    order = Window.partitionBy("rep", group).orderBy(F.md5(F.concat(F.lit(seed), F.col("rep").cast("string"), F.lit("_"), F.col(doc).cast("string"))), doc)
    k = unused(docs, "_k")
    # a number, not a column: each task then keeps no more of a group than the sample takes
    return docs.crossJoin(F.broadcast(reps)).withColumn(k, F.row_number().over(order)).where(F.col(k) <= (size.n if size else 0)).drop(k)


def sample_texts(docs: DataFrame, n: int, replicates: int, group: str = "year", doc: str = "doc_id", seed: str = "") -> DataFrame:
    """sample_groups() where only ids are sorted: the other columns, stored, are those of the drawn documents, once for each replicate."""
    ids = cut(sample_groups(docs.select(doc, group), n, replicates, group, doc, seed).distinct())
    drawn = (F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids).alias("i")
    found = docs.alias("d").join(drawn, F.col(f"d.`{doc}`").eqNullSafe(F.col(f"i.`{doc}`")) & F.col(f"d.`{group}`").eqNullSafe(F.col(f"i.`{group}`")))
    return cut(found.select("i.rep", *(f"d.`{c}`" for c in docs.columns)))


def count_vectors(tokens: DataFrame, group: str = "year") -> DataFrame:
    """(rep, group, term, w): relative frequency of each term in each group."""
    tf = term_counts(tokens, "rep", group)
    return tf.select("rep", group, "term", (F.col("tf") / F.sum("tf").over(Window.partitionBy("rep", group))).alias("w"))


def docfreq_vectors(tokens: DataFrame, sizes: DataFrame, group: str = "year", doc: str = "doc_id") -> DataFrame:
    """(rep, group, term, w): share of a group's documents that have the term; sizes is (rep, group, n)."""
    df = tokens.select("rep", group, doc, "term").distinct().groupBy("rep", group, "term").agg(F.count("*").alias("df"))
    return df.join(sizes, ["rep", group]).select("rep", group, "term", (F.col("df") / F.col("n")).alias("w"))


def tfidf_vectors(tokens: DataFrame, group: str = "year") -> DataFrame:
    """(rep, group, term, w): L1-normalised TF-IDF with each group as one document of its replicate."""
    return weighted(term_counts(tokens, "rep", group), "rep", group, "l1").select("rep", group, "term", F.col("weight").alias("w"))


def cosine_matrix(vectors: DataFrame, groups: DataFrame, group: str = "year", key: str = "term") -> DataFrame:
    """(rep, year_a, year_b, sim) for all pairs of (rep, group) in groups; 0 where nothing is common.

    Products are formed term by term from the list of groups that have the term, which is never longer than there are groups; the vectors are
    exchanged once and never joined with themselves."""
    by_term = vectors.groupBy("rep", key).agg(F.collect_list(F.struct(F.col(group).alias("g"), "w")).alias("v"))
    a = by_term.select("rep", "v", F.explode("v").alias("a"))
    dots = a.select("rep", "a", F.explode("v").alias("b")).groupBy("rep", F.col("a.g").alias("year_a"), F.col("b.g").alias("year_b")).agg(F.sum(F.col("a.w") * F.col("b.w")).alias("dot"))
    length = dots.where("year_a = year_b").select("rep", F.col("year_a").alias("g"), F.sqrt("dot").alias("len"))
    pairs = groups.select("rep", F.col(group).alias("year_a")).join(groups.select("rep", F.col(group).alias("year_b")), "rep")
    return (
        pairs.join(dots, ["rep", "year_a", "year_b"], "left")
        .join(length.select("rep", F.col("g").alias("year_a"), F.col("len").alias("len_a")), ["rep", "year_a"], "left")
        .join(length.select("rep", F.col("g").alias("year_b"), F.col("len").alias("len_b")), ["rep", "year_b"], "left")
        .select("rep", "year_a", "year_b", cosine(F.col("dot"), F.col("len_a"), F.col("len_b")).alias("sim"))
    )


def over_replicates(matrix: DataFrame) -> DataFrame:
    """(year_a, year_b, mean, std): mean and population deviation."""
    return matrix.groupBy("year_a", "year_b").agg(F.round(F.avg("sim"), DECIMALS).alias("mean"), F.round(F.stddev_pop("sim"), DECIMALS).alias("std"))


def year_similarity(docs: DataFrame, tokens: Column | str, method: str, n: int, replicates: int, group: str = "year", doc: str = "doc_id", seed: str = "") -> DataFrame:
    """(rep, year_a, year_b, sim) of resampled groups by "count", "docfreq" or "tfidf" vectors; tokens is the column, or an expression, with each
    document's tokens, and doc tells documents apart.

    Only ids are sampled and sorted; texts of documents that some replicate drew are fetched and cut into tokens once. All replicates are one job."""
    ids = sample_groups(docs.select(doc, group), n, replicates, group, doc, seed)
    sizes = ids.groupBy("rep", group).agg(F.count("*").alias("n"))
    drawn = docs.join(ids.select(doc).distinct(), doc, "left_semi").select(doc, (F.col(tokens) if isinstance(tokens, str) else tokens).alias("_tokens"))
    t = ids.join(drawn, doc).select("rep", group, doc, F.explode("_tokens").alias("term"))
    if method == "count":
        v = count_vectors(t, group)
    elif method == "docfreq":
        v = docfreq_vectors(t, sizes, group, doc)
    elif method == "tfidf":
        v = tfidf_vectors(t, group)
    else:
        raise ValueError(method)
    return cosine_matrix(v, sizes, group)


def wide(matrix: DataFrame, years: list[str] | None = None, value: str = "mean") -> DataFrame:
    """One row and one column for each year, columns in the order of `years` or, without it, of all years there are (one row a year comes to the driver)."""
    if years is None:
        years = [r[0] for r in matrix.select("year_b").distinct().orderBy("year_b").collect()]
    return matrix.groupBy("year_a").pivot("year_b", years).agg(F.first(value)).withColumnRenamed("year_a", "year")
