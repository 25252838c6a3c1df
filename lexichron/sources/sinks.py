"""Distributed writers, and single named files where a person is to open them."""

from __future__ import annotations

import base64
import urllib.parse
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import unused

#: What the names of corpus and result files begin with, unless another is given.
CORPUS, RESULT = "bcc_corpus", "bcc"
BOM = b"\xef\xbb\xbf"
#: Text comes back as it was, blank ends and all; an empty string comes back as null.
CSV = {"header": "true", "escape": '"', "nullValue": "", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


#: Rows of a CSV part at most: texts hold line breaks, so a part is read by one task.
CSV_ROWS = 2000


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """A folder of quoted CSV parts with headers."""
    w = df.write.mode("overwrite").options(**CSV).option("maxRecordsPerFile", CSV_ROWS)
    (w.partitionBy(*partition_by) if partition_by else w).csv(path)


def write_single(df: DataFrame, path: str, form: str = "csv", bom: bool = True, **options: str) -> str:
    """One file under exactly this name, for results of a size to open by hand; with a byte order mark if wanted."""
    spark = df.sparkSession
    draft = f"{path}.parts"
    w = df.coalesce(1).write.mode("overwrite").options(**(CSV if form == "csv" else {}) | options)
    w.format(form).save(draft)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(draft)
    system = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    _gather(spark, system, p, path, bom)
    system.delete(p, True)
    return path


def write_groups(df: DataFrame, folder: str, group: str, name: Callable[[str], str], form: str = "csv", bom: bool = True, order: tuple[str, ...] = (), **options: str) -> list[str]:
    """A file for each group, named by `name` of its value, in one distributed job; the rows without the group's column, in the order if one is given. A null group has no file.

    For groups of a size to open by hand: each is written by one task. The driver only moves files, one for each group."""
    spark = df.sparkSession
    draft = f"{folder}/.parts-{uuid.uuid4().hex}"
    key = unused(df, "_group")
    rows = df.where(F.col(group).isNotNull()).withColumn(key, F.base64(F.encode(F.col(group).cast("string"), "UTF-8"))).drop(group)
    # one more column to write by, safe in a path
    rows = rows.repartition(key).sortWithinPartitions(key, *order)
    # text has one column, so what only orders it goes
    rows = rows.select(key, "value") if form == "text" else rows
    rows.write.options(**(CSV if form == "csv" else {}) | options).partitionBy(key).format(form).save(draft)
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(draft)
    system, out = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), []
    for d in system.listStatus(root):
        if d.isDirectory():
            value = base64.b64decode(urllib.parse.unquote(d.getPath().getName().partition("=")[2])).decode()
            out.append(f"{folder}/{name(value)}")
            _gather(spark, system, d.getPath(), out[-1], bom)
    system.delete(root, True)
    return sorted(out)


def _gather(spark: SparkSession, system, parts, path: str, bom: bool) -> None:
    """The one part of a folder as one file."""
    jvm = spark.sparkContext._jvm
    part = next(s.getPath() for s in system.listStatus(parts) if s.getPath().getName().startswith("part-"))
    out = system.create(jvm.org.apache.hadoop.fs.Path(path), True)
    if bom:
        out.write(bytearray(BOM))
    jvm.org.apache.hadoop.io.IOUtils.copyBytes(system.open(part), out, 1 << 16, True)


def corpus_entries(kwic: DataFrame) -> DataFrame:
    """Parsed lines (with id) in the nested shape of a corpus entry; missing parts are empty elements."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return kwic.select(F.col("id").alias("_id"), text("source").alias("source"), text("year").alias("year"), F.struct(text("L-context").alias("L"), text("keyword").alias("keyword"), text("R-context").alias("R")).alias("context"))


def write_corpus_xml(kwic: DataFrame, path: str) -> None:
    corpus_entries(kwic).write.mode("overwrite").option("rootTag", "corpus").option("rowTag", "entry").option("nullValue", "").format("xml").save(path)


def write_free_xml(entries: DataFrame, path: str, root: str = "entries") -> None:
    """(author, content); a missing part is an empty element."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    entries.select(text("author"), text("content")).write.mode("overwrite").option("rootTag", root).option("rowTag", "entry").option("nullValue", "").format("xml").save(path)


def write_article_xml(articles: DataFrame, path: str) -> None:
    nested = articles.withColumns({"authors": F.struct(F.col("authors").alias("author")), "keywords": F.struct(F.col("keywords").alias("keyword"))})
    nested.write.mode("overwrite").option("rootTag", "articles").option("rowTag", "article").format("xml").save(path)


def topic_lines(terms: DataFrame) -> DataFrame:
    """(value): `Topic i: "word", p, "word2", p2` for each topic of (topic, position, term, weight)."""
    pair = F.format_string('"%s", %.3f', "term", "weight")
    return terms.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("position", pair.alias("p")))).alias("ps")).orderBy("topic").select(F.concat(F.lit("Topic "), F.col("topic").cast("string"), F.lit(": "), F.array_join("ps.p", ", ")).alias("value"))


def result_name(kind: str, slug: str, year: str | None = None, prefix: str = RESULT) -> str:
    """File names of ranked terms: by year, over all years, or of a free corpus."""
    return {"year": f"{prefix}_{year}_{slug}_tfidf_norml1.csv", "all": f"{prefix}_{slug}_tfidf_norml1.csv", "free": f"{slug}_tfidf_norml1.csv", "proto": f"{prefix}_{year}_{slug}_tfidf.csv"}[kind]


def write_tfidf(result: DataFrame, folder: str, slug: str, group: str = "year", everything: str = "all", prefix: str = RESULT) -> list[str]:
    """A ranked file for each group of a TF-IDF table and one for all groups together, each with a byte order mark."""
    return write_groups(result, folder, group, lambda y: result_name("all" if y == everything else "year", slug, y, prefix), order=("rank",))


def similarity_name(kind: str, slug: str, start: str, end: str, deviation: bool = False, prefix: str = RESULT) -> str:
    return f"{prefix}_{start}-{end}_{slug}_similarity_{kind}{'_std' if deviation else ''}.csv"


def topic_names(keyword: str, year: str) -> tuple[str, str]:
    """File names of the topics' terms and of the documents' topics; year may be "all"."""
    end = "" if year == "all" else f"_{year}"
    return f"{keyword}_topic_terms_matrix{end}.txt", f"{keyword}_text_topic_matrix{end}.csv"


def heat_map(matrix: DataFrame, path: str, title: str = "") -> str:
    """A PNG of (year_a, year_b, mean); needs matplotlib, which only this sink imports. The matrix has one row for each pair of years."""
    import matplotlib

    matplotlib.use("Agg")
    import matplotlib.pyplot as plt

    m = matrix.toPandas().pivot(index="year_a", columns="year_b", values="mean").sort_index().sort_index(axis=1)
    fig, ax = plt.subplots(figsize=(10, 8))
    image = ax.imshow(m.to_numpy(), cmap="Blues", interpolation="nearest")
    ax.set_xticks(range(len(m)), m.columns, rotation=90)
    ax.set_yticks(range(len(m)), m.index)
    ax.set_title(title)
    fig.colorbar(image)
    fig.savefig(path, dpi=200)
    plt.close(fig)
    return path
