"""Concordance text, CSV and XML corpora, term lists, saved pages."""

from __future__ import annotations

import os
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .places import with_places
from .shared import cut
from .sinks import CORPUS, CSV

KWIC = "source string, year string, kwic string, text string, `L-context` string, keyword string, `R-context` string"
CORPUS_ENTRY = "_id string, source string, year string, context struct<L: string, keyword: string, R: string>"
FREE_ENTRY = "author string, content string"
ARTICLE = (
    "title string, journal string, year string, issue string, page struct<startpage: string, endpage: string>, authors struct<author: array<string>>, "
    "funding struct<acknowledgement: string, order: string, researchtitle: string, number: string>, abstract string, keywords struct<keyword: array<string>>, "
    "impact struct<date: string, download: string, read: string>"
)


class MissingInput(FileNotFoundError):
    """An input that has to be there is not."""


def exists(spark: SparkSession, path: str) -> bool:
    """On whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def required(spark: SparkSession, path: str) -> str:
    if not exists(spark, path):
        raise MissingInput(path)
    return path


def concordance_paths(directory: str, keyword: str, start_year: int, end_year: int, prefix: str = CORPUS) -> list[str]:
    return [f"{directory}/{prefix}_{keyword}_{y}.txt" for y in range(int(start_year), int(end_year) + 1)]


def read_concordance(spark: SparkSession, directory: str, keyword: str, start_year: int, end_year: int, prefix: str = CORPUS) -> DataFrame:
    """(content, file, line): the lines of every year's file, both years included; a missing file is warned of and skipped. Files are
    read in splits, however long they are; lines are numbered from 0 within their file, blank ones are dropped, and so is a byte order mark."""
    there = []
    for p in concordance_paths(directory, keyword, start_year, end_year, prefix):
        if exists(spark, p):
            there.append(p)
        else:
            warnings.warn(f"no file {p}", stacklevel=2)
    if not there:
        return spark.createDataFrame([], "content string, file string, line long")
    lines = spark.read.text(there).select(F.regexp_replace("value", "^\ufeff", "").alias("content"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    # what a task numbers is fixed before it is sorted
    numbered = with_places(cut(lines), "line", "block", "n", group="file")
    return numbered.where(T.trim("content") != "").select("content", "file", (F.col("line") - 1).alias("line"))


def read_csv(spark: SparkSession, path: str, schema: str = KWIC) -> DataFrame:
    """A CSV with a header, with or without a byte order mark, every column as declared."""
    return spark.read.options(**CSV).csv(required(spark, path), schema=schema, multiLine=True)


def read_corpus_xml(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "entry").schema(CORPUS_ENTRY).load(required(spark, path))


def read_free_xml(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "entry").schema(FREE_ENTRY).load(required(spark, path))


def read_article_xml(spark: SparkSession, path: str) -> DataFrame:
    """Articles with authors and keywords as plain arrays."""
    df = spark.read.format("xml").option("rowTag", "article").schema(ARTICLE).load(required(spark, path))
    return df.withColumns({"authors": F.coalesce("authors.author", F.array()), "keywords": F.coalesce("keywords.keyword", F.array())})


def read_terms(spark: SparkSession, path: str | None, needed: bool = False) -> DataFrame:
    """(term): the distinct non-blank lines; an absent list is empty unless it is needed."""
    if path is None or not exists(spark, path):
        if needed:
            raise MissingInput(str(path))
        return spark.createDataFrame([], "term string")
    return spark.read.text(path).select(T.trim(F.regexp_replace("value", "^﻿", "")).alias("term")).where("term <> ''").distinct()


def read_characters(spark: SparkSession, path: str) -> dict[str, str]:
    """A table of characters, one a line: the character, white space, what takes its place (of several the least). Lines of another shape are passed over."""
    c = F.split(T.trim(F.regexp_replace("value", "^\ufeff", "")), r"(?U)\s+")
    rows = spark.read.text(required(spark, path)).select(c.alias("c")).where("size(c) >= 2 and length(c[0]) = 1 and length(c[1]) = 1").select(F.col("c")[0].alias("k"), F.col("c")[1].alias("v"))
    return {r.k: r.v for r in rows.groupBy("k").agg(F.min("v").alias("v")).orderBy("k").collect()}


def derived_names(path: str) -> tuple[str, str]:
    """Names for the parsed CSV and XML of a raw CSV."""
    out = path.replace("corpusraw", "corpusdata")
    return out, os.path.splitext(out)[0] + ".xml"
