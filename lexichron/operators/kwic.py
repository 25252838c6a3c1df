"""Keyword-in-context lines: parsing, entry ids, documents, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import unused
from ..sources.places import with_places

COLUMNS = ("source", "year", "kwic", "text", "L-context", "keyword", "R-context")
_HEAD = r"(?U)<B>(.*?)\s(\d{4})</B>"


def parse_kwic(lines: DataFrame, column: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """The seven columns of each line (and those to keep). A part without markup is null; of several hits in a line, the left
    context reaches to the last, the keyword is the first, the right context follows the first."""
    name = unused(lines, "_body")
    c, body = F.col(column), F.col(name)
    parts = {
        "source": T.extract(c, _HEAD, 1),
        "year": T.extract(c, _HEAD, 2),
        "kwic": c,
        "text": F.regexp_replace(body, "<U>|</U>", ""),
        "L-context": T.extract(body, "(?m)^(.*)<U>"),
        "keyword": T.extract(body, "<U>(.*?)</U>"),
        "R-context": T.extract(body, "</U>(.*)"),
    }
    # the greedy left context begins with its line: saying so keeps the search linear
    stripped = lines.withColumn(name, T.trim(F.regexp_replace(c, r"(?d)<B>.*?</B>", "")))
    return stripped.select(*keep, *(parts[k].alias(k) for k in COLUMNS))


def entry_ids(kwic: DataFrame, *order: str) -> DataFrame:
    """id = year_n, n being the line's place in the order; the number alone where the year is missing."""
    n = unused(kwic, "_n")
    return with_places(kwic, n, *order).withColumn("id", F.concat_ws("_", F.coalesce("year", F.lit("")), F.col(n).cast("string"))).drop(n)


def flatten_entries(entries: DataFrame) -> DataFrame:
    """Entries of a corpus XML as (id, source, year, L-context, keyword, R-context), all trimmed; missing parts are empty."""
    c = lambda n: T.trim(F.coalesce(F.col(n), F.lit("")))
    return entries.where(F.col("context.keyword").isNotNull()).select(F.col("_id").alias("id"), c("source").alias("source"), c("year").alias("year"), c("context.L").alias("L-context"), c("context.keyword").alias("keyword"), c("context.R").alias("R-context"))


def document() -> Column:
    """Left context, keyword and right context, trimmed and joined without spaces."""
    return F.concat(*(T.trim(F.coalesce(F.col(n), F.lit(""))) for n in ("`L-context`", "keyword", "`R-context`")))


def assemble(kwic: DataFrame) -> DataFrame:
    return kwic.withColumn("document", document())


def select_keyword(kwic: DataFrame, keyword: str | Column) -> DataFrame:
    return kwic.where(T.trim("keyword") == (F.lit(keyword) if isinstance(keyword, str) else keyword))


def select_years(kwic: DataFrame, start: str, end: str) -> DataFrame:
    """Both years included; compared as text, like the years themselves."""
    return kwic.where(T.trim("year").between(str(start), str(end)))


def free_documents(entries: DataFrame, with_author: bool = True) -> DataFrame:
    """(author, document) of entries with an author or a content."""
    a, c = (T.trim(F.coalesce(F.col(n), F.lit(""))) for n in ("author", "content"))
    doc = F.concat(a, F.lit(" "), c) if with_author else c
    return entries.where((a != "") | (c != "")).select(a.alias("author"), doc.alias("document"))


def distinct_keywords(kwic: DataFrame) -> DataFrame:
    return kwic.select("keyword").where("keyword is not null").distinct()


def sorted_years(kwic: DataFrame) -> DataFrame:
    return kwic.select("year").where("year is not null").distinct().orderBy("year")
