"""Saved web pages: records of journal lists and result lists, without duplicates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..sources.shared import unused

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_ITEM = "pos int, title string, ps array<array<string>>, lines array<string>, text string"


#: Start tags that end open elements without an end tag, and what keeps them from reaching further out.
_ENDS = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, **dict.fromkeys("p div ul ol table h1 h2 h3 section article".split(), {"p"})}
_WALLS = {"li": {"ul", "ol"}, "tr": {"table", "tbody", "thead"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tbody": {"table"}}


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += reversed(n.elements())


class Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        n = Node(tag, {k: v or "" for k, v in attrs})
        ends, walls = _ENDS.get(tag, ()), _WALLS.get(tag)
        while len(self.open) > 1 and ends:
            if walls is None:
                at = len(self.open) - 1 if self.open[-1].tag in ends else 0
            else:
                at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag in ends or self.open[i].tag in walls), 0)
            if not at or self.open[at].tag not in ends:
                break
            del self.open[at:]
        self.open[-1].children.append(n)
        if tag not in _VOID:
            self.open.append(n)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse_html(html: str) -> Node:
    t = Tree()
    t.feed(html or "")
    t.close()
    return t.root


def _clean(s: str) -> str:
    return " ".join(s.replace("﻿", " ").split())


def _title(item: Node) -> str:
    for tags in (("div",), ("h1", "h2", "h3")):
        for n in item.walk():
            kids = n.elements()
            if (n.tag in tags or len(tags) == 3 and "title" in n.attrs.get("class", "").split()) and kids and kids[0].tag == "a":
                return _clean(kids[0].text())
    return ""


def list_items(html: str, list_id: str = "ul_articlelist") -> list[tuple]:
    """(pos, title, text nodes of each p, texts of p, div, span and li inside, whole text) of the items of a list."""
    out = []
    for n in parse_html(html).walk():
        if n.attrs.get("id") == list_id:
            for item in (c for c in n.elements() if c.tag == "li"):
                inside = [x for x in item.walk() if x is not item]
                ps = [[c if isinstance(c, str) else c.text() for c in x.children] for x in inside if x.tag == "p"]
                lines = [t for x in inside if x.tag in ("p", "div", "span", "li") and (t := _clean(x.text()))]
                out.append((len(out), _title(item), ps, lines, _clean(item.text())))
            break
    return out


#: Pages whose rows are held in Python at a time.
PAGES = 64


def pieces(batch: pa.RecordBatch, rows_of: Callable[[str], list[tuple]], kinds: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """The rows of the pages (page_no, html) of a batch, PAGES pages at a time."""
    for at in range(0, batch.num_rows, PAGES):
        part = batch.slice(at, PAGES)
        rows = [(page.as_py(), *r) for page, html in zip(part.column(0), part.column(1)) for r in rows_of(html.as_py())]
        columns = zip(*rows) if rows else [()] * (1 + len(kinds))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), *kinds.values()))], names=["page_no", *kinds])


def _by_page(pages: DataFrame, rows_of: Callable[[str], list[tuple]], schema: str, kinds: dict[str, pa.DataType]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from pieces(batch, rows_of, kinds)

    return pages.select(F.col("page_no").cast("long").alias("page_no"), "html").mapInArrow(run, f"page_no long, {schema}")


def page_items(pages: DataFrame, list_id: str = "ul_articlelist") -> DataFrame:
    """(page_no, pos, title, ps, lines, text): one row for each item of each saved page; the only step that leaves the JVM, by Arrow batches."""
    texts = pa.list_(pa.string())
    return _by_page(pages, lambda html: list_items(html, list_id), _ITEM, {"pos": pa.int32(), "title": pa.string(), "ps": pa.list_(texts), "lines": texts, "text": pa.string()})


def line_with(lines: Column | str, *labels: str) -> Column:
    """The first line with any of the labels, or an empty string."""
    hit = lambda t: F.array_contains(F.array(*(t.contains(x) for x in labels)), True)
    return F.coalesce(F.get(F.filter(lines, hit), F.lit(0)), F.lit(""))


def value_of(ps: Column | str, *labels: str) -> Column:
    """The value of the first paragraph whose label, normalised, is one of these."""
    wanted = F.array(*(T.normal_label(F.lit(x)) for x in labels))
    split = F.transform(ps, T.split_label)
    return F.coalesce(F.get(F.filter(split, lambda x: F.array_contains(wanted, x["label"])), F.lit(0))["value"], F.lit(""))


def article_records(items: DataFrame, date: str | None = None) -> DataFrame:
    """(page_no, pos, key and the fields of an article) from page_items; `date` defaults to today."""
    source = T.parse_source(line_with("lines", "出处", "出 处"))
    funding = line_with("lines", "基金项目", "基金項目")
    impact = T.parse_impact("text")
    day = F.date_format(F.current_date(), "yyyy-MM-dd") if date is None else F.lit(date)
    r = items.select(
        "page_no",
        "pos",
        "title",
        source.alias("s"),
        T.split_list(value_of("ps", "作者")).alias("authors"),
        T.parse_funding(funding).alias("funding"),
        T.abstract(line_with("lines", "摘要", "摘 要")).alias("abstract"),
        T.split_list(value_of("ps", "关键词", "關鍵詞", "关键字"), r"|｜").alias("keywords"),
        F.struct(day.alias("date"), impact["download"].alias("download"), impact["read"].alias("read")).alias("impact"),
    )
    return r.select("page_no", "pos", F.concat_ws("||", "title", "s.journal", "s.year", "s.startpage").alias("key"), "title", "s.journal", "s.year", "s.issue", F.struct("s.startpage", "s.endpage").alias("page"), "authors", "funding", "abstract", "keywords", "impact")


def first_of_key(rows: DataFrame, key: str = "key", *order: str) -> DataFrame:
    """One row for each key, the first in the order."""
    by, n = Window.partitionBy(key).orderBy(*(order or ("page_no", "pos"))), unused(rows, "_n")
    return rows.withColumn(n, F.row_number().over(by)).where(F.col(n) == 1).drop(n)


def extract_articles(pages: DataFrame, max_pages: int = 100, date: str | None = None) -> DataFrame:
    """The distinct articles of the first `max_pages` pages (not positive: 100)."""
    limit = max_pages if max_pages and max_pages > 0 else 100
    return first_of_key(article_records(page_items(pages.where(F.col("page_no") <= limit)), date))


def result_rows(html: str, list_id: str = "DataList", per_page: int = 5) -> list[tuple[int, str, str]]:
    """(pos, source, content) of the first rows of a result table; a row without both parts is left out, and no other moves into its place."""
    out = []
    for table in parse_html(html).walk():
        if table.attrs.get("id") == list_id:
            body = next((n for n in table.elements() if n.tag == "tbody"), table)
            for i, row in enumerate(body.elements()[:per_page]):
                parts = [n for cell in row.elements() if row.tag == "tr" and cell.tag == "td" for box in cell.elements() if box.tag == "div" for n in box.elements() if n.tag == "div"]
                both = [next((_clean(n.text()) for n in parts if c in n.attrs.get("class", "").split()), None) for c in ("derivation", "summary")]
                if None not in both:
                    out.append((i, *both))
            break
    return out


def snippets(pages: DataFrame, per_page: int = 5) -> DataFrame:
    """(page_no, pos, source, content): the first rows of each result page, from the elements of class derivation and summary in one row."""
    return _by_page(pages, lambda html: result_rows(html, per_page=per_page), "pos int, source string, content string", {"pos": pa.int32(), "source": pa.string(), "content": pa.string()})


def has_next(html: str, pager_id: str = "layui-laypage-0", cls: str = "layui-laypage-next", disabled: str = "layui-disabled", label: str = "下一页") -> bool:
    """Whether a list page has a button to the next page that isn't disabled."""
    for pager in parse_html(html).walk():
        if pager.attrs.get("id") == pager_id:
            button = next((n for n in pager.walk() if n.tag == "a" and cls in n.attrs.get("class", "").split()), None)
            return button is not None and disabled not in button.attrs.get("class", "").split() and label in _clean(button.text())
    return False


def next_pages(pages: DataFrame) -> DataFrame:
    """(page_no, more): whether a further page follows each saved one."""
    return _by_page(pages, lambda html: [(has_next(html),)], "more boolean", {"more": pa.bool_()})


def element_texts(html: Column | str, tag: str) -> Column:
    """The texts of all elements of a tag that holds none of its kind, without inner tags; built-in expressions only."""
    return F.transform(F.regexp_extract_all(html, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), 1), lambda t: T.collapse(F.regexp_replace(t, r"<[^>]*>", "")))
