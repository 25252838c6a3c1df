"""Text, regular-expression and numeral expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
#: A word is two or more letters, digits or underscores.
WORD = r"[\p{L}\p{N}_]{2,}"
NUMERALS = {"零": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
#: Traditional to simplified characters that the default map knows; a larger map is a parameter.
SIMPLIFIED = dict(zip("憲國會議黨參與權選舉員長體學問題關東書報時間歷經濟萬從來對為這個們說話點條動發現", "宪国会议党参与权选举员长体学问题关东书报时间历经济万从来对为这个们说话点条动发现"))


def trim(c: Column | str) -> Column:
    """Without Unicode white space at either end (the built-in trim only knows the space)."""
    return F.regexp_replace(c, _EDGE, "")


def collapse(c: Column | str) -> Column:
    """Runs of Unicode white space as one space, none at the ends."""
    return trim(F.regexp_replace(c, r"(?U)[\s\x{feff}]+", " "))


def extract(c: Column | str, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null where there is none; `.` stops at a line feed only."""
    # one pass: no match gives an empty array, and that has no first element
    return F.get(F.regexp_extract_all(c, F.lit("(?d)" + pattern), group), F.lit(0))


def found(c: Column | str, pattern: str, group: int = 1) -> Column:
    """The same with an empty string where there is no match."""
    return F.coalesce(F.regexp_extract(c, "(?d)" + pattern, group), F.lit(""))


def words(c: Column | str) -> Column:
    """Lower-cased words of at least two characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), 1)


def word_text(c: Column | str) -> Column:
    r"""Lower-cased text in which Python's \w{2,} finds the same words; Python may know characters that the JVM doesn't."""
    return F.regexp_replace(F.lower(c), r"\p{Cn}", " ")


def xml_escape(c: Column | str) -> Column:
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def chinese_number(c: Column | str) -> Column:
    """Numerals from 0 to 99 as digits. The first run of digits wins; a text that is no numeral stays as it is; null stays
    null, and so does a malformed numeral with ten (一二十)."""
    s = trim(c)
    digit = F.create_map(*[F.lit(x) for k, v in NUMERALS.items() for x in (k, v)])
    parts = F.split(s, "十")
    tens = F.when(parts[0] == "", 1).otherwise(F.try_element_at(digit, parts[0]))
    ones = F.when(parts[1] == "", 0).otherwise(F.try_element_at(digit, parts[1]))
    return (
        F.when(s.rlike(r"[0-9]"), F.regexp_extract(s, r"([0-9]+)", 1))
        .when(s.contains("十"), (tens * 10 + ones).cast("string"))
        .otherwise(F.coalesce(F.try_element_at(digit, s).cast("string"), s))
    )


def simplify(c: Column | str, characters: dict[str, str] = SIMPLIFIED) -> Column:
    """Traditional characters as simplified ones, one by one."""
    return F.translate(c, "".join(characters), "".join(characters.values()))


def slug(c: Column | str) -> Column:
    """Letters, digits, _ and - only; "list" where none is left."""
    s = F.regexp_replace(c, r"[^\p{L}\p{N}_-]+", "")
    return F.when(s == "", "list").otherwise(s)


def normal_label(c: Column | str) -> Column:
    """A field label without white space and colons, in one spelling."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)[\s：:]", ""), "關鍵詞|关键字", "关键词")


def parse_source(c: Column | str) -> Column:
    """struct<journal, year, issue, startpage, endpage> of a source line; empty where missing."""
    pages = r"(\d+)\s*-\s*(\d+)"
    return F.struct(
        found(c, "《([^》]+)》").alias("journal"),
        found(c, r"(\d{4})年").alias("year"),
        F.coalesce(chinese_number(found(c, r"第\s*([0-9一二三四五六七八九十两]+)\s*期")), F.lit("")).alias("issue"),
        found(c, pages, 1).alias("startpage"),
        found(c, pages, 2).alias("endpage"),
    )


def parse_funding(c: Column | str) -> Column:
    """struct<acknowledgement, order, researchtitle, number> of a funding line; empty where missing."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.struct(
        trim(F.regexp_replace(c, r"^\s*基金项目[:：]\s*", "")).alias("acknowledgement"),
        trim(F.coalesce(F.nullif(found(c, "本文系(.+?项目)"), F.lit("")), found(c, "系(.+?项目)"))).alias("order"),
        found(c, "“([^”]+)”").alias("researchtitle"),
        found(c, r"[（(]([A-Za-z0-9\-]+)[)）]").alias("number"),
    )


def parse_impact(c: Column | str) -> Column:
    """struct<download, read>: the counters of an item, "0" where missing."""

    def first(*labels: str) -> Column:
        return F.coalesce(*(F.nullif(found(c, rf"{x}[:：]\s*(\d+)"), F.lit("")) for x in labels), F.lit("0"))

    return F.struct(first("下载次数", "下载量").alias("download"), first("在线阅读", "阅读量").alias("read"))


def abstract(c: Column | str) -> Column:
    return trim(F.regexp_replace(c, r"(?U)^\s*摘\s*要[:：]?\s*", ""))


def split_label(nodes: Column | str) -> Column:
    """struct<label, value> of the text nodes of a "label: value" line. The label ends with the first node that has a colon; what follows
    that node's last colon, and all later nodes, are the value. Label and value in one node give no usable label."""
    clean = F.filter(F.transform(nodes, collapse), lambda t: t != "")
    has = F.transform(clean, lambda t: t.rlike("[：:]"))
    at = F.array_position(has, True).cast("int")  # 0: none
    head = F.when(at > 0, F.slice(clean, F.lit(1), F.greatest(at, F.lit(1)))).otherwise(clean)
    after = trim(F.regexp_replace(F.element_at(clean, F.greatest(at, F.lit(1))), r"(?s)^.*[:：]", ""))
    rest = F.slice(clean, F.greatest(at, F.lit(1)) + 1, F.size(clean))
    value = F.when(at > 0, F.array_join(F.filter(F.concat(F.array(after), rest), lambda t: t != ""), " ")).otherwise("")
    return F.struct(normal_label(F.array_join(head, "")).alias("label"), F.coalesce(value, F.lit("")).alias("value"))


def split_list(c: Column | str, extra: str = "·") -> Column:
    """The parts of a list of names or keywords, trimmed, none of them empty."""
    return F.filter(F.transform(F.split(c, rf"(?U)[、，,；;{extra}\s]+"), trim), lambda x: x != "")
