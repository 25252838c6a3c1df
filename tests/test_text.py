import pytest
from pyspark.sql import functions as F

from lexichron.functions import text as T
from lexichron.functions.stats import cosine, normal_pdf, smooth_idf


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items()) or "x string"
    return spark.createDataFrame([tuple(values.values()) or (None,)], schema).select(column.alias("r")).first().r


@pytest.mark.parametrize(("raw", "number"), [("十", "10"), ("十二", "12"), ("二十", "20"), ("二十三", "23"), ("12", "12"), ("第12期", "12"), ("", ""), ("两", "2"), ("零", "0"), ("一二", "一二"), ("一二十", None), (None, None), (" 五 ", "5")])
def test_chinese_number(spark, raw, number):
    assert one(spark, T.chinese_number("c"), c=raw) == number


def test_trim_and_collapse(spark):
    assert one(spark, T.trim("c"), c="　 a　b \t\n") == "a　b"
    assert one(spark, T.collapse("c"), c="　a \n　b﻿") == "a b"


def test_words_drop_single_characters_and_split_inside(spark):
    assert one(spark, T.words("c"), c="AT&T x-ray a_b Ünï 国会 z 9") == ["at", "ray", "a_b", "ünï", "国会"]


def test_xml_escape_and_null(spark):
    assert one(spark, T.xml_escape("c"), c="<a & \"b\" 'c'>") == "&lt;a &amp; &quot;b&quot; &apos;c&apos;&gt;"
    assert one(spark, T.xml_escape("c"), c=None) == ""


def test_source_line(spark):
    r = one(spark, T.parse_source("c"), c="出处： 《近代史研究》 1998年 第十二期 12 - 34")
    assert tuple(r) == ("近代史研究", "1998", "12", "12", "34")
    assert tuple(one(spark, T.parse_source("c"), c="nothing")) == ("", "", "", "", "")


def test_funding(spark):
    r = one(spark, T.parse_funding("c"), c="基金项目：本文系国家社科基金项目“宪政史”（15BZS001）")
    assert tuple(r) == ("本文系国家社科基金项目“宪政史”（15BZS001）", "国家社科基金项目", "宪政史", "15BZS001")
    assert tuple(one(spark, T.parse_funding("c"), c=None)) == ("", "", "", "")


def test_impact_defaults(spark):
    assert tuple(one(spark, T.parse_impact("c"), c="下载量: 7 阅读量：9")) == ("7", "9")
    assert tuple(one(spark, T.parse_impact("c"), c="x")) == ("0", "0")


@pytest.mark.parametrize(("nodes", "label", "value"), [(["作　　者：", "张三、李四"], "作者", "张三、李四"), (["作者：张三"], "作者张三", "张三"), (["關 鍵 詞", "：", " a ", "b"], "关键词", "a b"), (["no colon"], "nocolon", ""), ([], "", ""), (["x: y: z", "w"], "xyz", "z w")])
def test_split_label(spark, nodes, label, value):
    assert tuple(one(spark, T.split_label("c"), c=nodes)) == (label, value)


def test_split_list(spark):
    assert one(spark, T.split_list("c"), c="张三、李四，王五;赵六·钱七　孙八") == ["张三", "李四", "王五", "赵六", "钱七", "孙八"]
    assert one(spark, T.split_list("c", "|｜"), c="a|b｜c") == ["a", "b", "c"]


def test_slug_and_simplify(spark):
    assert one(spark, T.slug("c"), c="a b!_-国") == "ab_-国"
    assert one(spark, T.slug("c"), c="!!") == "list"
    assert one(spark, T.simplify("c"), c="國會x") == "国会x"


def test_statistics(spark):
    assert one(spark, smooth_idf(F.col("n"), F.col("d")), n=3.0, d=3.0) == 1.0
    assert one(spark, normal_pdf(F.col("x"), F.col("m"), F.col("s")), x=0.0, m=0.0, s=1.0) == pytest.approx(0.3989422804)
    assert one(spark, normal_pdf(F.col("x"), F.col("m"), F.col("s")), x=0.0, m=0.0, s=0.0) is None
    assert one(spark, cosine(F.col("x"), F.col("m"), F.col("s")), x=0.0, m=0.0, s=0.0) == 0.0
