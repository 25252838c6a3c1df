import warnings

import pytest

from lexichron.functions import text as T
from lexichron.operators import kwic, tokens
from lexichron.operators.tokens import Tokenizer, combine, explode_tokens, retokenized, without_stop_words
from lexichron.plans import progress
from lexichron.sources import readers, sinks

LINES = [
    "<B>申报 1912</B>国会<U>参政</U>之权",
    "<B>大公报　1913</B>　甲<U>宪法</U>乙<U>议会</U>丙　",
    "no markup",
    "<B>x 12</B><U>k</U>",
    "a\rb<U>k</U>c\nd<U>e</U>",
    None,
]


@pytest.fixture
def parsed(spark):
    df = spark.createDataFrame(list(enumerate(LINES)), "n int, content string")
    return kwic.parse_kwic(df, keep=("n",))


def test_parse_kwic(parsed):
    r = {x.n: x.asDict() for x in parsed.collect()}
    assert (r[0]["source"], r[0]["year"], r[0]["text"], r[0]["L-context"], r[0]["keyword"], r[0]["R-context"]) == ("申报", "1912", "国会参政之权", "国会", "参政", "之权")
    # several hits: left to the last, first keyword, right from the first
    assert (r[1]["source"], r[1]["year"], r[1]["L-context"], r[1]["keyword"], r[1]["R-context"]) == ("大公报", "1913", "甲<U>宪法</U>乙", "宪法", "乙<U>议会</U>丙")
    assert r[2]["source"] is r[2]["keyword"] is r[2]["L-context"] is None and r[2]["text"] == "no markup"
    assert r[3]["year"] is None and r[3]["keyword"] == "k" and r[3]["L-context"] == ""
    assert r[4]["L-context"] == "a\rb" and r[4]["R-context"] == "c"
    assert r[5]["text"] is None


def test_documents_and_selection(parsed):
    docs = {x.n: x.document for x in kwic.assemble(parsed).collect()}
    assert docs[0] == "国会参政之权" and docs[2] == ""
    assert [x.n for x in kwic.select_keyword(parsed, "参政").collect()] == [0]
    assert [x.n for x in kwic.select_years(parsed, "1912", "1912").collect()] == [0]
    assert {x.keyword for x in kwic.distinct_keywords(parsed).collect()} == {"参政", "宪法", "k"}
    assert [x.year for x in kwic.sorted_years(parsed).collect()] == ["1912", "1913"]


def test_xml_round_trip(spark, parsed, tmp_path):
    ids = kwic.entry_ids(parsed, "n")
    sinks.write_corpus_xml(ids, f"file://{tmp_path}/x")
    back = {x.id: x for x in kwic.flatten_entries(readers.read_corpus_xml(spark, f"file://{tmp_path}/x")).collect()}
    assert back["1912_1"].keyword == "参政" and back["1912_1"]["L-context"] == "国会"
    assert back["_3"].source == "" and len(back) == 6


def test_concordance_and_terms(spark, tmp_path):
    (tmp_path / "bcc_corpus_k_1912.txt").write_bytes("﻿l1\nl2\n\n".encode())
    (tmp_path / "bcc_corpus_k_1914.txt").write_bytes(b"l3")
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        df = readers.read_concordance(spark, str(tmp_path), "k", 1912, 1914)
    assert any("1913" in str(x.message) for x in w)
    assert sorted(r.content for r in df.collect()) == ["l1", "l2", "l3"]
    (tmp_path / "stop.txt").write_text("﻿a\n\n a \nb\n")
    assert sorted(r.term for r in readers.read_terms(spark, str(tmp_path / "stop.txt")).collect()) == ["a", "b"]
    assert readers.read_terms(spark, str(tmp_path / "none.txt")).count() == 0
    with pytest.raises(readers.MissingInput):
        readers.read_terms(spark, str(tmp_path / "none.txt"), needed=True)
    with pytest.raises(readers.MissingInput):
        readers.read_free_xml(spark, str(tmp_path / "none.xml"))


def test_single_csv_with_mark(spark, tmp_path):
    at = sinks.write_single(spark.createDataFrame([('a "q", b', 1)], "t string, n int"), f"file://{tmp_path}/o.csv")
    data = (tmp_path / "o.csv").read_bytes()
    assert data == b'\xef\xbb\xbft,n\n"a ""q"", b",1\n' and at.endswith("o.csv")
    assert readers.read_csv(spark, f"file://{tmp_path}/o.csv", "t string, n int").first().t == 'a "q", b'


def test_names():
    assert readers.derived_names("d/bcc_corpusraw_k.csv") == ("d/bcc_corpusdata_k.csv", "d/bcc_corpusdata_k.xml")
    assert sinks.result_name("all", "k") == "bcc_k_tfidf_norml1.csv"


def test_free_xml(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<r><entry><author>A</author><content> c d </content></entry><entry><author/><content/></entry><entry><content>e</content></entry></r>")
    docs = kwic.free_documents(readers.read_free_xml(spark, str(tmp_path / "f.xml")))
    assert sorted(r.document for r in docs.collect()) == [" e", "A c d"]


def test_dictionary_tokenizer(spark):
    df = spark.createDataFrame([(1, "我国参政权abc的宪法"), (2, None), (3, "")], "id int, t string")
    force = Tokenizer(force=frozenset({"参政权", "参政"}), combined=frozenset({"宪法"}), shortest=2)
    got = {r.id: r.t for r in df.select("id", force.tokens("t").alias("t")).collect()}
    assert got == {1: ["参政权", "abc", "宪法"], 2: [], 3: []}
    plug = Tokenizer(load=lambda: lambda s: s.split("国"), shortest=1, stop=frozenset({"我"}))
    assert df.where("id = 1").select(plug.tokens("t").alias("t")).first().t == ["参政权abc的宪法"]
    assert combine(["a", "b", "c", "d"], frozenset({"abc", "cd"}), 3) == ["abc", "d"]


def test_stop_words_and_retokenizing(spark):
    df = spark.createDataFrame([(1, "The cat at the mat")], "id int, t string")
    t = explode_tokens(df, "t", Tokenizer(stop=frozenset({"the"})), ("id",))
    assert sorted(r.term for r in without_stop_words(t, spark.createDataFrame([("at",)], "term string")).collect()) == ["cat", "mat"]
    a = spark.createDataFrame([(["AT&T", "x-ray", "a"],)], "t array<string>")
    assert a.select(retokenized("t").alias("t")).first().t == ["at", "ray"]


def test_character_table(spark, tmp_path):
    (tmp_path / "t2s.txt").write_text("\ufeff國 国\n會\t会 more\n\nlong line\n臺\n憲　宪\n國 X\n")
    table = readers.read_characters(spark, str(tmp_path / "t2s.txt"))
    assert table == {"國": "X", "會": "会", "憲": "宪"}
    df = spark.createDataFrame([("國會憲x",)], "t string")
    assert df.select(T.simplify("t", table | {"國": "国"}).alias("t")).first().t == "国会宪x"


def test_tokenizer_from_files(spark, tmp_path, monkeypatch):
    (tmp_path / "stop.txt").write_text("a1\nb1\n")
    stop = str(tmp_path / "stop.txt")
    assert Tokenizer.from_files(spark, stop, str(tmp_path / "none.txt")).stop == {"a1", "b1"}
    assert Tokenizer.from_files(spark, stop, use_stopwords=False) == Tokenizer()
    monkeypatch.setattr(tokens, "MOST_TERMS", 1)
    with pytest.raises(ValueError):
        Tokenizer.from_files(spark, stop)


def test_a_file_for_each_group(spark, tmp_path):
    df = spark.createDataFrame([("x/y =1", 2, "b"), ("x/y =1", 1, "a"), ("é", 1, 'c "q"'), (None, 1, "d")], "g string, rank int, term string")
    names = {"x/y =1": "one.csv", "é": "two.csv"}
    out = sinks.write_groups(df, f"file://{tmp_path}/o", "g", names.get, order=("rank",))
    assert out == [f"file://{tmp_path}/o/one.csv", f"file://{tmp_path}/o/two.csv"] and sorted(x.name for x in (tmp_path / "o").iterdir() if not x.name.endswith(".crc")) == ["one.csv", "two.csv"]
    assert (tmp_path / "o" / "one.csv").read_bytes() == b"\xef\xbb\xbfrank,term\n1,a\n2,b\n"
    assert (tmp_path / "o" / "two.csv").read_bytes() == b'\xef\xbb\xbfrank,term\n1,"c ""q"""\n'
    assert sinks.write_groups(df.limit(0), f"file://{tmp_path}/e", "g", names.get) == []
    assert sinks.similarity_name("count", "k", "1900", "1910", True) == "bcc_1900-1910_k_similarity_count_std.csv"
    assert sinks.topic_names("k", "all") == ("k_topic_terms_matrix.txt", "k_text_topic_matrix.csv") and sinks.topic_names("k", "1900")[1] == "k_text_topic_matrix_1900.csv"


def test_long_concordances_are_read_in_splits(spark, tmp_path):
    lines = [f"line {i} {'x' * (i % 50)}" if i % 7 else "" for i in range(3000)]
    (tmp_path / "own_k_1900.txt").write_text("\n".join(lines))
    (tmp_path / "own_k_1901.txt").write_text("\ufeffother\r\n \r\nlast\r\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = readers.read_concordance(spark, f"file://{tmp_path}", "k", 1900, 1901, prefix="own").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    by = {y: {r.line: r.content for r in got if r.file.endswith(f"{y}.txt")} for y in (1900, 1901)}
    assert by[1900] == {i: x for i, x in enumerate(lines) if x} and by[1901] == {0: "other", 2: "last"}


def test_progress(caplog):
    times = {}
    with caplog.at_level("INFO", "lexichron"), pytest.raises(KeyError), progress.timed("a step", times):
        raise KeyError
    progress.empty("k in 1900")
    assert times["a step"] >= 0 and "a step took" in caplog.text and "no data for k in 1900" in caplog.text


def test_helper_columns_do_not_clash(spark):
    df = spark.createDataFrame([("<B>s 1900</B>a <U>k</U> b", 1, 2, 3)], "content string, _body int, _n int, _k int")
    assert kwic.entry_ids(kwic.parse_kwic(df, keep=("_body", "_n")), "_n").first().asDict().items() >= {"_body": 1, "_n": 2, "id": "1900_1", "L-context": "a "}.items()
