import pyarrow as pa
from pyspark.sql import functions as F

from lexichron.operators import pages, similarity, tokens
from lexichron.operators.tokens import Tokenizer
from lexichron.sources import readers, sinks


def test_pages_are_parsed_a_few_at_a_time():
    html = "<ul id=ul_articlelist><li>a</li><li>b</li></ul>"
    batch = pa.record_batch([pa.array(range(3 * pages.PAGES + 1)), pa.array([html, "", None] * pages.PAGES + [html])], names=["page_no", "html"])
    got = list(pages.pieces(batch, lambda h: [(p,) for p, *_ in pages.list_items(h)], {"pos": pa.int32()}))
    assert max(b.num_rows for b in got) <= 2 * pages.PAGES and len(got) == 4
    assert pa.Table.from_batches(got).column("page_no").to_pylist() == [i for i in range(3 * pages.PAGES + 1) if i % 3 == 0 for _ in range(2)]


def test_tokens_leave_python_a_few_texts_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(tokens, "TEXTS", 7)
    d = spark.range(100).select("id", F.concat(F.lit("aa b"), F.col("id"), F.lit(" cc")).alias("t"))
    split = Tokenizer(load=lambda: lambda s: s.split(" "))
    assert {r.id: r.x for r in d.select("id", split.tokens("t").alias("x")).collect()} == {i: ["aa", f"b{i}", "cc"] for i in range(100)}


def test_csv_parts_are_small(spark, tmp_path):
    d = spark.range(0, 2 * sinks.CSV_ROWS + 1, 1, 1).select(F.col("id").cast("string").alias("a"), F.lit("x\ny").alias("b"))
    sinks.write_csv(d, f"file://{tmp_path}/c")
    assert len([x for x in (tmp_path / "c").iterdir() if x.name.endswith(".csv")]) == 3
    back = readers.read_csv(spark, f"file://{tmp_path}/c", "a string, b string")
    assert back.count() == d.count() and back.exceptAll(d).count() == 0


def test_only_drawn_texts_are_fetched(spark):
    d = spark.range(50).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 7, "a").when(F.col("id") < 40, "b").alias("year"), F.repeat(F.lit("x"), 5).alias("t"))
    a, b = (x.select("rep", "year", "doc_id", "t") for x in (similarity.sample_texts(d, 5, 3), similarity.sample_groups(d, 5, 3)))
    assert a.count() == 45 and a.exceptAll(b).count() == 0
