from math import log, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexichron.operators import pages, similarity, topics, weights
from lexichron.plans import registry
from lexichron.sources import readers, sinks
from lexichron.sources.places import with_places
from lexichron.streaming.ingest import ingest

DOCS = [(1, "x", "aa bb aa"), (2, "x", "aa cc"), (3, "y", "bb bb dd"), (4, "y", "")]


@pytest.fixture
def tokens(spark):
    d = spark.createDataFrame(DOCS, "doc_id int, year string, t string")
    return d.select("doc_id", "year", F.explode(F.filter(F.split("t", " "), lambda x: x != "")).alias("term"))


@pytest.mark.parametrize("norm", ["l1", "l2"])
def test_tfidf_by_hand(tokens, norm):
    got = {(r.year, r.term): r for r in weights.tfidf(tokens, "year", "doc_id", norm).collect()}
    for g, docs in {"x": DOCS[:2], "y": DOCS[2:3], "all": DOCS[:3]}.items():
        bags = [t.split() for _, _, t in docs]
        terms = sorted({w for b in bags for w in b})
        idf = {w: log((1 + len(bags)) / (1 + sum(w in b for b in bags))) + 1 for w in terms}
        score = dict.fromkeys(terms, 0.0)
        for b in bags:
            v = {w: b.count(w) * idf[w] for w in set(b)}
            size = sum(v.values()) if norm == "l1" else sqrt(sum(x * x for x in v.values()))
            for w, x in v.items():
                score[w] += x / size
        s = {w: round(x, 9) for w, x in score.items()}
        for rank, w in enumerate(sorted(terms, key=lambda w: (-s[w], w)), 1):
            r = got[g, w]
            assert r.rank == rank and r["tf-idf"] == pytest.approx(s[w], abs=1e-9) and r.idf == pytest.approx(idf[w], abs=1e-9)
            assert r.docf == sum(w in b for b in bags) and r["count"] == sum(b.count(w) for b in bags)
        if norm == "l1":
            assert sum(score.values()) == pytest.approx(len(bags))
    assert len(got) == 3 + 2 + 4


def test_single_term_has_no_density(spark):
    t = spark.createDataFrame([(1, "g", "aa")], "doc_id int, year string, term string")
    assert weights.tfidf(t, "year", "doc_id", all_group=False).first().normdis is None


def test_sampling_is_exact_clamped_and_repeatable(spark):
    d = spark.range(50).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 7, "a").otherwise("b").alias("year"))
    s = similarity.sample_groups(d, 10, 3)
    assert {(r.rep, r.year): r["count"] for r in s.groupBy("rep", "year").count().collect()} == {(i, g): 7 for i in range(3) for g in "ab"}
    assert sorted(s.collect()) == sorted(similarity.sample_groups(d.repartition(5), 10, 3).collect())
    assert similarity.sample_groups(d.limit(0), 10, 3).count() == 0


@pytest.mark.parametrize("method", ["count", "docfreq", "tfidf"])
def test_similarity(spark, method):
    rows = [(i, y, t) for i, (y, t) in enumerate([("a", ["p", "q", "p"]), ("a", ["q"]), ("b", ["p", "r"]), ("b", ["r"]), ("c", ["z"]), ("c", [])])]
    d = spark.createDataFrame(rows, "doc_id int, year string, tokens array<string>")
    m = similarity.year_similarity(d, "tokens", method, 2, 2)
    out = {(r.year_a, r.year_b): (r.mean, r.std) for r in similarity.over_replicates(m).collect()}
    vec = {}
    terms = "pqrz"
    for y in "abc":
        docs = [t for _, g, t in rows if g == y]
        if method == "docfreq":
            vec[y] = np.array([sum(w in t for t in docs) / len(docs) for w in terms])
        else:
            vec[y] = np.array([float(sum(t.count(w) for t in docs)) for w in terms])
    if method == "tfidf":
        idf = np.array([log(4 / (1 + sum(vec[y][i] > 0 for y in "abc"))) + 1 for i in range(4)])
        vec = {y: v * idf for y, v in vec.items()}
    for a in "abc":
        for b in "abc":
            expected = vec[a] @ vec[b] / np.linalg.norm(vec[a]) / np.linalg.norm(vec[b])
            # n is the size of every group: no variance between replicates
            assert out[a, b] == (pytest.approx(expected, abs=1e-8), 0.0)
    wide = similarity.wide(similarity.over_replicates(m), ["a", "b", "c"])
    assert wide.columns == ["year", "a", "b", "c"] and wide.count() == 3


def test_topics(spark):
    rows = [(i, "a" if i % 2 else "b", ["sun", "sea", "sand"] if i % 2 else ["tax", "vote", "law"]) for i in range(20)] + [(20, "a", [])]
    d = spark.createDataFrame(rows, "doc_id int, year string, tokens array<string>")
    m = topics.fit_topics(d, k=2, passes=5, seed=1)
    p = {r.doc_id: r.topics for r in m.documents(d).collect()}
    assert all(sum(x) == pytest.approx(1) for x in p.values()) and p[20] == [0.5, 0.5]
    assert m.terms(3).count() == 6
    assert sinks.topic_lines(m.terms(3)).first().value.startswith("Topic 0: ")
    assert topics.topic_columns(m.documents(d), 2).columns[-2:] == ["topic 0", "topic 1"]
    s = topics.topic_similarity(similarity.sample_groups(d, 5, 2), k=2, passes=3)
    assert {round(r.sim, 6) for r in s.where("year_a = year_b").collect()} == {1.0}
    none = topics.fit_topics(d.where("doc_id = 20"), k=4)
    assert none.terms().collect() == [] and none.documents(d).first().topics == [0.25] * 4
    kw = d.select("doc_id", "year", "tokens").withColumn("keyword", F.lit("k 1/x")).unionAll(d.limit(2).selectExpr("doc_id", "cast(null as string)", "tokens", "'j'")).unionAll(d.limit(1).selectExpr("doc_id", "year", "tokens", "null"))
    got = [(k, y, own.count(), m.terms().count()) for k, y, own, m in topics.by_keyword(kw, k=2, passes=1)]
    assert got == [("j", "all", 2, 12), ("k 1/x", "all", 21, 12), ("k 1/x", "a", 11, 6), ("k 1/x", "b", 10, 6)]
    t = topics.topic_table(d, topics.fit_topics(d, k=2, passes=5, seed=1), "doc_id", columns=("year",))
    rows = sorted(t.collect())
    assert t.columns == ["no.", "year", "topic 0", "topic 1"] and [r["no."] for r in rows] == list(range(21)) and rows[20]["topic 0"] == "0.5000"


def test_topics_without_documents(spark):
    d = spark.createDataFrame([], "rep long, year string, tokens array<string>")
    m = topics.fit_topics(d, k=3)
    assert m.terms().collect() == m.documents(d).collect() == topics.topic_similarity(d).collect() == []
    only_null = spark.createDataFrame([(0, "a", [None])], d.schema)
    assert topics.fit_topics(only_null, k=3).documents(only_null).first().topics == pytest.approx([1 / 3] * 3)


@pytest.mark.parametrize("n", [0, 1, 500])
def test_places(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(g) if g < 4 else None, int(x), i) for i, (g, x) in enumerate(zip(rng.choice(5, n, p=[0.6, 0.1, 0.1, 0.1, 0.1]), rng.integers(0, 50, n)))]
    d = spark.createDataFrame(rows, "g int, x int, _at int")
    got = {r["_at"]: r for r in with_places(d, "place", F.desc("x"), "_at", group="g", moments="x").collect()}
    assert len(got) == n
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]].place for r in own] == list(range(1, len(own) + 1))
        assert got[own[0][2]].mu == pytest.approx(np.mean([r[1] for r in own])) and got[own[0][2]].sd == pytest.approx(np.std([r[1] for r in own]))
    assert [r.place for r in sorted(with_places(d, "place", "x", "_at").collect(), key=lambda r: (r.x, r["_at"]))] == list(range(1, n + 1))


def test_topics_keep_every_term(spark):
    # more terms than would fit a customary limit, each of them once
    d = spark.range(0, 270, 1, 4).select(F.transform(F.sequence(F.col("id") * 1000, F.col("id") * 1000 + 999), lambda i: i.cast("string")).alias("tokens"))
    m = topics.fit_topics(d, k=2, passes=1)
    assert m.weights.shape == (270_000, 2) and m.vocabulary.select("term").distinct().count() == 270_000
    assert topics.fit_topics(d.limit(1), k=2, passes=1, vocabulary=10).weights.shape == (10, 2)


def test_inference_equals_a_plain_version():
    rng = np.random.default_rng(2)
    k, size = 4, np.array([3, 0, 5, 1])
    beta, counts = rng.random((9, k)), rng.integers(1, 5, 9).astype(float)
    gamma, add = topics.infer(np.arange(9), counts, size, beta, 0.25)
    at = 0
    for d, m in enumerate(size):
        g = np.ones(k)
        b, c = beta[at : at + m], counts[at : at + m]
        for _ in range(topics.ROUNDS if m else 0):
            e = np.exp(topics.digamma(g) - topics.digamma(g.sum()))
            new = 0.25 + e * ((c / (b @ e))[:, None] * b).sum(0)
            stop, g = np.abs(new - g).mean() < 1e-9, new
            if stop:
                break
        assert gamma[d] == pytest.approx(g, abs=0.02)
        if m:
            e = np.exp(topics.digamma(gamma[d]) - topics.digamma(gamma[d].sum()))
            assert add[at : at + m] == pytest.approx(e[None] * (c / (b @ e))[:, None])
        at += m
    assert topics.digamma(np.array([1.0, 0.5, 10.0])) == pytest.approx([-0.5772156649, -1.9635100260, 2.2517525890])


def test_topics_find_what_is_there(spark, monkeypatch):
    monkeypatch.setattr(topics, "CHUNK", 50)
    rng = np.random.default_rng(3)
    groups = [[f"{g}{i}" for i in range(30)] for g in "abc"]
    rows = [(i, [str(w) for w in rng.choice(groups[i % 3], 40)]) for i in range(300)]
    d = spark.createDataFrame(rows, "id int, tokens array<string>")
    for few in (32, 0):  # sums added by the driver, or by term first
        monkeypatch.setattr(topics, "FEW_TASKS", few)
        m = topics.fit_topics(d, k=3, passes=5)
        lead = {}
        for r in m.terms(10).collect():
            lead.setdefault(r.topic, set()).add(r.term[0])
        assert sorted(map(len, lead.values())) == [1, 1, 1] and len(set().union(*lead.values())) == 3
        got = m.documents(d).collect()
        assert all(max(r.topics) > 0.9 and "abc"[r.id % 3] in lead[int(np.argmax(r.topics))] for r in got)


def test_topic_queries_fit_as_the_reference_does(spark, monkeypatch):
    seen = []

    def fit(docs, tokens="tokens", k=15, passes=20, seed=42, vocabulary=None):
        seen.append((k, passes, vocabulary))
        return fitted(docs, tokens, k, 1, seed, vocabulary)

    fitted = topics.fit_topics
    monkeypatch.setattr(topics, "fit_topics", fit)
    monkeypatch.setattr(registry, "_tokens_of", lambda *_: spark.createDataFrame([(i, "ab"[i % 2], ["sun", "sea", f"w{i}"]) for i in range(30)], "doc_id long, source string, tokens array<string>"))
    for name in ("lda_doc_topics", "lda_topic_terms", "sim_lda"):
        registry.QUERIES[name](spark, "")
    assert seen == [(7, 20, None), (15, 20, None)] + [(10, 15, None)] * registry.REPLICATES


PAGE = """<ul id="ul_articlelist">
<li><div><a href="#">宪政 &amp; 民权</a><a>other</a></div>
<p><b>作　　者：</b>张三、李四</p><p>出处：《史学》 1998年 第十期 3-9</p><p><b>关键词：</b>宪政;民权</p>
<p>摘要：这是摘要</p><p>基金项目：本文系国家项目“甲”（A-1）</p><span>下载次数：5</span></li>
<li><div><a>{}</a></div><p>出处：《史学》 1999年 第二期 1-2</p></li></ul>"""


def test_articles(spark, tmp_path):
    p = spark.createDataFrame([(1, PAGE.format("b")), (2, PAGE.format("c")), (200, PAGE.format("late")), (3, None), (4, "<p>no list")], "page_no long, html string")
    rows = {r.title: r for r in pages.extract_articles(p, 100, "2024-01-01").collect()}
    assert set(rows) == {"宪政 & 民权", "b", "c"}
    r = rows["宪政 & 民权"]
    assert (r.page_no, r.journal, r.year, r.issue, tuple(r.page)) == (1, "史学", "1998", "10", ("3", "9"))
    assert r.authors == ["张三", "李四"] and r.keywords == ["宪政", "民权"] and r.abstract == "这是摘要"
    assert tuple(r.funding) == ("本文系国家项目“甲”（A-1）", "国家项目", "甲", "A-1") and tuple(r.impact) == ("2024-01-01", "5", "0")
    sinks.write_article_xml(pages.extract_articles(p, 100, "2024-01-01").drop("page_no", "pos", "key"), f"file://{tmp_path}/a")
    back = {x.title: x for x in readers.read_article_xml(spark, f"file://{tmp_path}/a").collect()}
    assert back["宪政 & 民权"].authors == ["张三", "李四"] and back["b"].authors == []


def test_snippets(spark):
    part = lambda c, t: f'<div class="{c}">{t}</div>'
    # the second row lacks its summary, the third its source; the seventh is beyond the first five
    cells = [part("derivation", f"s{i}") * (i != 2) + part("summary x", f"c {i}") * (i != 1) for i in range(7)]
    for row in ("<tr><td><div>{}</div></td></tr>", "<tr><td><div>{}</div>"):
        html = "<div class='derivation'>menu</div><table id='DataList'><tbody>" + "".join(map(row.format, cells)) + "</table>"
        got = pages.snippets(spark.createDataFrame([(1, html), (2, None), (3, "<table id='DataList'></table>")], "page_no long, html string")).collect()
        assert [(r.page_no, r.pos, r.source, r.content) for r in got] == [(1, i, f"s{i}", f"c {i}") for i in (0, 3, 4)]


@pytest.mark.parametrize(("button", "more"), [("<a class='layui-laypage-next'>下一页</a>", True), ("<a class='layui-laypage-next layui-disabled'>下一页</a>", False), ("<a class='layui-laypage-next'>next</a>", False), ("<a>下一页</a>", False), ("", False)])
def test_next_button(button, more):
    assert pages.has_next(f"<div id='layui-laypage-0'><a>1</a>{button}</div>") is more and not pages.has_next(button)


def test_stream_keeps_the_first_of_a_batch(spark, tmp_path):
    rows = [(k, v) for k in range(20) for v in range(30, 0, -1)] + [(None, 2), (None, 1)]
    spark.createDataFrame(rows, "k int, _n int").repartition(5).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        ingest(spark, f"{tmp_path}/in", "k int, _n int", f"{tmp_path}/out", f"{tmp_path}/state", key="k", order=("_n",), files_per_batch=2).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {r.k for r in got} == {None, *range(20)} and len(got) == 21


def test_stream_keeps_first_of_key_over_batches(spark, tmp_path):
    src = f"{tmp_path}/in"
    for i, rows in enumerate([[(1, "a"), (2, "b")], [(2, "again"), (3, "c")]]):
        spark.createDataFrame(rows, "k int, v string").coalesce(1).write.mode("append").parquet(src)
        ingest(spark, src, "k int, v string", f"{tmp_path}/out", f"{tmp_path}/state", key="k", files_per_batch=1).awaitTermination()
    assert sorted((r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, "a"), (2, "b"), (3, "c")]
