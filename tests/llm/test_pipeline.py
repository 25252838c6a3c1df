import os
import random
import subprocess
import sys
import uuid

import pytest

import corpus_pipeline
from lexichron.llm.common import shared_dir

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SYLLABLES = "the and ing tion er on re at en nd ha es or ti ou le ver st".split()


def text(rng, n, *extra):
    w = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, 4))) for _ in range(n)]
    for x in extra:
        w.insert(rng.randrange(n), x)
    return " ".join(w)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(300):
        bad = i % 2 == 0
        rows.append((i, text(rng, 80, *(rng.sample(["idiot", "moron", "worthless"], 2) if bad else ())), "en", "s"))
        labels.append((i, 1, int(bad)))
    bench = [(0, text(rng, 30)), (1, text(rng, 20))]
    rows[1] = (1, rows[1][1] + " " + bench[0][1], "en", "s")
    rows[5] = (5, rows[5][1] + ' token = "' + "0f" * 20 + '"', "en", "s")
    rows += [(300, rows[3][1], "en", "s"), (301, rows[7][1].replace(" ", "  ", 5) + " tion", "en", "s"), (302, None, None, None), (303, "", "en", "s"), (304, text(rng, 30000), "en", "s"), (305, "the m0r0n and i d i o t eron tion", "en", "s")]
    docs = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return f"{at}", docs


def test_stages_decide_as_they_should(spark, tables):
    at, docs = tables
    toxic = {i for i in range(0, 300, 2)} | {305}
    expected = [set(range(306)) - toxic]
    expected.append(expected[0] - {300, 301})
    expected.append(expected[1] - {1})
    expected.append(expected[2])
    work = f"{shared_dir(spark)}/stages-{uuid.uuid4().hex}"
    current = docs
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, current, at)
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{work}/{k}")
        current = spark.read.parquet(f"{work}/{k}")
        if k < 4:
            assert {r.doc_id for r in current.select("doc_id").collect()} == expected[k], name
        if k == 3:
            r = current.where("doc_id = 5").first()
            assert "[SECRET:assignment]" in r.text and r.n_chars == len(r.text)
    assert {r.doc_id for r in current.collect()} == expected[3] - {302, 303}
    assert sorted(map(tuple, corpus_pipeline.run(spark, at).collect())) == sorted(map(tuple, current.collect()))


def test_stages_on_awkward_tables(spark, tables, tmp_path):
    """Nulls in every column, empty, very long and repeated texts, clashing columns, a table without rows."""
    at, docs = tables
    long = docs.where("doc_id = 304").first().text
    rows = [(None, None, None, None, None), (1000, None, "en", "s", 1), (1001, "", None, "s", None), (1002, "  ", "en", None, 2), (None, "a text without a number", "en", "s", 3), (1003, "the same row", "en", "s", 4), (1003, "the same row", "en", "s", 4), (1004, long + " eron", "en", "s", 5), (1005, "x", "en", "s", 1)]
    odd = spark.createDataFrame(rows, docs.schema)
    clash = "h0 score rule k rep group n slot length toxic item_id bin_id".split()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd.selectExpr("*", *(f"'x' as `{c}`" for c in clash)), at)
        assert out.columns == docs.columns + clash, name
        assert sorted(map(str, out.select(*docs.columns).collect())) == sorted(map(str, odd.collect())), name
        assert stage(spark, docs.limit(0), at).collect() == [], name
    laid = corpus_pipeline.STAGES[-1][1](spark, odd, at)
    count = {}
    for r in laid.where("piece = 0").collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert count == {1002: 1, None: 1, 1003: 2, 1004: 1, 1005: 1}
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), at).collect() == []
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{at}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}").collect() == []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, f"{tmp_path}").count() == len(rows), name


def test_the_rest_works_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "lexichron"):
        subprocess.run(["cp", "-r", f"{ROOT}/{name}", str(tmp_path)], check=True)
    subprocess.run(["rm", "-r", f"{tmp_path}/lexichron/llm"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 30 and not any(k.startswith('op') for k in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
