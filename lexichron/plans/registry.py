"""A query for each operator over whole tables, and the same in SQL where SQL has it.

The tables hold no concordances or journal lists, so some columns stand in: a document's source or 1900 + doc_id % 20 as its year, its
middle word as the keyword, lines in the shape of journal records built from its columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import kwic, pages, similarity, topics, weights
from ..operators.tokens import Tokenizer, explode_tokens, longest_match, retokenized, without_stop_words
from ..sources import readers, sinks
from ..sources.shared import cut, scratch, table
from ..streaming.ingest import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
STOP = ("the", "and", "of", "to", "der", "die", "und", "les", "des", "que")
SAMPLE, REPLICATES = 10, 2


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# Keyword in context


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.split("text", " ")
    m = F.floor(F.size(w) / 2).cast("int")
    d = table(spark, sf_dir, "documents").where("text is not null").withColumns({"w": w, "m": m})
    left, right = F.array_join(F.slice("w", F.lit(1), F.col("m")), " "), F.array_join(F.slice("w", F.col("m") + 2, F.size("w")), " ")
    content = F.concat(F.lit("<B>"), "source", F.lit(" "), (F.col("doc_id") % 20 + 1900).cast("string"), F.lit("</B>"), left, F.lit(" <U>"), F.get("w", F.col("m")), F.lit("</U> "), right)
    return d.select("doc_id", content.alias("content"))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kwic.parse_kwic(lines(spark, sf_dir), keep=("doc_id",))


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g')"


def _ext(x: str, p: str, g: int = 1) -> str:
    return f"CASE WHEN regexp_matches({x}, '{p}') THEN regexp_extract({x}, '{p}', {g}) END"


KWIC = rf"""
w0 AS (SELECT doc_id, source, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL),
l0 AS (SELECT doc_id, '<B>' || source || ' ' || CAST(1900 + doc_id % 20 AS VARCHAR) || '</B>' || array_to_string(w[1:len(w) // 2], ' ') || ' <U>' || w[len(w) // 2 + 1] || '</U> ' || array_to_string(w[len(w) // 2 + 2:], ' ') AS content FROM w0),
b0 AS (SELECT doc_id, content, {_trim(r"regexp_replace(content, '<B>.*?</B>', '', 'g')")} AS body FROM l0),
k AS (SELECT doc_id, {_ext("content", r"<B>(.*?)\s(\d{4})</B>")} AS source, {_ext("content", r"<B>(.*?)\s(\d{4})</B>", 2)} AS year, content AS kwic, regexp_replace(body, '<U>|</U>', '', 'g') AS text,
  {_ext("body", "(.*)<U>")} AS "L-context", {_ext("body", "<U>(.*?)</U>")} AS keyword, {_ext("body", "</U>(.*)")} AS "R-context" FROM b0)"""
DOC = " || ".join(_trim(f"coalesce({x}, '')") for x in ('"L-context"', "keyword", '"R-context"'))


@query(f"WITH {KWIC} SELECT * FROM k")
def kwic_parse(spark, sf_dir):
    return parsed(spark, sf_dir)


@query(f"WITH {KWIC} SELECT doc_id, coalesce(year, '') || '_' || CAST(row_number() OVER (ORDER BY doc_id) AS VARCHAR) AS id FROM k")
def entry_ids(spark, sf_dir):
    return kwic.entry_ids(parsed(spark, sf_dir), "doc_id").select("doc_id", "id")


@query(f"WITH {KWIC} SELECT doc_id, {DOC} AS document FROM k")
def doc_assemble(spark, sf_dir):
    return kwic.assemble(parsed(spark, sf_dir)).select("doc_id", "document")


@query(f"WITH {KWIC} SELECT doc_id, year, keyword FROM k WHERE {_trim('keyword')} = 'the' AND {_trim('year')} BETWEEN '1900' AND '1915'")
def filter_keyword_year(spark, sf_dir):
    return kwic.select_years(kwic.select_keyword(parsed(spark, sf_dir), "the"), "1900", "1915").select("doc_id", "year", "keyword")


@query(f"WITH {KWIC} SELECT year, CAST(count(*) AS BIGINT) AS n FROM k WHERE year BETWEEN '1905' AND '1910' GROUP BY year")
def year_range(spark, sf_dir):
    return kwic.select_years(parsed(spark, sf_dir), "1905", "1910").groupBy("year").agg(F.count("*").alias("n"))


@query(f"WITH {KWIC} SELECT DISTINCT keyword FROM k WHERE keyword IS NOT NULL")
def keywords_distinct(spark, sf_dir):
    return kwic.distinct_keywords(parsed(spark, sf_dir))


@query(f"WITH {KWIC} SELECT DISTINCT year FROM k WHERE year IS NOT NULL ORDER BY year")
def years_sorted(spark, sf_dir):
    return kwic.sorted_years(parsed(spark, sf_dir))


@query(f"WITH d AS (SELECT {_trim('coalesce(source, $$$$)')} AS a, {_trim('coalesce(text, $$$$)')} AS c FROM documents) SELECT a AS author, a || ' ' || c AS document FROM d WHERE a <> '' OR c <> ''".replace("$$$$", "''"))
def free_documents(spark, sf_dir):
    return kwic.free_documents(table(spark, sf_dir, "documents").select(F.col("source").alias("author"), F.col("text").alias("content")))


# Terms

TOKENS = r"""
tok AS (SELECT doc_id, source, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents)"""


def tokens(spark: SparkSession, sf_dir: str, tokenizer: Tokenizer = Tokenizer()) -> DataFrame:
    return explode_tokens(table(spark, sf_dir, "documents"), "text", tokenizer, ("doc_id", "source"))


@query(f"WITH {TOKENS} SELECT DISTINCT term FROM tok")
def vocab(spark, sf_dir):
    return tokens(spark, sf_dir).select("term").distinct()


@query(f"WITH {TOKENS} SELECT term, CAST(count(*) AS BIGINT) AS n FROM tok WHERE length(term) >= 4 AND term NOT IN {STOP} GROUP BY term")
def tokens_len_stop(spark, sf_dir):
    return tokens(spark, sf_dir, Tokenizer(stop=frozenset(STOP), shortest=4)).groupBy("term").agg(F.count("*").alias("n"))


@query(rf"WITH {TOKENS}, s AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM benchmark) SELECT term, CAST(count(*) AS BIGINT) AS n FROM tok ANTI JOIN s USING (term) GROUP BY term")
def stop_anti_join(spark, sf_dir):
    stop = explode_tokens(table(spark, sf_dir, "benchmark"), "text")
    return without_stop_words(tokens(spark, sf_dir), stop).groupBy("term").agg(F.count("*").alias("n"))


TF = f"""{TOKENS},
tf AS (SELECT doc_id, source, term, count(*) AS tf FROM tok GROUP BY ALL),
g AS (SELECT doc_id, unnest([source, 'all']) AS source, term, tf FROM tf)"""


@query(f"WITH {TF} SELECT source, term, CAST(count(*) AS BIGINT) AS docf, CAST(sum(tf) AS BIGINT) AS count FROM tf GROUP BY source, term")
def term_stats(spark, sf_dir):
    return weights.statistics_of(table(spark, sf_dir, "documents"), T.word_text("text"), "source", "doc_id")


@query(f"WITH {TF} SELECT term, round(ln((1 + (SELECT count(DISTINCT doc_id) FROM tf)) / (1 + count(*))) + 1, 9) AS idf FROM tf GROUP BY term")
def idf_smooth(spark, sf_dir):
    return weights.idf_of(table(spark, sf_dir, "documents"), T.word_text("text"), "doc_id")


def tfidf_sql(rows: str, norm: str = "sum(w) OVER p", docf: str = "docf", count: str = "count, ", where: str = "") -> str:
    return f"""
n AS (SELECT source, count(DISTINCT doc_id) AS n FROM {rows} GROUP BY source),
st AS (SELECT source, term, count(*) AS docf, sum(tf) AS count, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM {rows} JOIN n USING (source) GROUP BY source, term),
wt AS (SELECT source, doc_id, term, docf, st.count, idf, tf * idf AS w FROM {rows} JOIN st USING (source, term)),
nw AS (SELECT *, w / {norm} AS x FROM wt WINDOW p AS (PARTITION BY source, doc_id)),
sc AS (SELECT source, term, any_value(docf) AS docf, any_value(count) AS count, any_value(idf) AS idf, round(sum(x), 9) AS s FROM nw GROUP BY source, term),
sp AS (SELECT source, avg(s) AS mu, stddev_pop(s) AS sd FROM sc GROUP BY source)
SELECT source, term, CAST(docf AS BIGINT) AS {docf}, {"CAST(count AS BIGINT) AS count, " if count else ""}round(idf, 9) AS idf, s AS "tf-idf", CASE WHEN sd > 0 THEN round(exp(-pow(s - mu, 2) / (2 * sd * sd)) / (sd * sqrt(2 * pi())), 6) END AS normdis,
  row_number() OVER (PARTITION BY source ORDER BY s DESC, term) AS rank FROM sc JOIN sp USING (source) {where}"""


@query(f"WITH {TF}, {tfidf_sql('g')}")
def tfidf_l1_by_group(spark, sf_dir):
    return weights.tfidf_of(table(spark, sf_dir, "documents"), T.word_text("text"), "source", "doc_id")


@query(f"WITH {TF}, a AS (SELECT doc_id, 'all' AS source, term, tf FROM tf), {tfidf_sql('a')}")
def tfidf_l1_all(spark, sf_dir):
    return weights.tfidf_of(table(spark, sf_dir, "documents").withColumn("source", F.lit("all")), T.word_text("text"), "source", "doc_id", all_group=False)


@query(f"WITH {TF}, {tfidf_sql('tf', 'sqrt(sum(w * w) OVER p)', 'tf', '')}")
def tfidf_l2_proto(spark, sf_dir):
    return weights.tfidf_of(table(spark, sf_dir, "documents"), T.word_text("text"), "source", "doc_id", "l2", all_group=False).withColumnRenamed("docf", "tf").drop("count")


@query(rf"""WITH d AS (SELECT conv_id || '-' || turn AS doc_id, role || ' ' || text AS t FROM conversations WHERE role <> '' OR text <> ''),
tok AS (SELECT doc_id, 'free' AS source, unnest(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM d),
tf AS (SELECT doc_id, source, term, count(*) AS tf FROM tok GROUP BY ALL), {tfidf_sql("tf")}""")
def tfidf_free(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), F.concat("role", F.lit(" "), "text").alias("t"), "role", "text")
    c = c.where("role <> '' or text <> ''").withColumn("source", F.lit("free"))
    return weights.tfidf_of(c, T.word_text("t"), "source", "doc_id", all_group=False)


# a file for each source and one for all: what they hold, from their names and columns
@query(f"WITH {TF}, r AS ({tfidf_sql('g').replace('n AS (SELECT source, count(DISTINCT', 'WITH n AS (SELECT source, count(DISTINCT', 1)}) SELECT CASE WHEN source = 'all' THEN 'bcc_k_tfidf_norml1.csv' ELSE 'bcc_' || source || '_k_tfidf_norml1.csv' END AS file, term, docf, count, \"tf-idf\", rank FROM r")
def tfidf_files(spark, sf_dir):
    at = scratch(spark)
    names = sinks.write_tfidf(weights.tfidf_of(table(spark, sf_dir, "documents"), T.word_text("text"), "source", "doc_id"), at, "k", "source")
    schema = "term string, docf long, count long, idf double, `tf-idf` double, normdis double, rank long"
    r = spark.read.options(**sinks.CSV).csv(names, schema=schema).withColumn("file", F.element_at(F.split("_metadata.file_path", "/"), -1))
    return r.select("file", "term", "docf", "count", "tf-idf", "rank")


# a dictionary of words to keep whole, one of words to put together, stop words; from files, used or not
@query("SELECT doc_id, [source, '参政权', lang, '议员', '宪法'] AS tokens, [source, lang] AS plain FROM documents")
def tokens_from_files(spark, sf_dir):
    at = scratch(spark)
    for name, terms in (("stop", ["国会", "的"]), ("force", ["参政权", "国会", "参政"]), ("combine", ["议员", "宪法"])):
        sinks.write_single(spark.createDataFrame([(t,) for t in terms], "value string"), f"{at}/{name}.txt", "text")
    files = {"stop": f"{at}/stop.txt", "force": f"{at}/force.txt", "combined": f"{at}/combine.txt"}
    text = F.concat("source", F.lit("参政权"), "lang", F.lit("的国会议员 宪法"))
    full, plain = Tokenizer.from_files(spark, **files), Tokenizer.from_files(spark, **files, use_stopwords=False, use_dictionaries=False, load=lambda: lambda s: longest_match(s, frozenset(), 1))
    return table(spark, sf_dir, "documents").select("doc_id", full.tokens(text).alias("tokens"), plain.tokens(text).alias("plain"))


# any tokenizer and any normaliser: the text is normalised first, then cut, then filtered
@query(r"SELECT doc_id, list_filter(string_split('国会 ' || source || ' a ' || replace(text, '-', ' '), ' '), lambda x: length(x) >= 2) AS tokens FROM documents WHERE text IS NOT NULL")
def tokens_by_hook(spark, sf_dir):
    t = Tokenizer(load=lambda: lambda s: s.split(" "), normalize=lambda c: F.replace(T.simplify(c), F.lit("-"), F.lit(" ")))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", t.tokens(F.concat(F.lit("國會 "), "source", F.lit(" a "), "text")).alias("tokens"))


# tokens joined and cut again, as a vectorizer does
@query(r"SELECT conv_id, turn, regexp_extract_all(lower(array_to_string(regexp_split_to_array(text, '\s+'), ' ')), '[\p{L}\p{N}_]{2,}') AS tokens FROM conversations WHERE text IS NOT NULL")
def tokens_again(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", retokenized(F.split("text", r"\s+")).alias("tokens"))


# Similarity of periods

SIZES = "sz AS (SELECT source, count(*) AS c FROM documents GROUP BY source)"
DRAWN = f"""{SIZES},
r AS (SELECT unnest(range({REPLICATES})) AS rep),
o AS (SELECT rep, source, doc_id, text, row_number() OVER (PARTITION BY rep, source ORDER BY md5(CAST(rep AS VARCHAR) || '_' || CAST(doc_id AS VARCHAR)), doc_id) AS k FROM documents, r),
sm AS (SELECT * FROM o WHERE k <= least({SAMPLE}, (SELECT min(c) FROM sz))),
st AS (SELECT rep, source, doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM sm),
gr AS (SELECT rep, source, count(*) AS n FROM sm GROUP BY rep, source)"""
VECTORS = {
    "count": "v AS (SELECT rep, source, term, count(*) / sum(count(*)) OVER (PARTITION BY rep, source) AS w FROM st GROUP BY rep, source, term)",
    "docfreq": "v AS (SELECT rep, source, term, count(DISTINCT doc_id) / any_value(n) AS w FROM st JOIN gr USING (rep, source) GROUP BY rep, source, term)",
    "tfidf": """f AS (SELECT rep, source, term, count(*) AS tf FROM st GROUP BY rep, source, term),
ny AS (SELECT rep, count(DISTINCT source) AS n FROM f GROUP BY rep),
i AS (SELECT rep, term, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM f JOIN ny USING (rep) GROUP BY rep, term),
v AS (SELECT rep, source, term, tf * idf / sum(tf * idf) OVER (PARTITION BY rep, source) AS w FROM f JOIN i USING (rep, term))""",
}
MATRIX = """
dt AS (SELECT a.rep, a.source AS year_a, b.source AS year_b, sum(a.w * b.w) AS dot FROM v a JOIN v b ON a.rep = b.rep AND a.term = b.term GROUP BY ALL),
ln AS (SELECT rep, year_a AS y, sqrt(dot) AS len FROM dt WHERE year_a = year_b),
m AS (SELECT a.rep, a.source AS year_a, b.source AS year_b, coalesce(dot / nullif(la.len * lb.len, 0), 0) AS sim FROM gr a JOIN gr b ON a.rep = b.rep
  LEFT JOIN dt ON dt.rep = a.rep AND dt.year_a = a.source AND dt.year_b = b.source LEFT JOIN ln la ON la.rep = a.rep AND la.y = a.source LEFT JOIN ln lb ON lb.rep = a.rep AND lb.y = b.source)"""


@query(f"WITH {SIZES} SELECT CAST(min(c) AS BIGINT) AS smallest, CAST(least(30, min(c)) AS BIGINT) AS n FROM sz")
def group_sizes_min(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return similarity.group_sizes(d, "source").agg(F.min("n").alias("smallest")).crossJoin(similarity.clamped(d, 30, "source"))


@query(f"WITH {DRAWN} SELECT rep, source, doc_id FROM sm")
def sample_n(spark, sf_dir):
    return similarity.sample_groups(table(spark, sf_dir, "documents").select("doc_id", "source"), SAMPLE, REPLICATES, "source")


def matrices(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    return similarity.year_similarity(table(spark, sf_dir, "documents"), Tokenizer().tokens("text"), method, SAMPLE, REPLICATES, "source")


def _similarity(method: str) -> None:
    def single(spark, sf_dir):
        return matrices(spark, sf_dir, method).withColumn("sim", F.round("sim", 9))

    def boot(spark, sf_dir):
        return similarity.over_replicates(matrices(spark, sf_dir, method))

    single.__name__, boot.__name__ = f"sim_{method}", f"sim_{method}_boot"
    head = f"WITH {DRAWN}, {VECTORS[method]}, {MATRIX}"
    query(f"{head} SELECT rep, year_a, year_b, round(sim, 9) AS sim FROM m")(single)
    query(f"{head} SELECT year_a, year_b, round(avg(sim), 9) AS mean, round(stddev_pop(sim), 9) AS std FROM m GROUP BY year_a, year_b")(boot)


for _m in VECTORS:
    _similarity(_m)
_SOURCES = [f"src{i}" for i in range(20)]


def _pivot_sql(agg: str) -> str:
    return f"WITH {DRAWN}, {VECTORS['count']}, {MATRIX} SELECT year_a AS year, " + ", ".join(f"round({agg}(sim) FILTER (year_b = '{s}'), 9) AS {s}" for s in _SOURCES) + " FROM m GROUP BY year_a"


# the SQL names the sources of the given tables; the columns come from the data
@query(_pivot_sql("avg"))
def sim_pivot(spark, sf_dir):
    return similarity.wide(similarity.over_replicates(matrices(spark, sf_dir, "count")))


@query(_pivot_sql("stddev_pop"))
def sim_pivot_std(spark, sf_dir):
    return similarity.wide(similarity.over_replicates(matrices(spark, sf_dir, "count")), value="std")


# Topics: values depend on the implementation, so the queries give what must hold of them


def _tokens_of(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", Tokenizer(stop=frozenset(STOP)).tokens("text").alias("tokens"))


# every document has shares of all topics that add up to one; the smallest are left out, 6 % at most; its row has a number, and each share four decimals
@query("SELECT CAST(row_number() OVER (ORDER BY doc_id) AS BIGINT) AS number, doc_id, source, CAST(7 AS BIGINT) AS cells, true AS whole FROM documents")
def lda_doc_topics(spark, sf_dir):
    d = _tokens_of(spark, sf_dir)
    m = topics.fit_topics(d, k=7, passes=20, seed=1938)
    t = topics.topic_table(d, m, "doc_id", columns=("doc_id", "source"), first=1)
    cells = [F.col(f"topic {i}") for i in range(7)]
    good = sum((c.isNull() | c.rlike(r"^[01]\.[0-9]{4}$")).cast("long") for c in cells)
    total = sum(F.coalesce(c.cast("double"), F.lit(0.0)) for c in cells)
    return t.select(F.col("`no.`").alias("number"), "doc_id", "source", good.alias("cells"), total.between(0.93, 1.001).alias("whole"))


# ten leading terms for each topic, from the vocabulary, by falling weight
@query("SELECT CAST(t AS INTEGER) AS topic, CAST(p AS INTEGER) AS position, true AS known, true AS falling FROM range(15) a(t), range(10) b(p)")
def lda_topic_terms(spark, sf_dir):
    d = _tokens_of(spark, sf_dir)
    terms = topics.fit_topics(d, k=15, passes=20, seed=42).terms(10)
    known = d.select(F.explode("tokens").alias("term")).join(F.broadcast(terms.select("term").distinct()), "term", "left_semi").distinct().withColumn("known", F.lit(True))
    before = F.lag("weight").over(Window.partitionBy("topic").orderBy("position"))
    falling = terms.withColumn("falling", F.coalesce(F.col("weight") <= before, F.col("weight") > 0))
    return falling.join(known, "term", "left").select("topic", "position", F.coalesce("known", F.lit(False)).alias("known"), "falling")


# a matrix of all pairs of periods, symmetrical, one on the diagonal, between 0 and 1
@query(f"WITH {SIZES} SELECT a.source AS year_a, b.source AS year_b, true AS symmetrical, true AS within, a.source = b.source AS one FROM sz a, sz b")
def sim_lda(spark, sf_dir):
    d = similarity.sample_texts(_tokens_of(spark, sf_dir), SAMPLE, REPLICATES, "source")
    m = cut(similarity.over_replicates(topics.topic_similarity(d, group="source", k=10, passes=15)))
    other = m.select(F.col("year_b").alias("year_a"), F.col("year_a").alias("year_b"), F.col("mean").alias("m"), F.col("std").alias("s"))
    same = (F.abs(F.col("mean") - F.col("m")) < 1e-8) & (F.abs(F.col("std") - F.col("s")) < 1e-8)
    return m.join(other, ["year_a", "year_b"]).select("year_a", "year_b", same.alias("symmetrical"), F.col("mean").between(0, 1 + 1e-9).alias("within"), (F.abs(F.col("mean") - 1) < 1e-9).alias("one"))


def _turns(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role is not null")
    year = (F.col("turn") % 2 + 1990).cast("string")
    return c.select("conv_id", "turn", F.col("role").alias("keyword"), year.alias("year"), "text", Tokenizer().tokens("text").alias("tokens"))


# a model for each keyword over all years and for each year: as many numbered rows as documents, 15 shares with four decimals, ten terms a topic
@query("""WITH d AS (SELECT role AS keyword, unnest(['all', CAST(1990 + turn % 2 AS VARCHAR)]) AS year FROM conversations WHERE role IS NOT NULL)
SELECT keyword, year, CAST(count(*) AS BIGINT) AS documents, CAST(count(*) AS BIGINT) AS last, CAST(15 * count(*) AS BIGINT) AS cells, CAST(150 AS BIGINT) AS terms FROM d GROUP BY keyword, year""")
def lda_by_keyword(spark, sf_dir):
    out = None
    for keyword, year, own, m in topics.by_keyword(_turns(spark, sf_dir), k=15, passes=20, seed=42):
        t = topics.topic_table(own, m, "conv_id", "turn", columns=("text",), first=1)
        good = sum((F.col(f"topic {i}").isNull() | F.col(f"topic {i}").rlike(r"^[01]\.[0-9]{4}$")).cast("long") for i in range(15))
        row = t.agg(F.count("*").alias("documents"), F.max("`no.`").alias("last"), F.sum(good).alias("cells"))
        row = row.select(F.lit(keyword).alias("keyword"), F.lit(year).alias("year"), "documents", "last", "cells", F.lit(m.terms(10).count()).cast("long").alias("terms"))
        out = row if out is None else out.unionAll(row)
    return spark.createDataFrame([], "keyword string, year string, documents long, last long, cells long, terms long") if out is None else out


# both files of a model as a user gets them: the terms of each topic in a line, the documents with their numbers and shares
@query("""SELECT 'documents' AS file, CAST(row_number() OVER (ORDER BY item_id) AS VARCHAR) AS line, CAST(item_id AS VARCHAR) AS head, true AS shaped FROM benchmark
UNION ALL SELECT 'terms', CAST(t + 1 AS VARCHAR), 'Topic ' || CAST(t AS VARCHAR), true FROM range(7) r(t)""")
def lda_files(spark, sf_dir):
    at = scratch(spark)
    d = table(spark, sf_dir, "benchmark").select("item_id", F.col("item_id").cast("string").alias("author"), Tokenizer().tokens("text").alias("tokens"))
    m = topics.fit_topics(d, k=7, passes=20, seed=1938)
    terms, shares = sinks.topic_names("free", "all")
    sinks.write_single(sinks.topic_lines(m.terms(10)), f"{at}/{terms}", "text", bom=False)
    sinks.write_single(topics.topic_table(d, m, "item_id", columns=("author",), least=None, prefix="topic_", first=1).orderBy("`no.`"), f"{at}/{shares}")
    schema = "`no.` string, author string, " + ", ".join(f"topic_{i} string" for i in range(7))
    t = readers.read_csv(spark, f"{at}/{shares}", schema)
    shaped = F.forall(F.array(*(f"topic_{i}" for i in range(7))), lambda x: x.rlike(r"^[01]\.[0-9]{4}$"))
    own = t.select(F.lit("documents").alias("file"), F.col("`no.`").alias("line"), F.col("author").alias("head"), shaped.alias("shaped"))
    lines = spark.read.text(f"{at}/{terms}").select("value", F.regexp_extract("value", r"^(Topic (\d+)): ", 1).alias("head"), F.regexp_extract("value", r"^Topic (\d+): ", 1).alias("i"))
    return own.unionAll(lines.select(F.lit("terms"), (F.col("i").cast("int") + 1).cast("string"), "head", F.col("value").rlike(r'^Topic \d+: ("[^"]+", [01]\.\d{3}, ){9}"[^"]+", [01]\.\d{3}$')))


# Journal records

_DIGITS = "零一二三四五六七八九"


def _numeral(n: Column) -> Column:
    d = F.array(*map(F.lit, _DIGITS))
    tens, ones = F.floor(n / 10).cast("int"), (n % 10).cast("int")
    return F.when(n < 10, F.get(d, ones)).otherwise(F.concat(F.when(tens > 1, F.get(d, tens)).otherwise(""), F.lit("十"), F.when(ones > 0, F.get(d, ones)).otherwise("")))


_NUM = "(CASE WHEN n < 10 THEN '" + _DIGITS + "'[n + 1] ELSE (CASE WHEN n >= 20 THEN '" + _DIGITS + "'[n // 10 + 1] ELSE '' END) || '十' || (CASE WHEN n % 10 > 0 THEN '" + _DIGITS + "'[n % 10 + 1] ELSE '' END) END)"


@query(f"WITH d AS (SELECT doc_id, CAST(doc_id % 100 AS INTEGER) AS n FROM documents) SELECT doc_id, {_NUM} AS numeral, CAST(n AS VARCHAR) AS number FROM d")
def cn2num(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", _numeral(F.col("doc_id") % 100).alias("numeral")).withColumn("number", T.chinese_number("numeral"))


def _source_line() -> Column:
    n = F.col("doc_id") % 100
    return F.concat(F.lit("出处：《"), "source", F.lit("》，"), (F.lit(1900) + n).cast("string"), F.lit("年第"), _numeral(n), F.lit("期，"), n.cast("string"), F.lit(" - "), "n_chars")


@query("WITH d AS (SELECT doc_id, source, n_chars, CAST(doc_id % 100 AS INTEGER) AS n FROM documents) SELECT doc_id, source AS journal, CAST(1900 + n AS VARCHAR) AS year, CASE WHEN n % 100 = 0 THEN '' ELSE CAST(n AS VARCHAR) END AS issue, CAST(n AS VARCHAR) AS startpage, CAST(n_chars AS VARCHAR) AS endpage FROM d")
def source_line_parse(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.parse_source(_source_line()).alias("s")).select("doc_id", "s.*")


_CODE = "substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)"


@query(f"SELECT doc_id, '本文系' || source || '基金项目“' || lang || '”（' || {_CODE} || '）' AS acknowledgement, source || '基金项目' AS \"order\", lang AS researchtitle, {_CODE} AS number FROM documents")
def funding_parse(spark, sf_dir):
    line = F.concat(F.lit("基金项目： 本文系"), "source", F.lit("基金项目“"), "lang", F.lit("”（"), F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), F.lit("）"))
    return table(spark, sf_dir, "documents").select("doc_id", T.parse_funding(line).alias("f")).select("doc_id", "f.*")


@query(r"SELECT conv_id, turn, regexp_replace(role, '\s', '', 'g') AS label, trim(regexp_replace(text, '\s+', ' ', 'g')) AS value FROM conversations")
def label_split(spark, sf_dir):
    nodes = F.array(F.lit(" "), "role", F.lit("： "), "text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.split_label(nodes).alias("x")).select("conv_id", "turn", "x.*")


@query(r"SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[、，,；;·\s]+'), lambda x: x <> '') AS parts FROM conversations")
def list_split(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.split_list("text").alias("parts"))


@query("SELECT doc_id, CAST(n_chars AS VARCHAR) AS download, CASE WHEN doc_id % 2 = 0 THEN '0' ELSE CAST(doc_id AS VARCHAR) END AS read FROM documents")
def impact_parse(spark, sf_dir):
    line = F.concat(F.lit("下载量："), "n_chars", F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.concat(F.lit(" 在线阅读: "), "doc_id")))
    return table(spark, sf_dir, "documents").select("doc_id", T.parse_impact(line).alias("i")).select("doc_id", "i.*")


@query("SELECT doc_id, source || '||' || lang || '||' || CAST(n_chars % 100 AS VARCHAR) AS key FROM (SELECT *, row_number() OVER (PARTITION BY source, lang, n_chars % 100 ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def article_dedup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("||", "source", "lang", (F.col("n_chars") % 100).cast("string")).alias("key"))
    return pages.first_of_key(d, "key", "doc_id")


def _list_pages(spark, sf_dir) -> DataFrame:
    """Saved list pages of ten records each, built from the documents: labels in several spellings, missing lines, one-node labels, and the same record on two pages."""
    d = table(spark, sf_dir, "documents").where("text is not null").withColumn("n", F.col("doc_id") % 12)
    x = T.xml_escape
    when = lambda k, html: F.when(F.col("doc_id") % k != 0, html).otherwise("")
    code = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8)
    item = F.concat(
        F.lit("<li><div><a href='#'>"), x(F.concat("lang", F.lit(" & <"), (F.col("n_chars") % 10).cast("string"), F.lit(">"))), F.lit("</a><a>more</a></div>\n"),
        when(7, F.concat(F.when(F.col("doc_id") % 11 == 0, "<p>作者：").otherwise("<p><b>作　　者：</b>"), "source", F.lit("、 "), "lang", F.lit("</p>"))),
        F.lit("<p>出处：《"), "source", F.lit("》，"), (F.col("n") + 1900).cast("string"), F.lit("年第"), _numeral(F.col("n")), F.lit("期，"), F.col("n").cast("string"), F.lit(" - "), "n_chars", F.lit("</p>"),
        when(5, F.concat(F.when(F.col("doc_id") % 3 == 0, "<p><b>關 鍵 詞：</b>").otherwise("<p><span>关键词</span><i>：</i>"), "lang", F.lit(";"), "source", F.lit("|"), code, F.lit("</p>"))),
        F.lit("<p>摘　要："), x(F.substring("text", 1, 60)), F.lit("</p>"),
        when(4, F.concat(F.lit("<p>基金项目：本文"), F.when(F.col("doc_id") % 3 == 0, "系").otherwise("受"), "source", F.lit("基金项目“"), "lang", F.lit("”（"), code, F.lit("）</p>"))),
        F.lit("<span>下载次数：</span>"), "n_chars", F.lit("\n"), when(2, F.concat(F.lit("<span>阅读量: "), "doc_id", F.lit("</span>"))), F.lit("</li>"),
    )
    pages_ = d.select(F.floor(F.col("doc_id") / 10).alias("page_no"), "doc_id", item.alias("li")).groupBy("page_no").agg(F.sort_array(F.collect_list(F.struct("doc_id", "li"))).alias("items"))
    last = F.when(F.col("page_no") % 3 == 0, "<a class='layui-laypage-next layui-disabled'>下一页</a>").when(F.col("page_no") % 3 == 1, "<a class='x layui-laypage-next'> 下一页 </a>").otherwise("")
    return pages_.select("page_no", F.concat(F.lit("<html><ul><li>menu</li></ul><ul id=ul_articlelist>"), F.array_join("items.li", "\n"), F.lit("</ul><div id='layui-laypage-0'><a>1</a>"), last, F.lit("</div></html>")).alias("html"))


_ARTICLES = rf"""
a0 AS (SELECT *, CAST(doc_id % 12 AS INTEGER) AS n, {_CODE} AS code, CAST(doc_id // 10 AS BIGINT) AS page_no FROM documents WHERE text IS NOT NULL),
a1 AS (SELECT page_no, CAST(row_number() OVER (PARTITION BY page_no ORDER BY doc_id) - 1 AS INTEGER) AS pos, lang || ' & <' || CAST(n_chars % 10 AS VARCHAR) || '>' AS title, source AS journal, CAST(1900 + n AS VARCHAR) AS year,
  CASE WHEN n = 0 THEN '' ELSE CAST(n AS VARCHAR) END AS issue, CAST(n AS VARCHAR) AS startpage, CAST(n_chars AS VARCHAR) AS endpage,
  CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN CAST([] AS VARCHAR[]) ELSE [source, lang] END AS authors, CASE WHEN doc_id % 5 = 0 THEN CAST([] AS VARCHAR[]) ELSE [lang, source, code] END AS keywords,
  trim(regexp_replace(substr(text, 1, 60), '\s+', ' ', 'g')) AS abstract,
  CASE WHEN doc_id % 4 = 0 THEN '' ELSE '本文' || (CASE WHEN doc_id % 3 = 0 THEN '系' ELSE '受' END) || source || '基金项目“' || lang || '”（' || code || '）' END AS acknowledgement,
  CASE WHEN doc_id % 4 <> 0 AND doc_id % 3 = 0 THEN source || '基金项目' ELSE '' END AS "order", CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END AS researchtitle, CASE WHEN doc_id % 4 = 0 THEN '' ELSE code END AS number,
  CAST(n_chars AS VARCHAR) AS download, CASE WHEN doc_id % 2 = 0 THEN '0' ELSE CAST(doc_id AS VARCHAR) END AS read FROM a0),
a AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY title, journal, year, startpage ORDER BY page_no, pos) AS k FROM a1) WHERE k = 1)"""


def _flat_articles(df: DataFrame, *keep: str) -> DataFrame:
    # an element without text comes back from XML as a null
    t = lambda c, name: F.coalesce(c, F.lit("")).alias(name)
    plain = [t(F.col(c), c.split(".")[-1]) for c in ("title", "journal", "year", "issue", "page.startpage", "page.endpage", "funding.acknowledgement", "funding.order", "funding.researchtitle", "funding.number", "abstract", "impact.download", "impact.read")]
    return df.select(*keep, "authors", "keywords", *plain)


@query(f"WITH {_ARTICLES} SELECT * FROM a")
def articles(spark, sf_dir):
    return _flat_articles(pages.extract_articles(_list_pages(spark, sf_dir), 1 << 40, "2024-01-01"), "page_no", "pos")


@query(f"WITH {_ARTICLES} SELECT * EXCLUDE (page_no, pos) FROM a")
def article_round_trip(spark, sf_dir):
    at = scratch(spark)
    found = pages.extract_articles(_list_pages(spark, sf_dir), 1 << 40, "2024-01-01")
    sinks.write_article_xml(found.drop("page_no", "pos", "key"), at)
    return _flat_articles(readers.read_article_xml(spark, at))


@query("SELECT CAST(doc_id // 10 AS BIGINT) AS page_no, any_value(doc_id // 10 % 3 = 1) AS more FROM documents WHERE text IS NOT NULL GROUP BY doc_id // 10")
def next_page(spark, sf_dir):
    return pages.next_pages(_list_pages(spark, sf_dir))


@query(r"SELECT CAST(doc_id // 7 AS BIGINT) AS page_no, CAST(row_number() OVER (PARTITION BY doc_id // 7 ORDER BY doc_id) - 1 AS INTEGER) AS pos, source, trim(regexp_replace(substr(text, 1, 80), '\s+', ' ', 'g')) AS content FROM documents WHERE text IS NOT NULL QUALIFY pos < 5 AND doc_id % 5 <> 0 AND doc_id % 3 <> 0")
def snippets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    when = lambda k, html: F.when(F.col("doc_id") % k != 0, html).otherwise("")
    row = F.concat(F.lit("<tr><td><div>"), when(5, F.concat(F.lit("<div class='derivation'>"), "source", F.lit("</div>"))), when(3, F.concat(F.lit("<div class='x summary'>"), T.xml_escape(F.substring("text", 1, 80)), F.lit("</div>"))), F.lit("</div>"))
    p = d.select(F.floor(F.col("doc_id") / 7).alias("page_no"), "doc_id", row.alias("row")).groupBy("page_no").agg(F.sort_array(F.collect_list(F.struct("doc_id", "row"))).alias("rows"))
    return pages.snippets(p.select("page_no", F.concat(F.lit("<table id='DataList'><tbody>"), F.array_join("rows.row", ""), F.lit("</tbody></table>")).alias("html")))


def _first_element(tag: str) -> str:
    return _sql_text(rf"regexp_extract(html, '(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>', 1)")


def _sql_text(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({x}, '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))"


@query(rf"SELECT page_id, {_first_element('title')} AS title, {_first_element('h1')} AS heading, CAST(len(regexp_extract_all(html, '(?s)<p(?:\s[^>]*)?>(.*?)</p>')) AS INTEGER) AS paragraphs FROM pages")
def page_extract(spark, sf_dir):
    first = lambda tag: F.coalesce(F.get(pages.element_texts("html", tag), F.lit(0)), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", first("title").alias("title"), first("h1").alias("heading"), F.size(pages.element_texts("html", "p")).alias("paragraphs"))


@query(rf"WITH p AS (SELECT page_id, regexp_extract_all(html, '(?s)<p(?:\s[^>]*)?>(.*?)</p>', 1)[1:5] AS ps FROM pages), u AS (SELECT page_id, unnest(range(len(ps))) AS pos, unnest(ps) AS t FROM p) SELECT page_id, CAST(pos AS INTEGER) AS pos, {_sql_text('t')} AS content FROM u")
def first5_per_page(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.slice(pages.element_texts("html", "p"), 1, 5)).alias("pos", "content"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS escaped FROM pages")
def xml_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.xml_escape("html").alias("escaped"))


_TRAD, _SIMP = "".join(T.SIMPLIFIED), "".join(T.SIMPLIFIED.values())


@query(f"SELECT doc_id, translate('國會' || source || '議員' || lang || '憲政', '{_TRAD}', '{_SIMP}') AS simplified FROM documents")
def t2s(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.simplify(F.concat(F.lit("國會"), "source", F.lit("議員"), "lang", F.lit("憲政"))).alias("simplified"))


@query(r"SELECT page_id, CASE WHEN s = '' THEN 'list' ELSE s END AS slug FROM (SELECT page_id, regexp_replace(url, '[^\p{L}\p{N}_-]+', '', 'g') AS s FROM pages)")
def url_slug(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.slug("url").alias("slug"))


# Files and streams


@query(f"WITH {KWIC}, e AS (SELECT year || '_' || CAST(row_number() OVER (ORDER BY doc_id) AS VARCHAR) AS id, * FROM k) SELECT id, source, year, " + ", ".join(f"{_trim(f'coalesce({x}, $$$$)')} AS {x}".replace("$$$$", "''") for x in ('"L-context"', "keyword", '"R-context"')) + " FROM e")
def xml_round_trip(spark, sf_dir):
    at = scratch(spark)
    sinks.write_corpus_xml(kwic.entry_ids(parsed(spark, sf_dir), "doc_id"), at)
    return kwic.flatten_entries(readers.read_corpus_xml(spark, at))


# an empty string is written like a missing one: CSV has no other way that every reader knows
@query(f"WITH {KWIC} SELECT source, year, kwic, nullif(text, '') AS text, nullif(\"L-context\", '') AS \"L-context\", nullif(keyword, '') AS keyword, nullif(\"R-context\", '') AS \"R-context\" FROM k")
def csv_round_trip(spark, sf_dir):
    at = scratch(spark)
    sinks.write_csv(parsed(spark, sf_dir).drop("doc_id"), at)
    return readers.read_csv(spark, at)


# a file of lines for each year, read again with its lines numbered
@query(rf"""WITH {KWIC}, c AS (SELECT doc_id, year, regexp_replace(kwic, '\s+', ' ', 'g') AS content FROM k)
SELECT content, year, CAST(row_number() OVER (PARTITION BY year ORDER BY doc_id) - 1 AS BIGINT) AS line FROM c""")
def concordance_round_trip(spark, sf_dir):
    at = scratch(spark)
    d = parsed(spark, sf_dir).select("doc_id", "year", F.regexp_replace("kwic", r"\s+", " ").alias("value"))
    sinks.write_groups(d, at, "year", lambda y: f"{sinks.CORPUS}_k_{y}.txt", "text", order=("doc_id",))
    back = readers.read_concordance(spark, at, "k", 1900, 1919)
    return back.select("content", F.regexp_extract("file", r"_(\d{4})\.txt$", 1).alias("year"), "line")


@query(rf"SELECT {_trim("coalesce(role, '')")} AS author, {_trim("coalesce(role, '')")} || ' ' || {_trim("coalesce(text, '')")} AS document FROM conversations WHERE {_trim("coalesce(role, '')")} <> '' OR {_trim("coalesce(text, '')")} <> ''")
def free_xml_round_trip(spark, sf_dir):
    at = scratch(spark)
    sinks.write_free_xml(table(spark, sf_dir, "conversations").select(F.col("role").alias("author"), F.col("text").alias("content")), at)
    return kwic.free_documents(readers.read_free_xml(spark, at))


# a term list as a file, with a byte order mark, blank lines and repetitions
@query("SELECT DISTINCT source AS term FROM documents WHERE source IS NOT NULL")
def term_list(spark, sf_dir):
    at = scratch(spark)
    lines = table(spark, sf_dir, "documents").select(F.explode(F.array("source", F.lit(""), F.concat(F.lit(" "), "source", F.lit("　")))).alias("value")).where("value is not null")
    sinks.write_single(lines, f"{at}/terms.txt", "text")
    return readers.read_terms(spark, f"{at}/terms.txt", needed=True)


# the first row of a key over all batches
@query("SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source")
def stream_first_rows(spark, sf_dir):
    at = scratch(spark)
    schema = "doc_id long, source string"
    ingest(spark, f"{sf_dir}/documents.parque[t]", schema, f"{at}/out", f"{at}/state", key="source", order=("doc_id",)).awaitTermination()
    return spark.read.parquet(f"{at}/out").drop("_batch")


@query(rf"SELECT page_id, url, {_first_element('title')} AS title FROM pages")
def stream_ingest(spark, sf_dir):
    at = scratch(spark)

    def titles(p: DataFrame) -> DataFrame:
        return p.select("page_id", "url", F.coalesce(F.get(pages.element_texts("html", "title"), F.lit(0)), F.lit("")).alias("title"))

    schema = "page_id long, url string, html string"
    ingest(spark, f"{sf_dir}/pages.parque[t]", schema, f"{at}/out", f"{at}/state", titles, key="page_id").awaitTermination()
    return spark.read.parquet(f"{at}/out").drop("_batch")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
