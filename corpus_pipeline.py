"""From raw documents to packed training sequences: every stage works on all that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lexichron.llm import decontaminate, packing, secrets, simhash, toxicity
from lexichron.llm.common import shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted to the labels and to these documents, rejects go.

    Every row is judged by its own text, so repeated rows stay or go together; a null or empty text stays, whatever its other columns
    hold; without toxic labels, and of an empty table, all rows stay; all columns stay as they are, whatever their names."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id stays.

    Rows with a null doc_id, or a text that is null, empty or without a word, stay; rows of one doc_id are one document and
    stay or go together; an empty table stays empty; all columns stay as they are, whatever their names."""
    return simhash.drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item occurs go.

    Every row is searched for itself, so repeated rows stay or go together; a null or empty text stays; without items, and of an empty
    table, all rows stay; all columns stay as they are, whatever their names."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in place; every row stays, in order and number.

    A null or empty text stays as it is; repeated rows are treated alike; n_chars, if there is such a column, counts the new text where it
    changed; all other columns stay as they are, whatever their names; an empty table stays empty."""
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The layout of all documents in training sequences: (bin_id, position, doc_id, piece, start, length).

    Null and empty texts take no room; repeated rows are laid each; a null doc_id stays null; an empty table has an empty layout;
    columns besides doc_id and text aren't read."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_copies), ("decontamination", drop_benchmark), ("secrets", redact), ("packing", pack)]

#: Toxicity, near-duplicates, decontamination and packing are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet in the shared folder and read again by the next."""
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs
