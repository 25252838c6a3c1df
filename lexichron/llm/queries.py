"""The operators' queries, each over its whole table, and their SQL where there is any."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, license_scan, packing, secrets, simhash, substring, topk, toxicity, warczip
from .common import shared_dir, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxic_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warczip.pages_through_packages(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/packages-{uuid.uuid4().hex}")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_blocks(table(spark, sf_dir, "documents"), wrapped=True)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair_conversations(table(spark, sf_dir, "conversations"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), every=topk.QUERY_STEP)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_simhash, op3_licenses, op4_decontaminate, op5_packing, op6_warc, op7_secrets, op8_chat, op9_topk, op10_substring)}


def oracle_sql() -> dict[str, str]:
    return {"op3_licenses": license_scan.sql(), "op6_warc": warczip.SQL, "op7_secrets": secrets.sql(), "op9_topk": topk.sql(), "op10_substring": substring.sql()}
