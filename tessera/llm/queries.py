"""The queries of this folder and, where SQL can express them, their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, language_id, license_scan, mixing, nearest, ngram_join, quality, substring_dedup, url_filter
from .common import table


#: A folder of public vocabularies; where it is unset, the installed package of them tells.
TOKENIZERS = os.environ.get("TESSERA_TOKENIZERS")


def tokenizer(name: str = "byte_bpe_50k.json") -> bpe.Tokenizer:
    """Read on the driver and broadcast."""
    if TOKENIZERS:
        return bpe.Tokenizer.from_file(f"{TOKENIZERS}/{name}")
    import public_tokenizers

    return bpe.Tokenizer.from_file(public_tokenizers.path(name))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.classify(spark, quality.sites_of_documents(docs), quality.fit(docs, labels))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(spark, table(spark, sf_dir, "documents"), tokenizer())


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.judge(spark, table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return found.select("page_id", "host", "path", "rule", "verdict")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("source", "digest")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(spark, table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(spark, docs, language_id.fit(docs))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.group(spark, table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(spark, table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(spark, table(spark, sf_dir, "documents"))


OP9_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(d.text) AS text_sha256
FROM d JOIN g ON d.text = g.text
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_bpe, op3_url_filter, op4_mixing, op5_license_scan, op6_language_id, op7_nearest, op8_ngram_join, op9_exact_dedup, op10_substring_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": url_filter.oracle(), "op4_mixing": mixing.ORACLE, "op7_nearest": nearest.ORACLE, "op8_ngram_join": ngram_join.ORACLE, "op9_exact_dedup": OP9_SQL, "op10_substring_dedup": substring_dedup.ORACLE}
