"""From documents to token ids: five stages, each written and read again before the next.

language_id    drops documents whose language can't be told
exact_dedup    keeps the last of equal texts
near_dedup     keeps the first of each group that n-gram similarity links
mixing         repeats or drops documents until sources have their target weights
bpe            adds token_ids, and drops nothing

All stages but the last return the columns of documents, whatever further ones there are. An empty table
gives no rows. Null texts and texts without letters go in the first stage. Rows that repeat an id count by
id and text: of equal ones one stays after the second stage. A row without an id stays through the first
three stages unless its text equals another row's, and the mix takes it as any other. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, exact_dedup, language_id, mixing, ngram_join
from tessera.llm.common import stored, table
from tessera.llm.queries import tokenizer


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(spark, docs, language_id.fit(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(spark, docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(spark, docs, table(spark, sf_dir, "labels"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(spark, docs, tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("bpe", tokenize),
]

#: SQL has neither the language model nor the encoding.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
