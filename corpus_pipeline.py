"""Corpus pipeline: language ID, exact dedup, SimHash near-dedup, secret scans, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, and drop any other.
Empty tables give empty ones. Null and repeated ids are no obstacle: rows are told apart by id and text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.llm import exact, langid, packing, secrets, simhash
from trackspark.llm.common import small_batches, stored
from trackspark.llm.queries import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least score (see ``langid.annotated``) for a text to stay: held-out texts of learned languages lie above, nearly all of unlearned ones below.
LEAST_SCORE = 0.75


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose n-grams are likely in learned languages, one or several; null texts and texts without letters go."""
    found = langid.annotated(docs.select(*COLUMNS), langid.train(docs))
    return found.where((F.col("lang_pred") != langid.UND) & (F.col("lang_score") >= LEAST_SCORE)).select(*COLUMNS)


@in_small_batches
def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z in lower case), the document with the largest id."""
    return exact.drop_copies(docs).select(*COLUMNS)


@in_small_batches
def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five words, similarity 0.8), the document with the smallest id."""
    return simhash.drop_near_copies(docs, 5, 0.8).select(*COLUMNS)


@in_small_batches
def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts."""
    return secrets.redact_secrets(docs.select(*COLUMNS))


@in_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"), 1024, 2)


STAGES = [("language ID", identify), ("exact dedup", drop_exact), ("SimHash near-dedup", drop_near), ("secret scans", redact), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: No SQL: language models, SimHash links and tokenizers are beyond it; the tests hold run() against loops over every document of the smallest table.
ORACLE_SQL = None
