"""From raw documents to packed sequences: language, near duplicates, benchmark leaks, secrets, packing.

Defined results: a null text, or one without a letter, has no language and goes in the first stage; rows equal
in doc_id and text are one document, of which one stays; rows of one doc_id with other texts are documents of
their own; ties are broken by doc_id, then by hash of the text; an empty table gives an empty result; other
columns, whatever their names, are kept up to packing and read by no stage; whole texts count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import decontaminate, jaccard_join, language_id, packing, secret_scan
from tidewright.llm.common import Staged, table


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go."""
    return language_id.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of least doc_id stays; a document without words has no duplicates but repeated rows."""
    return jaccard_join.representatives(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item, as it is or re-parameterised, go; without a benchmark item none does."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; no document goes."""
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Planned sequences of at most 4096 tokens, a row per piece."""
    return packing.pack(docs)


STAGES = [
    ("language ID", keep_known_languages),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack_sequences),
]

#: The classifiers, the tokenizer and the plan are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage is computed once, into Parquet in the shared checkpoint folder, and dropped when the next one is written."""
    before, docs = None, table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        done = Staged(stage(spark, docs, sf_dir))
        if before:
            before.drop()
        before, docs = done, done.rows
    return docs
