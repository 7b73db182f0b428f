"""The corpus pipeline: from raw documents to token ids, in five stages.

Each stage is (spark, docs, sf_dir) -> DataFrame and works on all its predecessor kept; between stages the
documents are written to the shared folder and read again. The folders stay until remove_kept(spark) is called, which the
caller does once run()'s result has been written.

Defined cases: documents with a null or empty text have no language and go in the first stage; a null doc_id is a document
like others and never a near duplicate; rows that repeat are one document to near_dedup, and stay or go together; extra
columns, whatever their names, stay up to the last stage, which has columns of its own; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontaminate, langid, neardup, pieces, pii
from weftline.llm.common import keep, remove_kept  # noqa: F401
from weftline.llm.queries import PIECES, TOKENIZERS


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the byte network cannot tell go."""
    return langid.keep_identified(docs, langid.learn(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest doc_id; five-word shingles, similarity 0.8."""
    return neardup.deduplicate(docs, percent=80)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a benchmark item has leaked into go."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the texts; no document goes."""
    return pii.mask(docs, pii.train(docs))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, checked by decoding."""
    return pieces.encode_documents(docs, pieces.load_model(f"{TOKENIZERS}/{PIECES}"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("personal_data", mask_personal_data),
    ("sentencepiece", encode_pieces),
]

ORACLE_SQL = None  # stages with trained models and probabilistic search; tested stage by stage instead


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
