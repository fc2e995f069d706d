"""Corpus pipeline: five stages from raw documents to encoded ones.

Each stage reads what the one before kept, written as Parquet.  All but the
last return the columns of documents; the last returns ``doc_id``, the piece
numbers and the n best alternatives of every document that is left.

Null texts count as empty ones in every stage: they score 0 for toxicity, are
copies of each other, hold no benchmark item and have no pieces.  A document
without an id is a document like others.  Repeated rows are copies, so one
stays; empty tables give empty results; columns beside those of documents are
carried through to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sextant.llm import decontaminate, exact_dedup, near_dedup, pieces, toxicity
from sextant.llm.staging import load, stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.3 go; the model learns from labels outside the held-out quarter."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, load(spark, sf_dir, "labels")), threshold=0.3)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text, the one with the largest doc_id stays."""
    return exact_dedup.keep_one(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the one with the least doc_id stays."""
    return near_dedup.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_leaks(docs, load(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id`` and the piece numbers, score and alternatives of every document that is left."""
    return pieces.encode_pieces(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("piece encoding", encode),
]
#: A trained model, a hashed search and a best-first search decide: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result but the last is written to the shared folder and read again."""
    docs = load(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, name.replace(" ", "_"))
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
