"""A training corpus from ``documents``: five stages, each written as Parquet and read again by the next.

``run`` writes the stages into the folder that the cluster shares (spark.checkpoint.dir).
No stage but the last changes the columns; other columns than those of ``documents`` pass
through, whatever their names.  An empty table stays empty in every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from glossa.llm import exact, jaccard, packing, suffix, toxicity
from glossa.session import shared_folder


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; the model is trained on those of ``docs`` that have labels.

    Null texts are scored as empty ones; repeated rows have one score and stay or go together.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of the documents with equal texts, the one with the smallest id.

    Null texts equal empty ones, so one row of both is left.  Null ids come last; of rows that repeat an id, one stays.
    """
    return exact.drop_copies(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each family of near duplicates, the one with the smallest id.

    Null texts and texts without words are linked with nothing and stay, each row of them.
    """
    return jaccard.keep_one(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without strings of 400 bytes and more that stand at several places; n_chars follows the text.

    A null text stays null, with a null n_chars; a text of 400 bytes and more that repeats as a whole becomes empty.
    """
    cut = suffix.cut_repeats(docs)
    return cut.selectExpr(
        *["CAST(length(text) AS BIGINT) AS n_chars" if c == "n_chars" else f"`{c}`" for c in cut.columns]
    )


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, with their ids.

    Null and empty texts are one piece, their end token; repeated rows are packed once each.
    """
    return packing.pieces(packing.pack(docs))


STAGES = [
    ("toxicity", clean),
    ("exact_dedup", distinct),
    ("jaccard_join", unlike),
    ("suffix_dedup", unrepeated),
    ("packing", packed),
]

#: Training, suffix arrays and tokenizing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
