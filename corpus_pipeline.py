"""From raw documents to token ids in five stages; each works on all that the one before it kept.

quality drops documents that the classifier, trained on the labelled rows that are not held out, scores under
its threshold; near_duplicates keeps one document of each class of near copies; decontamination drops those
with a window of a benchmark item; secrets replaces secret values in texts; sentence_pieces encodes what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkevo.llm import common, decontaminate, near_duplicates, quality, secrets, sentence_pieces
from sparkevo.llm.queries import PIECES


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = common.table(spark, sf_dir, "labels")
    return quality.filter_quality(docs, quality.train(docs, labels, use=~quality.held_out()))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, owner=F.col("source"), repo=F.concat_ws("/", "source", "lang"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces and ids of every document that is left."""
    encoded = sentence_pieces.encode(docs, PIECES)
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "ids")


STAGES = [
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", replace_secrets),
    ("sentence_pieces", encode),
]

#: No stage but the secrets can be written in SQL; tests hold the pipeline against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read back."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.saved(stage(spark, docs, sf_dir), name)
    return docs
