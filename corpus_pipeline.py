"""From raw documents to packed training bins: five stages, each written as Parquet and read again by the next.

Every stage takes any table with the columns of `documents`. Null texts count as empty, rows of one doc_id are told apart
by their text, further columns go along, and an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import jaccard, mixing, packing, quality, secrets
from tickloom.llm.common import checkpoint_folder, table

#: SQL can express neither the classifier nor the rounding; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more, by a model of this corpus' labels. A null or empty text has the score of a text without words; equal texts go or stay together."""
    score = quality.scorer(quality.train(docs, table(spark, sf_dir, "labels")))
    return docs.where(score(F.col("text")) >= 0.5)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (Jaccard similarity of five-word shingles 0.8 or more): that of the smallest doc_id, null last, then of the smallest text hash. Texts without words are one group; repeated rows leave one."""
    return jaccard.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark. Null texts stay null; of rows with one doc_id each has the secrets of its own text."""
    return secrets.redact(docs, secrets.scan(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, as the mix of sources takes them: each group of rows equal in all columns has as many copies in all as the mix decided. Null sources are a source. Texts without words weigh nothing and follow the whole part of their source."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: bins of 2,048 words. Copies that the mix made are of one cluster and share no bin."""
    return packing.pack(docs, 2048)


STAGES = [("quality", good_documents), ("near_duplicates", one_of_each), ("secrets", without_secrets), ("mixing", mixed), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over `documents`; what a stage returns is written below `folder` and reread.

    With a `folder` in a shared store a run that failed goes on behind its last finished stage; without one a new folder
    below the session's checkpoint folder is used.
    """
    docs = table(spark, sf_dir, "documents")
    folder = folder or f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        if not _finished(spark, f"{folder}/{name}"):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


def _finished(spark: SparkSession, path: str) -> bool:
    """Whether a stage's output was committed."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)
