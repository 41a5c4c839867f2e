"""The corpus pipeline: toxicity, language, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before it
kept, and is written as Parquet in the shared folder before the next reads it.
A stage's files are deleted once the next one's are complete.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rowloom.llm import langid, packing, pii, simhash_bk, toxicity
from rowloom.llm.shared import ensure_shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_bk.drop_copies(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.replace_pii(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_languages),
    ("near_copies", drop_near_copies),
    ("personal_data", replace_personal_data),
    ("packing", pack),
]

#: Trained models, BK-trees and greedy packing: SQL can't say what run() returns.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            _delete(spark, before)
        before = at
    return docs
