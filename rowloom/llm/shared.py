"""The folder that all executors share, and lineage cuts in it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder. The cluster names it in spark.checkpoint.dir; only a
    local master, as in tests, gets one made here."""
    sc = spark.sparkContext
    there = sc.getCheckpointDir()
    if there:
        return there
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="rowloom-shared-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder; later plans read it from there."""
    ensure_shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
