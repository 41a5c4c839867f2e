"""Session helpers: tables of a directory, and lineage cuts in the shared folder."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster names it; a local session without one gets its own."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="rowloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder: what follows survives lost executors and has a short plan."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the Python workers, once a session, unless they find it by themselves:
    on PYTHONPATH, or in the working directory of a local session."""
    root = Path(__file__).resolve().parents[2]
    sc = spark.sparkContext
    found = str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    here = Path.cwd() == root and sc.master.startswith("local[")
    if found or here or sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='rowloom-')}/rowloom", "zip", root, "rowloom"))
