"""Incremental consolidation: batches or a stream of value records merged into a staging table.

The table is cut into ``BUCKETS`` by a hash of the key. A batch reads the newest
form of the buckets that its keys fall in, merges by dedupe_key, and writes those
buckets' next version beside them; a version is complete once its marker is there
(so a batch counts as a whole or not at all, UPS8), and a batch that is run again
writes the same version again. So a run that is stopped at any moment resumes
from its checkpoint without loss or double counting. Forms of a bucket that a
newer version but one replaces are deleted. All folders are given by the caller
and must be shared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import staging_upsert
from ..plans.session import materialize

BUCKETS = 64
_BUCKET = "__bucket"


def _files(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), root


def _names(spark: SparkSession, path: str, prefix: str) -> list[int]:
    fs, root = _files(spark, path)
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix))


def version_path(table: str, batch: int) -> str:
    return f"{table}/v={batch}"


def _complete(spark: SparkSession, table: str, before: int | None = None) -> list[int]:
    def done(v: int) -> bool:
        fs, marker = _files(spark, f"{version_path(table, v)}/_SUCCESS")
        return fs.exists(marker)

    return [v for v in _names(spark, table, "v=") if (before is None or v < before) and done(v)]


def _newest(spark: SparkSession, table: str, versions: list[int]) -> dict[int, int]:
    """The newest version of each bucket, of some versions in order."""
    return {b: v for v in versions for b in _names(spark, version_path(table, v), f"{_BUCKET}=")}


def _read(spark: SparkSession, table: str, newest: dict[int, int]) -> DataFrame | None:
    paths = [f"{version_path(table, v)}/{_BUCKET}={b}" for b, v in sorted(newest.items())]
    return spark.read.parquet(*paths) if paths else None


def latest(spark: SparkSession, table: str, before: int | None = None) -> DataFrame | None:
    """The table as its complete versions, of those before a batch, leave it."""
    return _read(spark, table, _newest(spark, table, _complete(spark, table, before)))


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _merge(batch: DataFrame, table: str, number: int) -> None:
    spark = batch.sparkSession
    versions = _complete(spark, table, number)
    newest = _newest(spark, table, versions)
    batch = materialize(batch)
    touched = {r[0] for r in batch.select(_bucket("dedupe_key")).distinct().collect()}  # at most BUCKETS
    merged = staging_upsert(batch, _read(spark, table, {b: v for b, v in newest.items() if b in touched}))
    # One file a bucket: a task holds whole buckets.
    out = merged.withColumn(_BUCKET, _bucket("dedupe_key")).repartition(min(BUCKETS, max(1, len(touched))), _BUCKET)
    out.write.mode("overwrite").partitionBy(_BUCKET).parquet(version_path(table, number))
    # A batch may run again: what it started from stays.
    for v in versions:
        for b in _names(spark, version_path(table, v), f"{_BUCKET}="):
            if newest[b] > v:
                fs, old = _files(spark, f"{version_path(table, v)}/{_BUCKET}={b}")
                fs.delete(old, True)


def merge_batch(table: str):
    """A foreachBatch function that merges a batch into the table."""

    def run(batch: DataFrame, number: int) -> None:
        _merge(batch, table, number)

    return run


def upsert_table(values: DataFrame, table: str) -> None:
    """Merges one batch of value records into the table (SNK5)."""
    spark = values.sparkSession
    _merge(values, table, max(_names(spark, table, "v="), default=-1) + 1)


def stream_upsert(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Merges what is available now, then stops: run it again to resume (ST6, ST8)."""
    return stream.writeStream.foreachBatch(merge_batch(table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_counters(events: DataFrame, delay: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Running counters of page events (ts, run_key, status, found) by event-time window."""
    done = F.col("status") == "processed"
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window), "run_key").agg(
        F.count_if(done).alias("pages_crawled"), F.coalesce(F.sum(F.when(done, F.col("found"))), F.lit(0)).alias("providers_found")
    )
