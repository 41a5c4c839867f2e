"""Operational counts and recent-activity lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as N


def count_all(df: DataFrame, name: str = "n") -> DataFrame:
    """One row with the number of rows (A1)."""
    return df.agg(F.count("*").alias(name))


def count_since(df: DataFrame, at: Column, start: Column, source: Column, sources: Sequence[str]) -> DataFrame:
    """Rows of the given sources since a moment."""
    return df.where((at >= start) & source.isin(list(sources))).agg(F.count("*").alias("n"))


def source_counts(df: DataFrame, source: Column, sources: Sequence[str] | None = None, complement: bool = False, most: int | None = None) -> DataFrame:
    """(source, n) by n falling and source rising; only the given sources, or all others (A3, A4)."""
    rows = df.select(F.coalesce(source, F.lit("unknown")).alias("source"))
    if sources is not None:
        inside = F.col("source").isin(list(sources))
        rows = rows.where(~inside if complement else inside)
    out = rows.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")
    return out.limit(most) if most else out


def recent(df: DataFrame, at: Sequence[str], most: int, tie: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The latest rows by the first of some moments that isn't null, ties by a unique column: a
    top-k, never a full sort (A5)."""
    moment = F.coalesce(*[F.col(c) for c in at])
    out = df.orderBy(moment.desc_nulls_last(), F.col(tie).desc()).limit(most)
    return out.select(*columns) if columns else out


def recent_errors(jobs: DataFrame, most: int = 25) -> DataFrame:
    """The latest jobs with an error, and its kind."""
    rows = recent(jobs.where("error is not null"), ["completed_at", "started_at", "created_at"], most, "id")
    return rows.withColumn("kind", N.error_kind("error"))


def run_history(runs: DataFrame, most: int = 30) -> DataFrame:
    """The latest runs (SNK6)."""
    return recent(runs, ["updated_at"], most, "run_key")


def warnings(app_write: bool, app_table: bool, current_since_start: DataFrame, sources: DataFrame, legacy: Sequence[str]) -> DataFrame:
    """(code): what an operator should know. Any legacy source is found by a semi-join."""
    spark = sources.sparkSession
    fixed = [c for c, on in (("app_write_disabled", not app_write), ("app_table_missing", not app_table)) if on]
    parts = spark.createDataFrame([(c,) for c in fixed], "code string")
    idle = current_since_start.where("n = 0").select(F.lit("nothing_written_since_start").alias("code"))
    names = spark.createDataFrame([(x,) for x in legacy], "source string")
    old = sources.join(names, "source", "left_semi").limit(1).select(F.lit("legacy_rows_exist").alias("code"))
    return parts.unionByName(idle).unionByName(old)


def dashboard_totals(raw: DataFrame, staging: DataFrame, app: DataFrame | None, since: DataFrame) -> DataFrame:
    """One row with the totals of the three tables and of what came in since the start."""
    parts = [count_all(raw, "raw_results"), count_all(staging, "staging_rows"), since.select(F.col("n").alias("current_raw_since_start"))]
    parts.append(count_all(app, "app_candidates") if app is not None else raw.sparkSession.range(1).select(F.lit(0).cast("long").alias("app_candidates")))
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


def answer(path: str, *, raw: DataFrame, staging: DataFrame, runs: DataFrame, current: Sequence[str], start: Column, app: DataFrame | None = None, jobs: DataFrame | None = None, legacy: Sequence[str] = (), app_write: bool = True) -> dict[str, DataFrame]:
    """What an address of the API answers, a part by name (SNK7); ValueError for an unknown address.

    raw: (source, ts, ...); staging and app: (id, updated_at, created_at, ...); runs:
    (run_key, updated_at, ...); jobs: legacy ones (id, error and their moments).
    """
    if path == "/api/run/status":
        return {"recent_runs": run_history(runs)}
    if path not in ("/api/dashboard", "/api/status"):
        raise ValueError(f"not an address of the API: {path}")
    since = count_since(raw, F.col("ts"), start, F.col("source"), current)
    parts = {
        "totals": dashboard_totals(raw, staging, app, since),
        "current_source_counts": source_counts(raw, F.col("source"), current),
        "legacy_source_counts": source_counts(raw, F.col("source"), current, complement=True, most=20),
        "recent_staging": recent(staging, ["updated_at", "created_at"], 30, "id"),
        "crawl_runs": recent(runs, ["updated_at"], 20, "run_key"),
        "warnings": warnings(app_write, app is not None, since, raw.select("source"), legacy),
    }
    if app is not None:
        parts["recent_app"] = recent(app, ["updated_at", "created_at"], 30, "id")
    if jobs is not None:
        parts["legacy_jobs"] = recent(jobs, ["completed_at", "started_at", "created_at"], 25, "id")
        parts["legacy_errors"] = recent_errors(jobs)
    return parts
