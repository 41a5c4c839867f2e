"""File sources and sinks: CSV, JSON Lines, JSON, free text, source registries, reports."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import records
from ..plans.shape import spread

REGISTRY_COLUMNS = ["country", "sourceTag", "url", "allowedDomain", "crawlMode", "enabled", "notes"]


def detect(spark: SparkSession, path: str, requested: str = "auto") -> str:
    """csv, json, jsonl or txt: as asked for, by suffix, else by the first line that isn't blank (SRC1)."""
    if requested != "auto":
        return requested
    suffix = PurePosixPath(path).suffix.lower()
    if suffix in (".csv", ".json", ".jsonl"):
        return suffix[1:]
    first = spark.read.text(path).where("trim(value) != ''").first()
    return "jsonl" if first and first["value"].lstrip().startswith("{") else "txt"


def _numbered(df: DataFrame) -> DataFrame:
    """With the position in the file: file splits are numbered in order."""
    return df.withColumn("position", F.monotonically_increasing_id())


def read_csv(spark: SparkSession, path: str, quoted_newlines: bool = True) -> DataFrame:
    """All columns as strings, blanks as '', a byte order mark dropped (SRC2). A file whose quoted
    values hold no line ends can be read in splits: say so by ``quoted_newlines=False``."""
    df = spark.read.options(header=True, multiLine=quoted_newlines, escape='"', nullValue="\0", emptyValue="").csv(path)
    names = [c.lstrip("\ufeff").strip('"') if i == 0 else c for i, c in enumerate(df.columns)]
    return _numbered(df.toDF(*names))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One record a line; a malformed line fails the read (SRC3)."""
    return _numbered(spark.read.options(mode="FAILFAST").json(path))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of records, or the array ``records`` of an object; else no rows (SRC4)."""
    df = spark.read.options(multiLine=True, mode="FAILFAST").json(path)
    kind = df.schema["records"].dataType if "records" in df.columns else None
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and df.count() == 1:
        return _numbered(df.select(F.explode("records").alias("r")).select("r.*"))
    whole = spark.read.text(path, wholetext=True).first()
    return _numbered(df if whole and whole["value"].lstrip("\ufeff \t\r\n").startswith("[") else df.limit(0))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(position, block) of free text (SRC5)."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc"), F.col("value").alias("text"))
    return records.text_blocks(whole).select("position", "block")


def import_rows(spark: SparkSession, path: str, fmt: str = "auto", limit: int | None = None, source_type: str = "provider_file_import", source_tag: str = "provider_text_import") -> DataFrame:
    """Import rows of a file of any of the formats; limit counts rows as read (SRC6)."""
    fmt = detect(spark, path, fmt)
    if fmt == "txt":
        rows = records.block_rows(spread(read_text(spark, path)), source_type, source_tag)
    else:
        raw = {"csv": read_csv, "jsonl": read_jsonl, "json": read_json}[fmt](spark, path)
        rows = records.normalize_structured(spread(raw), source_type, source_tag)
    return rows.orderBy("position").limit(limit) if limit else rows


def import_file(spark: SparkSession, path: str, fmt: str = "auto", min_score: float = 5, limit: int | None = None, strict_parity: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted, rejected, report) of a file."""
    rows = import_rows(spark, path, fmt, limit)
    scored = records.score_rows(rows, min_score, strict_parity=strict_parity)
    report = records.import_report(rows, scored, path, detect(spark, path, fmt))
    return records.accepted_rows(scored), records.rejected_rows(scored), report


def read_registry(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Source registries one after another, with file and row numbers (SRC10)."""
    schema = ", ".join(f"{c} string" for c in REGISTRY_COLUMNS)
    parts = []
    for k, path in enumerate(paths):
        df = spark.read.options(header=True, multiLine=True, escape='"').schema(schema).csv(path)
        parts.append(df.withColumn("file_no", F.lit(k)).withColumn("row_no", F.monotonically_increasing_id()))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A database table (SRC11). Errors surface; they never turn into rows."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """Given columns with a header, blanks for nulls (SNK1)."""
    chosen = df.select(*columns) if columns else df
    chosen.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in chosen.columns]).write.mode("overwrite").options(header=True, emptyValue="").csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """A one-row report as JSON (SNK2)."""
    report.coalesce(1).write.mode("overwrite").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """A JSON Lines feed (SNK3)."""
    df.write.mode("overwrite").json(path)


def append_raw(values: DataFrame, path: str) -> None:
    """Raw evidence, appended (SNK4): the value record, its category as a list, its source row."""
    cols = ["source_query", "country_code", "category", "address", "phone", "website", "latitude", "longitude", "raw"]
    values.select(F.col("name").alias("title"), *cols, F.array("category").alias("categories"), F.current_timestamp().alias("created_at")).write.mode("append").parquet(path)
