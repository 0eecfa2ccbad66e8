"""The append-only analysis log and metrics reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def analysis_rows(df: DataFrame) -> DataFrame:
    """Rows as stored: the list of sounds as JSON text, missing transcript and emotion empty."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    sounds = F.to_json(F.coalesce("sounds", F.array().cast("array<string>"))).alias("sounds_json")
    return df.select(
        "id", "filename", "question", blank("transcript"), sounds, blank("emotion"), "answer", "created_at"
    )


def append_analysis(df: DataFrame, path: str) -> None:
    """Append to the log, one folder per day, so that paging by time prunes files."""
    _append(analysis_rows(df), path)


def inference_rows(df: DataFrame) -> DataFrame:
    return df.select("id", "filename", F.col("duration").cast("double").alias("duration"), "mime", "payload", "question", "answer", "created_at")


def append_inference(df: DataFrame, path: str) -> None:
    _append(inference_rows(df), path)


def _append(df: DataFrame, path: str) -> None:
    dated = df.withColumn("day", F.to_date("created_at"))
    dated.write.mode("append").partitionBy("day").parquet(path)


def read_analysis(log: DataFrame) -> DataFrame:
    """Decode the list of sounds; null or malformed JSON is an empty list."""
    sounds = F.from_json("sounds_json", "array<string>")
    empty = F.array().cast("array<string>")
    return log.withColumn("sounds", F.coalesce(sounds, empty)).drop("sounds_json")


def write_lookup(log: DataFrame, path: str, *keys: str, rows: int = 1 << 20) -> None:
    """The log laid out for lookups by ``keys`` (the first one leads): ranged and sorted by it, with Bloom filters for all.

    A file covers one range of the first key, so its statistics rule out every other file; for the other keys the Bloom
    filters of the row groups do. ``rows`` is about how many rows a file gets.
    """
    files = max(1, -(-log.count() // rows))
    laid = log.repartitionByRange(files, keys[0]).sortWithinPartitions(keys[0])
    writer = laid.write.mode("append")
    for k in keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true").option(f"parquet.bloom.filter.expected.ndv#{k}", str(rows))
    writer.parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All entries appended so far, without the column of the day folders."""
    return spark.read.parquet(path).drop("day")


def write_metrics_report(report: DataFrame, path: str) -> None:
    """One JSON record per report row."""
    report.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def read_metrics_report(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Reports written above, or pretty-printed ones spanning several lines."""
    reader = spark.read.option("multiLine", "true")
    return (reader.schema(schema) if schema else reader).json(path)


def add_missing_columns(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    """Add the columns of ``spec`` (name to SQL type) that the table lacks."""
    have = {c.lower() for c in df.columns}
    new = {c: F.lit(None).cast(t) for c, t in spec.items() if c.lower() not in have}
    return df.withColumns(new) if new else df


def union_versions(tables: Sequence[DataFrame]) -> DataFrame:
    """Old and new log versions as one table."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
