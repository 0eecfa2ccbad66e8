"""What the operators of this subpackage share: input columns, splits, the shared folder, batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: a space and the controls 9 to 13.
SPACE = "\\x20\\x09-\\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def texts(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id and text, a null text as the empty one, and ``more``; other columns of whatever name are left out."""
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), *more, F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")
    )


def in_fold(divisor: int, remainder: int) -> Column:
    """Whether the row's doc_id falls in the held-out fold; a null doc_id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % divisor == remainder, F.lit(True))


def draw_texts(rows: DataFrame, label: str, seed: int, max_rows: int) -> tuple[DataFrame, dict, dict]:
    """About ``max_rows`` distinct pairs of a label and a text of ``rows``, the same number for each label as far as it has them.

    Drawn by ``drawn``, a hash of the text that comes along. Also the number of distinct texts by label, and the share drawn.
    """
    drawn = F.xxhash64("text", F.lit(seed))
    sizes = {r[label]: r["count"] for r in rows.select(label, drawn).distinct().groupBy(label).count().collect()}  # one row a label
    shares = {x: min(1.0, max_rows / len(sizes) / n) for x, n in sizes.items()}
    if not sizes:
        return rows.select(label, "text", drawn.alias("drawn")).limit(0), sizes, shares
    bound = F.create_map(*(F.lit(v) for x in sorted(shares) for v in (x, shares[x])))
    part = F.pmod(drawn, F.lit(1_000_000)) / 1e6 < bound[F.col(label)]
    return rows.select(label, "text").where(part).distinct().withColumn("drawn", drawn), sizes, shares


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The words of a text, split at ASCII white space."""
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Without that setting a temporary folder is used in local mode, where all share one machine; on a cluster it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="llm-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def mounted(folder: str) -> str:
    """The path under which every machine sees a shared folder; only mounted folders have one."""
    url = urlparse(folder)
    if url.scheme not in ("", "file"):
        raise ValueError(f"{folder} must be a mounted folder: workers map files in it into memory or seek in them")
    return url.path


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and still there when an executor is lost."""
    spark = df.sparkSession
    folder = shared_folder(spark, purpose)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what one Arrow batch of documents holds; long texts make the default of 10 000 rows too large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def visible_to_workers(spark: SparkSession) -> None:
    """Put this package on the Python path of workers that are started from now on, wherever the driver was started."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH")) if x)


def groups_of(batches: Iterator[pa.RecordBatch], columns: list[str], size: int) -> Iterator[list[list]]:
    """Rows of the batches as column lists, cut so that the texts (last column) of a group hold about ``size`` characters."""
    held: list[list] = [[] for _ in columns]
    chars = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            for to, value in zip(held, row, strict=True):
                to.append(value)
            chars += len(row[-1])
            if chars >= size:
                yield held
                held, chars = [[] for _ in columns], 0
    if held[0]:
        yield held
