"""Token ids in binary files: one zstandard frame a document, one dictionary for all, an index by offset."""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import groups_of, mounted, small_batches, texts
from .tokens import encoder

#: File: MAGIC, 8 bytes of the dictionary's SHA-256 (zeros: none), frames, index rows, then FOOT: number of rows and where they begin.
MAGIC = b"TOKIDS01"
FOOT = struct.Struct("<QQ")
#: An index row: document (and whether it has an id at all), where its frame begins, the frame's bytes, the number of its ids.
ENTRY = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("at", "<u8"), ("size", "<u8"), ("n", "<u8")])
DICTIONARY, MANIFEST = "dictionary.zst", "manifest"
MANIFEST_SCHEMA = "part long, path string, n_docs long, n_ids long"


def serialized(ids: bytes) -> bytes:
    """Ids of 32 bits with a leading byte 4, or of 16 bits with a leading 2 where all of them fit."""
    wide = np.frombuffer(ids, "<u4")
    return b"\x02" + wide.astype("<u2").tobytes() if not len(wide) or wide.max() < 1 << 16 else b"\x04" + ids


def restored(data: bytes) -> bytes:
    return data[1:] if data[:1] == b"\x04" else np.frombuffer(data, "<u2", offset=1).astype("<u4").tobytes()


def digest(dictionary: bytes) -> bytes:
    return hashlib.sha256(dictionary).digest()[:8] if dictionary else bytes(8)


def train_dictionary(docs: DataFrame, tokenizer: str, end: int, cut: str, max_docs: int = 1000, size: int = 65536) -> bytes:
    """A dictionary trained on about ``max_docs`` documents' arrays, drawn where they lie, of each the first 32 KiB; empty if too few.

    It decides the size of the frames, never the ids in them.
    """

    def read(batches):
        for (some,) in groups_of(batches, ["text"], 1 << 19):
            data = [serialized(x + end.to_bytes(4, "little"))[: 1 << 15] for x in encoder(tokenizer, cut).encode(some)]
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary())], ["data"])

    drawn = texts(docs).sample(min(1.0, max_docs / max(1, docs.count())), seed=5).select("text")
    samples = [bytes(r["data"]) for r in drawn.mapInArrow(read, "data binary").collect()]
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 8), samples).as_bytes() if len(samples) > 7 else b""
    except zstandard.ZstdError:  # the samples are too few or too alike
        return b""


class FileOfIds:
    """Random access to the documents of one file."""

    def __init__(self, path: str, dictionary: bytes):
        self.file = open(path, "rb")
        if self.file.read(8) != MAGIC or self.file.read(8) != digest(dictionary):
            raise ValueError(f"{path} isn't a file of ids, or was written with another dictionary")
        self.file.seek(-FOOT.size, os.SEEK_END)
        n, at = FOOT.unpack(self.file.read(FOOT.size))
        self.file.seek(at)
        self.index = np.frombuffer(self.file.read(n * ENTRY.itemsize), ENTRY)
        self.zstd = zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))

    def ids(self, row: int) -> bytes:
        """Ids of the document in an index row, as little-endian unsigned 32-bit integers."""
        self.file.seek(self.index["at"][row])
        return restored(self.zstd.decompress(self.file.read(self.index["size"][row])))

    def close(self) -> None:
        self.file.close()


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end: int, cut: str = "spaces", level: int = 3) -> DataFrame:
    """Write the ids of all documents, ``end`` after each, in ascending doc_id order; returns the manifest, one row a file.

    ``folder`` is a shared folder that every machine mounts. Each task writes one range of doc_id to a file of its own and
    renames it when it is whole, so a task that runs again replaces it with the same bytes. A null or empty text is the
    end id alone; null doc_ids come first; repeated rows are all written, in the order of their text's hash; an empty
    table makes no file; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    place = mounted(folder)
    dictionary = train_dictionary(docs, tokenizer, end, cut)
    os.makedirs(place, exist_ok=True)
    with open(f"{place}/{DICTIONARY}", "wb") as f:
        f.write(dictionary)
    sent = spark.sparkContext.broadcast(dictionary)

    def write(batches) -> Iterator[pa.RecordBatch]:
        words, task = sent.value, TaskContext.get()
        options = {"dict_data": zstandard.ZstdCompressionDict(words)} if words else {}
        zstd = zstandard.ZstdCompressor(level=level, **options)
        path = f"{place}/part-{task.partitionId():06d}.ids"
        own, index, at, total = f"{path}.{task.taskAttemptId()}", [], 16, 0
        with open(own, "wb") as f:
            f.write(MAGIC + digest(words))
            for docs_, some in groups_of(batches, ["doc_id", "text"], 1 << 20):
                for doc, data in zip(docs_, encoder(tokenizer, cut).encode(some), strict=True):
                    data += end.to_bytes(4, "little")
                    frame = zstd.compress(serialized(data))
                    f.write(frame)
                    index.append((doc or 0, doc is not None, at, len(frame), len(data) // 4))
                    at, total = at + len(frame), total + len(data) // 4
            f.write(_foot(index, at))
        if index:
            os.replace(own, path)
            row = [[task.partitionId()], [path], [len(index)], [total]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], ["part", "path", "n_docs", "n_ids"])
        else:
            os.remove(own)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = texts(docs).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ranged.mapInArrow(write, MANIFEST_SCHEMA).write.parquet(f"{folder}/{MANIFEST}")
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{folder}/{MANIFEST}")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit) from the files."""
    place = mounted(folder)
    manifest = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{folder}/{MANIFEST}")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def read(batches) -> Iterator[pa.RecordBatch]:
        with open(f"{place}/{DICTIONARY}", "rb") as f:
            dictionary = f.read()
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                file = FileOfIds(path, dictionary)
                n = file.index["n"].astype(np.int64)
                starts, held, size = base + np.cumsum(n) - n, [], 0
                for row, (entry, start) in enumerate(zip(file.index, starts, strict=True)):
                    ids = file.ids(row)
                    held.append((int(entry["doc_id"]) if entry["known"] else None, int(start), int(entry["n"]), ids))
                    size += len(ids)
                    if size > 1 << 22:
                        yield _rows(held)
                        held, size = [], 0
                if held:
                    yield _rows(held)
                file.close()

    spread = files.select("path", "base").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def _foot(index: list[tuple], at: int) -> bytes:
    return np.array(index, ENTRY).tobytes() + FOOT.pack(len(index), at)


def _rows(held: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(zip(*held, strict=True), kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids"])
