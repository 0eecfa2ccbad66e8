"""Reading recordings and upload requests."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import preview, strip
from ..operators.waveforms import BLOCK_SAMPLES

# Accepted suffixes and their types.
MIME = {
    ".wav": "audio/wav",
    ".mp3": "audio/mpeg",
    ".flac": "audio/flac",
    ".ogg": "audio/ogg",
    ".m4a": "audio/mp4",
    ".mp4": "audio/mp4",
    ".webm": "audio/webm",
}
ACCEPTED = (".wav", ".mp3", ".flac", ".ogg", ".m4a", ".mp4", ".mkv", ".webm", ".avi", ".mov")
MB = 1024 * 1024


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def file_name(path) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def suffix(path) -> Column:
    """Last suffix in lower case; names that only start with a dot have none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def stem(path) -> Column:
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]+$", "$1")


def bounded_batches(spark: SparkSession, megabytes: int = 64) -> None:
    """Bound the bytes of an Arrow batch, as files differ in length by orders of magnitude; a single longer file is a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{megabytes}m")


def mounted(folder: str) -> str:
    """The path under which every machine sees a shared folder that is mounted."""
    url = urlparse(folder)
    if url.scheme not in ("", "file"):
        raise ValueError(f"{folder} must be a mounted folder, as tasks write single files into it")
    return url.path


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write each row's ``content`` (binary) to a file called ``name`` in a mounted shared folder; returns name and length.

    A file is written under another name first and renamed when it is whole, so a task that runs again does no harm. Rows
    without a name or content are left out.
    """
    bounded_batches(files.sparkSession)
    place = mounted(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(place, exist_ok=True)
        for b in batches:
            lengths = []
            for name, content in zip(b.column("name").to_pylist(), b.column("content"), strict=True):
                own = f"{place}/.{uuid.uuid4().hex}"
                with open(own, "wb") as f:
                    lengths.append(f.write(content.as_buffer()))
                os.replace(own, f"{place}/{name}")
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(lengths, pa.int64())], ["name", "length"])

    rows = files.filter("name is not null and content is not null").select("name", F.col("content").cast("binary").alias("content"))
    return rows.mapInArrow(write, "name string, length long")


def write_pcm_wav(blocks: DataFrame, folder: str, scale: float = 32767.0, id_: str = "recording_id") -> DataFrame:
    """Write each recording's blocks as a 16-bit mono WAV called by its id; returns name and length.

    The blocks of a recording stream through one task in order, as they go into one file; it holds one block at a time.
    """
    place = mounted(folder)
    ordered = blocks.select(id_, "sample_rate", "block", "samples").repartition(id_).sortWithinPartitions(id_, "block")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(place, exist_ok=True)
        f = name = own = None
        size = 0

        def close():
            for at, octets in ((4, 36 + size), (40, size)):
                f.seek(at)
                f.write(octets.to_bytes(4, "little"))
            f.close()
            os.replace(own, f"{place}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([44 + size], pa.int64())], ["name", "length"])

        for b in batches:
            for key, rate, part in zip(b.column(id_).to_pylist(), b.column("sample_rate").to_pylist(), b.column("samples"), strict=True):
                if name != f"{key}.wav":
                    if f:
                        yield close()
                    name, own, size = f"{key}.wav", f"{place}/.{uuid.uuid4().hex}", 0
                    f = open(own, "wb")
                    octets = lambda value, n: int(value).to_bytes(n, "little")
                    f.write(b"RIFF\0\0\0\0WAVEfmt " + octets(16, 4) + octets(1, 2) + octets(1, 2) + octets(rate, 4) + octets(rate * 2, 4) + octets(2, 2) + octets(16, 2) + b"data\0\0\0\0")
                x = np.asarray(part.values, np.float64) * scale
                size += f.write(np.clip(np.trunc(x + np.copysign(0.5, x)), -32768, 32767).astype("<i2").tobytes())
        if f:
            yield close()

    return ordered.mapInArrow(write, "name string, length long")


def scan_recordings(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files under a folder with name, length and content hash."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return describe_files(reader.load(path))


def describe_files(files: DataFrame) -> DataFrame:
    return files.select(
        "path", file_name("path").alias("name"), F.col("length").cast("long").alias("length"), F.sha2("content", 256).alias("sha256")
    )


def mime_of(name) -> Column:
    types = F.create_map(*[F.lit(x) for x in chain.from_iterable(MIME.items())])
    return F.coalesce(types[suffix(name)], F.lit("application/octet-stream"))


def safe_stem(name) -> Column:
    """A file stem fit for a name: other characters become ``_``, at most 40 remain."""
    base = stem(F.coalesce(F.nullif(_c(name), F.lit("")), F.lit("audio")))
    clean = F.btrim(F.regexp_replace(base, r"[^\p{L}\p{N}_\-]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(F.substring(clean, 1, 40), F.lit("")), F.lit("audio"))


def admit(files: DataFrame, max_mb: int = 500, max_question: int = 1000) -> DataFrame:
    """Requests with the reason they are rejected (null when accepted) and the language kept.

    ``files`` has ``name, question, language, content`` or ``length``.
    """
    size = F.col("length") if "length" in files.columns else F.length("content")
    blank = lambda c: strip(F.coalesce(F.col(c), F.lit(""))) == ""
    reason = (
        F.when(blank("name"), "no file")
        .when(blank("question"), "empty question")
        .when(F.length("question") > max_question, "question too long")
        .when(~suffix("name").isin(*ACCEPTED), "file type not allowed")
        .when(F.coalesce(size, F.lit(0)) == 0, "empty file")
        .when(size / MB > max_mb, "file too large")
    )
    lang = F.lower(strip(F.coalesce("language", F.lit(""))))
    return files.withColumns(
        {"reject_reason": reason, "language": F.when(lang.isin("en", "kn"), lang).otherwise(F.lit(""))}
    )


def identity_record(df: DataFrame, stage: str) -> DataFrame:
    """Trace record of a recording.

    ``df`` has ``upload_name, audio_bytes, audio_sha256, wav_samples, sample_rate, text,
    language``.
    """
    seconds = F.col("wav_samples") / F.col("sample_rate")
    return df.select(
        F.lit(stage).alias("stage"),
        "upload_name", "audio_bytes", "audio_sha256", "wav_samples",
        F.when(seconds > 0, F.round(seconds, 3)).alias("wav_duration_sec"),
        F.coalesce(F.nullif(F.col("language"), F.lit("")), F.lit("auto")).alias("language"),
        preview("text").alias("whisper_preview"),
    )


@dataclass(frozen=True)
class Pcm:
    """Where the samples of a PCM WAV lie and how they are written."""

    rate: int
    channels: int
    dtype: str
    at: int
    frames: int

    def samples(self, data: bytes | pa.Buffer, first: int, n: int) -> np.ndarray:
        """Mono samples, the mean of the channels, of ``n`` frames from ``first`` on."""
        width = np.dtype(self.dtype).itemsize
        raw = np.frombuffer(data, self.dtype, n * self.channels, self.at + first * self.channels * width).astype(np.float32)
        if self.dtype == "u1":
            raw = (raw - 128.0) / 128.0
        elif self.dtype != "<f4":
            raw = raw / float(2 ** (8 * width - 1))
        return raw.reshape(-1, self.channels).mean(axis=1)


def pcm_header(data: bytes | memoryview) -> Pcm | None:
    """The layout of a PCM WAV, or None for anything else."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        body = at + 8
        if name == b"fmt ":
            kind, channels, rate = np.frombuffer(data, "<u2,<u2,<u4", 1, body)[0]
            bits = int.from_bytes(data[body + 14 : body + 16], "little")
            form = int(kind), int(channels), int(rate), bits
        elif name == b"data" and form:
            kind, channels, rate, bits = form
            dtype = {(1, 8): "u1", (1, 16): "<i2", (1, 32): "<i4", (3, 32): "<f4"}.get((kind, bits))
            if dtype is None or channels < 1:
                return None
            return Pcm(rate, channels, dtype, body, min(size, len(data) - body) // (channels * bits // 8))
        at = body + size + (size & 1)
    return None


def unpack_pcm_wav(files: DataFrame, max_sec: float | None = None, id_: str = "recording_id", size: int = BLOCK_SAMPLES) -> DataFrame:
    """PCM WAV bytes to blocks of mono samples; only the first ``max_sec`` seconds are decoded.

    Files come to Python in batches bounded by bytes and leave it block by block, so a task holds one batch and one block.
    """
    bounded_batches(files.sparkSession)
    id_type = files.schema[id_].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                content = batch.column("content")[i]
                data = content.as_buffer() if content.is_valid else b""
                pcm = pcm_header(memoryview(data))
                if pcm is None:
                    continue
                n = min(pcm.frames, int(max_sec * pcm.rate)) if max_sec else pcm.frames
                for first in range(0, max(n, 1), size):
                    part = pcm.samples(data, first, min(size, n - first))
                    columns = [batch.column(id_).slice(i, 1), pa.array([pcm.rate], pa.int32()), *(pa.array([x], pa.int64()) for x in (first // size, first)), pa.array([part], pa.list_(pa.float32()))]
                    yield pa.RecordBatch.from_arrays(columns, [id_, "sample_rate", "block", "first_sample", "samples"])

    return files.select(id_, "content").mapInArrow(decode, f"{id_} {id_type}, sample_rate int, block long, first_sample long, samples array<float>")
