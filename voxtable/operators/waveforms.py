"""Waveforms as tables of blocks: no recording is ever one cell, one group or one task.

A block table has ``recording_id, sample_rate, block, first_sample, samples``: the samples of a recording from
``first_sample`` on. The blocks of a recording follow each other without a gap, and no block but the first and the last
is shorter than a frame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.signal import rms, sum_of
from .islands import ID
from .ordered import Timeline, attach, number

BLOCK_SAMPLES = 1 << 16
FRAME_SEC, HOP_SEC = 0.025, 0.010
COLUMNS = [ID, "sample_rate", "block", "first_sample", "samples"]


def samples_in(rate: Column, seconds: float) -> Column:
    return F.greatest(F.lit(1), F.floor(rate * F.lit(seconds)).cast("int"))


def gather(rows: DataFrame, tl: Timeline, sample: str, rate: Column, size: int = BLOCK_SAMPLES) -> DataFrame:
    """Blocks of a table with one row a sample, in the order of the time line."""
    key = tl.key[0]
    placed = number(rows, tl, "__nth").withColumn("__i", F.col("__nth") - 1)
    placed = placed.withColumn("block", F.floor(F.col("__i") / size))
    ordered = F.array_sort(F.collect_list(F.struct("__i", F.col(sample).cast("float").alias("x"))))
    out = placed.groupBy(key, "block").agg(ordered.alias("__all"))
    return out.select(
        F.col(key).alias(ID), rate.alias("sample_rate"), "block", (F.col("block") * size).alias("first_sample"), F.transform("__all", lambda s: s["x"]).alias("samples")
    )


def cut(waveforms: DataFrame, size: int = BLOCK_SAMPLES) -> DataFrame:
    """Blocks of waveforms that come as one array each."""
    last = F.floor((F.size("samples") - 1) / size).cast("int")
    parts = F.when(F.size("samples") > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("samples", i * size + 1, size)))
    rows = waveforms.select(ID, "sample_rate", F.posexplode(parts).alias("block", "samples"))
    return rows.select(ID, "sample_rate", F.col("block").cast("long").alias("block"), (F.col("block").cast("long") * size).alias("first_sample"), "samples")


def frame_rms(blocks: DataFrame) -> DataFrame:
    """Root mean square of overlapping frames, one row per frame: ``recording_id, frame_idx, rms``.

    A frame belongs to the block in which it begins. What it needs of the next block, less than a frame, comes as a halo
    from there, so only that part is sent to a neighbour. Frames that the recording's end cuts off are left out.
    """
    sized = blocks.withColumns({"__frame": samples_in(F.col("sample_rate"), FRAME_SEC), "__hop": samples_in(F.col("sample_rate"), HOP_SEC)})
    halo = sized.filter("block > 0").select(ID, (F.col("block") - 1).alias("block"), F.slice("samples", F.lit(1), F.greatest(F.col("__frame") - 1, F.lit(0))).alias("__halo"))
    whole = F.when(F.col("__halo").isNull(), F.col("samples")).otherwise(F.concat("samples", F.col("__halo")))
    joined = attach(sized, halo, (ID, "block")).withColumn("__n", F.size("samples")).withColumn("samples", whole)
    first = F.ceil(F.col("first_sample") / F.col("__hop")).cast("long")
    begin = F.col("first_sample") + F.least(F.col("__n") - 1, F.size("samples") - F.col("__frame"))
    last = F.floor(begin / F.col("__hop")).cast("long")
    at = lambda i: (i * F.col("__hop") - F.col("first_sample") + 1).cast("int")
    levels = F.transform(
        F.sequence(first, last), lambda i: F.struct(i.alias("frame_idx"), let(F.slice("samples", at(i), F.col("__frame")), lambda part: rms(part)).alias("rms"))
    )
    return joined.filter(first <= last).select(ID, F.inline(levels)).withColumn("frame_idx", F.col("frame_idx").cast("int"))


def peak_normalize(blocks: DataFrame) -> DataFrame:
    """Samples over the recording's largest absolute sample, as doubles; a silent recording stays as it is."""
    peaks = blocks.groupBy(ID).agg(F.max(F.array_max(F.transform("samples", F.abs))).cast("double").alias("__peak"))
    divisor = F.when(F.col("__peak") > 0, F.col("__peak")).otherwise(F.lit(1.0))
    scaled = F.transform("samples", lambda x: x.cast("double") / divisor)
    return attach(blocks, peaks).select(*[scaled.alias(c) if c == "samples" else c for c in COLUMNS])


def loudness(blocks: DataFrame, key: Sequence[str] = (ID,), floor: float = 1e-12) -> DataFrame:
    """Root mean square by key: energy and length of the blocks, added up."""
    energy = sum_of(F.transform("samples", lambda x: x.cast("double") * x.cast("double")))
    sums = blocks.groupBy(*key).agg(F.sum(energy).alias("e"), F.sum(F.size("samples")).alias("n"))
    return sums.filter("n > 0").select(*key, F.sqrt(F.col("e") / F.col("n") + F.lit(floor)).alias("rms"))


def skip_silent(blocks: DataFrame, floor_rms: float, key: Sequence[str] = (ID,)) -> DataFrame:
    """Blocks of recordings (or of windows, by ``key``) that are not nearly silent."""
    loud = loudness(blocks, key).filter(F.col("rms") >= floor_rms).select(*key, F.lit(True).alias("__loud"))
    return attach(blocks, loud, key, "inner").drop("__loud")


def slice_span(blocks: DataFrame, start: Column, end: Column) -> DataFrame:
    """Samples of a span in seconds, clamped to the recording; ``first_sample`` counts from the span's first sample.

    Blocks outside the span are left out before anything is read of them but their place.
    """
    first = F.greatest(F.lit(0), F.floor(start * F.col("sample_rate")).cast("long"))
    last = F.floor(end * F.col("sample_rate")).cast("long")
    inside = blocks.withColumns({"__a": first, "__b": last})
    inside = inside.filter((F.col("first_sample") < F.col("__b")) & (F.col("first_sample") + F.size("samples") > F.col("__a")))
    skip = F.greatest(F.col("__a") - F.col("first_sample"), F.lit(0))
    length = F.least(F.col("__b") - F.col("first_sample"), F.size("samples").cast("long")) - skip
    cut_ = F.slice("samples", (skip + 1).cast("int"), length.cast("int"))
    return inside.select(
        ID, "sample_rate", "block", (F.greatest(F.col("first_sample"), F.col("__a")) - F.col("__a")).alias("first_sample"), cut_.alias("samples")
    )


def cap_duration(blocks: DataFrame, seconds: float) -> DataFrame:
    """The first ``seconds`` of each recording."""
    return slice_span(blocks, F.lit(0.0), F.lit(float(seconds)))


def samples(blocks: DataFrame) -> DataFrame:
    """One row a sample: ``recording_id, i, x``."""
    rows = blocks.select(ID, "first_sample", F.posexplode("samples").alias("__at", "x"))
    return rows.select(ID, (F.col("first_sample") + F.col("__at")).cast("long").alias("i"), F.col("x").cast("double").alias("x"))
