"""Waveforms in blocks against the same rules on whole arrays."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtable.operators import waveforms
from voxtable.sources import files

RATE = 400  # a frame is 10 samples, a hop 4


@pytest.fixture(scope="module")
def whole():
    draw = random.Random(7)
    sizes = {0: 1000, 1: 9, 2: 10, 3: 11, 4: 64, 5: 65, 6: 73, 7: 128, 8: 400, None: 300, 9: 1}
    return {k: np.array([draw.uniform(-1, 1) * (k != 8) for _ in range(n)], np.float32) for k, n in sizes.items()}


@pytest.fixture(scope="module")
def cells(spark, whole):
    rows = [(k, RATE, [float(x) for x in v]) for k, v in whole.items()] + [(50, RATE, [])]
    return spark.createDataFrame(rows, "recording_id long, sample_rate int, samples array<float>")


def by_recording(df, value):
    out = {}
    for r in df.collect():
        out.setdefault(r["recording_id"], []).append(r)
    return {k: [r[value] for r in sorted(v, key=lambda r: r["i"] if "i" in r else r["frame_idx"])] for k, v in out.items()}


@pytest.mark.parametrize("size", [16, 64, 1 << 16])
def test_frames_across_blocks(cells, whole, size):
    got = by_recording(waveforms.frame_rms(waveforms.cut(cells, size)), "rms")
    for k, x in whole.items():
        want = [np.sqrt(np.mean(x[i : i + 10].astype(float) ** 2) + 1e-12) for i in range(0, len(x) - 9, 4)]
        assert got.get(k, []) == pytest.approx(want), k


def test_frames_of_a_span(cells, whole):
    """The first block of a span is as short as the span leaves it."""
    span = waveforms.slice_span(waveforms.cut(cells, 16), F.lit(37 / RATE), F.lit(500 / RATE))
    got = by_recording(waveforms.frame_rms(span), "rms")
    for k, x in whole.items():
        part = x[37:500]
        assert got.get(k, []) == pytest.approx([np.sqrt(np.mean(part[i : i + 10].astype(float) ** 2) + 1e-12) for i in range(0, len(part) - 9, 4)]), k


def test_samples_in_blocks(cells, whole):
    blocks = waveforms.cut(cells, 16)
    normal = by_recording(waveforms.samples(waveforms.peak_normalize(blocks)), "x")
    capped = by_recording(waveforms.samples(waveforms.cap_duration(blocks, 0.1)), "x")
    loud = {r["recording_id"] for r in waveforms.skip_silent(blocks, 0.1).collect()}
    for k, x in whole.items():
        top = float(np.abs(x).max())
        assert normal[k] == pytest.approx([float(v) / (top or 1.0) for v in x])
        assert capped[k] == pytest.approx([float(v) for v in x[:40]])
        assert (k in loud) == (np.sqrt(np.mean(x.astype(float) ** 2) + 1e-12) >= 0.1)


def test_gathered_in_order(spark, whole):
    rows = [(k, float(i), float(v)) for k, x in whole.items() for i, v in enumerate(x)]
    random.Random(1).shuffle(rows)
    from voxtable.operators.ordered import Timeline

    df = spark.createDataFrame(rows, "user long, t double, v double")
    blocks = waveforms.gather(df, Timeline(("t",), F.floor(F.col("t") / 50), ("user",)), "v", F.lit(RATE), 64)
    assert blocks.columns == waveforms.COLUMNS and blocks.filter(F.size("samples") > 64).count() == 0
    got = by_recording(waveforms.samples(blocks), "x")
    assert {k: pytest.approx(v) for k, v in got.items()} == {k: [float(v) for v in x] for k, x in whole.items()}


def test_wav_files_through_a_folder(spark, cells, whole, tmp_path):
    folder = f"{tmp_path}/wav"
    made = files.write_pcm_wav(waveforms.cut(cells.filter("recording_id is not null and recording_id < 50"), 16), folder).collect()
    assert {r["name"]: r["length"] for r in made} == {f"{k}.wav": 44 + 2 * len(x) for k, x in whole.items() if k is not None}
    read = spark.read.format("binaryFile").load(f"{folder}/*.wav").select(files.stem("path").cast("long").alias("recording_id"), "content")
    blocks = files.unpack_pcm_wav(read, size=50)
    assert blocks.filter(F.size("samples") > 50).count() == 0
    got = by_recording(waveforms.samples(blocks), "x")
    for k, x in whole.items():
        if k is not None:
            assert got[k] == pytest.approx([float(v) for v in x], abs=1e-4)
    listed = files.scan_recordings(spark, folder, "*.wav")
    assert {r["name"]: r["length"] for r in listed.collect()} == {r["name"]: r["length"] for r in made}
    plan = listed.select("name", "length")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_channels_and_other_files(spark):
    def wav(kind, channels, bits, data):
        octets = lambda v, n: int(v).to_bytes(n, "little")
        form = octets(kind, 2) + octets(channels, 2) + octets(8000, 4) + octets(0, 4) + octets(0, 2) + octets(bits, 2)
        return b"RIFF" + octets(0, 4) + b"WAVEfmt " + octets(16, 4) + form + b"junk" + octets(3, 4) + b"abc\0" + b"data" + octets(len(data), 4) + data

    rows = [
        (1, wav(1, 2, 16, np.array([[16384, 0], [-16384, -16384]], "<i2").tobytes())),
        (2, wav(1, 1, 8, bytes([128, 192]))),
        (3, wav(3, 1, 32, np.array([0.5, 0.25, -1.0], "<f4").tobytes())),
        (4, b"RIFFxxxx"), (5, b""), (6, None), (7, wav(1, 1, 24, b"abc")),
    ]
    got = files.unpack_pcm_wav(spark.createDataFrame(rows, "recording_id long, content binary"))
    assert {r["recording_id"]: (r["sample_rate"], r["samples"]) for r in got.collect()} == {
        1: (8000, [0.25, -0.5]), 2: (8000, [0.0, 0.5]), 3: (8000, [0.5, 0.25, -1.0])
    }


def test_batches_of_files_are_bounded_by_bytes(spark):
    files.bounded_batches(spark, 1)
    try:
        df = spark.range(40).repartition(1).select(F.expr("cast(repeat('x', 200000) as binary)").alias("content"))

        def sizes(batches):
            for b in batches:
                import pyarrow as pa

                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

        got = [r["n"] for r in df.mapInArrow(sizes, "n long").collect()]
        assert sum(got) == 40 and max(got) <= 6
    finally:
        files.bounded_batches(spark)
