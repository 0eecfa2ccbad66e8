"""Ordered operators against sequential restatements, on random rows cut into many chunks."""

import random

from voxtable.operators import folds, islands
from voxtable.operators.ordered import Timeline, by_position, carry, number
from pyspark.sql import functions as F

SEGMENT = "recording_id long, pos long, speaker string, start_sec double, end_sec double"


def random_segments(seed, recordings=6, n=60):
    """One recording holds a third of all rows."""
    rng = random.Random(seed)
    rows = []
    for rec in range(recordings):
        t = 0.0
        for pos in range(n * recordings // 3 if rec == 0 else n):
            t += rng.choice([0.0, 0.1, 0.5, 1.0, 3.0])
            rows.append((rec, pos, rng.choice("ab"), round(t, 3), round(t + rng.choice([0.1, 0.3, 1.0, 2.0, 9.0]), 3)))
    return rows


def by_recording(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[3], r[4], r[1])):
        out.setdefault(r[0], []).append(r)
    return out


def test_merge_segments_is_sequential_merge(spark):
    rows = random_segments(1)
    expected = set()
    for rec, segs in by_recording(rows).items():
        kept = []
        for _, _, sp, a, b in segs:
            if kept and kept[-1][0] == sp and a - kept[-1][2] <= 0.6:
                kept[-1][2] = max(kept[-1][2], b)
            else:
                kept.append([sp, a, b])
        expected |= {(rec, *k) for k in kept}
    df = spark.createDataFrame(rows, SEGMENT)
    got = islands.merge_segments(df, 0.6, chunk_sec=7.0).collect()
    assert {(r.recording_id, r.speaker, r.start_sec, r.end_sec) for r in got} == expected


def test_resolve_overlaps_keeps_one_timeline(spark):
    rows = random_segments(2)
    df = spark.createDataFrame(rows, SEGMENT)
    one = folds.resolve_overlaps(df, chunk_sec=1e9).collect()
    many = folds.resolve_overlaps(df, chunk_sec=5.0).collect()
    assert sorted(one) == sorted(many)
    timeline = {}
    for r in sorted(many, key=lambda r: (r.recording_id, r.start_sec)):
        assert r.start_sec >= timeline.get(r.recording_id, 0.0) - 1e-9
        timeline[r.recording_id] = r.end_sec


def test_pack_windows_does_not_depend_on_chunks(spark):
    df = spark.createDataFrame(random_segments(3), SEGMENT)
    one = folds.pack_windows(df, chunk_sec=1e9).collect()
    many = folds.pack_windows(df, chunk_sec=5.0).collect()
    assert sorted(one) == sorted(many)


def test_smooth_switches_is_sequential(spark):
    rng = random.Random(4)
    rows, expected = [], {}
    for rec in range(8):
        words = [[rng.choice("abc"), i * 0.2, (i + 1) * 0.2] for i in range(50)]
        rows += [(rec, i, w[0], w[1], w[2]) for i, w in enumerate(words)]
        i = 0
        while i < len(words):
            j = i
            while j < len(words) and words[j][0] == words[i][0]:
                j += 1
            if words[j - 1][2] - words[i][1] < 0.3 and 0 < i and j < len(words) and words[i - 1][0] == words[j][0]:
                for k in range(i, j):
                    words[k][0] = words[i - 1][0]
            i = j
        expected.update({(rec, i): w[0] for i, w in enumerate(words)})
    df = spark.createDataFrame(rows, SEGMENT)
    got = islands.smooth_switches(df, 0.3, chunk_rows=7).collect()
    assert {(r.recording_id, r.pos): r.speaker for r in got} == expected


def test_carry_kinds_cross_chunks(spark):
    rows = [(1, i, None if i % 3 else i) for i in range(20)]
    df = spark.createDataFrame(rows, "recording_id long, pos long, v long")
    out = carry(
        df, by_position(chunk_rows=4),
        {"s": ("sum", F.col("pos")), "m": ("max_before", F.col("pos")), "l": ("last", F.col("v")), "g": ("lag", F.col("v")), "x": ("next", F.col("v"))},
    ).orderBy("pos").collect()
    for i, r in enumerate(out):
        assert r.s == sum(range(i + 1))
        assert r.m == (i - 1 if i else None)
        assert r.l == i - i % 3
        assert r.g == (None if i == 0 or (i - 1) % 3 else i - 1)
        nxt = (i // 3 + 1) * 3
        assert r.x == (nxt if nxt < 20 else None)


def test_number_without_a_key(spark):
    df = spark.range(100).withColumnRenamed("id", "pos")
    got = number(df, Timeline(("pos",), F.floor(F.col("pos") / 9), ())).collect()
    assert {(r.pos, r.row_no) for r in got} == {(i, i + 1) for i in range(100)}
