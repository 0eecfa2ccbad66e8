"""Interval joins against all pairs: spans of very different lengths, points, ties, recordings without an id."""

import random

import pytest
from pyspark.sql import functions as F

from voxtable.operators import intervals

SPAN = "recording_id long, pos long, speaker string, start_sec double, end_sec double"
WORD = "recording_id long, pos long, word string, start_sec double, end_sec double, score double, speaker string, confidence double"


@pytest.fixture(scope="module")
def spans():
    draw = random.Random(5)

    def some(n, k):
        out = []
        for pos in range(n):
            a = draw.uniform(-50, 2000)
            out.append((k, pos, draw.choice("abc"), a, a + draw.choice([0.0, 0.3, 5.0, 30.0, 31.0, 120.0, 480.0, 2500.0])))
        return out

    return {s: [r for k in (1, 2, None) for r in some(n, k)] for s, n in (("l", 60), ("r", 40))}


def sides(spark, spans):
    left, right = (spark.createDataFrame(spans[s], SPAN) for s in "lr")
    return intervals._left(left), intervals._right(right)


def test_pairs(spark, spans):
    got = [(r["recording_id"], r["l_pos"], r["r_pos"]) for r in intervals.overlap_pairs(*sides(spark, spans)).collect()]
    want = [(a[0], a[1], b[1]) for a in spans["l"] for b in spans["r"] if a[0] == b[0] and a[3] <= b[4] and b[3] <= a[4]]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_a_long_span_is_few_rows(spark):
    """A span of a day beside words of a quarter of a second: rows that meet grow with the pairs, not with the buckets."""
    day = spark.createDataFrame([(1, 0, "a", 0.0, 86400.0)], SPAN)
    words = spark.range(2000).select(F.lit(1).cast("long").alias("recording_id"), F.col("id").alias("l_pos"), (F.col("id") * 0.25).alias("l_start"), (F.col("id") * 0.25 + 0.25).alias("l_end"))
    pairs = intervals.overlap_pairs(words, intervals._right(day))
    assert pairs.count() == 2000
    plan = pairs._jdf.queryExecution().executedPlan()
    listed = intervals._level("start_sec", "end_sec", 30.0)
    level = day.select(listed.alias("k")).first()["k"]
    assert 30.0 * 4**level >= 86400.0 > 30.0 * 4 ** (level - 1) and plan is not None


def overlap(a, b):
    return max(0.0, min(a[4], b[4]) - max(a[3], b[3]))


def test_words(spark):
    draw = random.Random(9)
    words, segments, want = [], [], {}
    for k in (1, 2, None):
        mine = []
        for pos in range(12):
            a = round(draw.uniform(0, 60), 2)
            mine.append((k, pos, draw.choice("abc"), a, a + draw.choice([0.1, 2.0, 40.0])))
        segments += mine
        last = None
        for pos in range(80):
            a = pos * 0.9
            w = (k, pos, "x", a, a + draw.choice([0.05, 0.4, 1.5]))
            words.append((*w, 0.9, None, None))
            best = max(mine, key=lambda s: (overlap(w, s), -s[1]))
            length, mid = max(w[4] - w[3], 1e-3), (w[3] + w[4]) / 2
            if overlap(w, best) > 0:
                own, conf = best[2], overlap(w, best) / length
            else:
                own, conf = min(mine, key=lambda s: (min(abs(mid - s[3]), abs(mid - s[4])), s[1]))[2], 0.25
            last = own if conf >= 0.35 or pos == 0 else last
            want[k, pos] = last
    got = intervals.assign_words(spark.createDataFrame(words, WORD), spark.createDataFrame(segments, SPAN))
    assert {(r["recording_id"], r["pos"]): r["speaker"] for r in got.collect()} == want
