"""Chunks stay apart whatever the rows went through before; folds across many chunks."""

import re

import pytest
from pyspark.sql import functions as F

from voxtable.operators import embeddings, folds, intervals, speakers
from voxtable.operators.ordered import attach, by_position, carry, join_text, runs
from voxtable.plans.diarize import align_words


@pytest.fixture
def shuffled(spark):
    """Plans as for large tables: no side is small enough to be broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def windows_by_chunk(df):
    """For each window over (key, chunk), the columns of the exchange that it stands on."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    found = []
    for i, line in enumerate(lines):
        if re.search(r"\bWindow \[", line) and re.search(r", \[[^\]]*__chunk#\d+L?\]", line):
            below = next(x for x in lines[i:] if "Exchange" in x or "Scan" in x)
            found.append(below)
    return found


TURNS = "recording_id long, pos long, speaker string, start_sec double, end_sec double, text string, text_original string"


def test_chunks_after_a_join(shuffled):
    rows = shuffled.createDataFrame([(1, i, "ab"[i % 2], float(i), i + 1.0, "t", "t") for i in range(50)], TURNS)
    per_key = rows.groupBy("recording_id").agg(F.count("*").alias("n"))
    joined = attach(rows, per_key)
    by = by_position(chunk_rows=8)
    vectors = rows.select("recording_id", "pos", F.array(F.lit(1.0), F.col("start_sec")).alias("vec"), F.pmod("pos", F.lit(2)).alias("label"))
    turns = rows.withColumnRenamed("pos", "turn")
    plans = [
        carry(joined, by, {"before": ("sum_before", F.col("n"))}),
        runs(joined, by, lambda a, b: a("speaker") != b("speaker"), ["speaker"]),
        embeddings.split_quality(vectors),
        speakers.collapse_weak_speaker(turns),
        speakers.collapse_ping_pong(turns),
    ]
    for df in plans:
        under = windows_by_chunk(df)
        assert under and all("__chunk" in x for x in under), under
    assert "__chunk" in join_text(joined, by, {"all": (F.col("text"), " ")})._jdf.queryExecution().executedPlan().toString()


def sequential(texts, alike):
    kept, last = [], None
    for pos, text in enumerate(texts):
        if last is None or not alike(set(last.split()), set(text.split())):
            kept.append(pos)
            last = text
    return kept


@pytest.mark.parametrize("measure", ["jaccard", "overlap"])
def test_repeats_across_chunks(spark, measure):
    """Equal texts pass one state through all chunks; another recording changes often."""
    texts = {1: ["same words here"] * 40, 2: [f"w{i // 3} x{i // 5} y" for i in range(40)], 3: ["only one"]}
    df = spark.createDataFrame([(k, i, t) for k, ts in texts.items() for i, t in enumerate(ts)], "recording_id long, pos long, text string")
    size = {"jaccard": lambda a, b: len(a | b), "overlap": lambda a, b: min(len(a), len(b))}[measure]
    got = folds.drop_near_repeats(df, measure, 0.6, chunk_rows=4).collect()
    for k, ts in texts.items():
        assert sorted(r.pos for r in got if r.recording_id == k) == sequential(ts, lambda a, b: len(a & b) / size(a, b) >= 0.6)


def test_phrases_across_chunks(spark):
    said = ["a b c", "a b c", "a b", "d", "d e f", "d e f", "g", "", "a b c", "a b"] * 4
    rows = [(1, i, t, float(i), i + 1.4) for i, t in enumerate(said)]
    df = spark.createDataFrame(rows, "recording_id long, pos long, text string, start_sec double, end_sec double")
    one = sorted(folds.dedupe_phrases(df, chunk_rows=1000).collect())
    assert sorted(folds.dedupe_phrases(df, chunk_rows=3).collect()) == one
    kept = []
    for _, pos, text, a, b in rows:
        if not text:
            continue
        last = kept[-1] if kept else None
        if last and text == last[1]:
            last[3] = max(last[3], b)
        elif last and text in last[1] and b <= last[3] + 0.5:
            pass
        elif last and last[1] in text and a <= last[3] + 0.5:
            last[0], last[1], last[3] = pos, text, max(last[3], b)
        else:
            kept.append([pos, text, a, b])
    assert [(r.pos, r.text, r.start_sec, r.end_sec) for r in one] == [tuple(k) for k in kept]


def test_nested_words_go_into_turns(spark):
    word = "struct<word:string,start_sec:double,end_sec:double,score:double,speaker:string>"
    nested = spark.createDataFrame(
        [(1, 0, 0.0, 2.0, "hi there", [("hi", 0.0, 1.0, 0.9, None), ("there", 1.0, 2.0, 0.9, None)]), (1, 1, 5.0, 7.0, "good day", None), (2, 0, 0.0, 1.0, "alone", None)],
        f"recording_id long, seg long, start_sec double, end_sec double, text string, words array<{word}>",
    )
    segments = spark.createDataFrame([(1, 0, "A", 0.0, 3.0), (1, 1, "B", 4.0, 8.0), (2, 0, "A", 0.0, 1.0)], "recording_id long, pos long, speaker string, start_sec double, end_sec double")
    turns, plain = align_words(intervals.flatten_words(nested), segments)
    assert sorted((r.recording_id, r.speaker, r.text) for r in turns.collect()) == [(1, "Speaker 1", "hi there"), (1, "Speaker 2", "good day")]
    assert {r.recording_id: r.transcript for r in plain.collect()} == {1: "hi there good day", 2: "alone"}
