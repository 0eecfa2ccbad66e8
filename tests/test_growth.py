"""Steps whose time would grow faster than their input, or that one task would do alone."""

import random

from pyspark.sql import functions as F

from voxtable.functions import text as tx
from voxtable.operators.embeddings import cluster_speakers
from voxtable.operators.transcripts import clean_transcript
from voxtable.plans.analyze import spoken_pieces


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_clustering_is_dealt_out(spark):
    """Few bytes but much work: the recordings must not be put together in one task for their small size."""
    rows = [(r, p, [float(p % 2), 1.0 - p % 2, 0.1 * r]) for r in range(4) for p in range(6)]
    named = cluster_speakers(spark.createDataFrame(rows, "recording_id long, pos long, vec array<double>"))
    assert "REPARTITION_BY_NUM" in plan(named)
    assert named.count() == len(rows)


def test_phrases_as_by_the_pattern(spark):
    """Spaces are looked at, not every length at every character; the texts are those that the pattern gives."""
    draw = random.Random(5)
    texts = [None, "", " ", "abcd abcd", "abc abc", "x" * 80 + (" " + "x" * 80) * 2, "y" * 81 + " " + "y" * 81]
    for _ in range(1500):
        letters = draw.choice(["ab ", "abc  ", "ab \n", "a😀 b", "ಅಆ ab"])
        t = "".join(draw.choice(letters) for _ in range(draw.randint(1, 150)))
        i = draw.randrange(len(t))
        texts.append(t[:i] + (t[i : i + draw.randint(3, 90)] + " ") * draw.randint(1, 4) + t[i:])
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    both = df.select("t", tx.collapse_phrase_repeats("t").alias("new"), tx.collapse_phrase_pattern("t").alias("old"))
    assert both.filter(~F.col("new").eqNullSafe(F.col("old"))).collect() == []
    assert both.filter("new <> t").count() > 300
    assert "{2,78}" not in plan(clean_transcript(df, "t"))


def test_pieces_get_their_language_once(spark):
    """The codes of the pieces are found once for texts and languages, and not again by each reader."""
    rows = [(1, 0, "Hello there friends", None, "auto"), (1, 1, "ನಮಸ್ಕಾರ", "Greetings", "auto"), (2, 0, " ", None, "en"), (None, 0, "Hello you all", None, None)]
    found = spoken_pieces(spark.createDataFrame(rows, "recording_id long, pos long, original string, translated string, lang string"))
    assert "A-Za-z" not in plan(found)
    got = {r.recording_id: (r.transcript, r.language, r.languages) for r in found.collect()}
    assert got == {1: ("Hello there friends ನಮಸ್ಕಾರ", "multi", ["en", "kn"]), None: ("Hello you all", "en", ["en"])}


def test_words_travel_once_a_step(spark, monkeypatch):
    """Names found for words, runs and turns come to the chunk where the words lie; the words aren't dealt out by run or speaker."""
    from voxtable.operators import intervals, islands

    plans = []

    def noted(module):
        before = module.durable
        monkeypatch.setattr(module, "durable", lambda df: plans.append(plan(df)) or before(df))

    noted(intervals), noted(islands)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        schema = "recording_id long, pos long, word string, start_sec double, end_sec double, score double, speaker string, confidence double"
        rows = [(r, p, f"w{p}", float(p), p + 0.9, 0.5, None, None) for r in (1, 2, None) for p in range(20)]
        words = spark.createDataFrame(rows, schema)
        segments = spark.createDataFrame(
            [(r, i, "AB"[i % 2], 4.0 * i + 0.3, 4.0 * i + 4.3) for r in (1, 2) for i in range(5)], "recording_id long, pos long, speaker string, start_sec double, end_sec double"
        )
        named = intervals.prefer_given_speakers(words, segments)
        # before: a join of all words by recording, and two by recording and position
        assert "hashpartitioning(coalesce(recording_id" not in plan(named) and "hashpartitioning(coalesce(pos" not in plan(named)
        got = {(r.recording_id, r.pos): (r.speaker, r.confidence and round(r.confidence, 6)) for r in named.collect()}
        assert {k: got[1, k] for k in (0, 1, 4, 5)} == {0: ("A", 0.666667), 1: ("A", 1.0), 4: ("B", 0.666667), 5: ("B", 1.0)}
        assert got[None, 3] == (None, None) and len(got) == 60
        plans.clear()
        turns = islands.words_to_turns(intervals.durable(named), chunk_rows=3)
        assert len(plans) == 2 and plans[1].count("Exchange hash") == 1 and "word#" not in plan(turns)
        said = sorted((r.turn, r.speaker, r.text, round(r.confidence, 6)) for r in turns.collect() if r.recording_id == 1)
        assert [(t, s, x) for t, s, x, _ in said][:2] == [(0, "Speaker 1", "w0 w1 w2 w3"), (4, "Speaker 2", "w4 w5 w6 w7")]
        first = 0.6 / 0.9
        assert said[0][3] == round((((first + 1) / 2 + 1) / 2 + 1) / 2, 6)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
