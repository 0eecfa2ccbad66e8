"""Collapse rules by language, and a recording's final text."""

from pyspark.sql import functions as F

from voxtable.operators import speakers

SCHEMA = "recording_id long, turn long, speaker string, text string, text_original string, start_sec double, end_sec double, alignment string, lang string"


def turns(spark):
    rows = []

    def add(rec, lang, parts, alignment="vad"):
        t = 0.0
        for i, (who, sec) in enumerate(parts):
            rows.append((rec, i, who, f"{who}{i}", f"{who}{i}", t, t + sec, alignment, lang))
            t += sec

    add(1, "en", [("a", 10.0), ("b", 1.0), ("a", 5.0)])
    add(2, "kn", [("a", 3.0), ("b", 2.0), ("a", 2.0), ("b", 2.0)])
    add(3, "en", [("a", 30.0), ("b", 25.0)])
    add(4, "en", [("a", 10.0), ("b", 1.0)], "whisperx")
    add(5, "kn", [("a", 20.0), ("b", 19.0), ("a", 20.0), ("b", 0.2)])
    return spark.createDataFrame(rows, SCHEMA)


def test_normalize_turns_by_language(spark):
    df = turns(spark)
    out = speakers.normalize_turns(df, "lang")
    got = {}
    for r in out.orderBy("recording_id", "turn").collect():
        got.setdefault(r.recording_id, []).append((r.speaker, r.text))
    assert got[1] == [("a", "a0 b1 a2")]
    assert got[2] == [("a", "a0 b1 a2 b3")]
    assert got[3] == [("a", "a0"), ("b", "b1")]
    assert got[4] == [("a", "a0"), ("b", "b1")]
    assert got[5] == [("a", "a0"), ("b", "b1"), ("a", "a2")]
    langs = df.groupBy("recording_id").agg(F.max("lang").alias("lang"))
    final = {r.recording_id: r for r in speakers.turns_result(out, langs).collect()}
    assert (final[1].num_speakers, final[1].transcript, final[1].shows_turns) == (1, "a0 b1 a2", True)
    assert (final[2].num_speakers, final[2].shows_turns) == (1, False)
    assert (final[3].num_speakers, final[3].transcript) == (2, "a: a0\n\nb: b1")
