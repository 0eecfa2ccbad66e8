"""Text rules on literal rows: Unicode, empties, ties."""

import pytest
from pyspark.sql import functions as F

from voxtable.functions import labels, text as tx
from voxtable.operators import transcripts


def value(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize(
    "fn,text,expected",
    [
        (tx.infer_language, "ಕನ್ನಡ", "kn"),
        (tx.infer_language, "नमस्ते", "hi"),
        (tx.infer_language, "తెలుగు", "te"),
        (tx.infer_language, "plain", None),
        (tx.infer_language, None, None),
        (tx.collapse_word_repeats, "The the THE the cat", "The cat"),
        (tx.collapse_word_repeats, "Été été été été x", "Été x"),
        (tx.collapse_word_repeats, "the the the theory", "the the the theory"),
        (tx.collapse_script_word_repeats, "ಸರ್ಕಾರ ಸರ್ಕಾರ ಸರ್ಕಾರ ಸರ್ಕಾರ ok", "ಸರ್ಕಾರ ok"),
        (tx.mark_vocalization, "a-a-a-a-a-a-a-a-a-a-a-a-a", "[vocalization]"),
        (tx.collapse_whole_string_loop, "abcdef" * 5, "abcdef"),
        (tx.collapse_whole_string_loop, "thank you " * 4 + "bye", "thank you bye"),
        (tx.drop_repeated_sentences, "Yes. Yes. No.", "Yes. No."),
        (tx.collapse_phrase_repeats, "so it goes so it goes so it goes on", "so it goes on"),
        (tx.strip_language_tag, "[Kannada] ಕನ್ನಡ", "ಕನ್ನಡ"),
        (tx.strip_speaker_prefixes, "Speaker 1: a\nPerson 2: b", "a b"),
        (tx.is_meaningful_speech, "[No speech detected]", False),
        (tx.is_meaningful_speech, "[vocalization]", False),
        (tx.is_meaningful_speech, "hello", True),
        (tx.is_likely_english, "hello there", True),
        (tx.clean_before_ngrams, None, ""),
        (labels.label_key, "dog", "dog"),
        (labels.label_key, "Bark", "dog_bark"),
        (labels.label_display, "Window rattle", "wind"),
        (labels.label_display, "Training", "rain"),
    ],
)
def test_text_rule(spark, fn, text, expected):
    assert value(spark, text, fn) == expected


def test_long_loops_do_not_exhaust_the_engine(spark):
    looped = spark.range(1).select(F.expr("concat('x ', repeat('word ', 50000), 'end')").alias("t"))
    row = looped.select(tx.collapse_word_repeats("t").alias("a"), tx.collapse_phrase_repeats("t").alias("b")).first()
    assert row.a == row.b == "x word end"


def test_sentences_keep_abbreviations(spark):
    got = value(spark, "Good morning Mrs. Roy. Hello Mrs. Gupta. How are you? Fine Oh really.", tx.split_sentences)
    assert got == ["Good morning Mrs. Roy.", "Hello Mrs. Gupta.", "How are you?", "Fine.", "Oh really."]


def test_times(spark):
    assert value(spark, "65.5", lambda c: tx.format_timestamp(c.cast("double"))) == "01:05.500"
    assert value(spark, None, lambda c: tx.format_timestamp(c.cast("double"))) == "--:--.---"
    assert value(spark, "3725", lambda c: tx.format_timestamp_short(c.cast("double"))) == "01:02:05"


def test_ngrams_keep_the_first_occurrence(spark):
    loop = "alpha beta gamma"
    text = f"{loop} one two three {loop} four five six {loop} seven"
    df = spark.createDataFrame([(1, text), (2, "too short to touch"), (3, None)], "id long, text string")
    got = {r.id: r.text for r in transcripts.collapse_ngrams(df).collect()}
    assert got == {1: f"{loop} one two three four five six seven", 2: "too short to touch", 3: None}
