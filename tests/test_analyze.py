"""The whole plan on literal rows: pieces in several languages, recordings without a piece or a turn."""

import pytest

from voxtable.plans.analyze import analyze, spoken_pieces

KANNADA = "ನಮಸ್ಕಾರ ಎಲ್ಲರಿಗೂ ಸ್ವಾಗತ"
ENGLISH = "this is the first thing that we have to say to you"


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(
        [
            (1, 0, ENGLISH, None, "de"), (1, 1, KANNADA, "hello all", None), (1, 2, "  ", None, "fr"), (1, 3, ENGLISH, "", "en"),
            (2, 0, ENGLISH, None, "auto"), (3, 0, None, "lost", "kn"),
        ],
        "recording_id long, pos long, original string, translated string, lang string",
    )


def test_pieces_have_a_language_each(chunks):
    got = {r.recording_id: r for r in spoken_pieces(chunks).collect()}
    assert sorted(got) == [1, 2]
    assert got[1].languages == ["en", "kn"] and got[1].language == "multi" and got[1].language_name == "English, Kannada"
    assert got[1].original == f"{ENGLISH} {KANNADA} {ENGLISH}"
    assert (got[2].languages, got[2].language, got[2].transcript) == (["en"], "en", ENGLISH)


def test_record_of_several_languages(spark, chunks):
    recs = spark.createDataFrame([(1, "calm"), (2, ""), (3, None)], "recording_id long, emotion string")
    turns = spark.createDataFrame(
        [(2, 0, "A", 0.0, 2.0, "we are here now", "we are here now"), (2, 1, "B", 2.0, 4.0, "yes we are all here", "yes we are all here")],
        "recording_id long, turn long, speaker string, start_sec double, end_sec double, text string, text_original string",
    )
    hits = spark.createDataFrame([(1, 0, 0, "Dog", 0.9)], "recording_id long, detector_rank int, pos long, label string, score double")
    preds = spark.createDataFrame([(2, 0, "happy"), (2, 1, "sad")], "recording_id long, turn long, emotion string")
    got = {r.recording_id: r for r in analyze(recs, turns, hits, preds, chunks=chunks).collect()}
    assert sorted(got) == [1, 2, 3]
    assert got[1].language == "multi" and got[1].language_names == ["English", "Kannada"] and not got[1].speaker_turns
    assert [x.text for x in got[2].speaker_turns] == ["we are here now", "yes we are all here"] and got[2].num_speakers == 2
    assert got[3].transcript == "" and got[3].languages == [] and got[3].language == "en"
    assert all(r.summary == r.answer for r in got.values())
