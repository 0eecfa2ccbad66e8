"""One analysis record per recording."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.languages import language_label
from ..functions.text import display_text, resolve_language, strip, strip_speaker_prefixes
from ..operators.islands import ID
from ..operators.ordered import attach, by_position, durable, join_text
from ..operators.report import (
    build_context, conversation_transcript, detected_speakers, emotion_map, language_rollup, num_speakers, speaker_emotions,
    template_answer,
)
from ..operators.sounds import add_speech_event, event_labels, events_array, fuse_detectors
from ..operators.speakers import dialogue_from_text, normalize_turns, turns_result
from ..operators.transcripts import clean_transcript


def chosen_turns(voiced: DataFrame, spoken: DataFrame, cues: dict[str, str] | None = None) -> DataFrame:
    """Turns by preference: several voices, else a dialogue found in English text, else one voice.

    ``spoken`` has ``recording_id, transcript, language``.
    """
    voices = num_speakers(voiced)
    many = voices.filter("num_speakers >= 2").select(ID)
    rest = spoken.filter("language = 'en'").join(many, ID, "left_anti")
    rest = rest.select(ID, strip_speaker_prefixes("transcript").alias("text"))
    dialogue = dialogue_from_text(rest, "text", cues)
    talked = dialogue.select(ID).distinct()
    single = voiced.join(many, ID, "left_anti").join(talked, ID, "left_anti")
    out = voiced.join(many, ID, "left_semi")
    for more in (dialogue, single):
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def spoken_pieces(chunks: DataFrame) -> DataFrame:
    """Texts and languages per recording from its transcribed pieces, each in a language of its own.

    ``chunks`` has ``recording_id, pos, original, translated, lang``; pieces without text are left out.  The result has
    ``original, transcript, language, language_name, languages, language_names``; the language of a recording with
    several is ``multi``, its name lists them.
    """
    pieces = chunks.withColumn("original", strip(F.coalesce("original", F.lit("")))).filter("original <> ''")
    pieces = pieces.withColumn("code", resolve_language("original", "lang"))
    # written, as both the texts and the languages need the codes, which take most of the time
    pieces = durable(pieces.select(ID, "pos", "original", "code", display_text("original", "translated", "code").alias("transcript")))
    texts = join_text(pieces, by_position(), {c: (F.col(c), " ") for c in ("original", "transcript")})
    return attach(texts, language_rollup(pieces))


def _languages(recs: DataFrame, chunks: DataFrame | None) -> DataFrame:
    if chunks is None:
        one = recs.withColumn("language", resolve_language("original", "lang"))
        one = one.withColumn("transcript", display_text("original", "translated", "language"))
        return one.withColumns(
            {
                "language_name": language_label("language"),
                "languages": F.array("language"),
                "language_names": F.array(language_label("language")),
            }
        )
    none = F.array().cast("array<string>")
    many = attach(recs.select(ID, "emotion"), spoken_pieces(chunks))
    return many.withColumns(
        {
            "original": F.coalesce("original", F.lit("")),
            "transcript": F.coalesce("transcript", F.lit("")),
            "language": F.coalesce("language", F.lit("en")),
            "language_name": F.coalesce("language_name", language_label(F.lit("en"))),
            "languages": F.coalesce("languages", none),
            "language_names": F.coalesce("language_names", none),
        }
    )


def listed_turns(turns: DataFrame) -> DataFrame:
    """The turns of a recording in order, as one array of structs."""
    fields = [c for c in ("turn", "speaker", "start_sec", "end_sec", "text", "text_original") if c in turns.columns]
    return turns.groupBy(ID).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("speaker_turns"))


def analyze(
    recs: DataFrame, turns: DataFrame, hits: DataFrame, preds: DataFrame, cues: dict[str, str] | None = None,
    chunks: DataFrame | None = None,
) -> DataFrame:
    """Transcript, languages, turns, sounds, emotion, context and answer of every recording.

    ``recs`` has ``recording_id, original, translated, lang, emotion``; ``turns`` the
    turns found by voice (may lack recordings), ``hits`` detector hits and ``preds``
    an emotion per turn.  With ``chunks`` (see :func:`spoken_pieces`) texts and languages
    come from them, and ``recs`` needs only ``recording_id, emotion``.
    """
    given = _languages(recs, chunks)
    # an original that is the transcript is cleaned once
    given = given.withColumn("__same", F.col("original").eqNullSafe(F.col("transcript")))
    given = given.withColumn("original", F.when(~F.col("__same"), F.col("original")))
    spoken = clean_transcript(clean_transcript(given, "transcript"), "original")
    original = F.when(F.col("__same"), F.col("transcript")).otherwise(F.col("original"))
    spoken = durable(spoken.withColumn("transcript_original", original).drop("original", "__same"))

    langs = spoken.select(ID, F.col("language").alias("lang"))
    voiced = durable(normalize_turns(attach(turns, langs), "lang"))
    used = durable(chosen_turns(voiced, spoken.select(ID, "transcript", "language"), cues))
    said = durable(turns_result(used, langs))
    shown = used.join(said.filter("shows_turns").select(ID), ID, "left_semi")

    base = attach(spoken, said.select(ID, F.col("num_speakers"), F.col("transcript").alias("__t"), F.col("transcript_original").alias("__o")))
    base = base.withColumns(
        {
            "transcript": F.coalesce(F.nullif(F.col("__t"), F.lit("")), F.col("transcript")),
            "transcript_original": F.coalesce(F.nullif(F.col("__o"), F.lit("")), F.col("transcript_original")),
            "num_speakers": F.coalesce("num_speakers", F.lit(0)),
        }
    ).drop("__t", "__o")
    base = attach(base, events_array(fuse_detectors(hits)))
    base = base.withColumn("events", add_speech_event("events", "transcript", "transcript_original"))
    base = durable(base.withColumn("sounds", event_labels("events")))

    moods = emotion_map(speaker_emotions(shown, preds, recs.select(ID, "emotion")))
    for extra in (
        detected_speakers(shown), conversation_transcript(shown), listed_turns(shown), moods, build_context(base, shown),
        template_answer(base, shown),
    ):
        base = attach(base, extra)
    return base.select(
        ID, "transcript", "transcript_original", "language", "language_name", "languages", "language_names",
        "speaker_turns", "num_speakers",
        F.coalesce("speakers", F.array().cast("array<string>")).alias("detected_speakers"),
        F.coalesce(F.nullif(F.col("formatted_transcript"), F.lit("")), F.col("transcript")).alias("formatted_transcript"),
        F.col("events").alias("sound_events"),
        F.coalesce(F.nullif(strip("emotion"), F.lit("")), F.lit("neutral")).alias("emotion"),
        "speaker_emotions", "context", "answer", F.col("answer").alias("summary"),
    )
