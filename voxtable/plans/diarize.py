"""From frame energies, embeddings and timed text to speaker turns, for all recordings at once.

The neural stages stay outside: ``embed`` is the user's scorer over time spans, and
phrases or words arrive as tables.  Every per-recording choice (language, number of
speakers) is a column or a filter, never a driver-side branch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import shorter_than
from ..operators.embeddings import label_speakers
from ..operators.folds import drop_near_repeats, resolve_overlaps
from ..operators.intervals import assign_phrases, assign_timed_text, prefer_given_speakers
from ..operators.islands import ID, merge_asr_turns, merge_segments, smooth_switches, words_to_turns
from ..operators.ordered import Timeline, attach, by_position, durable, join_text, number, spread
from ..operators.speakers import collapse_to_single, drop_micro_segments, is_kannada, looks_like_monologue, normalize_turns
from ..operators.transcripts import filter_script_mismatch
from ..operators.windows import region_windows, speech_regions


def speaker_segments(
    frames: DataFrame, recordings: DataFrame, embed: Callable[[DataFrame], DataFrame], max_speakers: int = 6, threshold: float = 0.35
) -> DataFrame:
    """Speech regions labelled by speaker.

    ``recordings`` has ``recording_id, n_samples, sample_rate, lang``; ``embed`` adds
    ``vec`` to rows with ``recording_id, pos, start_sec, end_sec``.
    """
    kn = is_kannada("lang")
    regions = durable(
        speech_regions(
            frames, recordings,
            F.when(kn, F.lit(0.4)).otherwise(F.lit(0.3)),
            F.when(kn, F.lit(0.45)).otherwise(F.lit(0.35)),
        )
    )
    strict = recordings.select(ID, kn.alias("strict"))
    windows = region_windows(regions, recordings)
    in_turn = Timeline(("region", "nth"), F.floor(F.col("region") / F.lit(64)))
    windows = number(windows, in_turn, "pos").select(ID, "pos", "start_sec", "end_sec")
    named = label_speakers(
        attach(embed(regions), strict), attach(embed(windows), strict), max_speakers, threshold, F.col("strict")
    )
    named = attach(named, strict)
    plain = merge_segments(named.filter("not strict").drop("strict"), 0.45)
    careful = durable(merge_segments(drop_micro_segments(named.filter("strict").drop("strict"), 0.4), 0.6))
    verdict = durable(attach(careful, looks_like_monologue(careful)))
    one = collapse_to_single(verdict.filter("monologue").drop("monologue"))
    return plain.unionByName(verdict.filter("not monologue").drop("monologue")).unionByName(one)


def spoken_turns(segments: DataFrame, phrases: DataFrame, recordings: DataFrame) -> DataFrame:
    """Timed phrases placed on a clean speaker timeline and merged to turns."""
    line = durable(merge_segments(durable(resolve_overlaps(durable(segments))), 1.0))
    lang = recordings.select(ID, "lang")
    people = line.groupBy(ID).agg(F.countDistinct("speaker").alias("n"))
    kind = people.join(lang, ID, "left").select(
        ID, "lang",
        F.when(is_kannada("lang"), "kannada").when(F.col("n") >= 2, "several").otherwise("single").alias("kind"),
    )
    said = filter_script_mismatch(spread(attach(phrases, kind, (ID,), "inner"), ID, "pos"))
    # written before the filter, which would otherwise clean every text a second time
    said = durable(said.drop("lang")).filter(~shorter_than("text", 2, " .,?!"))
    part = lambda k: said.filter(F.col("kind") == k).drop("kind")
    kannada, single, several = part("kannada"), part("single"), part("several")
    keep = lambda rows, kept: rows.join(kept.select(ID, "pos"), [ID, "pos"], "left_semi")
    alone = keep(kannada, drop_near_repeats(kannada, "overlap", 0.75)).unionByName(
        keep(single, drop_near_repeats(single, "jaccard", 0.92))
    )
    placed = assign_timed_text(alone, line).select(
        ID, F.col("pos").alias("turn"), "speaker", "start_sec", "end_sec", "text", F.col("text").alias("text_original"),
        F.lit(0.0).alias("confidence"), F.lit("vad").alias("alignment"),
    )
    return merge_asr_turns(durable(placed.unionByName(assign_phrases(several, line))))


def diarize(
    frames: DataFrame, recordings: DataFrame, embed: Callable[[DataFrame], DataFrame], phrases: DataFrame, max_speakers: int = 6
) -> DataFrame:
    """Speaker turns per recording from energies, embeddings and timed phrases."""
    segments = speaker_segments(frames, recordings, embed, max_speakers)
    turns = durable(spoken_turns(segments, phrases, recordings))
    return normalize_turns(attach(turns, recordings.select(ID, "lang")), "lang")


def align_words(words: DataFrame, segments: DataFrame, min_conf: float = 0.35) -> tuple[DataFrame, DataFrame]:
    """Word-level alignment: (turns, plain text per recording).

    Recordings that end with fewer than two speakers give no turns.
    """
    named = durable(prefer_given_speakers(words, segments, min_conf))
    turns = durable(words_to_turns(durable(smooth_switches(named)))).withColumn("alignment", F.lit("whisperx"))
    people = turns.groupBy(ID).agg(F.countDistinct("speaker").alias("n")).filter("n >= 2")
    plain = join_text(words, by_position(), {"transcript": (F.col("word"), " ")})
    rounded = turns.withColumns(
        {"start_sec": F.round("start_sec", 2), "end_sec": F.round("end_sec", 2), "confidence": F.round("confidence", 3)}
    )
    return rounded.join(people.select(ID), ID, "left_semi"), plain
