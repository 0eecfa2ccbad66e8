"""Per-recording summaries and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.languages import PRIMARY, language_label
from ..functions.text import NO_SPEECH, format_timestamp, is_meaningful_speech, strip
from .islands import ID
from .ordered import attach, by_position, join_text


def language_vote(votes: DataFrame, preferred: tuple[str, ...] = PRIMARY) -> DataFrame:
    """Most frequent code among the preferred ones, else among all; the first seen wins ties."""
    code = F.coalesce("code", F.lit(""))
    counted = votes.groupBy(ID, code.alias("code")).agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    rank = F.struct(F.col("code").isin(*preferred), "n", -F.col("first"))
    best = F.max_by("code", F.when(F.col("code") != "", rank))
    return counted.groupBy(ID).agg(F.coalesce(best, F.lit("")).alias("language"))


def _first_seen(rows: DataFrame, value: Column, order: str, out: str) -> DataFrame:
    """Distinct values in order of first appearance; the values of a recording are few."""
    seen = rows.groupBy(ID, value.alias("__v")).agg(F.min(order).alias("__at")).filter("__v <> ''")
    listed = F.array_sort(F.collect_list(F.struct("__at", "__v")))
    return seen.groupBy(ID).agg(F.transform(listed, lambda x: x["__v"]).alias(out))


def language_rollup(chunks: DataFrame) -> DataFrame:
    """Codes in first-appearance order, their names, and the primary code or ``multi``."""
    rolled = _first_seen(chunks, F.coalesce("code", F.lit("")), "pos", "languages")
    names = F.transform("languages", lambda c: language_label(c))
    rolled = rolled.withColumn("language_names", names)
    single = F.size("languages") == 1
    return rolled.select(
        ID, "languages", "language_names",
        F.when(single, F.get("languages", F.lit(0))).otherwise(F.lit("multi")).alias("language"),
        F.array_join("language_names", ", ").alias("language_name"),
    )


def detected_speakers(turns: DataFrame) -> DataFrame:
    return _first_seen(turns, strip(F.coalesce("speaker", F.lit(""))), "turn", "speakers")


def num_speakers(turns: DataFrame) -> DataFrame:
    return turns.groupBy(ID).agg(F.countDistinct("speaker").alias("num_speakers"))


def words_per_recording(words: DataFrame) -> DataFrame:
    return words.groupBy(ID).agg(F.count("*").alias("word_count"))


def conversation_transcript(turns: DataFrame) -> DataFrame:
    """Blocks of time range, speaker and text."""
    text = strip(F.coalesce("text", F.lit("")))
    who = strip(F.coalesce(F.nullif(F.col("speaker"), F.lit("")), F.lit("Speaker 1")))
    block = F.concat(
        F.lit("["), format_timestamp("start_sec"), F.lit(" - "), format_timestamp("end_sec"), F.lit("]\n"),
        who, F.lit("\n"), text,
    )
    return join_text(turns, by_position("turn"), {"formatted_transcript": (F.when(text != "", block), "\n\n")})


def speaker_lines(turns: DataFrame, sep: str = "\n\n", indent: str = "", out: str = "transcript") -> DataFrame:
    """``speaker: text`` lines of the turns that have text."""
    text = F.coalesce("text", F.lit(""))
    line = F.concat(F.lit(indent), "speaker", F.lit(": "), text)
    return join_text(turns, by_position("turn"), {out: (F.when(strip(text) != "", line), sep)})


def plain_transcript(turns: DataFrame) -> DataFrame:
    """Texts in one line; the original falls back to the text."""
    text = strip(F.coalesce("text", F.lit("")))
    original = strip(F.coalesce(F.nullif(F.col("text_original"), F.lit("")), F.col("text"), F.lit("")))
    return join_text(
        turns, by_position("turn"),
        {
            "transcript": (F.when(text != "", text), " "),
            "transcript_original": (F.when(original != "", original), " "),
        },
    )


def build_context(recs: DataFrame, turns: DataFrame, scores: bool = False, template: str | None = None) -> DataFrame:
    """One text block describing each recording.

    ``recs`` has ``recording_id, transcript, emotion, events``; ``template`` may name
    ``{transcript}``, ``{events}`` and ``{emotion}``.
    """
    text = strip(F.coalesce("text", F.lit("")))
    line = F.concat(F.coalesce("speaker", F.lit("Speaker")), F.lit(": "), text)
    spoken = join_text(turns, by_position("turn"), {"__lines": (F.when(text != "", line), "\n")})
    out = attach(recs, spoken)
    speech = F.coalesce(F.nullif(strip("transcript"), F.lit("")), F.lit(NO_SPEECH))
    shown = lambda e: F.concat(e["label"], F.format_string(" (%.2f)", F.coalesce(e["score"], F.lit(0.0)))) if scores else e["label"]
    sounds = F.coalesce(
        F.nullif(F.array_join(F.transform("events", shown), ", "), F.lit("")),
        F.lit("[No environmental sounds detected]"),
    )
    emotion = F.coalesce(F.nullif(strip("emotion"), F.lit("")), F.lit("unknown"))
    if template is not None:
        context = F.lit(template)
        for name, value in (("transcript", speech), ("events", sounds), ("emotion", emotion)):
            context = F.replace(context, F.lit("{" + name + "}"), value)
    else:
        context = F.concat_ws(
            "\n",
            F.concat(F.lit("Speech (transcript): "), speech),
            F.when(F.col("__lines") != "", F.concat(F.lit("Speaker-separated transcript:\n"), F.col("__lines"))),
            F.concat(F.lit("Speaker emotion (estimated): "), emotion),
            F.concat(F.lit("Non-speech (environmental sounds): "), sounds),
        )
    return out.select(ID, context.alias("context"))


def sound_summary(labels) -> Column:
    c = F.col(labels) if isinstance(labels, str) else labels
    other = F.filter(c, lambda l: ~F.lower(l).isin("speech", "conversation"))
    return (
        F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, F.lit("No distinct environmental sounds detected."))
        .when(F.size(other) == 0, F.lit("General speech-like audio."))
        .otherwise(F.array_join(other, ", "))
    )


def template_answer(recs: DataFrame, turns: DataFrame) -> DataFrame:
    """Rule-based answer per recording.

    ``recs`` has ``recording_id, transcript, transcript_original, language, languages,
    emotion, sounds``.
    """
    lines = speaker_lines(turns.withColumn("text", strip("text")), "\n", "  ", "__lines")
    who = num_speakers(turns).withColumnRenamed("num_speakers", "__n")
    out = attach(attach(recs, lines), who)
    english = strip(F.coalesce("transcript", F.lit("")))
    original = strip(F.coalesce("transcript_original", F.lit("")))
    speech = F.when(english != "", english).otherwise(original)
    heard = is_meaningful_speech("transcript") | is_meaningful_speech("transcript_original")
    sounds = F.coalesce(F.size("sounds"), F.lit(0)) > 0
    mood = strip(F.coalesce(F.nullif(F.col("emotion"), F.lit("")), F.lit("neutral")))
    mood = F.concat(F.upper(F.substring(mood, 1, 1)), F.lower(F.substring(mood, 2, 2**31 - 1)))
    foreign = (F.lower(F.coalesce(F.nullif(F.col("language"), F.lit("")), F.lit("en"))) != "en") | (
        F.coalesce(F.size("languages"), F.lit(0)) > 1
    )
    quoted = F.when(foreign & (original != ""), original).otherwise(speech)
    said = (
        F.when(
            F.coalesce("__n", F.lit(0)) >= 2,
            F.concat_ws("\n", F.lit("Conversation by speaker:"), F.nullif(F.col("__lines"), F.lit(""))),
        )
        .when(heard, F.concat(F.lit('Speech heard: "'), quoted, F.lit('"')))
        .when(speech != "", F.lit("Non-speech vocalizations are present (e.g. barking or background noise)."))
    )
    clear = (mood != "") & ~F.lower(mood).isin("unknown", "neutral")
    answer = F.concat_ws(
        "\n",
        F.when(sounds, F.concat(F.lit("Sounds detected: "), sound_summary("sounds"), F.lit("."))),
        said,
        F.when(clear | heard, F.concat(F.lit("Speaker emotion: "), mood, F.lit("."))),
    )
    nothing = F.lit("No clear speech or identifiable sounds were detected in this clip.")
    return out.select(ID, F.when(heard | sounds, answer).otherwise(nothing).alias("answer"))


def speaker_emotions(
    turns: DataFrame, preds: DataFrame, clip: DataFrame, min_sec: float = 0.35, budget_sec: float = 12.0
) -> DataFrame:
    """One emotion per speaker from the slices of speech within a time budget.

    ``preds`` has ``recording_id, turn, emotion`` (a slice's label), ``clip`` has
    ``recording_id, emotion`` (the recording's label).  Slices are weighted by their
    time within the budget; as each has at least ``min_sec``, a bounded number of
    first slices is enough, which the rank filter keeps small before any shuffle.
    A speaker with slices but no label on them is neutral. Where a recording has no
    slice at all, its own label, if any, is that of every speaker.
    """
    usable = turns.filter(
        (strip(F.coalesce("speaker", F.lit(""))) != "") & (F.col("end_sec") - F.col("start_sec") >= min_sec)
    ).select(ID, "turn", strip("speaker").alias("speaker"), (F.col("end_sec") - F.col("start_sec")).alias("sec"))
    w = Window.partitionBy(ID, "speaker").orderBy("turn")
    most = int(budget_sec / min_sec) + 1
    first = usable.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= most)
    before = F.coalesce(F.sum("sec").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    cut = first.withColumn("sec", F.least("sec", F.lit(budget_sec) - before)).filter("sec > 0")
    said = attach(cut, preds.filter("emotion <> ''").select(ID, "turn", "emotion"), (ID, "turn"))
    weight = said.groupBy(ID, "speaker", "emotion").agg(F.sum("sec").alias("sec"), F.min("turn").alias("first"))
    best = F.max_by("emotion", F.when(F.col("emotion").isNotNull(), F.struct("sec", -F.col("first"))))
    voted = weight.groupBy(ID, "speaker").agg(F.coalesce(best, F.lit("neutral")).alias("emotion"))
    with_vote = voted.groupBy(ID).agg(F.lit(True).alias("__heard"))
    rest = attach(clip.filter("emotion <> ''"), with_vote).filter("__heard is null").drop("__heard")
    names = detected_speakers(turns)
    rest = attach(rest, names).select(
        ID, F.explode(F.coalesce("speakers", F.array(F.lit("Speaker 1")))).alias("speaker"), "emotion"
    )
    return voted.unionByName(rest)


def emotion_map(per_speaker: DataFrame) -> DataFrame:
    entries = F.collect_list(F.struct("speaker", "emotion"))
    return per_speaker.groupBy(ID).agg(F.map_from_entries(F.array_sort(entries)).alias("speaker_emotions"))


def emotion_block(speakers, emotion, emotions) -> Column:
    """``speaker:`` and label blocks; a missing label falls back to the clip's, then neutral."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    fallback = F.coalesce(F.nullif(strip(F.coalesce(c(emotion), F.lit(""))), F.lit("")), F.lit("neutral"))
    given = F.coalesce(c(emotions), F.create_map().cast("map<string,string>"))
    some = lambda a: F.when(F.size(a) > 0, a)
    names = F.coalesce(some(c(speakers)), some(F.map_keys(given)), F.array(F.lit("Speaker 1")))
    label = lambda s: F.coalesce(F.nullif(strip(given[s]), F.lit("")), fallback)
    return F.array_join(F.transform(names, lambda s: F.concat(s, F.lit(":\n"), label(s))), "\n\n")
