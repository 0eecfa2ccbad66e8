"""Deciding how many people really speak: collapse rules and dialogue splitting.

Rules that look at a whole recording are computed as per-recording aggregates and
joined back, so a long recording is aggregated in parallel.  Limits may be columns,
which lets every recording follow the rules of its own language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import turn_duration
from ..functions.text import DIALOGUE_CUES, strip
from .islands import ID, merge_consecutive, merge_segments, switch_stats
from .ordered import CHUNK_ROWS, attach, by_position, by_time, carry, durable, join_text
from .transcripts import sentences


def talk_stats(turns: DataFrame) -> DataFrame:
    """Talk time, turn count, share and first turn per speaker."""
    who = turns.withColumn("__sec", turn_duration(turns)).groupBy(ID, "speaker").agg(
        F.sum("__sec").alias("talk_sec"), F.count("*").alias("n_turns"), F.min("turn").alias("first_turn")
    )
    total = who.groupBy(ID).agg(F.sum("talk_sec").alias("__total"))
    share = F.when(F.col("__total") > 0, F.col("talk_sec") / F.col("__total"))
    return attach(who, total).select(ID, "speaker", "talk_sec", "n_turns", "first_turn", share.alias("share"))


def _balance(turns: DataFrame) -> DataFrame:
    """Per recording: the speakers with most and least talk time (first to speak wins ties)."""
    who = talk_stats(turns)
    return who.groupBy(ID).agg(
        F.count("*").alias("n_speakers"),
        F.max_by("speaker", F.struct("talk_sec", -F.col("first_turn"))).alias("major"),
        F.min(F.struct("talk_sec", (-F.col("first_turn")).alias("o"), "n_turns", "share")).alias("least"),
        F.sum("talk_sec").alias("total_sec"),
    )


def _relabel(turns: DataFrame, verdict: DataFrame) -> DataFrame:
    """Give all turns of a collapsing recording to one speaker and merge them.

    ``verdict`` has ``recording_id, __to``, null where nothing collapses.  Merging
    consecutive turns changes nothing in a recording already merged, but the others
    must stay as they are, so only the collapsing ones pass through it.
    """
    # one row a recording, read by both branches
    marked = attach(turns, durable(verdict))
    same = marked.filter("__to is null").drop("__to")
    moved = marked.filter("__to is not null").withColumn("speaker", F.col("__to")).drop("__to")
    return same.unionByName(merge_consecutive(moved), allowMissingColumns=True)


def collapse_weak_speaker(turns: DataFrame, ratio=0.05, turns_max=2) -> DataFrame:
    """When the smallest speaker is negligible in time and turns, everything goes to the largest."""
    per_rec = _balance(turns)
    if isinstance(ratio, Column):
        per_rec = per_rec.join(_limits(turns, ratio=ratio, turns_max=turns_max), ID)
        ratio, turns_max = F.col("ratio"), F.col("turns_max")
    weak = (
        (F.col("n_speakers") >= 2)
        & (F.col("total_sec") > 0)
        & (F.col("least.share") < ratio)
        & (F.col("least.n_turns") <= turns_max)
    )
    return _relabel(turns, per_rec.select(ID, F.when(weak, F.col("major")).alias("__to")))


def _limits(turns: DataFrame, **columns: Column) -> DataFrame:
    return turns.groupBy(ID).agg(*[F.max(c).alias(n) for n, c in columns.items()])


def collapse_ping_pong(turns: DataFrame, ratio=0.7, mean_sec=5.0) -> DataFrame:
    """Two voices changing at nearly every short turn are one voice cut in pieces."""
    per_rec = switch_stats(turns).join(_balance(turns), ID)
    if isinstance(ratio, Column):
        per_rec = per_rec.join(_limits(turns, ratio=ratio, mean_max=mean_sec), ID)
        ratio, mean_sec = F.col("ratio"), F.col("mean_max")
    fake = (
        (F.col("n_turns") >= 4)
        & (F.col("n_speakers") == 2)
        & (F.col("switch_ratio") >= ratio)
        & (F.col("mean_sec") <= mean_sec)
    )
    return _relabel(turns, per_rec.select(ID, F.when(fake, F.col("major")).alias("__to")))


def looks_like_monologue(segments: DataFrame) -> DataFrame:
    """Per recording, whether two segment labels look like one person."""
    tl = by_time()
    marked = carry(segments, tl, {"__prev": ("lag", F.col("speaker"))})
    sec = F.greatest(F.lit(0.0), F.col("end_sec") - F.col("start_sec"))
    overall = marked.groupBy(ID).agg(
        F.count("*").alias("n"),
        F.sum((F.col("__prev") != F.col("speaker")).cast("int")).alias("switches"),
        F.avg(sec).alias("mean_sec"),
    )
    share = segments.groupBy(ID, "speaker").agg(F.sum(sec).alias("sec"))
    share = share.groupBy(ID).agg(
        F.count("*").alias("speakers"), F.min("sec").alias("least"), F.sum("sec").alias("total")
    )
    both = overall.join(share, ID)
    switch = F.coalesce("switches", F.lit(0)) / F.greatest(F.col("n") - 1, F.lit(1))
    minority = F.col("least") / F.when(F.col("total") > 0, F.col("total")).otherwise(F.lit(1.0))
    verdict = (F.col("n") >= 4) & (F.col("speakers") == 2) & (
        ((switch >= 0.55) & (F.col("mean_sec") <= 6.0)) | (minority < 0.30)
    )
    return both.select(ID, verdict.alias("monologue"))


def collapse_to_single(segments: DataFrame, gap: float = 0.6) -> DataFrame:
    return merge_segments(segments.withColumn("speaker", F.lit("Speaker 1")), gap)


def drop_micro_segments(segments: DataFrame, min_sec: float = 0.4) -> DataFrame:
    """Drop short spans, except in recordings that have nothing longer."""
    long_enough = F.col("end_sec") - F.col("start_sec") >= min_sec
    some = segments.groupBy(ID).agg(F.max(long_enough).alias("__some"))
    return attach(segments, some).filter(long_enough | ~F.col("__some")).drop("__some")


def is_kannada(language) -> Column:
    c = F.col(language) if isinstance(language, str) else language
    return F.coalesce(F.lower(strip(c)).isin("kn", "kannada"), F.lit(False))


def normalize_turns(turns: DataFrame, language: str = "lang") -> DataFrame:
    """Merged turns after the collapse rules of each recording's language.

    ``turns`` carries a per-recording language column.  Turns aligned word by word
    (``whisperx``) are only merged.  The language limits are columns.
    """
    aligned = "alignment" in turns.columns
    state = turns.groupBy(ID).agg(
        F.max(language).alias(language), (F.max(F.col("alignment") == "whisperx") if aligned else F.max(F.lit(False))).alias("__fixed")
    )
    merged = merge_consecutive(turns.drop(language))
    merged = durable(attach(merged, state).withColumn("__kn", is_kannada(language)))
    keep = merged.filter(F.coalesce("__fixed", F.lit(False))).drop("__fixed", "__kn", language)
    loose = merged.filter(~F.coalesce("__fixed", F.lit(False))).drop("__fixed", language)
    kn = F.col("__kn")
    pick = lambda a, b: F.when(kn, F.lit(a)).otherwise(F.lit(b))
    loose = durable(_with_flag(loose, collapse_weak_speaker(loose, pick(0.32, 0.22), pick(2, 3))))
    loose = durable(_with_flag(loose, collapse_ping_pong(loose, pick(0.55, 0.7), pick(8.0, 5.0))))
    flips = _drop_flips(loose.filter("__kn"))
    done = loose.filter("not __kn").drop("__kn").unionByName(merge_consecutive(flips.drop("__kn")), allowMissingColumns=True)
    return keep.unionByName(done, allowMissingColumns=True)


def _with_flag(before: DataFrame, after: DataFrame) -> DataFrame:
    flag = before.groupBy(ID).agg(F.max("__kn").alias("__kn"))
    return attach(after.drop("__kn"), flag)


def _drop_flips(turns: DataFrame, min_sec: float = 0.4) -> DataFrame:
    lengthy = turn_duration(turns) >= min_sec
    per_rec = turns.groupBy(ID).agg(F.count("*").alias("__n"), F.max(lengthy).alias("__some"))
    out = attach(turns, per_rec)
    return out.filter(lengthy | (F.col("__n") <= 2) | ~F.col("__some")).drop("__n", "__some")


def turns_result(turns: DataFrame, language: DataFrame) -> DataFrame:
    """Per recording: transcript, original, number of speakers and whether turns are shown.

    Several speakers give a prefixed transcript; one speaker gives plain text, and
    in Kannada no turns.  ``language`` has ``recording_id, lang``.
    """
    tl = by_position("turn")
    text, original = strip("text"), strip(F.coalesce(F.nullif(F.col("text_original"), F.lit("")), F.col("text")))
    who = turns.filter("speaker <> ''").groupBy(ID).agg(F.countDistinct("speaker").alias("num_speakers"))
    joined = join_text(
        turns, tl,
        {
            "plain": (F.when(text != "", text), " "),
            "original": (F.when(original != "", original), " "),
            "prefixed": (F.when(text != "", F.concat("speaker", F.lit(": "), "text")), "\n\n"),
        },
    )
    out = joined.join(who, ID, "left").join(language, ID, "left")
    n = F.coalesce("num_speakers", F.lit(0))
    return out.select(
        ID,
        n.alias("num_speakers"),
        F.when(n >= 2, F.coalesce(F.nullif(F.col("prefixed"), F.lit("")), F.col("plain"))).otherwise(F.col("plain")).alias("transcript"),
        F.coalesce(F.nullif(F.col("original"), F.lit("")), F.col("plain")).alias("transcript_original"),
        ((n >= 2) | ((n == 1) & ~is_kannada("lang"))).alias("shows_turns"),
    )


def dialogue_speakers(
    rows: DataFrame, cues: dict[str, str] | None = None, chunk_rows: int = CHUNK_ROWS, merge: bool = True
) -> DataFrame:
    """Speaker 1 / Speaker 2 for the sentences of scripted two-person dialogue.

    ``rows`` has ``recording_id, pos, text``, one row per sentence.  A cue sentence is
    an anchor; after the first one, every sentence that is neither cue nor short
    follow-up changes the speaker, so the speaker is the anchor's, flipped by the
    parity of changes since.  Recordings that do not address both people, or end up
    with one speaker, give no rows.
    """
    p = {**DIALOGUE_CUES, **(cues or {})}
    hit = {name: F.col("text").rlike(pattern) for name, pattern in p.items()}
    flags = rows.select(ID, "pos", "text", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in hit.items()])
    begin = F.when(F.col("start"), F.struct("pos", F.lit(1).alias("shift")))
    begin = begin.when(F.col("greeting"), F.struct("pos", F.lit(0).alias("shift")))
    per_rec = flags.groupBy(ID).agg(
        (F.max("addresses_a") & F.max("addresses_b")).alias("strong"),
        F.min(begin).alias("begin"),
        F.max("pos").alias("last_pos"),
        F.min("pos").alias("first_pos"),
    )
    per_rec = per_rec.filter("strong and last_pos > first_pos").select(
        ID, "first_pos",
        F.least(F.coalesce(F.col("begin.pos") + F.col("begin.shift"), F.col("first_pos")), F.col("last_pos")).alias("from_pos"),
    )
    said = durable(flags.join(per_rec, ID))
    inside = F.col("pos") >= F.col("from_pos")
    one = F.col("self_b") | (~F.col("self_a") & F.col("addresses_a") & ~F.col("addresses_b"))
    two = F.col("self_a") | (F.col("addresses_b") & ~F.col("addresses_a"))
    fixed = F.when(~inside, F.lit(0)).when(one, F.lit(0)).when(two, F.lit(1))
    cue = inside & (F.col("addresses_a") | F.col("addresses_b") | F.col("self_a") | F.col("self_b"))
    said = said.withColumn("fixed", fixed).withColumn("cue", cue)
    tl = by_position(chunk_rows=chunk_rows)
    turnover = (
        F.col("fixed").isNull() & F.col("active") & ~F.col("follow_up") & (F.col("pos") > F.col("first_pos"))
    )
    anchor = F.when(
        F.col("fixed").isNotNull() | ~F.col("active"),
        F.struct(F.coalesce("fixed", F.lit(0)).alias("who"), F.col("flips").alias("at")),
    )
    said = carry(
        said, tl, {"active": ("max", F.col("cue"))}, {"flips": ("sum", turnover.cast("long"))}, {"anchor": ("last", anchor)}
    )
    who = (F.coalesce(F.col("anchor.who"), F.lit(0)) + F.col("flips") - F.coalesce(F.col("anchor.at"), F.lit(0))) % 2
    named = said.select(
        ID, F.col("pos").alias("turn"), F.concat(F.lit("Speaker "), (who + 1).cast("string")).alias("speaker"),
        "text", F.col("text").alias("text_original"),
        F.lit(None).cast("double").alias("start_sec"), F.lit(None).cast("double").alias("end_sec"),
    )
    several = named.groupBy(ID).agg(F.min("speaker").alias("a"), F.max("speaker").alias("b")).filter("a <> b")
    named = named.join(several.select(ID), ID, "left_semi")
    return merge_consecutive(named, chunk_rows) if merge else named


def dialogue_from_text(recordings: DataFrame, text: str = "text", cues: dict[str, str] | None = None) -> DataFrame:
    """Dialogue turns straight from one transcript per recording."""
    return dialogue_speakers(sentences(recordings, ID, text), cues)
