"""Merging, smoothing and numbering of time-ordered rows (gaps and islands)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import (
    CHUNK,
    CHUNK_ROWS,
    CHUNK_SEC,
    KEY,
    Timeline,
    attach,
    by_position,
    by_time,
    carry,
    durable,
    join_text,
    runs,
    spans,
)

ID = "recording_id"


def sort_timeline(df: DataFrame) -> DataFrame:
    """Rows in timeline order: a range-partitioned global sort."""
    return df.orderBy(ID, "start_sec", "end_sec", "pos")


def merge_segments(segments: DataFrame, gap: float = 0.6, chunk_sec: float = CHUNK_SEC) -> DataFrame:
    """Unite neighbouring segments of one speaker when at most ``gap`` seconds lie between.

    Speaker runs first, then interval union inside each run.  The running end must
    not reach over a speaker change, hence the two steps.
    """
    tl = by_time(chunk_sec=chunk_sec)
    run = runs(segments, tl, lambda p, c: ~p("speaker").eqNullSafe(c("speaker")), ["speaker"])
    inner = by_time(key=(ID, "run"), chunk_sec=chunk_sec)
    tagged = spans(run, inner, "start_sec", "end_sec", gap)
    merged = tagged.groupBy(ID, "run", "span").agg(
        F.first("speaker").alias("speaker"),
        F.min("start_sec").alias("start_sec"),
        F.max("end_sec").alias("end_sec"),
        F.min_by("pos", F.struct("start_sec", "end_sec", "pos")).alias("pos"),
    )
    return merged.select(ID, "pos", "speaker", "start_sec", "end_sec")


def _turn_line(timed: bool) -> Timeline:
    return by_time() if timed else by_position("turn")


def _glue_turns(islands: DataFrame, tl: Timeline, end: Column, texts: Sequence[str]) -> DataFrame:
    """Collapse numbered islands of turns to one turn each."""
    key = (*tl.key, "run")
    inner = Timeline(tl.order, tl.chunk, key)
    extra = [
        F.min_by(F.col(c), tl.sort_key).alias(f"first_{c}")
        for c in ("turn", "speaker", "start_sec", *_kept(islands))
    ]
    extra.append(end.alias("last_end_sec"))
    out = join_text(islands, inner, {t: (F.col(t), " ") for t in texts}, extra)
    return out.select(
        *tl.key,
        F.col("first_turn").alias("turn"),
        F.col("first_speaker").alias("speaker"),
        F.col("first_start_sec").alias("start_sec"),
        F.col("last_end_sec").alias("end_sec"),
        *[F.trim(t).alias(t) for t in texts],
        *[F.col(f"first_{c}").alias(c) for c in _kept(islands)],
    )


def _kept(df: DataFrame) -> list[str]:
    return [c for c in ("confidence", "alignment") if c in df.columns]


def _texts(df: DataFrame) -> list[str]:
    return [c for c in ("text", "text_original") if c in df.columns]


def merge_asr_turns(turns: DataFrame, gap: float = 0.5, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Join a turn to the one before when the speaker is the same and the pause at most ``gap``."""
    tl = by_position("turn", chunk_rows=chunk_rows)

    def breaks(p, c):
        return ~p("speaker").eqNullSafe(c("speaker")) | (c("start_sec") - p("end_sec") > gap)

    islands = runs(turns, tl, breaks, ["speaker", "start_sec", "end_sec"])
    end = F.max_by(F.col("end_sec"), tl.sort_key)
    return _glue_turns(islands, tl, end, _texts(turns))


def merge_consecutive(turns: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Join all consecutive turns of one speaker; a missing end time never hides a known one."""
    tl = by_position("turn", chunk_rows=chunk_rows)
    islands = runs(turns, tl, lambda p, c: ~p("speaker").eqNullSafe(c("speaker")), ["speaker"])
    end = F.max_by(F.col("end_sec"), F.when(F.col("end_sec").isNotNull(), tl.sort_key))
    return _glue_turns(islands, tl, end, _texts(turns))


def number_speakers(rows: DataFrame, order: Sequence[str] = ("pos",), speaker: str = "speaker") -> DataFrame:
    """Rename speakers to ``Speaker k`` by first appearance within the recording."""
    first = rows.groupBy(ID, speaker).agg(F.min(F.struct(*order)).alias("__first"))
    rank = F.dense_rank().over(Window.partitionBy(ID).orderBy("__first"))
    names = first.select(ID, speaker, F.concat(F.lit("Speaker "), rank.cast("string")).alias("__name"))
    out = attach(rows, names, (ID, speaker))
    return out.select(*[F.col("__name").alias(c) if c == speaker else F.col(c) for c in rows.columns])


def words_to_turns(words: DataFrame, gap: float = 0.6, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Spoken words to turns: same speaker and a pause of at most ``gap`` seconds.

    The turn's confidence is the pairwise running mean, which weights the i-th of n
    words by 2^-(n-i+1) (the first by 2^-(n-1)); as a weighted sum it needs no
    ordered state, only the word's number inside the island.
    """
    usable = words.filter((F.trim("word") != "") & F.col("speaker").isNotNull() & (F.col("speaker") != ""))
    tl = by_position(chunk_rows=chunk_rows)

    def breaks(p, c):
        return (p("speaker") != c("speaker")) | (c("start_sec") - p("end_sec") > gap)

    # words travel once; what goes on from there is one row for each part of a turn inside a chunk
    seen = F.struct("speaker", "start_sec", "end_sec")
    parts = tl.tag(usable).withColumn("__prev", F.lag(seen).over(tl.rows))
    cut = F.coalesce(breaks(lambda c: F.col("__prev")[c], lambda c: F.col(c)), F.lit(True))
    parts = parts.withColumn("__part", F.sum(F.when(cut, 1).otherwise(0)).over(tl.rows.rowsBetween(Window.unboundedPreceding, 0)))
    said = F.struct("pos", "word", "confidence", "start_sec", "end_sec")
    parts = parts.groupBy(*tl.ids, "__part").agg(F.first("speaker").alias("speaker"), F.array_sort(F.collect_list(said)).alias("w"))
    parts = durable(
        parts.select(
            *tl.key_columns, "speaker", F.array_min("w.pos").alias("pos"), F.size("w").alias("size"),
            F.element_at("w", 1)["start_sec"].alias("start_sec"), F.element_at("w", -1)["end_sec"].alias("end_sec"),
            F.array_join("w.word", " ").alias("text"), F.element_at("w", 1)["confidence"].alias("lead"),
            F.when(
                F.exists("w.confidence", lambda c: c.isNotNull()),
                F.aggregate("w.confidence", F.lit(0.0), lambda a, c: (a + F.coalesce(c.cast("double"), F.lit(0.0))) / 2),
            ).alias("share"),
        )
    )
    islands = runs(number_speakers(parts), tl, breaks, ["speaker", "start_sec", "end_sec"])
    piece = F.struct("pos", "start_sec", "end_sec", "size", "share", "lead", "text", "speaker")
    out = islands.groupBy(ID, "run").agg(F.min("pos").alias("turn"), F.sum("size").alias("size"), F.array_sort(F.collect_list(piece)).alias("p"))
    lead = F.element_at("p", 1)
    later = F.aggregate("p", F.lit(0.0), lambda a, p: a * F.pow(F.lit(0.5), p["size"]) + F.coalesce(p["share"], F.lit(0.0)))
    mean = later + F.coalesce(lead["lead"].cast("double"), F.lit(0.0)) * F.pow(F.lit(0.5), F.col("size"))
    text = F.trim(F.array_join("p.text", " "))
    return out.select(
        ID, "turn", lead["speaker"].alias("speaker"), lead["start_sec"].alias("start_sec"), F.element_at("p", -1)["end_sec"].alias("end_sec"),
        text.alias("text"), text.alias("text_original"), F.when(F.exists("p.share", lambda c: c.isNotNull()), mean).alias("confidence"),
    )


def merge_labeled_windows(
    windows: DataFrame, gap: float = 0.35, min_sec: float = 0.4, chunk_sec: float = CHUNK_SEC
) -> DataFrame:
    """Merge clustered windows, drop short results, number the speakers, round the times."""
    merged = merge_segments(windows, gap, chunk_sec)
    long_enough = merged.filter(F.col("end_sec") - F.col("start_sec") >= min_sec)
    named = number_speakers(long_enough, ("start_sec", "end_sec", "pos"))
    return named.withColumns(
        {"start_sec": F.round("start_sec", 2), "end_sec": F.round("end_sec", 2)}
    )


def smooth_switches(words: DataFrame, min_sec: float = 0.3, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Give a short speaker run between two runs of one other speaker to that speaker.

    Left to right, a relabelled run takes its right neighbour's "previous speaker"
    away: in a streak of adjacent candidates those at odd places change.
    """
    tl = by_position(chunk_rows=chunk_rows)
    tagged = tl.tag(words).withColumn("__prev", F.lag(F.struct("speaker")).over(tl.rows))
    cut = F.col("__prev").isNull() | ~F.col("__prev")["speaker"].eqNullSafe(F.col("speaker"))
    upto = tl.rows.rowsBetween(Window.unboundedPreceding, 0)
    tagged = tagged.withColumn("__part", F.sum(F.when(cut, 1).otherwise(0)).over(upto))
    parts = tagged.groupBy(*tl.ids, "__part").agg(
        F.first("speaker").alias("speaker"),
        F.min("pos").alias("pos"),
        F.max("pos").alias("last_pos"),
        F.min_by("start_sec", "pos").alias("start_sec"),
        F.max_by("end_sec", "pos").alias("end_sec"),
    )
    parts = durable(parts.select(*tl.key_columns, F.col(CHUNK).alias("chunk"), "__part", "speaker", "pos", "last_pos", "start_sec", "end_sec"))
    parts = durable(runs(parts, tl, lambda p, c: ~p("speaker").eqNullSafe(c("speaker")), ["speaker"]))
    run = parts.groupBy(ID, "run").agg(
        F.first("speaker").alias("speaker"),
        F.min_by("start_sec", "pos").alias("start_sec"),
        F.max_by("end_sec", "last_pos").alias("end_sec"),
    )
    line = by_position("run", chunk_rows=chunk_rows)
    candidate = (
        (F.col("end_sec") - F.col("start_sec") < min_sec)
        & F.col("left").isNotNull()
        & (F.col("left") != "")
        & F.col("left").eqNullSafe(F.col("right.speaker"))
    )
    run = carry(
        run,
        line,
        {"left": ("lag", F.col("speaker")), "right": ("next", F.struct("speaker"))},
        {"candidate": F.coalesce(candidate, F.lit(False)), "stop": ("last", F.when(~F.col("candidate"), F.col("run")))},
    )
    place = F.col("run") - F.coalesce("stop", F.lit(0))
    run = run.select(
        ID, "run", F.when(F.col("candidate") & (place % 2 == 1), F.col("left")).alias("__new")
    )
    # the new names go back to the words by chunk, so that the words need not be dealt out again by run
    named = attach(parts, run.filter("__new is not null"), (ID, "run"), "inner")
    names = named.groupBy(F.struct(ID).alias(KEY), F.col("chunk").alias(CHUNK)).agg(
        F.map_from_entries(F.collect_list(F.struct("__part", "__new"))).alias("__names")
    )
    out = tagged.join(names, tl.ids, "left")
    new = F.try_element_at("__names", F.col("__part"))
    return out.select(*[F.coalesce(new, "speaker").alias(c) if c == "speaker" else F.col(c) for c in words.columns])


def fillable(run: DataFrame, longest: Column) -> DataFrame:
    """A table of runs (``recording_id, run, len``) with ``__fill``: short, and neither the first nor the last of the recording."""
    ends = run.groupBy(ID).agg(F.max("run").alias("__last"))
    fill = (F.col("len") <= longest) & (F.col("run") > 1) & (F.col("run") < F.col("__last"))
    return attach(run, ends).withColumn("__fill", fill).drop("__last")


def fill_holes(frames: DataFrame, longest: int | Column, chunk_rows: int = 65536) -> DataFrame:
    """Turn inner non-speech runs of at most ``longest`` frames into speech.

    ``longest`` may be a column, constant within a recording.
    """
    longest = longest if isinstance(longest, Column) else F.lit(longest)
    tl = by_position("frame_idx", chunk_rows=chunk_rows)
    tagged = runs(frames, tl, lambda p, c: p("speech") != c("speech"), ["speech"])
    run = tagged.groupBy(ID, "run").agg(F.count("*").alias("len"), F.max(longest).alias("__most"))
    out = attach(tagged, fillable(run, F.col("__most")).select(ID, "run", "__fill"), (ID, "run"))
    return out.select(
        *[(F.col("speech") | F.col("__fill")).alias(c) if c == "speech" else F.col(c) for c in frames.columns]
    )


def switch_stats(turns: DataFrame, chunk_rows: int = CHUNK_ROWS, order: str = "turn") -> DataFrame:
    """Speaker changes, their share of all steps, and the mean duration per recording."""
    from ..functions.spans import turn_duration

    marked = carry(turns, by_position(order, chunk_rows=chunk_rows), {"__prev": ("lag", F.struct("speaker"))})
    change = F.col("__prev").isNotNull() & ~F.col("__prev.speaker").eqNullSafe(F.col("speaker"))
    stats = marked.groupBy(ID).agg(
        F.count("*").alias("n_turns"),
        F.sum(change.cast("long")).alias("switches"),
        F.avg(turn_duration(turns)).alias("mean_sec"),
    )
    ratio = F.col("switches") / F.greatest(F.col("n_turns") - 1, F.lit(1))
    return stats.select(ID, "n_turns", "switches", ratio.alias("switch_ratio"), "mean_sec")
