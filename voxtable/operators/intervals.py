"""Joining timed words and phrases to speaker segments.

Overlap joins carry the equality on recording, level of length and time bucket, so
that a long recording is spread over its buckets and each pair is met once.  Nearest-segment
lookups are as-of scans over segment edges, not pair enumeration.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import midpoint, overlap_sec
from ..functions.text import strip, words as split_words
from .islands import ID, merge_consecutive
from .ordered import CHUNK_SEC, KEY, Timeline, attach, by_position, by_time, carry, carry_dealt, durable, join_text

BUCKET_SEC = 30.0


def overlap_pairs(left: DataFrame, right: DataFrame, bucket_sec: float = BUCKET_SEC) -> DataFrame:
    """Pairs of one recording whose closed time intervals touch.

    ``left`` needs ``l_pos, l_start, l_end``, ``right`` ``r_pos, r_start, r_end``. A span has a level by its length: buckets
    of level k are ``bucket_sec`` times 4^k long, and a span of that level is at most as long, so it lies in at most two
    of them. Two spans meet at the higher of their levels, where the shorter one also lies in at most two buckets: a span
    is listed at its own level and at each higher one that the other side has. A span as long as a recording is two rows,
    not one for each bucket. A pair is produced only in the later of its two first buckets, so no de-duplication is needed.
    """
    left, right = (df.withColumn(f"{s}_level", _level(f"{s}_start", f"{s}_end", bucket_sec)) for df, s in ((left, "l"), (right, "r")))
    rows = left.select(F.lit("l").alias("s"), F.col("l_level").alias("k")).unionByName(right.select(F.lit("r").alias("s"), F.col("r_level").alias("k")))
    seen = {"l": set(), "r": set()}
    for row in rows.distinct().collect():  # a level for each fourfold length: some ten rows for any table
        seen[row["s"]].add(row["k"])

    # what follows from level, start and end is found again after the join and does not travel
    def first(side: str) -> Column:
        return F.floor(F.col(f"{side}_start") / (F.lit(bucket_sec) * F.pow(F.lit(4.0), F.col("__level"))))

    def spread(df: DataFrame, side: str, others: set[int]) -> DataFrame:
        own = F.col(f"{side}_level")
        higher = F.filter(F.array(*[F.lit(k) for k in sorted(others)]).cast("array<int>"), lambda k: k > own)
        listed = df.withColumn("__level", F.explode(F.concat(F.array(own), higher))).drop(f"{side}_level")
        last = F.floor(F.col(f"{side}_end") / (F.lit(bucket_sec) * F.pow(F.lit(4.0), F.col("__level"))))
        return listed.withColumn("__bucket", F.explode(F.sequence(first(side), F.greatest(last, first(side)))))

    met = (F.col("l_start") <= F.col("r_end")) & (F.col("r_start") <= F.col("l_end"))
    once = F.col("__bucket") == F.greatest(first("l"), first("r"))
    own = F.col("__level") == F.greatest(_level("l_start", "l_end", bucket_sec), _level("r_start", "r_end", bucket_sec))
    named = spread(right, "r", seen["l"])
    key = (ID, "__level", "__bucket")
    pairs = attach(spread(left, "l", seen["r"]), named, key, "inner")
    return pairs.filter(met & once & own).drop("__level", "__bucket")


def _level(start: str, end: str, bucket_sec: float) -> Column:
    """The least k for which a bucket of level k is at least as long as the span."""
    longer = F.greatest((F.col(end) - F.col(start)) / bucket_sec, F.lit(1.0))
    return F.coalesce(F.ceil(F.round(F.log(longer) / math.log(4.0), 9)).cast("int"), F.lit(0))


def _left(rows: DataFrame) -> DataFrame:
    return rows.select(ID, F.col("pos").alias("l_pos"), F.col("start_sec").alias("l_start"), F.col("end_sec").alias("l_end"))


def _right(segments: DataFrame) -> DataFrame:
    return segments.select(
        ID,
        F.col("pos").alias("r_pos"),
        F.col("start_sec").alias("r_start"),
        F.col("end_sec").alias("r_end"),
        F.col("speaker").alias("r_speaker"),
    )


def nearest(points: DataFrame, marks: DataFrame, chunk_sec: float = CHUNK_SEC) -> DataFrame:
    """For each point the mark closest in time; ties go to the mark with the smaller position.

    ``points`` has ``recording_id, pos, t``; ``marks`` has ``recording_id, t, r_pos,
    r_speaker``.  Returns ``recording_id, pos, r_pos, r_speaker, r_t``.
    """
    mark = F.struct("r_pos", "r_speaker")
    edges = marks.groupBy(ID, "t").agg(F.min(mark).alias("mark"))
    line = edges.select(ID, "t", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("pos"), "mark")
    asks = points.select(
        ID, "t", F.lit(1).alias("kind"), F.col("pos").cast("long"), F.lit(None).cast(line.schema["mark"].dataType).alias("mark")
    )
    tl = by_time("t", ("t", "kind", "pos"), chunk_sec=chunk_sec)
    here = F.when(F.col("kind") == 0, F.struct("t", "mark"))
    found = carry(line.unionByName(asks), tl, {"back": ("last", here), "ahead": ("next", here)})
    found = found.filter("kind = 1")

    def choice(side: str) -> Column:
        present = F.col(side).isNotNull()
        return F.when(
            present,
            F.struct(
                F.abs(F.col("t") - F.col(f"{side}.t")).alias("d"),
                F.col(f"{side}.mark.r_pos").alias("r_pos"),
                F.col(f"{side}.mark.r_speaker").alias("r_speaker"),
                F.col(f"{side}.t").alias("r_t"),
            ),
        )

    best = F.array_min(F.array_compact(F.array(choice("back"), choice("ahead"))))
    found = found.withColumn("best", best).filter("best is not null")
    return found.select(ID, "pos", "best.r_pos", "best.r_speaker", "best.r_t")


def _edges(segments: DataFrame) -> DataFrame:
    """Both ends of every segment as time marks."""
    return segments.select(
        ID,
        F.explode(F.array("start_sec", "end_sec")).alias("t"),
        F.col("pos").alias("r_pos"),
        F.col("speaker").alias("r_speaker"),
    )


def assign_words(words: DataFrame, segments: DataFrame, min_conf: float = 0.35) -> DataFrame:
    """Give each word the speaker of the segment it overlaps most, else of the nearest one.

    A word whose overlap is a small part of its duration inherits the speaker of the
    last confident word; the recording's first word always counts as confident.
    """
    return _assigned(words, segments, min_conf, F.lit(False))


def prefer_given_speakers(words: DataFrame, segments: DataFrame, min_conf: float = 0.35) -> DataFrame:
    """Assign by overlap only in recordings where no word came with a speaker."""
    return _assigned(words, segments, min_conf, F.coalesce(F.col("speaker"), F.lit("")) != "")


def _assigned(words: DataFrame, segments: DataFrame, min_conf: float, given: Column) -> DataFrame:
    """Words with a speaker each, but for recordings in which a word is ``given``, which stay as they are.

    What is found for a word goes to the chunk in which the word lies and meets it there, so the words themselves are
    dealt out twice: to meet the segments they overlap, and to meet the nearest ones and the words before them.
    """
    tl = by_position()
    here = Window.partitionBy(*tl.ids, "pos")
    pairs = overlap_pairs(_left(words.filter(~given)), _right(segments))
    hit = F.struct("ov", (-F.col("r_pos")).alias("r_pos"), F.col("r_speaker").alias("speaker"))
    hits = pairs.withColumn("ov", overlap_sec("l_start", "l_end", "r_start", "r_end")).filter("ov > 0")
    hits = hits.select(ID, F.col("l_pos").alias("pos"), hit.alias("__hit"))
    bag = words.withColumn("__word", F.lit(True)).unionByName(hits, allowMissingColumns=True)
    scored = tl.tag(bag).withColumn("__hit", F.max("__hit").over(here)).filter("__word")
    scored = durable(scored.select(*words.columns, "__word", "__hit.ov", F.col("__hit.speaker").alias("__hit")))
    alone = scored.filter(F.col("__hit").isNull() & ~given).select(ID, "pos", midpoint().alias("t"))
    near = nearest(alone, _edges(segments)).select(ID, "pos", F.struct("r_speaker").alias("__near"))
    dealt = tl.tag(scored.unionByName(near, allowMissingColumns=True))
    dealt = dealt.withColumn("__near", F.collect_list("__near").over(here)).filter("__word")
    dealt = dealt.withColumn("__near", F.explode_outer("__near")).withColumn("__near", F.col("__near.r_speaker"))
    length = F.greatest(F.greatest(F.lit(0.0), F.col("end_sec") - F.col("start_sec")), F.lit(1e-3))
    dealt = dealt.withColumn(
        "__conf",
        F.when(F.col("__hit").isNotNull(), F.col("ov") / length).when(F.col("__near").isNotNull(), F.lit(0.25)),
    )
    dealt = dealt.withColumn("__own", F.coalesce("__hit", "__near"))
    # the first word of a recording is the one without a row before it
    anchor = (F.col("__conf") >= min_conf) | F.col("__before").isNull()
    dealt = carry_dealt(
        dealt, tl, [*words.columns, "__conf", "__own"],
        {"__before": ("lag", F.struct("pos"))}, {"__who": ("last", F.when(anchor, F.col("__own")))},
    )
    some = tl.mark(scored).groupBy(*tl.ids).agg(F.max(given).alias("__given"))
    some = some.select(*tl.ids, F.max("__given").over(Window.partitionBy(KEY)).alias("__given"))
    new = {"speaker": F.col("__who"), "confidence": F.col("__conf")}
    out = dealt.join(some, tl.ids)
    return out.select(*[F.when(F.col("__given"), F.col(c)).otherwise(new[c]).alias(c) if c in new else F.col(c) for c in words.columns])


def flatten_words(aligned: DataFrame) -> DataFrame:
    """Nested aligned segments to words.

    ``aligned`` has ``recording_id, seg, start_sec, end_sec, text, words`` with words
    an array of structs ``word, start_sec, end_sec, score, speaker``.  Segments
    without words are split at white space and lend their words their own times.
    The result goes into :func:`prefer_given_speakers`; its ``confidence`` is 0.
    """
    has_words = F.size(F.coalesce("words", F.array())) > 0
    nested = aligned.filter(has_words).select(ID, "seg", F.posexplode("words").alias("i", "w"))
    nested = nested.select(
        ID,
        "seg",
        "i",
        strip(F.col("w.word")).alias("word"),
        F.col("w.start_sec").alias("start_sec"),
        F.col("w.end_sec").alias("end_sec"),
        F.coalesce("w.score", F.lit(0.0)).alias("score"),
        F.nullif(F.col("w.speaker"), F.lit("")).alias("speaker"),
        F.lit(0.0).alias("confidence"),
    )
    plain = aligned.filter(~has_words).select(
        ID, "seg", F.posexplode(split_words("text")).alias("i", "word"), "start_sec", "end_sec",
        F.lit(0.5).alias("score"), F.lit(None).cast("string").alias("speaker"), F.lit(0.0).alias("confidence"),
    )
    flat = nested.unionByName(plain).filter(
        (F.coalesce("word", F.lit("")) != "") & F.col("start_sec").isNotNull() & F.col("end_sec").isNotNull()
    )
    tl = Timeline(("seg", "i"), F.floor(F.col("seg") / 256))
    return carry(flat, tl, {"pos": ("sum", F.lit(1).cast("long"))}).select(
        ID, (F.col("pos") - 1).alias("pos"), "word", "start_sec", "end_sec", "score", "speaker", "confidence"
    )


def _phrase_overlaps(phrases: DataFrame, segments: DataFrame) -> DataFrame:
    pairs = overlap_pairs(_left(phrases), _right(segments))
    return (
        pairs.withColumn("ov0", F.greatest("l_start", "r_start"))
        .withColumn("ov1", F.least("l_end", "r_end"))
        .withColumn("ov", F.col("ov1") - F.col("ov0"))
    )


def assign_phrases(phrases: DataFrame, segments: DataFrame, min_overlap: float = 0.05) -> DataFrame:
    """Distribute phrases over the segments they overlap; one turn per segment with text.

    A phrase over several segments gives each a share of its words by overlap, in
    time order, and the last one the rest.  A phrase over none goes to the segment
    with the nearest midpoint.  The overlaps of one phrase are few and are folded
    as a small array.
    """
    spoken = phrases.withColumn("text", strip("text")).filter(
        (F.col("text") != "") & ~F.col("text").isin(".", ",", "?", "!", "…")
    )
    parts = _phrase_overlaps(spoken, segments).filter(F.col("ov") > min_overlap)
    per_phrase = parts.groupBy(ID, F.col("l_pos").alias("pos")).agg(
        F.array_sort(F.collect_list(F.struct("ov0", "r_pos", "ov1", "ov"))).alias("parts"),
        F.max_by(F.struct("r_pos", "ov0", "ov1"), F.struct("ov", -F.col("ov0"), -F.col("r_pos"))).alias("top"),
        F.sum("ov").alias("total"),
    )
    joined = durable(attach(spoken, per_phrase, (ID, "pos"))).withColumn("w", split_words("text"))
    whole = F.array(
        F.struct(
            F.col("top.r_pos").alias("r_pos"), F.col("top.ov0").alias("a"), F.col("top.ov1").alias("b"),
            F.col("text").alias("piece"),
        )
    )
    n = F.size("w")
    share = lambda p: F.greatest(F.lit(1), F.bround(n * (p["ov"] / F.col("total"))).cast("int"))
    cuts = F.transform(
        "parts",
        lambda p, i: F.aggregate(F.slice("parts", F.lit(1), i), F.lit(0), lambda a, q: a + share(q)),
    )
    pieces = F.transform(
        F.arrays_zip(F.col("parts").alias("p"), cuts.alias("c")),
        lambda x, i: F.struct(
            x["p"]["r_pos"].alias("r_pos"),
            x["p"]["ov0"].alias("a"),
            x["p"]["ov1"].alias("b"),
            F.array_join(
                F.slice(
                    F.col("w"),
                    x["c"] + 1,
                    F.when(i == F.size("parts") - 1, n).otherwise(share(x["p"])),
                ),
                " ",
            ).alias("piece"),
        ),
    )
    split = F.when((F.size("parts") == 1) | (n <= 2), whole).otherwise(pieces)
    placed = joined.filter("parts is not null").select(ID, "pos", F.explode(split).alias("x"))
    placed = placed.select(ID, "pos", "x.*").filter("piece != ''")
    alone = joined.filter("parts is null")
    middles = segments.select(ID, midpoint().alias("t"), F.col("pos").alias("r_pos"), F.col("speaker").alias("r_speaker"))
    near = nearest(alone.select(ID, "pos", midpoint().alias("t")), middles)
    far = attach(alone, near, (ID, "pos"), "inner").select(
        ID, "pos", "r_pos", F.col("start_sec").alias("a"), F.col("end_sec").alias("b"), F.col("text").alias("piece")
    )
    bag = placed.unionByName(far)
    tl = Timeline(("a", "pos"), F.floor(F.col("a") / CHUNK_SEC), (ID, "r_pos"))
    turns = join_text(
        bag, tl, {"text": (F.col("piece"), " ")},
        [F.min("a").alias("min_a"), F.max_by("b", F.struct("a", "pos")).alias("last_b")],
    )
    who = segments.select(ID, F.col("pos").alias("r_pos"), "speaker")
    return attach(turns, who, (ID, "r_pos"), "inner").select(
        ID, F.col("r_pos").alias("turn"), "speaker", F.col("min_a").alias("start_sec"), F.col("last_b").alias("end_sec"),
        strip("text").alias("text"), strip("text").alias("text_original"),
        F.lit(0.0).alias("confidence"), F.lit("vad").alias("alignment"),
    )


def assign_timed_text(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """Speaker by largest overlap where a recording has several speakers, else that of its first segment."""
    per_rec = segments.groupBy(ID).agg(
        F.countDistinct("speaker").alias("n"),
        F.min_by("speaker", F.struct("start_sec", "end_sec", "pos")).alias("lead"),
    )
    pairs = overlap_pairs(_left(rows), _right(segments))
    shared = overlap_sec("l_start", "l_end", "r_start", "r_end")
    best = (
        pairs.withColumn("ov", shared).filter("ov > 0").groupBy(ID, F.col("l_pos").alias("pos"))
        .agg(F.max_by("r_speaker", F.struct("ov", -F.col("r_start"), -F.col("r_end"), -F.col("r_pos"))).alias("hit"))
    )
    out = attach(attach(rows, best, (ID, "pos")), per_rec, (ID,), "inner")
    speaker = F.when(F.col("n") >= 2, F.coalesce("hit", "lead")).otherwise(F.col("lead"))
    return out.select(*rows.columns, speaker.alias("speaker"))


def speaker_at(phrases: DataFrame, segments: DataFrame) -> DataFrame:
    """Each phrase to the first segment around its midpoint, else the nearest edge; then merge turns."""
    points = phrases.select(ID, "pos", midpoint().alias("t"))
    probe = points.select(ID, F.col("pos").alias("l_pos"), F.col("t").alias("l_start"), F.col("t").alias("l_end"))
    inside = (
        overlap_pairs(probe, _right(segments)).groupBy(ID, F.col("l_pos").alias("pos"))
        .agg(F.min_by("r_speaker", "r_pos").alias("inside"))
    )
    found = durable(attach(points, inside, (ID, "pos")))
    near = nearest(found.filter("inside is null"), _edges(segments)).select(ID, "pos", "r_speaker")
    found = attach(found, near, (ID, "pos")).withColumn("speaker", F.coalesce("inside", "r_speaker"))
    named = durable(attach(phrases, found.filter("speaker is not null").select(ID, "pos", "speaker"), (ID, "pos"), "inner"))
    turns = named.withColumn("turn", F.col("pos")).withColumn("text_original", F.col("text"))
    merged = merge_consecutive(turns.withColumn("alignment", F.lit("legacy")))
    return merged.withColumns({"start_sec": F.round("start_sec", 2), "end_sec": F.round("end_sec", 2)})
