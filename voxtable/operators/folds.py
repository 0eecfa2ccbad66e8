"""Rules whose outcome for a row depends on the last row *kept* so far."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.text import squash_space, token_jaccard, token_overlap, word_overlap_suffix
from .ordered import CHUNK_ROWS, CHUNK_SEC, by_position, by_time, fold

SEGMENT = "struct<pos:bigint,speaker:string,start_sec:double,end_sec:double>"


def _none(ddl: str) -> Column:
    return F.array().cast(f"array<{ddl}>")


def _seg(pos, speaker, start, end) -> Column:
    return F.struct(
        pos.cast("long").alias("pos"), speaker.alias("speaker"),
        start.cast("double").alias("start_sec"), end.cast("double").alias("end_sec"),
    )


def resolve_overlaps(segments: DataFrame, min_sec: float = 0.2, chunk_sec: float = CHUNK_SEC) -> DataFrame:
    """Turn overlapping segments into a timeline without overlaps.

    State: the segment that may still change.  A same-speaker overlap extends it;
    otherwise both are cut at the middle of the overlap, and what is left of the
    newcomer is kept when it is longer than 0.15 s.
    """

    def step(last: Column, row: Column) -> tuple[Column, Column]:
        fresh = _seg(row["pos"], row["speaker"], row["start_sec"], row["end_sec"])
        middle = F.lit(0.5) * (last["end_sec"] + row["start_sec"])
        cut = F.greatest(middle, last["start_sec"] + 0.05)
        shortened = _seg(last["pos"], last["speaker"], last["start_sec"], cut)
        rest = _seg(row["pos"], row["speaker"], cut, row["end_sec"])
        longer = _seg(last["pos"], last["speaker"], last["start_sec"], F.greatest(last["end_sec"], row["end_sec"]))
        clash = row["start_sec"] < last["end_sec"]
        same = last["speaker"] == row["speaker"]
        goes_on = row["end_sec"] > cut + 0.15
        state = (
            F.when(last.isNull() | ~clash, fresh)
            .when(same, longer)
            .when(goes_on, rest)
            .otherwise(shortened)
        )
        done = (
            F.when(last.isNull() | (clash & same) | (clash & ~goes_on), _none(SEGMENT))
            .when(~clash, F.array(last))
            .otherwise(F.array(shortened))
        )
        return state, done

    def masked(last: Column, first: Column) -> Column:
        # a cut lies at the middle of an overlap, which no later row can move before the state's start, unless it begins there
        near = last["start_sec"] + 0.05 > first["start_sec"]
        return _seg(F.lit(None), last["speaker"], F.when(near, last["start_sec"]), last["end_sec"])

    out = fold(
        segments, by_time(chunk_sec=chunk_sec), ["pos", "speaker", "start_sec", "end_sec"],
        SEGMENT, SEGMENT, step, lambda last: F.array(last), masked, ["pos", "start_sec"],
    )
    return out.filter(F.col("end_sec") - F.col("start_sec") >= min_sec)


def pack_windows(
    segments: DataFrame, max_sec: float = 18.0, join: float = 0.6, chunk_sec: float = CHUNK_SEC
) -> DataFrame:
    """Pack neighbouring spans into windows of at most ``max_sec``; a later longer span is cut up."""
    window = "struct<start_sec:double,end_sec:double>"
    make = lambda a, b: F.struct(a.cast("double").alias("start_sec"), b.cast("double").alias("end_sec"))
    full = lambda w: F.when(w["end_sec"] > w["start_sec"], F.array(w)).otherwise(_none(window))

    def pieces(a: Column, b: Column) -> Column:
        count = F.ceil((b - a) / max_sec).cast("int")
        return F.filter(
            F.transform(
                F.sequence(F.lit(0), F.greatest(count, F.lit(0))),
                lambda i: make(a + i * max_sec, F.least(b, a + (i + 1) * max_sec)),
            ),
            lambda w: w["start_sec"] < b,
        )

    def step(cur: Column, row: Column) -> tuple[Column, Column]:
        a, b = row["start_sec"], row["end_sec"]
        fits = (a - cur["end_sec"] <= join) & (b - cur["start_sec"] <= max_sec)
        too_long = b - a > max_sec
        state = (
            F.when(cur.isNull(), make(a, b))
            .when(fits, make(cur["start_sec"], F.greatest(cur["end_sec"], b)))
            .when(too_long, make(b, b))
            .otherwise(make(a, b))
        )
        done = (
            F.when(cur.isNull() | fits, _none(window))
            .when(too_long, F.concat(full(cur), pieces(a, b)))
            .otherwise(full(cur))
        )
        return state, done

    def ends(rows: Column) -> Column:
        """All windows that may be open after the last row: begun by a row near enough to it, or left behind by a long one."""
        near = F.filter(
            F.transform(rows, lambda r, i: F.struct(i.alias("i"), r["start_sec"].alias("a"), r["end_sec"].alias("b"))),
            lambda r: (r["a"] > F.element_at(rows, -1)["start_sec"] - max_sec) | (r["b"] - r["a"] > max_sec),
        )
        reach = lambda r: F.array_max(F.transform(F.slice(rows, r["i"] + 1, F.size(rows)), lambda x: x["end_sec"]))
        begun = F.transform(near, lambda r: make(r["a"], reach(r)))
        behind = F.transform(F.filter(near, lambda r: r["b"] - r["a"] > max_sec), lambda r: make(r["b"], reach(r)))
        return F.concat(begun, behind)

    return fold(
        segments, by_time(chunk_sec=chunk_sec), ["start_sec", "end_sec"], window, window, step, full, seeds=ends
    )


#: A state of which only the text counts.
TEXT = "struct<text:string>"
PHRASE = "struct<pos:bigint,text:string,start_sec:double,end_sec:double>"


def dedupe_phrases(phrases: DataFrame, slack: float = 0.5, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Drop phrases that repeat the last kept one; a longer version replaces it."""
    keyed = phrases.filter(squash_space("text") != "")

    def make(pos, text, a, b) -> Column:
        return F.struct(
            pos.cast("long").alias("pos"), text.alias("text"), a.alias("start_sec"), b.alias("end_sec")
        )

    def step(last: Column, row: Column) -> tuple[Column, Column]:
        old, new = squash_space(last["text"]), squash_space(row["text"])
        fresh = make(row["pos"], row["text"], row["start_sec"], row["end_sec"])
        reach = F.greatest(last["end_sec"], row["end_sec"])

        def decide(k: Column) -> Column:
            return (
                F.when(last.isNull(), 0)
                .when(k["o"] == k["n"], 1)
                .when(k["o"].contains(k["n"]) & (row["end_sec"] <= last["end_sec"] + slack), 2)
                .when(k["n"].contains(k["o"]) & (row["start_sec"] <= last["end_sec"] + slack), 3)
                .otherwise(0)
            )

        case = let(F.struct(old.alias("o"), new.alias("n")), decide)
        both = let(
            case,
            lambda c: F.struct(
                F.when(c == 1, make(last["pos"], last["text"], last["start_sec"], reach))
                .when(c == 2, last)
                .when(c == 3, make(row["pos"], row["text"], last["start_sec"], reach))
                .otherwise(fresh).alias("state"),
                F.when((c == 0) & last.isNotNull(), F.array(last)).otherwise(_none(PHRASE)).alias("done"),
            ),
        )
        return both["state"], both["done"]

    def masked(last: Column, first: Column) -> Column:
        return make(F.lit(None), last["text"], F.lit(None).cast("double"), last["end_sec"])

    return fold(
        keyed, by_position(chunk_rows=chunk_rows), ["pos", "text", "start_sec", "end_sec"],
        PHRASE, PHRASE, step, lambda last: F.array(last), masked, ["pos", "start_sec"],
    )


def stitch_chunks(chunks: DataFrame, longest: int = 16, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Pieces of overlapping chunk transcripts that add something to the last added piece."""
    piece = "struct<pos:bigint,text:string>"
    usable = chunks.filter(F.length(F.btrim("text", F.lit(" .,?!।"))) >= 2)

    def step(last: Column, row: Column) -> tuple[Column, Column]:
        added = F.when(last.isNull(), row["text"]).otherwise(
            word_overlap_suffix(last["text"], row["text"], longest)
        )
        both = let(
            added,
            lambda t: F.struct(
                F.when(t != "", F.struct(t.alias("text"))).otherwise(last).alias("state"),
                F.when(t != "", F.array(F.struct(row["pos"].cast("long").alias("pos"), t.alias("text"))))
                .otherwise(_none(piece)).alias("done"),
            ),
        )
        return both["state"], both["done"]

    return fold(
        usable, by_position(chunk_rows=chunk_rows), ["pos", "text"], TEXT, piece, step, lambda last: _none(piece)
    )


def drop_near_repeats(
    rows: DataFrame, measure: str = "jaccard", threshold: float = 0.92, chunk_rows: int = 256
) -> DataFrame:
    """Keep a text unless it is too similar to the last kept one of the recording."""
    item = "struct<pos:bigint,text:string>"
    similarity = {"jaccard": token_jaccard, "overlap": token_overlap}[measure]

    def step(last: Column, row: Column) -> tuple[Column, Column]:
        me = F.struct(row["pos"].cast("long").alias("pos"), row["text"].alias("text"))
        both = let(
            last.isNotNull() & (similarity(last["text"], row["text"]) >= threshold),
            lambda again: F.struct(
                F.when(again, last).otherwise(F.struct(row["text"].alias("text"))).alias("state"),
                F.when(again, _none(item)).otherwise(F.array(me)).alias("done"),
            ),
        )
        return both["state"], both["done"]

    kept = fold(rows, by_position(chunk_rows=chunk_rows), ["pos", "text"], TEXT, item, step, lambda last: _none(item))
    return kept
