"""Frames, speech regions and analysis windows over recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import overlap_pairs
from .islands import ID, fillable
from .ordered import Timeline, attach, by_position, carry, durable, runs, spans
from .waveforms import FRAME_SEC, HOP_SEC, samples_in

def percentiles(
    rows: DataFrame, value: str, shares: dict[str, float], key: tuple[str, ...] = (ID,)
) -> DataFrame:
    """Exact linear percentiles per key by distributed selection.

    Equal values are counted first; running counts over value ranges locate the two
    neighbours of each percentile, so no task sorts a whole key.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("__n"))
    scale = F.signum(value) * F.log1p(F.abs(F.col(value)) * 1e6) * 16
    tl = Timeline((value,), F.floor(scale), key)
    ranked = carry(counts, tl, {"__upto": ("sum", F.col("__n"))})
    total = counts.groupBy(*key).agg(F.sum("__n").alias("__total"))
    ranked = attach(ranked, total, key)
    picks = []
    for name, q in shares.items():
        place = (F.col("__total") - 1) * F.lit(q)
        for side, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            here = (rank < F.col("__upto")) & (rank >= F.col("__upto") - F.col("__n"))
            picks.append(F.max(F.when(here, F.col(value))).alias(f"__{side}_{name}"))
    found = ranked.groupBy(*key).agg(F.max("__total").alias("__total"), *picks)
    out = []
    for name, q in shares.items():
        place = (F.col("__total") - 1) * F.lit(q)
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        out.append((lo + (hi - lo) * (place - F.floor(place))).alias(name))
    return found.select(*key, *out)


def noise_threshold(frames: DataFrame) -> DataFrame:
    """Level above which a frame counts as speech."""
    p = percentiles(frames, "rms", {"p20": 0.2, "p40": 0.4})
    return p.select(ID, F.greatest(F.col("p20") * 2.5, F.col("p40") * 0.6, F.lit(1e-4)).alias("threshold"))


def speech_regions(
    frames: DataFrame, recordings: DataFrame, min_speech=0.3, min_silence=0.35, chunk_rows: int = 65536
) -> DataFrame:
    """Time regions with speech.

    ``frames`` has ``recording_id, frame_idx, rms``; ``recordings`` has ``recording_id,
    n_samples, sample_rate``.  A recording without any region, or shorter than a
    frame, is one region unless it is silent.  The two limits may be columns of
    ``recordings``.
    """
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    limits = recordings.select(
        ID, "n_samples", "sample_rate",
        samples_in(F.col("sample_rate"), FRAME_SEC).alias("frame"),
        samples_in(F.col("sample_rate"), HOP_SEC).alias("hop"),
        F.greatest(F.lit(1), F.floor(lit(min_speech) * 1000.0 / (HOP_SEC * 1000)).cast("int")).alias("speech_frames"),
        F.greatest(F.lit(1), F.floor(lit(min_silence) * 1000.0 / (HOP_SEC * 1000)).cast("int")).alias("silence_frames"),
    )
    loud = attach(frames, noise_threshold(frames)).filter("threshold is not null")
    loud = loud.select(ID, "frame_idx", (F.col("rms") >= F.col("threshold")).alias("speech"))
    changes = lambda p, c: p("speech") != c("speech")
    run = runs(loud, by_position("frame_idx", chunk_rows=chunk_rows), changes, ["speech"]).groupBy(ID, "run").agg(
        F.first("speech").alias("speech"), F.count("*").alias("len"), F.min("frame_idx").alias("first"), F.max("frame_idx").alias("last")
    )
    # from here on only the table of runs: holes are filled and their neighbours united on it
    run = fillable(durable(attach(run, limits)), F.col("silence_frames"))
    whole_runs = runs(
        run.withColumn("speech", F.col("speech") | F.col("__fill")).withColumnRenamed("run", "nth"), by_position("nth", chunk_rows=chunk_rows), changes, ["speech"]
    )
    region = whole_runs.filter("speech").groupBy(ID, "run").agg(
        F.sum("len").alias("len"), F.min("first").alias("first"), F.max("last").alias("last"),
        *[F.max(c).alias(c) for c in ("hop", "frame", "n_samples", "sample_rate", "speech_frames")],
    )
    region = durable(region.filter("len >= speech_frames")).select(
        ID,
        (F.col("first") * F.col("hop") / F.col("sample_rate").cast("double")).alias("start_sec"),
        (
            F.least(F.col("n_samples"), (F.col("last") + 1) * F.col("hop") + F.col("frame"))
            / F.col("sample_rate").cast("double")
        ).alias("end_sec"),
    ).filter("end_sec > start_sec")
    peak = frames.groupBy(ID).agg(F.max("rms").alias("peak"))
    whole = attach(attach(limits, peak), region.groupBy(ID).agg(F.lit(True).alias("__found"))).filter("__found is null")
    short = F.col("n_samples") < F.col("frame")
    whole = whole.filter((F.col("n_samples") > 0) & (short | (F.col("peak") > 1e-5))).select(
        ID, F.lit(0.0).alias("start_sec"), (F.col("n_samples") / F.col("sample_rate").cast("double")).alias("end_sec")
    )
    found = durable(region.unionByName(whole))
    tl = Timeline(("start_sec", "end_sec"), F.floor(F.col("start_sec") / 600.0))
    return carry(found, tl, {"pos": ("sum", F.lit(1).cast("long"))}).select(
        ID, (F.col("pos") - 1).alias("pos"), "start_sec", "end_sec"
    )


def even_windows(recs: DataFrame, seg_sec: float = 2.5, max_windows: int = 12) -> DataFrame:
    """At most ``max_windows`` windows of equal length with evenly spaced starts (sample offsets)."""
    rate, n = F.col("sample_rate"), F.col("n_samples")
    sized = recs.filter(n > 0).withColumn("__seg", F.greatest(F.floor(F.lit(seg_sec) * rate), rate.cast("long")))
    if max_windows > 0:
        count = F.lit(max_windows)
    else:
        by_length = F.floor(n / rate / F.lit(max(seg_sec * 0.5, 0.5))) + 1
        count = F.least(F.lit(32), F.greatest(F.lit(8), by_length))
    sized = sized.withColumn("__k", F.when(n <= F.col("__seg"), F.lit(1)).otherwise(count).cast("int"))
    starts = sized.withColumn("__starts", F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.col("__k") - 1),
        lambda i: F.when(
            F.col("__k") > 1,
            F.bround(i * (n - F.col("__seg")) / (F.col("__k") - 1)).cast("long"),
        ).otherwise(F.lit(0).cast("long")),
    )))
    out = starts.select(ID, "sample_rate", "n_samples", "__seg", F.posexplode("__starts").alias("window_id", "start"))
    end = F.least("n_samples", F.col("start") + F.col("__seg"))
    whole = F.col("n_samples") <= F.col("__seg")
    return out.filter(whole | (end - F.col("start") >= F.floor(F.col("sample_rate") / 4))).select(
        ID, F.col("window_id").cast("long").alias("window_id"), "start", end.alias("end")
    )


def hop_windows(
    recs: DataFrame, win_sec: float, hop_sec: float, min_tail_sec: float,
    stop: str = "end", max_windows: int | None = None, keep_first: bool = False,
) -> DataFrame:
    """Overlapping windows by hop (sample offsets), none shorter than ``min_tail_sec``.

    ``stop="end"``: no window starts after one that reached the end; ``"half"``: the
    last start leaves half a window; ``"tail"``: only the shortest length stops.
    """
    rate, n = F.col("sample_rate"), F.col("n_samples")
    sized = recs.filter(n > 0).select(
        ID, "n_samples",
        samples_in(rate, win_sec).alias("win"), samples_in(rate, hop_sec).alias("hop"),
        F.floor(rate * F.lit(min_tail_sec)).alias("tail"),
    )
    out = sized.select("*", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n_samples") - 1, F.col("hop").cast("long"))).alias("window_id", "start"))
    length = F.least("win", F.col("n_samples") - F.col("start"))
    if stop == "end":
        goes_on = (F.col("start") == 0) | (F.col("start") - F.col("hop") + F.col("win") < F.col("n_samples"))
    elif stop == "half":
        goes_on = F.col("start") < F.greatest(F.col("n_samples") - F.floor(F.col("win") / 2), F.lit(1))
    else:
        goes_on = F.lit(True)
    keep = goes_on & (length >= F.col("tail"))
    if keep_first:
        keep = keep | (F.col("start") == 0)
    if max_windows is not None:
        keep = keep & (F.col("window_id") < max_windows)
    return out.filter(keep).select(
        ID, F.col("window_id").cast("long").alias("window_id"), "start", (F.col("start") + length).alias("end")
    )


def split_time_chunks(recs: DataFrame, segment_sec: float, max_segments: int) -> DataFrame:
    """Overlapping transcription windows: half a second (at most a quarter window) overlap, capped."""
    if max_segments <= 1:
        zero = F.lit(0).cast("long")
        return recs.filter("n_samples > 0").select(
            ID, zero.alias("window_id"), zero.alias("start"), F.col("n_samples").cast("long").alias("end")
        )
    seg = max(segment_sec, 1.0)
    step = max(seg - min(0.5, seg / 4), 0.5)
    cut = hop_windows(recs, seg, step, 0.5, stop="tail", max_windows=max_segments, keep_first=True)
    whole = recs.select(ID, F.col("n_samples") <= F.lit(seg) * F.col("sample_rate"))
    short = whole.toDF(ID, "__short")
    return cut.join(short, ID).filter(~F.col("__short") | (F.col("window_id") == 0)).drop("__short")


def region_windows(
    regions: DataFrame, recordings: DataFrame, win_sec: float = 1.5, hop_sec: float = 0.75,
    speech: DataFrame | None = None,
) -> DataFrame:
    """Windows inside each region plus one at its tail; a short region gives one window.

    ``speech`` (regions by default) tells how much of a window is speech: at least
    half, for short regions 30 %.
    """
    r = F.col("sample_rate")
    cut = regions.join(recordings.select(ID, "n_samples", "sample_rate"), ID).select(
        ID, "pos", "sample_rate",
        F.greatest(F.lit(0), F.floor(F.col("start_sec") * r)).cast("long").alias("s0"),
        F.least("n_samples", F.floor(F.col("end_sec") * r)).cast("long").alias("e0"),
        F.greatest(F.floor(F.lit(win_sec) * r), F.floor(r / 4)).cast("long").alias("win"),
        F.greatest(F.floor(F.lit(hop_sec) * r), F.floor(r / 8), F.lit(1)).cast("long").alias("hop"),
    )
    size = F.col("e0") - F.col("s0")
    brief = size < F.col("win")
    inner = F.when(~brief, F.sequence("s0", F.col("e0") - F.col("win"), F.col("hop")))
    tail = F.when(~brief & (F.col("e0") - F.col("win") > F.col("s0")), F.array(F.col("e0") - F.col("win")))
    starts = F.when(brief, F.array("s0")).otherwise(F.concat(inner, F.coalesce(tail, F.array().cast("array<bigint>"))))
    out = cut.filter(~brief | (size >= F.floor(r / 10))).withColumn("__need", F.when(brief, 0.3).otherwise(0.5))
    out = out.select(ID, F.col("pos").alias("region"), "sample_rate", "e0", "win", "__need", F.posexplode(starts).alias("nth", "start"))
    out = out.withColumn("end", F.least("e0", F.col("start") + F.col("win")))
    rate = F.col("sample_rate").cast("double")
    out = out.select(
        ID, "region", F.col("nth").cast("long").alias("nth"), (F.col("start") / rate).alias("start_sec"), (F.col("end") / rate).alias("end_sec"), "__need"
    )
    mask = _union_spans(regions if speech is None else speech)
    left = out.select(ID, F.struct("region", "nth").alias("l_pos"), F.col("start_sec").alias("l_start"), F.col("end_sec").alias("l_end"))
    pairs = overlap_pairs(left, mask)
    voiced = pairs.groupBy(ID, "l_pos").agg(
        F.sum(F.least("l_end", "r_end") - F.greatest("l_start", "r_start")).alias("__voiced")
    ).select(ID, "l_pos.*", "__voiced")
    out = out.join(voiced, [ID, "region", "nth"], "left")
    share = F.coalesce("__voiced", F.lit(0.0)) / (F.col("end_sec") - F.col("start_sec"))
    return out.filter(share >= F.col("__need")).select(ID, "region", "nth", "start_sec", "end_sec")


def _union_spans(regions: DataFrame) -> DataFrame:
    tl = Timeline(("start_sec", "end_sec", "pos"), F.floor(F.col("start_sec") / 600.0))
    tagged = spans(regions, tl, "start_sec", "end_sec", 0.0)
    return tagged.groupBy(ID, "span").agg(
        F.min("start_sec").alias("r_start"), F.max("end_sec").alias("r_end")
    ).select(ID, "r_start", "r_end")
