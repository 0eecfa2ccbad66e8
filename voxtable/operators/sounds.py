"""Sound-event hits: thresholds, per-label maxima, fusing of detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import is_noise, label_parts
from ..functions.text import is_meaningful_speech, strip
from .islands import ID

DETECTORS = ("cnn", "ast")


def union_detectors(*hits: DataFrame) -> DataFrame:
    """Concatenate detector outputs; ``detector_rank`` and ``pos`` keep their order."""
    out = None
    for rank, one in enumerate(hits):
        part = one.withColumn("detector_rank", F.lit(rank))
        out = part if out is None else out.unionByName(part)
    return out


def drop_noise_labels(hits: DataFrame) -> DataFrame:
    return hits.filter(~is_noise("label"))


def top_k_per_window(hits: DataFrame, k: int, threshold: float) -> DataFrame:
    """The ``k`` best classes of every window, then those reaching the threshold.

    The rank filter is pushed below the shuffle as a per-task limit.
    """
    w = Window.partitionBy(ID, "detector", "window_id").orderBy(F.desc("score"), "pos")
    ranked = hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.filter(F.col("score") >= threshold).withColumn("score", F.round("score", 4))


def best_per_label(
    hits: DataFrame, threshold: float, cap: int | None = None, per_window: bool = False
) -> DataFrame:
    """Largest score per label over all windows, best first.

    The threshold applies to the maxima, or with ``per_window`` to every hit before;
    ``cap`` keeps the best labels of a recording only.
    """
    used = hits.filter(F.col("score") >= threshold) if per_window else hits
    best = used.groupBy(ID, "label").agg(F.max("score").alias("score"), F.min(F.struct("window_id", "pos")).alias("__first"))
    ranked = best.filter(F.col("score") >= threshold).withColumn(
        "rank", F.row_number().over(Window.partitionBy(ID).orderBy(F.desc("score"), "__first"))
    )
    if cap is not None:
        ranked = ranked.filter(F.col("rank") <= cap)
    return ranked.select(ID, "rank", "label", F.round("score", 4).alias("score"))


def fuse_detectors(hits: DataFrame, max_results: int = 12, min_score: float = 0.0) -> DataFrame:
    """One list of sounds per recording from all detectors.

    Hits with the same normalised key become one: its best score, and the display
    name of the last hit that reached it.  ``hits`` carries ``detector_rank`` and
    ``pos`` as its order. Hits are first brought down to one row for each label as it
    was written, so the rules for labels run once for each of those.
    """
    clean = hits.withColumn("label", strip(F.coalesce("label", F.lit("")))).filter((F.col("score") >= min_score) & (F.col("score") >= 0))
    written = clean.groupBy(ID, "label").agg(
        F.max(F.struct("score", "detector_rank", "pos")).alias("top"), F.min(F.struct("detector_rank", "pos")).alias("first")
    )
    keyed = written.filter((F.col("label") != "") & ~is_noise("label")).select(ID, "top", "first", label_parts("label").alias("p"))
    best = keyed.filter("p.key <> ''").groupBy(ID, F.col("p.key").alias("key")).agg(
        F.max("top.score").alias("score"), F.max_by("p.display", "top").alias("label"), F.min("first").alias("first")
    )
    w = Window.partitionBy(ID).orderBy(F.desc("score"), "first")
    ranked = best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max_results)
    return ranked.select(ID, "rank", "key", "label", F.round("score", 4).alias("score"))


def events_array(fused: DataFrame) -> DataFrame:
    """Ranked sounds (at most a dozen) as an array of label and score per recording."""
    events = F.array_sort(F.collect_list(F.struct("rank", "label", "score")))
    return fused.groupBy(ID).agg(
        F.transform(events, lambda e: F.struct(e["label"].alias("label"), e["score"].alias("score"))).alias("events")
    )


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def add_speech_event(events, *texts) -> Column:
    """Put a Speech event first when something meaningful was said and no label mentions speech."""
    ev = F.coalesce(_c(events), F.array().cast("array<struct<label:string,score:double>>"))
    spoken = F.lit(False)
    for t in texts:
        spoken = spoken | is_meaningful_speech(t)
    speech = F.array(F.struct(F.lit("Speech").alias("label"), F.lit(0.95).alias("score")))
    named = F.exists(ev, lambda e: F.lower(F.coalesce(e["label"], F.lit(""))).contains("speech"))
    return F.when(spoken & ~named, F.concat(speech, ev)).otherwise(ev)


def event_labels(events) -> Column:
    return F.transform(event_details(events), lambda e: e["label"])


def event_details(events) -> Column:
    return F.filter(_c(events), lambda e: F.coalesce(e["label"], F.lit("")) != "")


def choose_events(cnn: DataFrame, ast: DataFrame, backend: str = "auto", **limits) -> DataFrame:
    """Hits of the detectors a backend name uses, fused."""
    parts = {
        "cnn": (cnn,), "ast": (ast,), "hf": (ast,), "huggingface": (ast,)
    }.get(backend.lower(), (cnn, ast))
    return fuse_detectors(union_detectors(*parts), **limits)


def choose_emotion(cnn, hf, n_samples, backend: str = "auto", min_samples: int = 4000) -> Column:
    """First usable label in the backend's order; clips that are too short are neutral."""
    first = lambda c: F.nullif(strip(_c(c)), F.lit(""))
    order = {
        "cnn": (cnn, hf), "auto": (cnn, hf), "hybrid": (cnn, hf), "hf": (hf, cnn),
        "wav2vec2": (hf, cnn), "huggingface": (hf, cnn),
    }.get(backend.lower(), (cnn, hf))
    return F.when(_c(n_samples) < min_samples, F.lit("neutral")).otherwise(
        F.coalesce(*[first(c) for c in order], F.lit("neutral"))
    )
