"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from voxtable.catalog import CATALOG, Tables

HEADLINE = [
    "talk_report", "merge_segments", "merge_asr_turns", "resolve_overlaps", "assign_words", "assign_timed_text", "speech_regions",
    "fuse_detectors", "best_per_label", "infer_language", "resolve_language", "split_sentences", "collapse_whole_string_loop",
    "language_vote", "history", "active_sessions", "score_summary_orders", "stratified_split", "normalize_embeddings", "conversation_transcript",
]
#: Whole plans and the heaviest rules; timed after the headline list and not part of its total.
HEAVY = ["clean_transcript", "collapse_ngrams", "diarize", "analyze", "align_words", "cluster_speakers", "split_quality"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tables = Tables(spark, folder)
    tables.read("events").groupBy("event_type").count().collect()  # warm up
    times = {}
    for name in HEADLINE + HEAVY:
        begin = time.perf_counter()
        CATALOG[name].build(tables).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    total = lambda names: round(sum(times[n] for n in names), 3)
    print(json.dumps({"metric": "headline_total", "value": total(HEADLINE), "unit": "sec", "queries": times, "heavy_total": total(HEAVY), "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
