"""The operators of this subpackage as queries over the given tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, conversations, decontamination, language, lines, lm, near_duplicates, packing, personal, quality, secrets, spelling, sql, token_files, toxicity


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    common.visible_to_workers(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """One row a document with a line: how many lines it has, how many are copies or near an earlier one, and which go."""
    got = lines.deduplicate_lines(_table(spark, folder, "documents"))
    number = lambda cond: F.count(F.when(cond, 1))
    gone = F.array_join(F.array_sort(F.collect_set(F.when(~F.col("kept"), F.col("line_no")))), ",")
    return got.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), number(F.col("copy")).alias("n_copies"), number(F.col("near") & ~F.col("copy")).alias("n_near"), gone.alias("removed")
    )


def near_duplicate_documents(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(_table(spark, folder, "documents"), percent=85)


def lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = lm.train(docs.where(~common.in_fold(7, 2)))
    scored = lm.score(docs, model)
    return scored.select(
        "doc_id", common.in_fold(7, 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        *(F.round(c, 6).alias(c) for c in ("base_score", "score")),
    )


def decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.decontamination_report(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = language.train_language_model(docs.where(~common.in_fold(4, 2)))
    return language.predict_languages(docs, model).withColumn("held_out", common.in_fold(4, 2))


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    got = quality.quality_report(_table(spark, folder, "documents"))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return got.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (F.col("rejected_by").isNull() & ~base).alias("kept")
    )


def toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    labelled = toxicity.labelled_documents(docs, _table(spark, folder, "labels")).where(~common.in_fold(5, 0))
    model = toxicity.train_toxicity_model(labelled)
    return toxicity.score_toxicity(docs, model).withColumn("held_out", common.in_fold(5, 0))


def pack_sequences(spark: SparkSession, folder: str) -> DataFrame:
    placed = packing.pack(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=2, capacity=4096)
    return placed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    found = personal.find_personal_data(docs, personal.train_span_model(docs))
    sure = F.filter("spans", lambda x: x["sure"])
    number = lambda kind: F.size(F.filter("spans", lambda x: x["sure"] & (x["kind"] == kind))).cast("long")
    counts = [number(kind).alias(f"n_{kind}") for kind in personal.KINDS]
    return found.select("doc_id", *counts, F.sha2(_spans(sure), 256).alias("base_sha256"), _spans(F.col("spans")).alias("spans"))


def token_ids(spark: SparkSession, folder: str) -> DataFrame:
    place = common.shared_folder(spark, "tokens")
    token_files.write_token_files(_table(spark, folder, "documents"), place, public_tokenizers.path("byte_bpe_50k.json"), end=0)
    read = token_files.read_token_files(spark, place)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, folder, "documents"))
    sure = F.filter("spans", lambda x: x["sure"])
    number = lambda kind: F.size(F.filter("spans", lambda x: x["sure"] & (x["kind"] == kind))).cast("long")
    counts = [number(kind).alias(f"n_{kind}") for kind in secrets.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(_spans(sure), 256).alias("base_sha256"), _spans(F.col("spans")).alias("spans"))


def _spans(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    words = spelling.count_words(_table(spark, folder, "documents"), every=31)
    return spelling.spelling_variants(common.written(words, "words"))


def conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = conversations.damaged(_table(spark, folder, "conversations"))
    report = common.written(conversations.repair_report(rows), "repairs")
    digests = conversations.digests(conversations.repaired(rows, report)).withColumnRenamed("conv_id", "id")
    both = report.join(digests, report["conv_id"].eqNullSafe(digests["id"]), "left").drop("id")
    return both.withColumn("repaired_sha256", F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256))).drop("sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": line_dedup,
    "op2_lm_scoring": lm_scoring,
    "op3_decontaminate": decontaminate,
    "op4_near_duplicates": near_duplicate_documents,
    "op5_language_id": language_id,
    "op6_quality_rules": quality_rules,
    "op7_toxicity": toxicity_scores,
    "op8_packing": pack_sequences,
    "op9_personal_data": personal_data,
    "op10_token_ids": token_ids,
    "op11_spelling_variants": spelling_variants,
    "op12_conversation_repair": conversation_repair,
    "op13_secret_scan": secret_scan,
}
SQL: dict[str, str] = {
    "op1_line_dedup": sql.LINE_DEDUP,
    "op2_lm_scoring": sql.LM_SCORING,
    "op4_near_duplicates": sql.NEAR_DUPLICATES,
    "op6_quality_rules": sql.QUALITY_RULES,
    "op11_spelling_variants": sql.SPELLING_VARIANTS,
    "op12_conversation_repair": sql.CONVERSATION_REPAIR,
}
