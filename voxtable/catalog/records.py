"""Queries on the log, datasets, metrics, embeddings, collapse rules, whole plans and streams."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from ..functions import signal as sg
from ..operators import dataset, embeddings, log, metrics, scoring, speakers, transcripts, waveforms as wf
from ..operators.islands import merge_consecutive
from ..operators.ordered import attach
from ..plans import analyze as an, diarize as di
from ..sources import log as lg
from ..streaming import windows as st
from .fixtures import Tables
from .registry import register

ID = "recording_id"

# --- log
register("history_view", lambda t: log.history_view(t.log()), "SELECT id, audio_filename, question, answer, created_at FROM log", "log")
register("history", lambda t: log.history(t.log(), 500, 20), "SELECT id, audio_filename, question, answer, created_at FROM log ORDER BY created_at DESC, id DESC LIMIT 100 OFFSET 20", "log")
register("get_by_id", lambda t: log.get_by_id(t.log(), 7), "SELECT id, audio_filename, question, answer, created_at FROM log WHERE id = 7", "log")


def _looked_up(t: Tables, find):
    """The log with sounds, laid out for lookups in eight files, and one entry of it."""
    folder = t.scratch("lookup")
    sounds = F.when(F.col("id") % 2 == 0, F.to_json(F.array("question", "answer"))).otherwise(F.lit("not json"))
    log_ = t.log().withColumns({"token": F.concat(F.lit("t"), F.md5(F.col("id").cast("string"))), "sounds_json": sounds})
    lg.write_lookup(log_, folder, "id", "token", rows=max(1, log_.count() // 8))
    return find(t.spark.read.parquet(folder))


_SOUNDS = "CASE WHEN id % 2 = 0 THEN question || '|' || answer ELSE '' END AS sounds"
register(
    "get_analysis_by_id",
    lambda t: _looked_up(t, lambda logs: log.get_by_id(logs, 32)).withColumn("sounds", F.array_join("sounds", "|")),
    "SELECT id, audio_filename, question, answer, created_at, 't' || md5(id::VARCHAR) AS token, " + _SOUNDS + " FROM log WHERE id = 32", "log",
)
register(
    "get_analysis_by_token",
    lambda t: _looked_up(t, lambda logs: lg.read_analysis(log.history_view(logs)).filter(F.col("token") == "t" + hashlib.md5(b"7").hexdigest())).withColumn("sounds", F.array_join("sounds", "|")),
    "SELECT id, audio_filename, question, answer, created_at, 't' || md5(id::VARCHAR) AS token, " + _SOUNDS + " FROM log WHERE id = 7", "log",
)
register(
    "get_audio",
    lambda t: log.get_audio(t.log().withColumns({"audio_mime": F.when(F.col("id") % 2 == 0, F.lit("")).otherwise(F.col("audio_mime")), "audio_data": F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("audio_data"))})).withColumn("audio_data", F.hex("audio_data")),
    "SELECT id, hex(audio_data) AS audio_data, CASE WHEN id % 2 = 0 THEN 'application/octet-stream' ELSE audio_mime END AS audio_mime, audio_filename FROM log WHERE id % 3 <> 0", "log",
)
register("active_sessions", lambda t: log.active_sessions(t.users(), t.sessions(), F.lit("1997-01-01").cast("timestamp")), "SELECT token, id, email, expires_at FROM sessions JOIN users ON users.id = user_id WHERE expires_at > TIMESTAMP '1997-01-01'", "sessions users")
register("end_sessions", lambda t: log.end_sessions(t.sessions(), t.log().filter("answer = 'O'").select(F.col("id").alias("token"))), "SELECT * FROM sessions WHERE token NOT IN (SELECT id FROM log WHERE answer = 'O')", "sessions log")
register("find_user", lambda t: log.find_user(t.users(), " CUSTOMER#000000042@mail.ORG "), "SELECT * FROM users WHERE lower(email) = 'customer#000000042@mail.org'", "users")


def _worker_lines(t: Tables):
    """Events as log lines: stages, noise and messages."""
    line = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("[worker] stage "), "props"))
        .when(F.col("event_type") == "signup", F.lit("You are sending unauthenticated requests to the HF Hub"))
        .otherwise(F.concat(F.lit(" "), F.col("event_type"), F.lit(" "), F.col("props")))
    )
    return t.read("events").select(F.col("user_id").alias("run"), F.col("event_id").alias("pos"), line.alias("line"))


register(
    "triage_worker_log",
    lambda t: log.triage_worker_log(_worker_lines(t)),
    "SELECT run, trim(concat_ws(' ', 'Last stage: ' || replace(stage, '[worker] ', '') || '.', nullif(substring(body, 1, 280), ''))) AS message FROM (SELECT user_id AS run, arg_max(CASE WHEN event_type = 'view' THEN '[worker] stage ' || props END, "
    "CASE WHEN event_type = 'view' THEN event_id END) AS stage, string_agg(CASE WHEN event_type NOT IN ('view', 'signup') THEN event_type || ' ' || props END, ' ' ORDER BY event_id) AS body FROM events WHERE event_type <> 'signup' GROUP BY user_id)",
)


def _answers(t: Tables):
    """One answer for each turn; beside every second one, the answer to a clip without a transcript."""
    c = t.read("conversations").withColumn("id", F.col("conv_id") * 100 + F.col("turn")).withColumn("transcript", F.col("text"))
    silent = c.filter(F.col("turn") % 2 == 1).withColumns({"id": -1 - F.col("id"), "transcript": F.lit(None).cast("string")})
    return c.unionByName(silent).select(
        "id", F.concat(F.lit("clip"), F.col("conv_id").cast("string")).alias("filename"), F.col("role").alias("question"),
        "transcript", F.when(F.col("turn") % 3 > 0, F.array("role", F.lit("dog \"barking\""))).alias("sounds"),
        F.when(F.col("turn") % 3 == 1, F.lit("calm")).alias("emotion"), F.col("role").alias("answer"), F.timestamp_seconds(F.col("conv_id") * 3600).alias("created_at"),
        F.octet_length("text").cast("double").alias("duration"), F.lit("audio/wav").alias("mime"), F.encode("role", "UTF-8").alias("payload"),
    )


_ANSWERS = (
    "an AS (SELECT *, conv_id * 100 + turn AS id, text AS transcript FROM conversations UNION ALL "
    "SELECT *, -1 - (conv_id * 100 + turn), NULL FROM conversations WHERE turn % 2 = 1)"
)
register(
    "append_analysis",
    lambda t: lg.analysis_rows(_answers(t)).withColumn("created_at", F.unix_seconds("created_at")),
    "SELECT id, 'clip' || conv_id AS filename, role AS question, coalesce(transcript, '') AS transcript, CASE WHEN turn % 3 > 0 THEN '[\"' || role || '\",\"dog \\\"barking\\\"\"]' ELSE '[]' END AS sounds_json, "
    "CASE WHEN turn % 3 = 1 THEN 'calm' ELSE '' END AS emotion, role AS answer, conv_id * 3600 AS created_at FROM an",
    also=_ANSWERS,
)
register(
    "append_inference",
    lambda t: lg.inference_rows(_answers(t)).withColumns({"created_at": F.unix_seconds("created_at"), "payload": F.hex("payload")}),
    "SELECT id, 'clip' || conv_id AS filename, octet_length(encode(text))::DOUBLE AS duration, 'audio/wav' AS mime, hex(encode(role)) AS payload, role AS question, role AS answer, conv_id * 3600 AS created_at FROM an",
    also=_ANSWERS,
)


def _appended(t: Tables, append):
    """The log after two appends, read back."""
    folder = t.scratch("log")
    answers = _answers(t)
    append(answers.filter("id >= 0"), folder)
    append(answers.filter("id < 0"), folder)
    return lg.read_log(t.spark, folder).withColumn("created_at", F.unix_seconds("created_at"))


register(
    "analysis_log_roundtrip",
    lambda t: lg.read_analysis(_appended(t, lg.append_analysis)).withColumn("sounds", F.array_join("sounds", "|")),
    "SELECT id, 'clip' || conv_id AS filename, role AS question, coalesce(transcript, '') AS transcript, CASE WHEN turn % 3 > 0 THEN role || '|dog \"barking\"' ELSE '' END AS sounds, "
    "CASE WHEN turn % 3 = 1 THEN 'calm' ELSE '' END AS emotion, role AS answer, conv_id * 3600 AS created_at FROM an",
    also=_ANSWERS,
)
register(
    "inference_log_roundtrip",
    lambda t: _appended(t, lg.append_inference).withColumn("payload", F.hex("payload")),
    "SELECT id, 'clip' || conv_id AS filename, octet_length(encode(text))::DOUBLE AS duration, 'audio/wav' AS mime, hex(encode(role)) AS payload, role AS question, role AS answer, conv_id * 3600 AS created_at FROM an",
    also=_ANSWERS,
)


def _stored(t: Tables):
    """Event properties as stored lists, some broken, some missing."""
    kind = F.col("event_id") % 4
    js = F.when(kind == 0, F.lit(None)).when(kind == 1, F.col("props")).when(kind == 2, F.concat(F.lit('["'), F.col("event_type"), F.lit('", "x"]'))).otherwise(F.lit('["broken'))
    return t.read("events").select(F.col("event_id").alias("id"), js.alias("sounds_json"))


register(
    "read_analysis",
    lambda t: lg.read_analysis(_stored(t)).select("id", F.array_join("sounds", "|").alias("sounds"), F.size("sounds").cast("long").alias("n")),
    "SELECT event_id AS id, CASE WHEN event_id % 4 = 2 THEN event_type || '|x' ELSE '' END AS sounds, CASE WHEN event_id % 4 = 2 THEN 2 ELSE 0 END::BIGINT AS n FROM events",
)
register(
    "add_missing_columns",
    lambda t: lg.union_versions([lg.add_missing_columns(t.users(), {"email": "string", "phone": "string", "age": "int"}), t.users().withColumn("age", F.lit(30))]),
    "SELECT id, email, NULL::VARCHAR AS phone, NULL::INT AS age FROM users UNION ALL SELECT id, email, NULL, 30 FROM users", "users",
)

# --- datasets
register("read_manifest", lambda t: dataset.read_manifest(t.manifest(), _clip_files(t)), "SELECT '/audio/' || filename AS path, target, category, fold FROM manifest JOIN (SELECT s_suppkey * 3 AS k FROM supplier) ON filename = 'clip' || k || '.wav'", "manifest")


def _manifest_files(t: Tables):
    folder = t.scratch("manifest")
    t.manifest().withColumn("take", F.lit('A "quoted", part')).write.option("header", "true").option("escape", '"').csv(folder)
    return dataset.read_manifest(dataset.read_manifest_csv(t.spark, folder), _clip_files(t))


register("read_manifest_csv", _manifest_files, "SELECT '/audio/' || filename AS path, target, category, fold FROM manifest JOIN (SELECT s_suppkey * 3 AS k FROM supplier) ON filename = 'clip' || k || '.wav'", "manifest")


def _clip_files(t: Tables):
    return t.read("supplier").select(F.concat(F.lit("/audio/clip"), (F.col("s_suppkey") * 3).cast("string"), F.lit(".wav")).alias("path"))


register("class_names", lambda t: dataset.class_names(t.manifest()).select(F.array_join("class_names", "|").alias("names")), "SELECT string_agg(category, '|' ORDER BY target) AS names FROM (SELECT DISTINCT target, category FROM manifest)", "manifest")


def _emotion_files(t: Tables):
    k = F.col("s_suppkey")
    pad = lambda c: F.format_string("%02d", c)
    return t.read("supplier").select(F.concat(F.lit("/set/"), F.when(k % 7 == 0, F.lit("02")).otherwise(F.lit("03")), F.lit("-01-"), F.when(k % 11 == 0, F.lit("xx")).otherwise(pad(k % 10)), F.lit("-"), pad(k), F.when(k % 13 == 0, F.lit(".txt")).otherwise(F.lit(".wav"))).alias("path"))


register(
    "label_from_filename",
    lambda t: dataset.label_from_filename(_emotion_files(t)),
    "SELECT printf('/set/03-01-%02d-%02d.wav', s_suppkey % 10, s_suppkey) AS path, s_suppkey % 10 - 1 AS label FROM supplier "
    "WHERE s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 0 AND s_suppkey % 13 <> 0 AND s_suppkey % 10 BETWEEN 1 AND 8",
)
register("label_ids", lambda t: dataset.label_ids(t.read("part"), "p_name").select("p_partkey", "label_id"), "SELECT p_partkey, dense_rank() OVER (ORDER BY p_name) - 1 AS label_id FROM part")
register("class_count", lambda t: dataset.class_count(t.read("part"), "p_type"), "SELECT count(DISTINCT p_type) AS n_classes FROM part")
register(
    "stratified_split",
    lambda t: dataset.stratified_split(t.read("orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus"),
    "SELECT o_orderkey, o_orderstatus, CASE WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42:' || o_orderkey), o_orderkey) <= round_even(count(*) OVER (PARTITION BY o_orderstatus) * 0.2, 0) THEN 'validation' ELSE 'train' END AS part FROM orders",
)
register("class_weights", lambda t: metrics.class_weights(t.read("embeddings"), "label", 12), "SELECT r AS label, w / avg(w) OVER () AS weight FROM (SELECT r, 1.0::DOUBLE / greatest(coalesce(n, 0), 1) AS w FROM range(12) x(r) LEFT JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) e ON e.label = r)", decimals="weight")
register(
    "train_classifier",
    lambda t: metrics.score_summary(dataset.train_classifier(dataset.stratified_split(t.read("embeddings"), "vec_id", "label"), "embedding", "label", "vec_id", 10), 10),
)

# --- metrics
_CC = (
    "cc AS (SELECT label, coalesce(sum(s), 0)::BIGINT AS support, coalesce(sum(p), 0)::BIGINT AS predicted, coalesce(sum(tp), 0)::BIGINT AS tp FROM ("
    "SELECT y_true AS label, 1 AS s, 0 AS p, (y_true = y_pred)::INT AS tp FROM {src} UNION ALL SELECT y_pred, 0, 1, 0 FROM {src}) GROUP BY label), "
    "sc AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0 END AS f1 FROM cc)"
)
_SUMMARY = (
    "SELECT sum(support)::BIGINT AS n_samples, sum(tp) / sum(support) AS accuracy, avg(CASE WHEN support > 0 THEN recall END) AS balanced_accuracy, avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1, "
    "2 * sum(tp) / sum(support + predicted) AS micro_f1, sum(f1 * support) / sum(support) AS weighted_f1 FROM sc"
)
_SCORES = "accuracy balanced_accuracy macro_precision macro_recall macro_f1 micro_f1 weighted_f1"
register("score_summary", lambda t: metrics.score_summary(t.predictions()), _SUMMARY, "predictions", _CC.format(src="predictions"), decimals=_SCORES)


def _many(t: Tables):
    """Order priority predicted by status: five classes, some never predicted."""
    return t.read("orders").select(F.col("o_orderkey").alias("id"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("y_true"), (F.ascii("o_orderstatus") % 5).alias("y_pred"))


_MANY = "many AS (SELECT o_orderkey AS id, o_orderpriority[1]::INT - 1 AS y_true, ascii(o_orderstatus) % 5 AS y_pred FROM orders), " + _CC.format(src="many")
register("score_summary_orders", lambda t: metrics.score_summary(_many(t)), _SUMMARY, also=_MANY, decimals=_SCORES)
register(
    "class_report",
    lambda t: metrics.class_report(_many(t)),
    "SELECT label::VARCHAR AS class, precision, recall, f1, support FROM sc UNION ALL SELECT 'accuracy', NULL, NULL, avg((y_true = y_pred)::INT), count(*) FROM many UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM sc UNION ALL "
    "SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM sc",
    also=_MANY, decimals="precision recall f1",
)
register("confusion_matrix", lambda t: metrics.confusion_matrix(_many(t)), "SELECT a.label::BIGINT AS y_true, b.label::BIGINT AS y_pred, (SELECT count(*) FROM many WHERE y_true = a.label AND y_pred = b.label) AS n FROM cc a, cc b", also=_MANY)
register("per_class_recall", lambda t: metrics.per_class_recall(_many(t), 6), "SELECT r AS label, coalesce(support, 0) AS support, CASE WHEN support > 0 THEN tp / support END AS recall_on_class FROM range(6) x(r) LEFT JOIN cc ON label = r", also=_MANY, decimals="recall_on_class")
register(
    "best_epoch",
    lambda t: metrics.best_epoch(t.history(), 20, chunk_rows=16),
    "SELECT run, arg_max(epoch, epoch) FILTER (improved) AS epoch, arg_max(accuracy, epoch) FILTER (improved) AS accuracy, arg_max(macro_f1, epoch) FILTER (improved) AS macro_f1, max(epoch) AS last_epoch FROM ("
    "SELECT *, min(CASE WHEN epoch - last >= 20 THEN epoch END) OVER (PARTITION BY run) AS stop FROM (SELECT *, max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS last FROM ("
    "SELECT *, top IS NULL OR (accuracy, macro_f1) > top AS improved FROM (SELECT *, max((accuracy, macro_f1)) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM history)))) WHERE stop IS NULL OR epoch <= stop GROUP BY run",
    "history", decimals="macro_f1",
)
register(
    "merge_reports",
    lambda t: metrics.merge_reports(metrics.metrics_report(t.predictions(), "sounds"), metrics.metrics_report(_many(t), "emotion")).select("format", F.explode("tasks").alias("task", "m")).select(
        "format", "task", F.round("m.summary.accuracy", 6).alias("accuracy"), F.size("m.report").cast("long").alias("report_rows"), F.size("m.confusion").cast("long").alias("cells")),
    "SELECT 'metrics_merged_v1' AS format, task, round(accuracy, 6) AS accuracy, k + 3 AS report_rows, k * k AS cells FROM (SELECT 'sounds' AS task, avg((y_true = y_pred)::INT) AS accuracy, (SELECT count(DISTINCT y) FROM (SELECT y_true AS y FROM predictions UNION ALL SELECT y_pred FROM predictions)) AS k FROM predictions "
    "UNION ALL SELECT 'emotion', avg((y_true = y_pred)::INT), (SELECT count(*) FROM cc) FROM many)",
    "predictions", _MANY,
)


def _report_file(t: Tables):
    folder = t.scratch("report")
    lg.write_metrics_report(metrics.metrics_report(_many(t), "emotion"), folder)
    return lg.read_metrics_report(t.spark, folder).select("task", "summary.*")


register("metrics_report_roundtrip", _report_file, "SELECT 'emotion' AS task, * FROM (" + _SUMMARY + ")", also=_MANY, decimals=_SCORES)

# --- vectors
_LONG = "SELECT recording_id, pos, unnest(range(64)) AS d, unnest(vec) AS x FROM emb"


def _unnest(df, column, out="x"):
    return df.select(ID, "pos", F.posexplode(column).alias("d", out)).withColumns({"d": F.col("d").cast("long"), out: F.col(out).cast("double")})


register(
    "normalize_embeddings",
    lambda t: _unnest(embeddings.normalize_embeddings(t.embeddings()), "vec"),
    "SELECT recording_id, pos, d, z / (sqrt(sum(z * z) OVER (PARTITION BY recording_id, pos)) + 1e-8) AS x FROM (SELECT recording_id, pos, d, (x - avg(x) OVER w) / (stddev_pop(x) OVER w + 1e-6) * CASE WHEN d >= 61 THEN 3 ELSE 1 END AS z FROM ("
    "SELECT recording_id, pos, unnest(range(64)) AS d, unnest(vec)::DOUBLE AS x FROM emb) WINDOW w AS (PARTITION BY recording_id, d))",
    "emb", decimals="x",
)
register(
    "split_quality",
    lambda t: embeddings.split_quality(t.embeddings()).withColumns({c: F.round(c, 5) for c in ("silhouette", "minority", "switch_distance")}),
    "SELECT recording_id, round(sil, 5) AS silhouette, round(minority, 5) AS minority, round(coalesce(sw, 0), 5) AS switch_distance, k >= 2 AND sil >= 0.08 AND minority >= 0.08 AND coalesce(sw, 0) >= 0.15 AS accepted FROM ("
    "SELECT recording_id, avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS sil FROM (SELECT recording_id, pos, label, max(m) FILTER (own) AS a, min(m) FILTER (NOT own) AS b FROM ("
    "SELECT x.recording_id, x.pos, x.label, x.label = y.label AS own, avg(1 - list_cosine_similarity(x.vec::DOUBLE[], y.vec::DOUBLE[])) FILTER (x.pos <> y.pos) AS m FROM emb x JOIN emb y ON x.recording_id = y.recording_id GROUP BY x.recording_id, x.pos, x.label, y.label) GROUP BY ALL) GROUP BY ALL) s "
    "JOIN (SELECT recording_id, min(n) / sum(n) AS minority, count(*) AS k FROM (SELECT recording_id, label, count(*) AS n FROM emb GROUP BY ALL) GROUP BY ALL) m USING (recording_id) JOIN (SELECT recording_id, avg(CASE WHEN label <> pl THEN 1 - list_cosine_similarity(vec::DOUBLE[], pv::DOUBLE[]) END) AS sw FROM ("
    "SELECT *, lag(label) OVER w AS pl, lag(vec) OVER w AS pv FROM emb WINDOW w AS (PARTITION BY recording_id ORDER BY pos)) GROUP BY ALL) j USING (recording_id)",
    "emb",
)
register("cluster_speakers", lambda t: embeddings.cluster_speakers(embeddings.normalize_embeddings(t.embeddings())))
register("cluster_windows", lambda t: embeddings.cluster_windows(t.embeddings()))
register("cluster_global", lambda t: embeddings.cluster_global(t.embeddings(), 4).select(ID, "pos", "voice"))


def _regions(t: Tables):
    start = F.col("pos") * 1.0
    return t.embeddings().select(ID, "pos", start.alias("start_sec"), (start + F.when(F.col(ID) % 2 == 0, 0.9).otherwise(0.15)).alias("end_sec"), "vec")


register("label_speakers", lambda t: embeddings.label_speakers(_regions(t), _regions(t).withColumn("end_sec", F.col("start_sec") + 1.5)))


register(
    "score_batches",
    lambda t: scoring.score_batches(t.read("embeddings").select("vec_id", "embedding"), scoring.linear_scorer(np.cos(np.outer(np.arange(64), np.arange(1, 11))), "vec_id", "embedding"), "vec_id long, best long, score double").select("vec_id", "best", F.round("score", 5).alias("score")),
    "SELECT vec_id, arg_max(c, s) AS best, round(max(s), 5) AS score FROM (SELECT vec_id, c - 1 AS c, sum(x * cos(d * c)) AS s FROM (SELECT vec_id, unnest(range(64)) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings), range(1, 11) r(c) GROUP BY ALL) GROUP BY vec_id",
)
_E = "SELECT vec_id // 20 AS recording_id, vec_id % 20 AS pos, unnest(range(len(v))) AS d, unnest(v)::DOUBLE AS x FROM (SELECT vec_id, {v} AS v FROM embeddings)"
register("softmax", lambda t: _unnest(t.embeddings(), sg.softmax("vec")), "SELECT recording_id, pos, d, round(exp(x) / sum(exp(x)) OVER (PARTITION BY recording_id, pos), 4) AS x FROM (SELECT recording_id, pos, unnest(range(64)) AS d, unnest(vec)::DOUBLE AS x FROM emb)", "emb")
register(
    "standardize", lambda t: _unnest(t.embeddings(), sg.standardize("vec")),
    "SELECT recording_id, pos, d, (x - avg(x) OVER w) / greatest(stddev_samp(x) OVER w, 1e-6) AS x FROM (SELECT recording_id, pos, unnest(range(64)) AS d, unnest(vec)::DOUBLE AS x FROM emb) WINDOW w AS (PARTITION BY recording_id, pos)", "emb", decimals="x",
)
register(
    "pad_or_crop", lambda t: _unnest(t.embeddings(), sg.pad_or_crop("vec", 40)).unionByName(_unnest(t.embeddings(), sg.pad_or_crop("vec", 70))),
    _E.format(v="embedding[13:52]") + " UNION ALL " + _E.format(v="list_concat(embedding, list_transform(range(6), lambda i: list_min(embedding)))"), decimals="x",
)
register(
    "cosine_distance",
    lambda t: t.embeddings().select(ID, "pos", F.round(sg.cosine_distance(sg.unit("vec"), sg.unit(F.reverse("vec"))), 5).alias("d")),
    "SELECT recording_id, pos, round(1 - list_cosine_similarity(vec::DOUBLE[], list_reverse(vec)::DOUBLE[]), 5) AS d FROM emb", "emb",
)
_S = "SELECT recording_id, unnest(range(len(s))) AS i, unnest(s) AS x FROM (SELECT recording_id, {s} AS s FROM waveforms)"


register("peak_normalize", lambda t: wf.samples(wf.peak_normalize(t.waveforms())), _S.format(s="list_transform(samples, lambda x: x::DOUBLE / list_max(list_transform(samples, lambda y: abs(y)))::DOUBLE)"), "waveforms", decimals="x")
register("cap_duration", lambda t: wf.samples(wf.cap_duration(t.waveforms(), 0.2)), _S.format(s="list_transform(samples[1:40], lambda x: x::DOUBLE)"), "waveforms", decimals="x")
register("slice_span", lambda t: wf.samples(wf.slice_span(t.waveforms(), F.lit(0.05), F.lit(0.3))), _S.format(s="list_transform(samples[11:60], lambda x: x::DOUBLE)"), "waveforms", decimals="x")
register(
    "skip_silent",
    lambda t: wf.skip_silent(t.waveforms(), 0.12).select(ID).distinct(),
    "SELECT recording_id FROM waveforms WHERE sqrt(list_sum(list_transform(samples, lambda x: x::DOUBLE * x::DOUBLE)) / len(samples) + 1e-12) >= 0.12", "waveforms",
)

# --- collapse rules
_BAL = (
    "who AS (SELECT recording_id, speaker, sum(end_sec - start_sec) AS sec, count(*) AS n, min(turn) AS f FROM m0 GROUP BY ALL), bal AS (SELECT recording_id, count(*) AS k, arg_max(speaker, (sec, -f)) AS major, sum(sec) AS total, arg_min(n, (sec, -f)) AS least_n, min(sec) / sum(sec) AS least_share FROM who GROUP BY ALL)"
)
_M0 = (
    "m0 AS (SELECT recording_id, min(turn) AS turn, any_value(speaker) AS speaker, min(start_sec) AS start_sec, max(end_sec) AS end_sec, string_agg(text, ' ' ORDER BY turn) AS text FROM (SELECT *, sum(chg) OVER (PARTITION BY recording_id ORDER BY turn) AS run FROM "
    "(SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY recording_id ORDER BY turn) = speaker THEN 0 ELSE 1 END AS chg FROM turns)) GROUP BY recording_id, run)"
)


def _collapsed(condition: str) -> str:
    return (
        f"SELECT recording_id, turn, speaker, start_sec, end_sec, text, text AS text_original FROM m0 WHERE recording_id NOT IN (SELECT recording_id FROM bal WHERE {condition}) UNION ALL "
        f"SELECT m0.recording_id, min(turn), any_value(major), min(start_sec), max(end_sec), string_agg(text, ' ' ORDER BY turn), string_agg(text, ' ' ORDER BY turn) FROM m0 JOIN bal ON bal.recording_id = m0.recording_id WHERE {condition} GROUP BY m0.recording_id"
    )


def _merged(t: Tables):
    return merge_consecutive(t.turns().drop("role"))


register("collapse_weak_speaker", lambda t: speakers.collapse_weak_speaker(_merged(t), 0.45, 2), _collapsed("k >= 2 AND least_share < 0.45 AND least_n <= 2"), "turns", f"{_M0}, {_BAL}")
_SWITCH = "bal.recording_id IN (SELECT recording_id FROM m0 GROUP BY recording_id HAVING count(*) >= 4 AND avg(end_sec - start_sec) <= 25) AND k = 2"
register("collapse_ping_pong", lambda t: speakers.collapse_ping_pong(_merged(t), 0.7, 25.0), _collapsed(_SWITCH), "turns", f"{_M0}, {_BAL}")


def _lang_of(t: Tables):
    return t.turns().select(ID).distinct().withColumn("lang", F.when(F.col(ID) % 2 == 0, "kn").otherwise("en"))


def _normalized(t: Tables):
    return speakers.normalize_turns(attach(t.turns().drop("role"), _lang_of(t)), "lang")


register("normalize_turns", _normalized)
register("turns_result", lambda t: speakers.turns_result(_normalized(t), _lang_of(t)))

CUES = {"addresses_a": r"(?i)\bthe\b", "addresses_b": r"(?i)\band\b", "self_a": "^In ", "self_b": "^An ", "greeting": r"(?i)\bhe\b", "start": r"(?i)\ber\b", "follow_up": r"^[A-Za-z]+\.$"}
_FLAG = {k: f"regexp_matches(text, '{p}')" for k, p in CUES.items()}
register(
    "dialogue_speakers",
    lambda t: speakers.dialogue_speakers(_sentences(t), CUES, chunk_rows=16).select(ID, "turn", "speaker", "text"),
    "SELECT recording_id, min(turn) AS turn, 'Speaker ' || (min(who) + 1) AS speaker, string_agg(text, ' ' ORDER BY turn) AS text FROM (SELECT *, sum(changed) OVER (PARTITION BY recording_id ORDER BY turn) AS run FROM ("
    "SELECT *, CASE WHEN lag(who) OVER (PARTITION BY recording_id ORDER BY turn) = who THEN 0 ELSE 1 END AS changed, max(who) OVER (PARTITION BY recording_id) <> min(who) OVER (PARTITION BY recording_id) AS two_voices FROM f) WHERE two_voices) GROUP BY recording_id, run",
    "turns", recursive=True,
    also="s0 AS (SELECT recording_id, string_agg(text, ' ' ORDER BY turn) AS text FROM turns GROUP BY recording_id), s1 AS (SELECT recording_id, unnest(range(len(p))) AS pos, unnest(p) AS text FROM (SELECT recording_id, list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), "
    "lambda x: trim(x, ' ,')), lambda x: x <> '') AS p FROM s0)), s2 AS (SELECT recording_id, pos, CASE WHEN regexp_matches(text, '[.!?]$') THEN text ELSE text || '.' END AS text FROM s1), fl AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in _FLAG.items()) + " FROM s2), "
    "pr AS (SELECT recording_id, least(coalesce(min(CASE WHEN start THEN (pos, 1) WHEN greeting THEN (pos, 0) END)[1] + min(CASE WHEN start THEN (pos, 1) WHEN greeting THEN (pos, 0) END)[2], 0), max(pos)) AS b FROM fl GROUP BY recording_id HAVING bool_or(addresses_a) AND bool_or(addresses_b) AND max(pos) > 0), "
    "o AS (SELECT fl.*, pos >= b AS ins, bool_or(pos >= b AND (addresses_a OR addresses_b OR self_a OR self_b)) OVER (PARTITION BY fl.recording_id ORDER BY pos) AS act FROM fl JOIN pr ON pr.recording_id = fl.recording_id), "
    "f AS (SELECT recording_id, pos AS turn, text, CASE WHEN NOT ins OR self_b THEN 0 WHEN self_a THEN 1 WHEN addresses_a AND NOT addresses_b THEN 0 WHEN addresses_b AND NOT addresses_a THEN 1 ELSE 0 END AS who FROM o WHERE pos = 0 UNION ALL "
    "SELECT o.recording_id, o.pos, o.text, CASE WHEN NOT ins OR self_b THEN 0 WHEN self_a THEN 1 WHEN addresses_a AND NOT addresses_b THEN 0 WHEN addresses_b AND NOT addresses_a THEN 1 WHEN act AND follow_up THEN who WHEN act THEN 1 - who ELSE 0 END FROM f JOIN o ON o.recording_id = f.recording_id AND o.pos = f.turn + 1)",
)


def _sentences(t: Tables):
    from ..operators.ordered import by_position, join_text

    whole = join_text(t.turns(), by_position("turn"), {"text": (F.col("text"), " ")})
    return transcripts.sentences(whole).withColumn("pos", F.col("pos").cast("long"))


# --- whole plans
def _talk_clips(t: Tables):
    return attach(t.clips(), _event_lang(t))


def _event_lang(t: Tables):
    return t.clips().select(ID, F.when(F.col(ID) % 3 == 0, "kn").otherwise("en").alias("lang"))


def _embed(t: Tables):
    """Stands for the user's model: one of all embeddings, drawn by a hash of recording and position."""
    ids = t.read("embeddings")
    vectors = ids.select(F.col("vec_id").alias("__v"), F.col("embedding").alias("vec"))
    lowest = ids.agg(F.min("vec_id")).scalar()
    span = ids.agg(F.max("vec_id") - F.min("vec_id") + 1).scalar()

    def embed(spans):
        keyed = spans.withColumn("__v", lowest + F.pmod(F.xxhash64(ID, "pos"), span))
        return keyed.join(vectors, "__v").drop("__v")

    return embed


def _clip_phrases(t: Tables):
    """Phrases on the clips' short time lines."""
    p = t.phrases()
    return p.select(ID, "pos", "text", (F.col("start_sec") / 200).alias("start_sec"), (F.col("end_sec") / 200).alias("end_sec"))


register("speaker_segments", lambda t: di.speaker_segments(t.frames(), _talk_clips(t), _embed(t)))
register("diarize", lambda t: di.diarize(t.frames(), _talk_clips(t), _embed(t), _clip_phrases(t)))
register("align_words", lambda t: di.align_words(t.words(), t.turn_segments())[0])


def _heard(t: Tables):
    """What the plan takes besides texts: turns by voice, detector hits and an emotion per turn."""
    preds = t.turns().select(ID, "turn", F.when(F.col("turn") % 2 == 0, "happy").otherwise("sad").alias("emotion"))
    return t.turns().drop("role"), t.hits(), preds


def _to_analyze(t: Tables):
    from ..operators.report import plain_transcript

    recs = plain_transcript(t.turns()).select(
        ID, F.col("transcript_original").alias("original"), F.lit(None).cast("string").alias("translated"), F.lit("auto").alias("lang"),
        F.when(F.col(ID) % 2 == 0, "calm").otherwise("").alias("emotion"),
    )
    return an.analyze(recs, *_heard(t))


def _pieces(t: Tables):
    """Turns as transcribed pieces in English or in the language that a model gave, some with a translation."""
    code = F.element_at(F.array(*[F.lit(x) for x in ("kn", "de", "fr")]), (F.col("turn") % 3 + 1).cast("int"))
    other = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("translated "), "text"))
    return t.turns().select(ID, F.col("turn").alias("pos"), F.col("text").alias("original"), other.alias("translated"), code.alias("lang"))


def _analyze_pieces(t: Tables):
    recs = t.turns().groupBy(ID).agg(F.when(F.col(ID) % 2 == 0, "calm").otherwise("").alias("emotion"))
    return an.analyze(recs, *_heard(t), chunks=_pieces(t))


register("analyze_pieces", _analyze_pieces)
register("analyze", _to_analyze)


# --- streams, driven to their end over a table that arrives part by part
_PARTS = 3


def _arrivals(t: Tables):
    """The events in parts by time, one after the other; every tenth one comes again with the part after its own."""
    source = t.read("events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi = source.agg(F.min(at), F.max(at)).first()
    part = F.lit(0) if lo is None else F.expr(f"int(({_PARTS} * (unix_micros(cast(ts AS timestamp)) - {lo})) div {hi - lo + 1})")
    dealt = source.withColumn("part", part)
    again = dealt.filter(F.col("event_id") % 10 == 0).withColumn("part", F.col("part") + 1)
    every = dealt.unionByName(again)
    return [every.filter(F.col("part") == k).drop("part") for k in range(_PARTS + 1)]


def _stream(t: Tables, name: str, build):
    """What the stream has written after the last part; it is stopped and taken up again between parts."""
    spark = t.spark
    folder = t.scratch(name)
    schema = t.read("events").schema
    for part in _arrivals(t):
        part.write.mode("append").parquet(f"{folder}/in")
        rows = spark.readStream.schema(schema).parquet(f"{folder}/in")
        frames = rows.select(F.col("user_id").alias(ID), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") / 500).alias("rms"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("created_at"))
        build(frames, folder).awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def _run(df, folder):
    return df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")


# a window or session comes out once the watermark, the newest time less the delay, has passed its end; an event that
# comes again counts where the watermark of the parts before hasn't passed the end that it would have by itself
_ARRIVALS = (
    "ends AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events), "
    f"dealt AS (SELECT user_id AS recording_id, value / 500 AS rms, epoch_us(ts) AS u, event_id, {_PARTS} * (epoch_us(ts) - lo) // (hi - lo + 1) AS part FROM events, ends), "
    "marks AS (SELECT p, (max(u) // 1000) * 1000 AS mark FROM dealt, range(1, 9) r(p) WHERE part < p GROUP BY p), "
    "arrived AS (SELECT recording_id, rms, u, -9000000000000000 AS mark FROM dealt UNION ALL SELECT recording_id, rms, u, mark FROM dealt JOIN marks ON p = part + 1 WHERE event_id % 10 = 0)"
)
register(
    "stream_windows",
    lambda t: _stream(t, "windows", lambda f, d: _run(st.stream_windows(f, "2 hours", "1 hour", "3 hours"), d)).select(
        ID, F.unix_seconds("win_start").alias("win_start"), "n_frames", "peak"),
    "SELECT recording_id, win_start, count(*) AS n_frames, max(rms) AS peak FROM (SELECT *, (u // 3600000000 - unnest([0, 1])) * 3600 AS win_start FROM arrived) "
    "WHERE (win_start + 7200) * 1000000 > mark - 10800000000 AND (win_start + 7200) * 1000000 <= (SELECT hi // 1000 * 1000 - 10800000000 FROM ends) GROUP BY ALL",
    also=_ARRIVALS, decimals="peak",
)
register(
    "stream_speech_sessions",
    lambda t: _stream(t, "sessions", lambda f, d: _run(st.stream_speech_sessions(f, 0.1, "5 hours", "10 hours"), d)).withColumns(
        {"from_ts": F.unix_micros("from_ts"), "to_ts": F.unix_micros("to_ts")}),
    "SELECT recording_id, min(u) AS from_ts, max(u) + 18000000000 AS to_ts, count(*) AS n_frames, max(rms) AS peak FROM (SELECT *, sum(chg) OVER (PARTITION BY recording_id ORDER BY u) AS s FROM ("
    "SELECT *, CASE WHEN u - lag(u) OVER (PARTITION BY recording_id ORDER BY u) <= 18000000000 THEN 0 ELSE 1 END AS chg FROM arrived WHERE rms >= 0.1 AND u + 18000000000 > mark - 36000000000)) "
    "GROUP BY recording_id, s HAVING max(u) + 18000000000 <= (SELECT hi // 1000 * 1000 - 36000000000 FROM ends)",
    also=_ARRIVALS, decimals="peak",
)
register(
    "stream_log",
    lambda t: _stream(t, "log", lambda f, d: st.stream_log(f.unionByName(f).select("id", ID, "created_at"), f"{d}/out", f"{d}/state", available_now=True)).select("id", ID),
    "SELECT event_id AS id, user_id AS recording_id FROM events",
)
