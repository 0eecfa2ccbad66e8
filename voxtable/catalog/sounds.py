"""Queries on detector hits, emotions and per-recording reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import DISPLAY, KEYWORDS, label_display, label_key
from ..operators import report, sounds, speakers
from ..operators.ordered import attach
from .fixtures import Tables
from .registry import register

ID = "recording_id"
_NOISE = "regexp_matches(lower(label), 'sine wave|white noise|pink noise|silence')"


def _names(t: Tables):
    """Part names as sound labels; many hold keyword substrings."""
    return t.read("part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", F.element_at(F.array(F.lit("Smoke Alarm"), F.lit("dog"), F.lit("Window"), F.lit("car horn"), F.lit("clock-alarm"), F.lit("")), (F.col("p_partkey") % 6 + 1).cast("int")), "p_name").alias("label"))


_NAMED = "named AS (SELECT p_partkey AS id, concat_ws(' ', ['Smoke Alarm', 'dog', 'Window', 'car horn', 'clock-alarm', ''][p_partkey % 6 + 1], p_name) AS label FROM part), nl AS (SELECT id, trim(label) AS raw, lower(trim(label)) AS low, trim(regexp_replace(lower(trim(label)), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM named)"
_KEY = "CASE WHEN raw = '' THEN '' " + " ".join(f"WHEN slug = '{k}' THEN '{k}'" for k in DISPLAY) + " " + " ".join(f"WHEN regexp_matches(low, '{p}') THEN '{k}'" for p, k, _ in KEYWORDS) + " ELSE coalesce(nullif(substring(slug, 1, 80), ''), substring(low, 1, 80)) END"
_DISP = "CASE WHEN raw = '' THEN '' " + " ".join(f"WHEN slug = '{k}' THEN '{d}'" for k, d in DISPLAY.items()) + " " + " ".join(f"WHEN regexp_matches(low, '{p}') THEN '{d}'" for p, _, d in KEYWORDS) + " ELSE trim(regexp_replace(replace(raw, '_', ' '), '\\s+', ' ', 'g')) END"
register("normalize_label", lambda t: _names(t).select("id", label_key("label").alias("key"), label_display("label").alias("display")), f"SELECT id, {_KEY} AS key, {_DISP} AS display FROM nl", also=_NAMED)
register("drop_noise_labels", lambda t: sounds.drop_noise_labels(t.hits()), f"SELECT * FROM hits WHERE NOT {_NOISE}", "hits")
register("union_detectors", lambda t: sounds.union_detectors(*[t.hits().drop("detector_rank").filter(F.col("detector") == d) for d in sounds.DETECTORS]), "SELECT * FROM hits", "hits")
register(
    "top_k_per_window",
    lambda t: sounds.top_k_per_window(t.hits(), 2, 0.1),
    "SELECT * REPLACE (round(score, 4) AS score) FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, detector, window_id ORDER BY score DESC, pos)::INT AS rank FROM hits) WHERE rank <= 2 AND score >= 0.1", "hits",
)


def _best(threshold: float, cap: str, per_window: bool) -> str:
    return (
        "SELECT * FROM (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY s DESC, f)::INT AS rank, label, round(s, 4) AS score FROM (SELECT recording_id, label, max(score) AS s, min((window_id, pos)) AS f FROM hits "
        + (f"WHERE score >= {threshold} " if per_window else "") + f"GROUP BY ALL HAVING max(score) >= {threshold}))" + cap
    )


register("best_per_label", lambda t: sounds.best_per_label(t.hits(), 0.2), _best(0.2, "", False), "hits")
register("best_per_label_capped", lambda t: sounds.best_per_label(t.hits(), 0.08, cap=3, per_window=True), _best(0.08, " WHERE rank <= 3", True), "hits")
_KEYED = f"keyed AS (SELECT recording_id, detector_rank, pos, score, {_KEY} AS key, {_DISP} AS display FROM (SELECT *, trim(label) AS raw, lower(trim(label)) AS low, trim(regexp_replace(lower(trim(label)), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM hits WHERE NOT {_NOISE}))"
_FUSED = (
    "SELECT * FROM (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY s DESC, f)::INT AS rank, key, label, round(s, 4) AS score FROM (SELECT recording_id, key, max(score) AS s, "
    "arg_max(display, (score, detector_rank, pos)) AS label, min((detector_rank, pos)) AS f FROM keyed GROUP BY ALL)) WHERE rank <= 12"
)
register("fuse_detectors", lambda t: sounds.fuse_detectors(t.hits()), _FUSED, "hits", _KEYED)


def _parts(t: Tables):
    return [t.hits().drop("detector_rank").filter(F.col("detector") == d) for d in sounds.DETECTORS]


register("choose_events", lambda t: sounds.choose_events(*_parts(t), backend="ast"), _FUSED.replace("FROM keyed", "FROM keyed WHERE detector_rank = 1"), "hits", _KEYED)
register(
    "event_labels",
    lambda t: sounds.events_array(sounds.fuse_detectors(t.hits())).select(ID, F.array_join(sounds.event_labels("events"), "|").alias("labels"), F.size(sounds.event_details("events")).cast("long").alias("n")),
    f"SELECT recording_id, string_agg(label, '|' ORDER BY rank) AS labels, count(*) AS n FROM ({_FUSED}) GROUP BY recording_id", "hits", _KEYED,
)


def _records(t: Tables):
    """One record per conversation, sounds from the user of the same number; beside every fourth, one without speech."""
    texts = report.plain_transcript(t.turns())
    recs = attach(texts, sounds.events_array(sounds.fuse_detectors(t.hits())))
    n = F.col(ID) % 4
    recs = recs.withColumns({
        "transcript_original": F.concat(F.lit("o "), "transcript_original"),
        "emotion": F.element_at(F.array(F.lit("happy"), F.lit(""), F.lit("neutral"), F.lit("sad")), (n + 1).cast("int")),
        "language": F.when(n == 1, F.lit("fr")).otherwise(F.lit("en")),
        "languages": F.array(F.when(n == 1, F.lit("fr")).otherwise(F.lit("en"))),
    })
    silent = recs.filter(n == 3).withColumns({ID: -1 - F.col(ID), "transcript": F.lit(""), "transcript_original": F.lit("")})
    return recs.unionByName(silent)


_ST = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_RECS = _KEYED + f", fused AS ({_FUSED}), ev AS (SELECT recording_id, list(label ORDER BY rank) AS labels, string_agg(label || printf(' (%.2f)', score + 1e-9), ', ' ORDER BY rank) AS scored FROM fused GROUP BY recording_id), " + (
    f"rec0 AS (SELECT t.recording_id, p AS transcript, 'o ' || p AS transcript_original, ['happy', '', 'neutral', 'sad'][t.recording_id % 4 + 1] AS emotion, "
    f"CASE WHEN t.recording_id % 4 = 1 THEN 'fr' ELSE 'en' END AS language, labels, scored, lines, n FROM (SELECT recording_id, string_agg({_ST.format('text')}, ' ' ORDER BY turn) AS p, string_agg(speaker || ': ' || {_ST.format('text')}, E'\\n' ORDER BY turn) AS lines, "
    f"count(DISTINCT speaker) AS n FROM turns WHERE {_ST.format('text')} <> '' GROUP BY recording_id) t LEFT JOIN ev USING (recording_id)), "
    "recs AS (SELECT * FROM rec0 UNION ALL SELECT * REPLACE (-1 - recording_id AS recording_id, '' AS transcript, '' AS transcript_original, NULL AS lines, NULL AS n) FROM rec0 WHERE recording_id % 4 = 3)"
)
_MEANS = "(length({0}) >= 3 AND (regexp_matches({0}, '[A-Za-z\\x{{0900}}-\\x{{0D7F}}]{{2}}') OR length({0}) >= 4))"
register(
    "add_speech_event",
    lambda t: _records(t).select(ID, F.array_join(sounds.event_labels(sounds.add_speech_event("events", "transcript", "transcript_original")), "|").alias("labels")),
    f"SELECT recording_id, array_to_string(CASE WHEN ({_MEANS.format(_ST.format('transcript'))} OR {_MEANS.format(_ST.format('transcript_original'))}) THEN list_concat(['Speech'], coalesce(labels, [])) ELSE coalesce(labels, []) END, '|') AS labels FROM recs",
    "hits turns", _RECS,
)
register(
    "build_context",
    lambda t: report.build_context(_records(t), t.turns(), scores=True),
    "SELECT recording_id, concat_ws(E'\\n', 'Speech (transcript): ' || CASE WHEN transcript = '' THEN '[No speech detected]' ELSE transcript END, 'Speaker-separated transcript:' || E'\\n' || lines, "
    "'Speaker emotion (estimated): ' || coalesce(nullif(emotion, ''), 'unknown'), 'Non-speech (environmental sounds): ' || coalesce(scored, '[No environmental sounds detected]')) AS context FROM recs",
    "hits turns", _RECS,
)
register(
    "build_context_from_template",
    lambda t: report.build_context(_records(t), t.turns(), template="<{emotion}> {transcript} / {events}"),
    "SELECT recording_id, '<' || coalesce(nullif(emotion, ''), 'unknown') || '> ' || CASE WHEN transcript = '' THEN '[No speech detected]' ELSE transcript END || ' / ' || coalesce(array_to_string(labels, ', '), '[No environmental sounds detected]') AS context FROM recs",
    "hits turns", _RECS,
)
register(
    "sound_summary",
    lambda t: _records(t).select(ID, report.sound_summary(sounds.event_labels("events")).alias("summary")),
    "SELECT recording_id, coalesce(array_to_string(labels, ', '), 'No distinct environmental sounds detected.') AS summary FROM recs", "hits turns", _RECS,
)
_SAID = f"({_MEANS.format('transcript')} OR {_MEANS.format('transcript_original')})"
_MOOD = "coalesce(nullif(emotion, ''), 'neutral')"
register(
    "template_answer",
    lambda t: report.template_answer(_records(t).withColumn("sounds", sounds.event_labels("events")), t.turns()),
    f"SELECT recording_id, CASE WHEN NOT {_SAID} AND labels IS NULL THEN 'No clear speech or identifiable sounds were detected in this clip.' ELSE concat_ws(E'\\n', 'Sounds detected: ' || array_to_string(labels, ', ') || '.', "
    f"CASE WHEN n >= 2 THEN 'Conversation by speaker:' || E'\\n  ' || replace(lines, E'\\nspk_', E'\\n  spk_') WHEN {_SAID} THEN 'Speech heard: \"' || CASE WHEN language <> 'en' THEN transcript_original ELSE transcript END || '\"' END, "
    f"CASE WHEN {_MOOD} NOT IN ('unknown', 'neutral') OR {_SAID} THEN 'Speaker emotion: ' || upper({_MOOD}[1]) || {_MOOD}[2:] || '.' END) END AS answer FROM recs",
    "hits turns", _RECS,
)

# --- languages of a recording
register(
    "language_vote",
    lambda t: report.language_vote(t.votes(), ("en", "kn")),
    "SELECT recording_id, arg_max(code, (code IN ('en', 'kn'), n, -f)) AS language FROM (SELECT recording_id, code, count(*) AS n, min(pos) AS f FROM votes GROUP BY ALL) GROUP BY recording_id", "votes",
)
_NAME = "CASE code WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' ELSE upper(code) END"
register(
    "language_rollup",
    lambda t: report.language_rollup(t.votes()).select(ID, F.array_join("languages", "|").alias("languages"), "language", "language_name"),
    f"SELECT recording_id, string_agg(code, '|' ORDER BY f) AS languages, CASE WHEN count(*) = 1 THEN any_value(code) ELSE 'multi' END AS language, string_agg({_NAME}, ', ' ORDER BY f) AS language_name FROM ("
    "SELECT recording_id, code, min(pos) AS f FROM votes GROUP BY ALL) GROUP BY recording_id", "votes",
)

# --- turns of a recording
register(
    "talk_stats",
    lambda t: speakers.talk_stats(t.turns()),
    "SELECT *, talk_sec / sum(talk_sec) OVER (PARTITION BY recording_id) AS share FROM (SELECT recording_id, speaker, sum(CASE WHEN end_sec > start_sec THEN end_sec - start_sec ELSE 0.25 END) AS talk_sec, count(*) AS n_turns, min(turn) AS first_turn FROM turns GROUP BY ALL)",
    "turns", decimals="talk_sec share",
)
register(
    "talk_stats_untimed",
    lambda t: speakers.talk_stats(t.turns_untimed()),
    "SELECT *, talk_sec / sum(talk_sec) OVER (PARTITION BY recording_id) AS share FROM (SELECT recording_id, speaker, sum(greatest(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')), 1) / 4.0::DOUBLE) AS talk_sec, count(*) AS n_turns, min(turn) AS first_turn FROM turns_untimed GROUP BY ALL)",
    "turns_untimed", decimals="talk_sec share",
)
register(
    "talk_report",
    lambda t: attach(speakers.talk_stats(t.turns()), report.speaker_lines(t.turns())).withColumn("share", F.round("share", 6)),
    "SELECT s.recording_id, s.speaker, talk_sec, n_turns, first_turn, round(talk_sec / sum(talk_sec) OVER (PARTITION BY s.recording_id), 6) AS share, transcript FROM (SELECT recording_id, speaker, sum(CASE WHEN end_sec > start_sec THEN end_sec - start_sec ELSE 0.25 END) AS talk_sec, "
    f"count(*) AS n_turns, min(turn) AS first_turn FROM turns GROUP BY ALL) s JOIN (SELECT recording_id, string_agg(speaker || ': ' || text, E'\\n\\n' ORDER BY turn) AS transcript FROM turns WHERE {_ST.format('text')} <> '' GROUP BY recording_id) x ON x.recording_id = s.recording_id",
    "turns",
)
register("detected_speakers", lambda t: report.detected_speakers(t.turns()).select(ID, F.array_join("speakers", "|").alias("speakers")),
         "SELECT recording_id, string_agg(speaker, '|' ORDER BY f) AS speakers FROM (SELECT recording_id, speaker, min(turn) AS f FROM turns GROUP BY ALL) GROUP BY recording_id", "turns")
_TS = "(lpad((floor({0} / 60)::BIGINT)::VARCHAR, 2, '0') || ':' || printf('%06.3f', {0} - floor({0} / 60) * 60))"
register(
    "conversation_transcript",
    lambda t: report.conversation_transcript(t.turns()),
    f"SELECT recording_id, string_agg('[' || {_TS.format('start_sec')} || ' - ' || {_TS.format('end_sec')} || ']' || E'\\n' || speaker || E'\\n' || {_ST.format('text')}, E'\\n\\n' ORDER BY turn) AS formatted_transcript FROM turns WHERE {_ST.format('text')} <> '' GROUP BY recording_id", "turns",
)
register("speaker_prefixed_transcript", lambda t: report.speaker_lines(t.turns()), f"SELECT recording_id, string_agg(speaker || ': ' || text, E'\\n\\n' ORDER BY turn) AS transcript FROM turns WHERE {_ST.format('text')} <> '' GROUP BY recording_id", "turns")
register("plain_transcript", lambda t: report.plain_transcript(t.turns()), f"SELECT recording_id, string_agg({_ST.format('text')}, ' ' ORDER BY turn) AS transcript, string_agg({_ST.format('text')}, ' ' ORDER BY turn) AS transcript_original FROM turns WHERE {_ST.format('text')} <> '' GROUP BY recording_id", "turns")
register("words_per_recording", lambda t: report.words_per_recording(t.words()), "SELECT recording_id, count(*) AS word_count FROM words GROUP BY recording_id", "words")
register("num_speakers", lambda t: report.num_speakers(t.turns()), "SELECT recording_id, count(DISTINCT speaker) AS num_speakers FROM turns GROUP BY recording_id", "turns")

# --- emotions
_MOODS = "['angry', 'happy', '', 'sad'][(turn * 7 + recording_id) % 4 + 1]"


def _moods(t: Tables):
    pick = F.element_at(F.array(F.lit("angry"), F.lit("happy"), F.lit(""), F.lit("sad")), ((F.col("turn") * 7 + F.col(ID)) % 4 + 1).cast("int"))
    return t.turns().select(ID, "turn", pick.alias("emotion"))


def _clip_moods(t: Tables):
    return t.turns().select(ID).distinct().withColumn("emotion", F.when(F.col(ID) % 3 == 0, F.lit("")).otherwise(F.lit("calm")))


def _voices(t: Tables):
    """All turns, and beside them those of recordings whose turns are too short, and of some whose first speaker is silent."""
    short = t.turns().withColumns({ID: -1 - F.col(ID), "end_sec": F.col("start_sec") + F.lit(0.25)})
    return t.turns().unionByName(short)


def _by_speaker(t: Tables):
    """Moods of all turns but those of one voice in every sixth recording, which is then neutral."""
    mood = _moods(t).join(t.turns().select(ID, "turn", "speaker"), [ID, "turn"])
    mood = mood.filter((F.col(ID) % 6 > 0) | (F.col("speaker") != "spk_0")).drop("speaker")
    clips = _clip_moods(t).unionByName(_clip_moods(t).withColumn(ID, -1 - F.col(ID)))
    return report.speaker_emotions(_voices(t), mood, clips, budget_sec=6.0)


_EMO = (
    "us AS (SELECT *, end_sec - start_sec AS sec, coalesce(sum(end_sec - start_sec) OVER (PARTITION BY recording_id, speaker ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM turns WHERE end_sec - start_sec >= 0.35), "
    f"mo AS (SELECT recording_id, speaker, CASE WHEN {_MOODS} <> '' AND (recording_id % 6 > 0 OR speaker <> 'spk_0') THEN {_MOODS} END AS emotion, least(sec, 6.0 - before) AS sec, turn FROM us WHERE before < 6.0), "
    "vt AS (SELECT recording_id, speaker, coalesce(arg_max(emotion, (sec, -f)) FILTER (emotion IS NOT NULL), 'neutral') AS emotion FROM (SELECT recording_id, speaker, emotion, sum(sec) AS sec, min(turn) AS f FROM mo GROUP BY ALL) GROUP BY ALL), "
    "al AS (SELECT recording_id, recording_id AS own, speaker FROM turns UNION ALL SELECT -1 - recording_id, recording_id, speaker FROM turns), "
    "em AS (SELECT * FROM vt UNION ALL SELECT DISTINCT recording_id, speaker, 'calm' FROM al WHERE own % 3 <> 0 AND recording_id NOT IN (SELECT recording_id FROM vt))"
)
register("speaker_emotions", lambda t: _by_speaker(t), "SELECT recording_id, speaker, emotion FROM em", "turns", _EMO)
register(
    "emotion_block",
    lambda t: attach(attach(_clip_moods(t), report.detected_speakers(t.turns())), report.emotion_map(_by_speaker(t))).select(ID, report.emotion_block("speakers", "emotion", "speaker_emotions").alias("block")),
    "SELECT s.recording_id, string_agg(s.speaker || ':' || E'\\n' || coalesce(em.emotion, CASE WHEN s.recording_id % 3 = 0 THEN 'neutral' ELSE 'calm' END), E'\\n\\n' ORDER BY f) AS block FROM (SELECT recording_id, speaker, min(turn) AS f FROM turns GROUP BY ALL) s LEFT JOIN em ON em.recording_id = s.recording_id AND em.speaker = s.speaker GROUP BY s.recording_id",
    "turns", _EMO,
)
register(
    "choose_emotion",
    lambda t: t.read("events").select("event_id", sounds.choose_emotion(F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.lit("cnn_mood")), F.when(F.col("event_id") % 2 == 0, F.lit("hf_mood")), (F.col("value") * 100).cast("int"), "hf").alias("emotion")),
    "SELECT event_id, CASE WHEN floor(value * 100) < 4000 THEN 'neutral' WHEN event_id % 2 = 0 THEN 'hf_mood' WHEN event_id % 3 <> 0 THEN 'cnn_mood' ELSE 'neutral' END AS emotion FROM events",
)
