"""Queries on segments, words, frames and turns: islands, folds, interval joins, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.spans import midpoint, overlap_sec
from ..operators import folds, intervals, islands, speakers, waveforms, windows
from ..operators.ordered import by_time, carry
from .fixtures import Tables
from .registry import register

ID = "recording_id"
ORDER = "ORDER BY start_sec, end_sec, pos"


def _merged_sql(source: str, gap: float) -> str:
    return (
        f"SELECT recording_id, arg_min(pos, (start_sec, end_sec, pos)) AS pos, any_value(speaker) AS speaker, min(start_sec) AS start_sec, max(end_sec) AS end_sec FROM ("
        f"SELECT *, sum(CASE WHEN reach IS NULL OR start_sec - reach > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id, run {ORDER}) AS span FROM ("
        f"SELECT *, max(end_sec) OVER (PARTITION BY recording_id, run {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ("
        f"SELECT *, sum(chg) OVER (PARTITION BY recording_id {ORDER}) AS run FROM ("
        f"SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY recording_id {ORDER}) IS NOT DISTINCT FROM speaker THEN 0 ELSE 1 END AS chg FROM {source})))) "
        "GROUP BY recording_id, run, span"
    )


register("merge_segments", lambda t: islands.merge_segments(t.segments(), 0.6, 120.0), _merged_sql("segments", 0.6), "segments", decimals="start_sec end_sec")
register("sort_timeline", lambda t: islands.sort_timeline(t.segments()), "SELECT * FROM segments ORDER BY recording_id, start_sec, end_sec, pos", "segments", decimals="start_sec end_sec")
register(
    "min_duration",
    lambda t: speakers.drop_micro_segments(t.segments(), 0.4),
    "SELECT * EXCLUDE (any_long) FROM (SELECT *, max(end_sec - start_sec >= 0.4) OVER (PARTITION BY recording_id) AS any_long FROM segments) "
    "WHERE end_sec - start_sec >= 0.4 OR NOT any_long",
    "segments", decimals="start_sec end_sec",
)
register(
    "number_speakers",
    lambda t: islands.number_speakers(t.segments(), ("start_sec", "end_sec", "pos")),
    "SELECT s.recording_id, s.pos, 'Speaker ' || k AS speaker, s.start_sec, s.end_sec FROM segments s JOIN (SELECT recording_id, speaker, "
    "row_number() OVER (PARTITION BY recording_id ORDER BY f) AS k FROM (SELECT recording_id, speaker, min((start_sec, end_sec, pos)) AS f FROM segments GROUP BY ALL)) n "
    "ON n.recording_id = s.recording_id AND n.speaker = s.speaker",
    "segments", decimals="start_sec end_sec",
)
register(
    "merge_labeled_windows",
    lambda t: islands.merge_labeled_windows(t.segments(), chunk_sec=120.0),
    "SELECT m.recording_id, m.pos, 'Speaker ' || n.k AS speaker, round(m.start_sec, 2) AS start_sec, round(m.end_sec, 2) AS end_sec FROM kept m JOIN ("
    "SELECT recording_id, speaker, row_number() OVER (PARTITION BY recording_id ORDER BY min((start_sec, end_sec, pos))) AS k FROM kept GROUP BY recording_id, speaker) n "
    "ON n.recording_id = m.recording_id AND n.speaker = m.speaker",
    "segments", also=f"kept AS (SELECT * FROM ({_merged_sql('segments', 0.35)}) WHERE end_sec - start_sec >= 0.4)",
)


def _turn_islands(cut: str, end: str, extra: str = "") -> str:
    return (
        "SELECT recording_id, min(turn) AS turn, any_value(speaker) AS speaker, arg_min(start_sec, turn) AS start_sec, "
        f"{end} AS end_sec, trim(string_agg(text, ' ' ORDER BY turn)) AS text, trim(string_agg(text_original, ' ' ORDER BY turn)) AS text_original{extra} FROM ("
        "SELECT *, sum(chg) OVER (PARTITION BY recording_id ORDER BY turn) AS run FROM ("
        f"SELECT *, CASE WHEN {cut} THEN 0 ELSE 1 END AS chg FROM (SELECT *, lag(speaker) OVER w AS ps, lag(end_sec) OVER w AS pe FROM turns "
        "WINDOW w AS (PARTITION BY recording_id ORDER BY turn)))) GROUP BY recording_id, run"
    )


def _plain_turns(t: Tables):
    return t.turns().drop("role")


register("merge_asr_turns", lambda t: islands.merge_asr_turns(_plain_turns(t), chunk_rows=3), _turn_islands("ps = speaker AND start_sec - pe <= 0.5", "arg_max(end_sec, turn)"), "turns")
register("merge_consecutive", lambda t: islands.merge_consecutive(_plain_turns(t), chunk_rows=3), _turn_islands("ps = speaker", "arg_max(end_sec, turn)"), "turns")


def _spoken(t: Tables):
    """Words with a speaker and a confidence taken from their length."""
    n = F.length("word")
    return t.words().withColumns({"speaker": F.when(n % 3 == 0, F.lit("s0")).otherwise(F.lit("s1")), "confidence": (n % 10) / 9.7})


SPOKEN = "spoken AS (SELECT * REPLACE (CASE WHEN length(word) % 3 = 0 THEN 's0' ELSE 's1' END AS speaker, (length(word) % 10) / 9.7::DOUBLE AS confidence) FROM words)"
register(
    "words_to_turns",
    lambda t: islands.words_to_turns(_spoken(t), chunk_rows=64),
    "SELECT recording_id, turn, speaker, start_sec, end_sec, text, text AS text_original, list_reduce(cs, lambda a, b: (a + b) / 2) AS confidence FROM ("
    "SELECT i.recording_id, min(pos) AS turn, 'Speaker ' || any_value(n.k) AS speaker, min(start_sec) AS start_sec, max(end_sec) AS end_sec, "
    "string_agg(word, ' ' ORDER BY pos) AS text, list(confidence ORDER BY pos) AS cs FROM (SELECT *, sum(chg) OVER (PARTITION BY recording_id ORDER BY pos) AS run FROM ("
    "SELECT *, CASE WHEN lag(speaker) OVER w = speaker AND start_sec - lag(end_sec) OVER w <= 0.6 THEN 0 ELSE 1 END AS chg FROM spoken WINDOW w AS (PARTITION BY recording_id ORDER BY pos))) i "
    "JOIN (SELECT recording_id, speaker, row_number() OVER (PARTITION BY recording_id ORDER BY min(pos)) AS k FROM spoken GROUP BY recording_id, speaker) n "
    "ON n.recording_id = i.recording_id AND n.speaker = i.speaker GROUP BY i.recording_id, run)",
    "words", also=SPOKEN, decimals="confidence",
)
register(
    "smooth_switches",
    lambda t: islands.smooth_switches(_spoken(t), chunk_rows=64),
    "SELECT w.recording_id, w.pos, w.word, w.start_sec, w.end_sec, w.score, CASE WHEN r.cand AND (r.run - coalesce(r.stop, 0)) % 2 = 1 THEN r.l ELSE w.speaker END AS speaker, w.confidence "
    "FROM tagged w JOIN (SELECT *, max(CASE WHEN NOT cand THEN run END) OVER (PARTITION BY recording_id ORDER BY run) AS stop FROM ("
    "SELECT *, coalesce(b - a < 0.3 AND l = r, false) AS cand FROM (SELECT *, lag(speaker) OVER x AS l, lead(speaker) OVER x AS r FROM ("
    "SELECT recording_id, run, any_value(speaker) AS speaker, min(start_sec) AS a, max(end_sec) AS b FROM tagged GROUP BY ALL) WINDOW x AS (PARTITION BY recording_id ORDER BY run)))) r "
    "ON r.recording_id = w.recording_id AND r.run = w.run",
    "words",
    also=SPOKEN + ", tagged AS (SELECT *, sum(chg) OVER (PARTITION BY recording_id ORDER BY pos)::BIGINT AS run FROM (SELECT *, CASE WHEN lag(speaker) OVER "
    "(PARTITION BY recording_id ORDER BY pos) = speaker THEN 0 ELSE 1 END AS chg FROM spoken))",
)

_SPEECH_RUNS = (
    "SELECT *, count(*) OVER (PARTITION BY recording_id, run) AS len, max(run) OVER (PARTITION BY recording_id) AS last FROM ("
    "SELECT *, sum(chg) OVER (PARTITION BY recording_id ORDER BY frame_idx) AS run FROM (SELECT *, CASE WHEN lag(speech) OVER "
    "(PARTITION BY recording_id ORDER BY frame_idx) = speech THEN 0 ELSE 1 END AS chg FROM {src}))"
)
register(
    "fill_holes",
    lambda t: islands.fill_holes(t.frames().withColumn("speech", F.col("rms") >= 0.2), 3, chunk_rows=16),
    "SELECT recording_id, frame_idx, rms, speech OR (len <= 3 AND run > 1 AND run < last) AS speech FROM ("
    + _SPEECH_RUNS.format(src="(SELECT *, rms >= 0.2 AS speech FROM frames)") + ")",
    "frames", decimals="rms",
)
register(
    "switch_stats",
    lambda t: islands.switch_stats(t.turns(), chunk_rows=3),
    "SELECT recording_id, count(*) AS n_turns, sum(CASE WHEN ps IS NOT NULL AND ps <> speaker THEN 1 ELSE 0 END)::BIGINT AS switches, "
    "sum(CASE WHEN ps IS NOT NULL AND ps <> speaker THEN 1 ELSE 0 END) / greatest(count(*) - 1, 1) AS switch_ratio, avg(CASE WHEN end_sec > start_sec THEN end_sec - start_sec ELSE 0.25 END) AS mean_sec FROM ("
    "SELECT *, lag(speaker) OVER (PARTITION BY recording_id ORDER BY turn) AS ps FROM turns) GROUP BY recording_id",
    "turns", decimals="switch_ratio mean_sec",
)

# --- frames and regions
_THR = (
    "thr AS (SELECT recording_id, greatest(quantile_cont(rms, 0.2) * 2.5, quantile_cont(rms, 0.4) * 0.6, 1e-4) AS threshold FROM frames GROUP BY recording_id)"
)
register("noise_threshold", lambda t: windows.noise_threshold(t.frames()), "SELECT * FROM thr", "frames", also=_THR, decimals="threshold")
_MIN_SPEECH, _MIN_SILENCE = 0.02, 0.03  # two and three frames
register(
    "speech_regions",
    lambda t: windows.speech_regions(t.frames(), t.clips(), _MIN_SPEECH, _MIN_SILENCE, chunk_rows=16),
    "SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY start_sec, end_sec) - 1 AS pos, start_sec, end_sec FROM ("
    "SELECT * FROM reg UNION ALL SELECT c.recording_id, 0.0, n_samples / 200.0 FROM clips c JOIN (SELECT recording_id, max(rms) AS peak FROM frames GROUP BY ALL) p USING (recording_id) "
    "WHERE peak > 1e-5 AND c.recording_id NOT IN (SELECT recording_id FROM reg))",
    "frames clips",
    also=_THR + ", s AS (SELECT f.*, rms >= threshold AS speech FROM frames f JOIN thr USING (recording_id)), filled AS (SELECT recording_id, frame_idx, "
    "speech OR (len <= 3 AND run > 1 AND run < last) AS speech FROM (" + _SPEECH_RUNS.format(src="s") + ")), reg AS (SELECT r.recording_id, a * 2 / 200.0::DOUBLE AS start_sec, "
    "least(n_samples, (b + 1) * 2 + 5) / 200.0::DOUBLE AS end_sec FROM (SELECT recording_id, run, min(frame_idx) AS a, max(frame_idx) AS b, count(*) AS n FROM ("
    + _SPEECH_RUNS.format(src="filled") + ") WHERE speech GROUP BY ALL) r JOIN clips USING (recording_id) WHERE n >= 2 AND least(n_samples, (b + 1) * 2 + 5) > a * 2)",
    decimals="start_sec end_sec",
)
register(
    "frame_rms",
    lambda t: waveforms.frame_rms(t.waveforms()),
    "SELECT recording_id, i::INT AS frame_idx, sqrt(list_sum(list_transform(samples[i * 2 + 1 : i * 2 + 5], lambda x: x::DOUBLE * x::DOUBLE)) / 5 + 1e-12) AS rms FROM ("
    "SELECT recording_id, samples, unnest(range(1 + (len(samples) - 5) // 2)) AS i FROM waveforms WHERE len(samples) >= 5)",
    "waveforms", decimals="rms",
)


def _talk(t: Tables):
    """Recordings as long as the conversation is wordy."""
    n = t.turns().groupBy(ID).agg(F.max("end_sec").alias("s"))
    return n.select(ID, (F.col("s") * 4 * 4000).cast("long").alias("n_samples"), F.lit(16000).alias("sample_rate"))


RECS = "recs AS (SELECT recording_id, (max(end_sec) * 16000)::BIGINT AS n_samples, 16000 AS sample_rate FROM turns GROUP BY recording_id)"
register(
    "even_windows",
    lambda t: windows.even_windows(_talk(t), 2.5, 12),
    "SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY start) - 1 AS window_id, start, least(n_samples, start + 40000) AS \"end\" FROM ("
    "SELECT DISTINCT recording_id, n_samples, start FROM (SELECT *, CASE WHEN n_samples <= 40000 THEN 0 ELSE round_even(i * (n_samples - 40000) / 11.0, 0)::BIGINT END AS start FROM "
    "(SELECT *, unnest(range(12)) AS i FROM recs)))",
    "turns", also=RECS,
)
register(
    "even_windows_by_length",
    lambda t: windows.even_windows(_talk(t), 2.5, 0),
    "SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY start) - 1 AS window_id, start, least(n_samples, start + 40000) AS \"end\" FROM ("
    "SELECT DISTINCT recording_id, n_samples, start FROM (SELECT *, CASE WHEN n_samples <= 40000 THEN 0 ELSE round_even(i * (n_samples - 40000) / (k - 1)::DOUBLE, 0)::BIGINT END AS start FROM "
    "(SELECT *, unnest(range(k)) AS i FROM (SELECT *, least(32, greatest(8, floor(n_samples / 16000.0 / 1.25)::BIGINT + 1)) AS k FROM recs))))",
    "turns", also=RECS,
)


def _hops(win: int, hop: int, tail: int, goes_on: str) -> str:
    return (
        f"SELECT recording_id, start // {hop} AS window_id, start, least(n_samples, start + {win}) AS \"end\" FROM (SELECT *, unnest(range(0, n_samples, {hop})) AS start FROM recs) "
        f"WHERE least({win}, n_samples - start) >= {tail} AND ({goes_on})"
    )


register("hop_windows_long", lambda t: windows.hop_windows(_talk(t), 18, 16, 0.4), _hops(288000, 256000, 6400, "start = 0 OR start - 256000 + 288000 < n_samples"), "turns", also=RECS)
register("hop_windows_pieces", lambda t: windows.hop_windows(_talk(t), 90, 85, 0.5), _hops(1440000, 1360000, 8000, "start = 0 OR start - 1360000 + 1440000 < n_samples"), "turns", also=RECS)
register("hop_windows_speech", lambda t: windows.hop_windows(_talk(t), 1.2, 0.6, 1 / 3, stop="half"), _hops(19200, 9600, 5333, "start < greatest(n_samples - 9600, 1)"), "turns", also=RECS)
register(
    "split_time_chunks",
    lambda t: windows.split_time_chunks(_talk(t), 30.0, 4),
    "SELECT * FROM (" + _hops(480000, 472000, 8000, "start // 472000 < 4") + ") WHERE \"end\" - start >= 8000 OR start = 0", "turns", also=RECS,
)
register(
    "region_windows",
    lambda t: windows.region_windows(t.segments().select(ID, "pos", "start_sec", "end_sec"), _event_clips(t)),
    "SELECT recording_id, region, row_number() OVER (PARTITION BY recording_id, region ORDER BY start, ord) - 1 AS nth, start / 100.0::DOUBLE AS start_sec, least(e0, start + 150) / 100.0::DOUBLE AS end_sec FROM ("
    "SELECT recording_id, pos AS region, e0, s0 AS start, 0 AS ord FROM cut WHERE e0 - s0 < 150 AND e0 - s0 >= 10 UNION ALL "
    "SELECT recording_id, pos, e0, unnest(range(s0, e0 - 150 + 1, 75)), 0 FROM cut WHERE e0 - s0 >= 150 UNION ALL SELECT recording_id, pos, e0, e0 - 150, 1 FROM cut WHERE e0 - 150 > s0)",
    "segments",
    also="cut AS (SELECT recording_id, pos, greatest(0, floor(start_sec * 100))::BIGINT AS s0, least(n, floor(end_sec * 100))::BIGINT AS e0 FROM segments JOIN ("
    "SELECT recording_id, (ceil(max(end_sec)) * 100)::BIGINT AS n FROM segments GROUP BY ALL) USING (recording_id))",
    decimals="start_sec end_sec",
)


def _event_clips(t: Tables):
    return t.segments().groupBy(ID).agg((F.ceil(F.max("end_sec")) * 100).cast("long").alias("n_samples")).withColumn("sample_rate", F.lit(100))


# --- ordered folds
register(
    "resolve_overlaps",
    lambda t: folds.resolve_overlaps(t.segments(), chunk_sec=240.0),
    "SELECT recording_id, pos, speaker, start_sec, end_sec FROM (SELECT recording_id, p AS pos, s AS speaker, a AS start_sec, b AS end_sec, n, last FROM f WHERE n = last "
    "UNION ALL SELECT recording_id, ep, es, ea, eb, n, last FROM f WHERE ep IS NOT NULL) WHERE end_sec - start_sec >= 0.2",
    "segments", recursive=True,
    also="o AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY start_sec, end_sec, pos) AS n, count(*) OVER (PARTITION BY recording_id) AS last FROM segments), "
    "f AS (SELECT recording_id, n, last, pos AS p, speaker AS s, start_sec AS a, end_sec AS b, NULL::BIGINT AS ep, NULL::VARCHAR AS es, NULL::DOUBLE AS ea, NULL::DOUBLE AS eb FROM o WHERE n = 1 UNION ALL "
    "SELECT recording_id, n, last, CASE WHEN k IN ('new', 'cut') THEN np ELSE p END, CASE WHEN k IN ('new', 'cut') THEN ns ELSE s END, "
    "CASE k WHEN 'new' THEN na WHEN 'cut' THEN m ELSE a END, CASE k WHEN 'new' THEN nb WHEN 'cut' THEN nb WHEN 'same' THEN greatest(b, nb) ELSE m END, "
    "CASE WHEN k IN ('new', 'cut') THEN p END, CASE WHEN k IN ('new', 'cut') THEN s END, CASE WHEN k IN ('new', 'cut') THEN a END, CASE k WHEN 'new' THEN b WHEN 'cut' THEN m END FROM ("
    "SELECT o.recording_id, o.n, o.last, f.p, f.s, f.a, f.b, o.pos AS np, o.speaker AS ns, o.start_sec AS na, o.end_sec AS nb, greatest(0.5 * (f.b + o.start_sec), f.a + 0.05) AS m, "
    "CASE WHEN o.start_sec >= f.b THEN 'new' WHEN o.speaker = f.s THEN 'same' WHEN o.end_sec > greatest(0.5 * (f.b + o.start_sec), f.a + 0.05) + 0.15 THEN 'cut' ELSE 'drop' END AS k "
    "FROM f JOIN o ON o.recording_id = f.recording_id AND o.n = f.n + 1))",
    decimals="start_sec end_sec",
)
register(
    "pack_windows",
    lambda t: folds.pack_windows(t.segments(), chunk_sec=240.0),
    "SELECT recording_id, start_sec, end_sec FROM (SELECT recording_id, a AS start_sec, b AS end_sec FROM f WHERE n = last AND b > a UNION ALL SELECT recording_id, ea, eb FROM f WHERE ea IS NOT NULL AND eb > ea "
    "UNION ALL SELECT recording_id, q0 + i * 18.0, least(q1, q0 + (i + 1) * 18.0) FROM (SELECT recording_id, q0, q1, unnest(range(ceil((q1 - q0) / 18.0)::BIGINT + 1)) AS i FROM f WHERE q0 IS NOT NULL) WHERE q0 + i * 18.0 < q1)",
    "segments", recursive=True,
    also="o AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY start_sec, end_sec, pos) AS n, count(*) OVER (PARTITION BY recording_id) AS last FROM segments), "
    "f AS (SELECT recording_id, n, last, start_sec AS a, end_sec AS b, NULL::DOUBLE AS ea, NULL::DOUBLE AS eb, NULL::DOUBLE AS q0, NULL::DOUBLE AS q1 FROM o WHERE n = 1 UNION ALL "
    "SELECT recording_id, n, last, CASE k WHEN 'fit' THEN a WHEN 'long' THEN nb ELSE na END, CASE k WHEN 'fit' THEN greatest(b, nb) ELSE nb END, CASE WHEN k <> 'fit' THEN a END, CASE WHEN k <> 'fit' THEN b END, "
    "CASE WHEN k = 'long' THEN na END, CASE WHEN k = 'long' THEN nb END FROM (SELECT o.recording_id, o.n, o.last, f.a, f.b, o.start_sec AS na, o.end_sec AS nb, "
    "CASE WHEN o.start_sec - f.b <= 0.6 AND o.end_sec - f.a <= 18.0 THEN 'fit' WHEN o.end_sec - o.start_sec > 18.0 THEN 'long' ELSE 'new' END AS k FROM f JOIN o ON o.recording_id = f.recording_id AND o.n = f.n + 1))",
    decimals="start_sec end_sec",
)


def _looped_phrases(t: Tables):
    """Every phrase, and beside it an echo: the same again, its start behind it, or its start before it."""
    kind = F.col("pos") % 3
    echo = t.phrases().withColumn("text", F.when(kind == 0, F.col("text")).otherwise(F.substring("text", 1, 12)))
    echo = echo.withColumn("pos", F.col("pos") * 3 + F.when(kind == 2, 0).otherwise(2))
    return t.phrases().withColumn("pos", F.col("pos") * 3 + 1).unionByName(echo)


_LOOPED = (
    "lp AS (SELECT recording_id, pos * 3 + 1 AS pos, text, start_sec, end_sec FROM phrases UNION ALL SELECT recording_id, pos * 3 + CASE WHEN pos % 3 = 2 THEN 0 ELSE 2 END, "
    "CASE WHEN pos % 3 = 0 THEN text ELSE substring(text, 1, 12) END, start_sec, end_sec FROM phrases), o AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY pos) AS n, "
    "count(*) OVER (PARTITION BY recording_id) AS last FROM lp WHERE trim(text) <> '')"
)
_SQ = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
register(
    "dedupe_phrases",
    lambda t: folds.dedupe_phrases(_looped_phrases(t), chunk_rows=4),
    "SELECT recording_id, p AS pos, x AS text, a AS start_sec, b AS end_sec FROM f WHERE n = last UNION ALL SELECT recording_id, ep, ex, ea, eb FROM f WHERE ep IS NOT NULL",
    "phrases", recursive=True,
    also=_LOOPED + ", f AS (SELECT recording_id, n, last, pos AS p, text AS x, start_sec AS a, end_sec AS b, NULL::BIGINT AS ep, NULL::VARCHAR AS ex, NULL::DOUBLE AS ea, NULL::DOUBLE AS eb FROM o WHERE n = 1 UNION ALL "
    "SELECT recording_id, n, last, CASE WHEN k IN ('new', 'more') THEN np ELSE p END, CASE WHEN k IN ('new', 'more') THEN nx ELSE x END, CASE k WHEN 'new' THEN na ELSE a END, "
    "CASE k WHEN 'new' THEN nb WHEN 'less' THEN b ELSE greatest(b, nb) END, CASE WHEN k = 'new' THEN p END, CASE WHEN k = 'new' THEN x END, CASE WHEN k = 'new' THEN a END, CASE WHEN k = 'new' THEN b END FROM ("
    "SELECT o.recording_id, o.n, o.last, f.p, f.x, f.a, f.b, o.pos AS np, o.text AS nx, o.start_sec AS na, o.end_sec AS nb, "
    f"CASE WHEN {_SQ.format('o.text')} = {_SQ.format('f.x')} THEN 'same' WHEN contains({_SQ.format('f.x')}, {_SQ.format('o.text')}) AND o.end_sec <= f.b + 0.5 THEN 'less' "
    f"WHEN contains({_SQ.format('o.text')}, {_SQ.format('f.x')}) AND o.start_sec <= f.b + 0.5 THEN 'more' ELSE 'new' END AS k FROM f JOIN o ON o.recording_id = f.recording_id AND o.n = f.n + 1))",
)
_W = "list_filter(string_split_regex({}, '\\s+'), lambda w: w <> '')"
_OVER = "list_max(list_filter(range(1, least(len(pw), len(cw), 16) + 1), lambda k: list_slice(pw, len(pw) - k + 1, len(pw)) = list_slice(cw, 1, k)))"
register(
    "stitch_chunks",
    lambda t: folds.stitch_chunks(t.chunks(), chunk_rows=4),
    "SELECT recording_id, pos, x AS text FROM f WHERE kept",
    "chunks", recursive=True,
    also="o AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY pos) AS n FROM chunks WHERE length(trim(text, ' .,?!।')) >= 2), "
    "f AS (SELECT recording_id, n, pos, text AS x, true AS kept FROM o WHERE n = 1 UNION ALL SELECT recording_id, n, pos, CASE WHEN added <> '' THEN added ELSE x END, added <> '' FROM ("
    "SELECT recording_id, n, pos, x, CASE WHEN k IS NULL THEN t ELSE array_to_string(list_slice(cw, k + 1, len(cw)), ' ') END AS added FROM ("
    f"SELECT *, {_OVER} AS k FROM (SELECT o.recording_id, o.n, o.pos, o.text AS t, f.x, {_W.format('f.x')} AS pw, {_W.format('o.text')} AS cw FROM f JOIN o ON o.recording_id = f.recording_id AND o.n = f.n + 1))))",
)


def _by_source(t: Tables):
    return t.read("documents").select(F.col("source").alias(ID), F.col("doc_id").alias("pos"), F.col("text"))


def _repeat_sql(measure: str, threshold: float) -> dict:
    share = {"jaccard": "len(list_distinct(list_concat(pw, cw)))", "overlap": "least(len(pw), len(cw))"}[measure]
    return dict(
        sql="SELECT recording_id, pos, text FROM f JOIN (SELECT doc_id, text FROM documents) d ON d.doc_id = f.pos WHERE kept",
        recursive=True,
        also="o AS MATERIALIZED (SELECT source AS recording_id, doc_id AS pos, list_distinct(" + _W.format("text") + ") AS cw, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents), "
        "f AS (SELECT recording_id, n, pos, cw AS pw, true AS kept FROM o WHERE n = 1 UNION ALL SELECT recording_id, n, pos, CASE WHEN again THEN pw ELSE cw END, NOT again FROM ("
        f"SELECT o.recording_id, o.n, o.pos, f.pw, o.cw, len(f.pw) > 0 AND len(o.cw) > 0 AND len(list_intersect(f.pw, o.cw)) / greatest({share.replace('pw', 'f.pw').replace('cw', 'o.cw')}, 1) >= {threshold} AS again "
        "FROM f JOIN o ON o.recording_id = f.recording_id AND o.n = f.n + 1))",
    )


register("drop_near_repeats", lambda t: folds.drop_near_repeats(_by_source(t), "jaccard", 0.2), **_repeat_sql("jaccard", 0.2))
register("drop_near_repeats_overlap", lambda t: folds.drop_near_repeats(_by_source(t), "overlap", 0.4), **_repeat_sql("overlap", 0.4))

# --- interval joins
_PAIRS = (
    "pr AS (SELECT w.recording_id, w.pos, w.start_sec AS a, w.end_sec AS b, s.pos AS sp, s.speaker AS spk, s.start_sec AS c, s.end_sec AS d, "
    "least(w.end_sec, s.end_sec) - greatest(w.start_sec, s.start_sec) AS ov, 0.5 * (w.start_sec + w.end_sec) AS mid FROM {rows} w JOIN {segs} s ON s.recording_id = w.recording_id)"
)
_NEAR = "SELECT recording_id, pos, arg_min(spk, (least(abs(mid - c), abs(mid - d)), sp)) AS near FROM pr GROUP BY ALL"
register(
    "assign_words",
    lambda t: intervals.assign_words(t.words(), t.turn_segments()),
    "SELECT recording_id, pos, word, start_sec, end_sec, score, last_value(CASE WHEN anchor THEN own END IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY pos) AS speaker, confidence FROM ("
    "SELECT *, confidence >= 0.35 OR pos = min(pos) OVER (PARTITION BY recording_id) AS anchor FROM (SELECT w.*, coalesce(h.hit, n.near) AS own, CASE WHEN h.hit IS NOT NULL THEN h.ov / 0.25 ELSE 0.25 END AS confidence "
    "FROM (SELECT * EXCLUDE (speaker, confidence) FROM words) w LEFT JOIN (SELECT recording_id, pos, max(ov) AS ov, arg_max(spk, (ov, -sp)) AS hit FROM pr WHERE ov > 0 GROUP BY ALL) h "
    f"ON h.recording_id = w.recording_id AND h.pos = w.pos LEFT JOIN ({_NEAR}) n ON n.recording_id = w.recording_id AND n.pos = w.pos))",
    "words turn_segments", also=_PAIRS.format(rows="words", segs="turn_segments"), decimals="confidence",
)
register(
    "assign_words_to_events",
    lambda t: intervals.assign_words(t.segments().select(ID, "pos", F.col("speaker").alias("word"), "start_sec", (F.col("start_sec") + 1).alias("end_sec"), F.lit(0.5).alias("score"), F.lit(None).cast("string").alias("speaker"), F.lit(None).cast("double").alias("confidence")), _even_segments(t)),
    "SELECT recording_id, pos, word, start_sec, end_sec, score, last_value(CASE WHEN anchor THEN own END IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY pos) AS speaker, confidence FROM ("
    "SELECT *, confidence >= 0.35 OR pos = min(pos) OVER (PARTITION BY recording_id) AS anchor FROM (SELECT w.*, coalesce(h.hit, n.near) AS own, CASE WHEN h.hit IS NOT NULL THEN h.ov / greatest(w.end_sec - w.start_sec, 1e-3) WHEN n.near IS NOT NULL THEN 0.25 END AS confidence "
    "FROM rows1 w LEFT JOIN (SELECT recording_id, pos, max(ov) AS ov, arg_max(spk, (ov, -sp)) AS hit FROM pr WHERE ov > 0 GROUP BY ALL) h "
    f"ON h.recording_id = w.recording_id AND h.pos = w.pos LEFT JOIN ({_NEAR}) n ON n.recording_id = w.recording_id AND n.pos = w.pos))",
    "segments", also="rows1 AS (SELECT recording_id, pos, speaker AS word, start_sec, start_sec + 1 AS end_sec, 0.5::DOUBLE AS score FROM segments), "
    "evens AS (SELECT recording_id, pos, speaker, start_sec + 5 AS start_sec, start_sec + 7 AS end_sec FROM segments), " + _PAIRS.format(rows="rows1", segs="evens"),
    decimals="start_sec end_sec confidence",
)


def _even_segments(t: Tables):
    """Short segments five seconds later, so that many rows overlap none."""
    return t.segments().select(ID, "pos", "speaker", (F.col("start_sec") + 5).alias("start_sec"), (F.col("start_sec") + 7).alias("end_sec"))


register(
    "assign_phrases",
    lambda t: intervals.assign_phrases(t.phrases(), t.turn_segments()),
    "SELECT b.recording_id, b.sp AS turn, s.speaker, min(b.a) AS start_sec, arg_max(b.b, (b.a, b.pos)) AS end_sec, string_agg(piece, ' ' ORDER BY b.a, b.pos) AS text, string_agg(piece, ' ' ORDER BY b.a, b.pos) AS text_original, "
    "0.0::DOUBLE AS confidence, 'vad' AS alignment FROM bag b JOIN turn_segments s ON s.recording_id = b.recording_id AND s.pos = b.sp WHERE piece <> '' GROUP BY b.recording_id, b.sp, s.speaker",
    "phrases turn_segments",
    also=_PAIRS.format(rows="phrases", segs="turn_segments") + ", big AS (SELECT *, greatest(a, c) AS o0, least(b, d) AS o1, count(*) OVER w AS m, row_number() OVER x AS i, sum(ov) OVER w AS total FROM pr WHERE ov > 0.05 "
    "WINDOW w AS (PARTITION BY recording_id, pos), x AS (PARTITION BY recording_id, pos ORDER BY greatest(a, c), sp)), ws AS (SELECT recording_id, pos, text, string_split(text, ' ') AS w FROM phrases), "
    "sh AS (SELECT b.*, text, w, greatest(1, round_even(len(w) * (ov / total), 0)::INT) AS take FROM big b JOIN ws USING (recording_id, pos)), "
    "cut AS (SELECT *, coalesce(sum(take) OVER (PARTITION BY recording_id, pos ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS c0 FROM sh), "
    "bag AS (SELECT recording_id, pos, sp, o0 AS a, o1 AS b, array_to_string(CASE WHEN i = m THEN w[c0 + 1 :] ELSE w[c0 + 1 : c0 + take] END, ' ') AS piece FROM cut WHERE m > 1 AND len(w) > 2 UNION ALL "
    "SELECT recording_id, pos, arg_max(sp, (ov, -o0, -sp)), arg_max(o0, (ov, -o0, -sp)), arg_max(o1, (ov, -o0, -sp)), any_value(text) FROM sh WHERE m = 1 OR len(w) <= 2 GROUP BY recording_id, pos UNION ALL "
    "SELECT p.recording_id, p.pos, arg_min(sp, (abs(0.5 * (c + d) - mid), sp)), any_value(p.start_sec), any_value(p.end_sec), any_value(p.text) FROM phrases p JOIN pr ON pr.recording_id = p.recording_id AND pr.pos = p.pos "
    "WHERE NOT EXISTS (SELECT 1 FROM big WHERE big.recording_id = p.recording_id AND big.pos = p.pos) GROUP BY p.recording_id, p.pos)",
    decimals="start_sec end_sec",
)
register(
    "assign_timed_text",
    lambda t: intervals.assign_timed_text(t.phrases(), t.turn_segments()),
    "SELECT p.*, CASE WHEN n >= 2 THEN coalesce(hit, lead) ELSE lead END AS speaker FROM phrases p JOIN (SELECT recording_id, count(DISTINCT speaker) AS n, arg_min(speaker, pos) AS lead FROM turn_segments GROUP BY ALL) s "
    "ON s.recording_id = p.recording_id LEFT JOIN (SELECT recording_id, pos, arg_max(spk, (ov, -sp)) AS hit FROM pr WHERE ov > 0 GROUP BY ALL) h ON h.recording_id = p.recording_id AND h.pos = p.pos",
    "phrases turn_segments", also=_PAIRS.format(rows="phrases", segs="turn_segments"),
)
register(
    "speaker_at",
    lambda t: intervals.speaker_at(t.phrases(), t.turn_segments()),
    "SELECT recording_id, min(pos) AS turn, any_value(speaker) AS speaker, round(arg_min(start_sec, pos), 2) AS start_sec, round(arg_max(end_sec, pos), 2) AS end_sec, string_agg(text, ' ' ORDER BY pos) AS text, "
    "string_agg(text, ' ' ORDER BY pos) AS text_original, 'legacy' AS alignment FROM (SELECT *, sum(chg) OVER (PARTITION BY recording_id ORDER BY pos) AS run FROM (SELECT *, CASE WHEN lag(speaker) OVER "
    "(PARTITION BY recording_id ORDER BY pos) = speaker THEN 0 ELSE 1 END AS chg FROM (SELECT p.*, coalesce(i.inside, n.near) AS speaker FROM phrases p LEFT JOIN (SELECT recording_id, pos, arg_min(spk, sp) AS inside FROM pr "
    f"WHERE c <= mid AND mid <= d GROUP BY ALL) i ON i.recording_id = p.recording_id AND i.pos = p.pos LEFT JOIN ({_NEAR}) n ON n.recording_id = p.recording_id AND n.pos = p.pos))) GROUP BY recording_id, run",
    "phrases turn_segments", also=_PAIRS.format(rows="phrases", segs="turn_segments"),
)


def _aligned(t: Tables):
    """Turns as aligned segments; odd turns keep their words, even ones have none."""
    w = F.transform(F.split("text", " "), lambda x: F.struct(
        x.alias("word"), F.col("start_sec").alias("start_sec"), F.when(x != "", F.col("end_sec")).alias("end_sec"), F.lit(0.7).alias("score"), F.col("speaker").alias("speaker")))
    return t.turns().select(ID, F.col("turn").alias("seg"), "start_sec", "end_sec", "text", F.when(F.col("turn") % 2 == 1, w).alias("words"))


register(
    "flatten_words",
    lambda t: intervals.flatten_words(_aligned(t)),
    "SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY turn, i) - 1 AS pos, word, start_sec, end_sec, score, speaker, 0.0::DOUBLE AS confidence FROM ("
    "SELECT recording_id, turn, trim(unnest(string_split(text, ' ')), E' \\n\\t\\r') AS word, unnest(range(len(string_split(text, ' ')))) AS i, start_sec, end_sec, 0.7::DOUBLE AS score, speaker FROM turns WHERE turn % 2 = 1 UNION ALL "
    f"SELECT recording_id, turn, unnest({_W.format('text')}), unnest(range(len({_W.format('text')}))), start_sec, end_sec, 0.5, NULL FROM turns WHERE turn % 2 = 0) WHERE word <> ''",
    "turns",
)


def _half_named(t: Tables):
    """Words with given speakers in recordings with an odd id."""
    return t.words().withColumns({
        "speaker": F.when(F.col(ID) % 2 == 1, F.concat(F.lit("given_"), (F.length("word") % 2).cast("string"))),
        "confidence": F.lit(None).cast("double"),
    })


register("prefer_given_speakers", lambda t: intervals.prefer_given_speakers(_half_named(t), t.turn_segments()),
    "SELECT recording_id, pos, word, start_sec, end_sec, score, CASE WHEN recording_id % 2 = 1 THEN 'given_' || (length(word) % 2) ELSE last_value(CASE WHEN anchor THEN own END IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY pos) END AS speaker, "
    "CASE WHEN recording_id % 2 = 0 THEN confidence END AS confidence FROM ("
    "SELECT *, confidence >= 0.35 OR pos = min(pos) OVER (PARTITION BY recording_id) AS anchor FROM (SELECT w.*, coalesce(h.hit, n.near) AS own, CASE WHEN h.hit IS NOT NULL THEN h.ov / 0.25 ELSE 0.25 END AS confidence "
    "FROM (SELECT * EXCLUDE (speaker, confidence) FROM words) w LEFT JOIN (SELECT recording_id, pos, max(ov) AS ov, arg_max(spk, (ov, -sp)) AS hit FROM pr WHERE ov > 0 GROUP BY ALL) h "
    f"ON h.recording_id = w.recording_id AND h.pos = w.pos LEFT JOIN ({_NEAR}) n ON n.recording_id = w.recording_id AND n.pos = w.pos))",
    "words turn_segments", also=_PAIRS.format(rows="words", segs="turn_segments"), decimals="confidence",
)
register(
    "overlap_and_midpoint",
    lambda t: carry(t.segments(), by_time(), {"p": ("lag", F.struct("start_sec", "end_sec"))}).filter("p is not null").select(
        ID, "pos", overlap_sec("start_sec", "end_sec", "p.start_sec", "p.end_sec").alias("shared"), midpoint().alias("mid")),
    "SELECT recording_id, pos, greatest(0.0, least(end_sec, pe) - greatest(start_sec, ps)) AS shared, 0.5 * (start_sec + end_sec) AS mid FROM (SELECT *, lag(start_sec) OVER w AS ps, lag(end_sec) OVER w AS pe FROM segments "
    f"WINDOW w AS (PARTITION BY recording_id {ORDER})) WHERE pe IS NOT NULL",
    "segments", decimals="shared mid",
)
register(
    "looks_like_monologue",
    lambda t: speakers.looks_like_monologue(_two_voices(t)),
    "SELECT a.recording_id, n >= 4 AND k = 2 AND ((sw / greatest(n - 1, 1) >= 0.55 AND mean <= 6.0) OR least_sec / CASE WHEN total > 0 THEN total ELSE 1 END < 0.3) AS monologue FROM (SELECT recording_id, count(*) AS n, "
    "coalesce(sum((ps <> speaker)::INT), 0) AS sw, avg(greatest(0.0, end_sec - start_sec)) AS mean FROM (SELECT *, lag(speaker) OVER (PARTITION BY recording_id ORDER BY start_sec, end_sec, pos) AS ps FROM two) GROUP BY ALL) a JOIN "
    "(SELECT recording_id, count(*) AS k, min(sec) AS least_sec, sum(sec) AS total FROM (SELECT recording_id, speaker, sum(greatest(0.0, end_sec - start_sec)) AS sec FROM two GROUP BY ALL) GROUP BY ALL) b USING (recording_id)",
    "turn_segments", also="two AS (SELECT * FROM turn_segments)",
)


def _two_voices(t: Tables):
    return t.turn_segments()


register("collapse_to_single", lambda t: speakers.collapse_to_single(t.segments()), _merged_sql("(SELECT * REPLACE ('Speaker 1' AS speaker) FROM segments)", 0.6), "segments", decimals="start_sec end_sec")
