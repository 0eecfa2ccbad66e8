"""Queries on transcripts, files and languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import languages, text as tx
from ..operators import transcripts
from ..operators.ordered import Timeline, carry, spread
from ..plans.analyze import spoken_pieces
from ..sources import files as fl
from .fixtures import Tables
from .registry import CATALOG, register

ID = "recording_id"
_COUNTS = ", ".join(f"len(regexp_extract_all(text, '{rng}')) AS {code}_n" for code, rng in tx.SCRIPTS.items())
_TOP = "greatest(" + ", ".join(f"{c}_n" for c in tx.SCRIPTS) + ")"
_BEST = "CASE " + " ".join(f"WHEN {c}_n = {_TOP} THEN '{c}'" for c in tx.SCRIPTS) + " END"
_WS = r" \t\n\r"
_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_SQUASH = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
# views: script counts, and the inferred language
_SC = f"sc AS (SELECT *, {_COUNTS}, length({_STRIP.format('text')}) AS stripped FROM transcripts)"
_LANG = f"CASE WHEN {_TOP} >= CASE WHEN stripped <= 24 THEN 1 ELSE 2 END THEN {_BEST} END"


def _col(name, column, sql=None, views="transcripts", also="", **kw):
    register(name, lambda t: t.transcripts().select(ID, column().alias("result")), sql, views if sql else "", also, **kw)


_col("infer_language", lambda: tx.infer_language("text"), f"SELECT recording_id, {_LANG} AS result FROM sc", also=_SC)
_col("contains_indic", lambda: tx.contains_indic("text"), f"SELECT recording_id, ({_LANG}) IS NOT NULL AS result FROM sc", also=_SC)
_LOWQ = "(text = '' OR contains(lower(text), 'commission') OR contains(lower(text), 'subscribe') OR (len(k) >= 8 AND len(list_distinct(k)) <= 3))"
_KN = "kn AS (SELECT *, regexp_extract_all(text, '[\\x{0C80}-\\x{0CFF}]') AS k FROM transcripts)"
_col("is_low_quality", lambda: tx.is_low_quality("text"), f"SELECT recording_id, {_LOWQ} AS result FROM kn", also=_KN)
_col(
    "is_meaningful_speech", lambda: tx.is_meaningful_speech("text"),
    f"SELECT recording_id, s <> '' AND s <> '[No speech detected]' AND length(r) >= 3 AND (regexp_matches(r, '[A-Za-z\\x{{0900}}-\\x{{0D7F}}]{{2}}') OR length(r) >= 4) AS result FROM ("
    f"SELECT recording_id, s, {_STRIP.format(chr(39).join(['replace(s, ', '[vocalization]', ', ', '', ')']))} AS r FROM (SELECT recording_id, {_STRIP.format('text')} AS s FROM transcripts))",
)
_ENGLISH = "(len(regexp_extract_all({t}, '\\p{{L}}')) >= 4 AND len(regexp_extract_all({t}, '[A-Za-z]')) / greatest(len(regexp_extract_all({t}, '\\p{{L}}')), 1) >= 0.85)"
_col("is_likely_english", lambda: tx.is_likely_english("text"), f"SELECT recording_id, {_ENGLISH.format(t='text')} AS result FROM transcripts")
_col("strip_language_tag", lambda: tx.strip_language_tag("text"), f"SELECT recording_id, {_STRIP.format(chr(39).join(['regexp_replace(' + _STRIP.format('text') + ', ', '^\\[[^\\]]+\\]\\s*', ', ', '', ')']))} AS result FROM transcripts")
_col("squash_space", lambda: tx.squash_space("text"), f"SELECT recording_id, {_SQUASH.format('text')} AS result FROM transcripts")


def _stuttering(t: Tables):
    """Transcripts with a stutter of their first letter appended, long enough in two of three."""
    letter = F.regexp_extract("text", "[a-z]", 0)
    times = (F.col(ID) % 3 * 6).cast("int")
    return t.transcripts().withColumn("text", F.when(letter != "", F.concat("text", F.lit(" "), F.repeat(F.concat(letter, F.lit("-")), times), letter)).otherwise(F.col("text")))


_STUTTER = (
    "st AS (SELECT recording_id, CASE WHEN l <> '' THEN text || ' ' || repeat(l || '-', (recording_id % 3 * 6)::INT) || l ELSE text END AS text FROM (SELECT *, regexp_extract(text, '[a-z]', 0) AS l FROM transcripts))"
)
register("mark_vocalization", lambda t: _stuttering(t).select(ID, tx.mark_vocalization("text").alias("result")),
         "SELECT recording_id, regexp_replace(text, '\\b(?:[A-Za-z]-){12,}[A-Za-z]?\\b', '[vocalization]', 'g') AS result FROM st", "transcripts", _STUTTER)
_col("collapse_word_repeats", lambda: tx.collapse_word_repeats("text"))
_col("collapse_script_word_repeats", lambda: tx.collapse_script_word_repeats("text"))
register("collapse_phrase_repeats", lambda t: spread(t.transcripts(), ID).select(ID, tx.collapse_phrase_repeats(tx.squash_space("text")).alias("result")))


def _copied(t: Tables):
    """Each whole transcript behind three copies of its start; beside every second one, five copies of its start and no more."""
    head = F.concat(F.substring("text", 1, 30), F.lit(" "))
    led = t.transcripts().withColumn("text", F.concat(F.repeat(head, 3), "text"))
    loops = t.transcripts().filter(F.col(ID) % 2 == 0).withColumns({ID: -1 - F.col(ID), "text": F.repeat(head, 5)})
    return led.unionByName(loops).withColumn("text", tx.squash_space("text"))


_COPIED = (
    f"cp AS (SELECT recording_id, {_SQUASH.format('x')} AS t FROM (SELECT recording_id, repeat(h, 3) || text AS x FROM (SELECT *, substring(text, 1, 30) || ' ' AS h FROM transcripts) "
    "UNION ALL SELECT -1 - recording_id, repeat(substring(text, 1, 30) || ' ', 5) FROM transcripts WHERE recording_id % 2 = 0))"
)
_BLOCK = "trim(substring(t, {k} * z + 1, z))"
_WHOLE = "(n % z = 0 AND t = repeat(substring(t, 1, z), (n // z)::INT))"
register(
    "collapse_whole_string_loop",
    lambda t: _copied(t).select(ID, tx.collapse_whole_string_loop("text").alias("result")),
    f"SELECT c.recording_id, CASE WHEN z IS NULL THEN t WHEN {_WHOLE} THEN trim(substring(t, 1, z)) ELSE trim(trim(substring(t, 1, z)) || ' ' || trim(substring(t, reps * z + 1))) END AS result FROM cp c LEFT JOIN ("
    f"SELECT *, coalesce(list_min(list_filter(range(0, (n // z) + 1), lambda i: (i + 1) * z > n OR trim(substring(t, i * z + 1, z)) <> trim(substring(t, 1, z)))), n // z) AS reps FROM ("
    f"SELECT recording_id, t, length(t) AS n, z, row_number() OVER (PARTITION BY recording_id ORDER BY z DESC) AS k FROM (SELECT *, length(t) AS n, unnest(range(6, least(length(t) // 2, 240) + 1)) AS z FROM cp WHERE length(t) >= 12) "
    f"WHERE length({_BLOCK.format(k=0)}) >= 6 AND {_BLOCK.format(k=1)} = {_BLOCK.format(k=0)} AND ((n >= 3 * z AND {_BLOCK.format(k=2)} = {_BLOCK.format(k=0)}) OR {_WHOLE})) WHERE k = 1) z USING (recording_id, t)",
    "transcripts", _COPIED,
)


def _echoing(t: Tables):
    """Each transcript with its first sentence said three times more."""
    first = F.regexp_extract("text", r"^[^.!?।॥]*[.!?।॥]", 0)
    return t.transcripts().withColumn("text", F.concat(first, F.lit(" "), first, F.lit(" "), first, F.lit(" "), F.col("text")))


_ECHO = "ec AS (SELECT recording_id, f || ' ' || f || ' ' || f || ' ' || text AS text FROM (SELECT *, regexp_extract(text, '^[^.!?।॥]*[.!?।॥]', 0) AS f FROM transcripts))"
register(
    "drop_repeated_sentences",
    lambda t: _echoing(t).select(ID, tx.drop_repeated_sentences("text").alias("result")),
    "SELECT recording_id, array_to_string(list_filter(list_filter(s, lambda x, i: i = 1 OR x <> s[i - 1]), lambda x: x <> ''), ' ') AS result FROM (SELECT recording_id, "
    f"list_transform(regexp_extract_all({_SQUASH.format('text')}, '[^.!?।॥]*[.!?।॥]\\s*|[^.!?।॥]+$'), lambda x: trim(x)) AS s FROM ec)",
    "transcripts", _ECHO,
)
register("collapse_ngrams", lambda t: transcripts.collapse_ngrams(spread(t.transcripts(), ID)).select(ID, F.col("text").alias("result")))
register("clean_transcript", lambda t: transcripts.clean_transcript(spread(t.transcripts(), ID)).select(ID, F.col("text").alias("result")))
_col("clean_preserving", lambda: tx.clean_preserving("text"))
_HAS = "CASE lang " + " ".join(f"WHEN '{c}' THEN {c}_n > 0" for c in tx.SCRIPTS) + " ELSE false END"
_SHOWN = "('> ' || text)"
_INDIC = "('" + "', '".join(tx.SCRIPTS) + "')"
register(
    "keep_script",
    lambda t: t.transcripts().select(ID, tx.keep_script(tx.squash_space("text"), F.col("lang")).alias("result")),
    f"SELECT recording_id, CASE WHEN text = '' OR lang IN ('', 'en', 'english') THEN text WHEN contains(lower(text), 'commission') OR contains(lower(text), 'subscribe') OR contains(lower(text), 'thank you for watching') "
    f"OR (len(regexp_extract_all(text, '[.。]')) >= 3 AND length(text) < 80) OR (regexp_matches(text, '{tx.FOREIGN_SCRIPT}') AND NOT ({_HAS})) THEN '' WHEN found IS NULL THEN text "
    f"WHEN found = lang THEN CASE WHEN {_LOWQ} THEN '' ELSE text END WHEN lang IN {_INDIC} THEN CASE WHEN ({_HAS}) AND NOT {_LOWQ} THEN text ELSE '' END ELSE text END AS result FROM ("
    f"SELECT *, {_LANG} AS found, regexp_extract_all(text, '[\\x{{0C80}}-\\x{{0CFF}}]') AS k FROM sc)",
    "transcripts", f"sq AS (SELECT recording_id, lang, {_SQUASH.format('text')} AS text FROM transcripts), " + _SC.replace("FROM transcripts", "FROM sq"),
)
register("filter_script_mismatch", lambda t: transcripts.filter_script_mismatch(spread(t.transcripts(), ID)).select(ID, F.col("text").alias("result")))
register(
    "resolve_language",
    lambda t: t.transcripts().withColumn("language", tx.resolve_language("text", "lang")).select(
        ID, "language", tx.display_text("text", F.concat(F.lit("> "), "text"), "language").alias("shown")),
    f"SELECT recording_id, language, CASE WHEN language IN ('en', 'kn') OR {_STRIP.format(_SHOWN)} = '' THEN {_STRIP.format('text')} ELSE {_STRIP.format(_SHOWN)} END AS shown FROM ("
    f"SELECT *, coalesce({_LANG}, CASE WHEN {_ENGLISH.format(t='text')} THEN 'en' END, nullif(lower(lang), ''), 'en') AS language FROM sc)",
    "transcripts", _SC,
)


def _pieces_of_five(t: Tables):
    """Five texts in a row as the pieces of one recording, with a marked translation."""
    return t.transcripts().select(
        F.floor(F.col(ID) / 5).alias(ID), F.col(ID).alias("pos"), F.col("text").alias("original"), F.concat(F.lit("> "), "text").alias("translated"), "lang")


register(
    "spoken_pieces",
    lambda t: spoken_pieces(_pieces_of_five(t)).select(ID, "original", "transcript", "language", F.array_join("languages", "|").alias("languages")),
    "SELECT recording_id, string_agg(original, ' ' ORDER BY pos) AS original, string_agg(shown, ' ' ORDER BY pos) AS transcript, CASE WHEN count(DISTINCT language) = 1 THEN any_value(language) ELSE 'multi' END AS language, "
    "string_agg(CASE WHEN first THEN language END, '|' ORDER BY pos) AS languages FROM (SELECT *, pos = min(pos) OVER (PARTITION BY recording_id, language) AS first FROM ("
    f"SELECT recording_id // 5 AS recording_id, recording_id AS pos, original, language, CASE WHEN language IN ('en', 'kn') THEN original ELSE {_STRIP.format(_SHOWN)} END AS shown FROM ("
    f"SELECT *, {_STRIP.format('text')} AS original, coalesce({_LANG}, CASE WHEN {_ENGLISH.format(t='text')} THEN 'en' END, nullif(lower(lang), ''), 'en') AS language FROM sc) WHERE original <> '')) GROUP BY recording_id",
    "transcripts", _SC,
)
_MASK = "regexp_replace({}, '(?i)\\b(Mrs|Mr|Ms|Dr|Prof|Sr|Jr|vs|etc|i\\.e|e\\.g)\\.', '\\1․', 'g')"
_CUT = "regexp_replace({}, '(?i)\\s+(Oh|Yeah|Hmm|OK|Okay|Yes|No|Mom|Dear)([^\\p{{L}}\\p{{N}}_]|$)', chr(1) || '\\1\\2', 'g')"
register(
    "split_sentences",
    lambda t: transcripts.sentences(t.transcripts()).select(ID, F.col("pos").cast("long").alias("pos"), "text"),
    "SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY i) - 1 AS pos, CASE WHEN regexp_matches(s, '[.!?]$') THEN s ELSE s || '.' END AS text FROM ("
    "SELECT recording_id, unnest(range(len(p))) AS i, trim(replace(unnest(p), '․', '.'), ' ,') AS s FROM (SELECT recording_id, string_split(m, chr(1)) AS p FROM ("
    f"SELECT recording_id, {_CUT.format(_CUT.format('m'))} AS m FROM (SELECT recording_id, regexp_replace({_MASK.format(_SQUASH.format('text'))}, '([.!?])\\s+', '\\1' || chr(1), 'g') AS m FROM transcripts)))) WHERE s <> ''",
    "transcripts",
)


def _prefixed(t: Tables):
    """Conversations as text with a speaker prefix on every line."""
    prefix = F.concat(F.lit("Speaker "), (F.col("turn") % 2 + 1).cast("string"), F.lit(": "))
    lines = F.array_join(F.transform(F.split("text", "\n"), lambda s: F.concat(prefix, s)), "\n")
    return t.turns().groupBy(ID).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", lines.alias("l")))), lambda x: x["l"]), "\n").alias("text"))


register(
    "strip_speaker_prefixes",
    lambda t: _prefixed(t).select(ID, tx.strip_speaker_prefixes("text").alias("result")),
    f"SELECT recording_id, array_to_string(list_filter(list_transform(flatten(list(string_split(text, E'\\n') ORDER BY turn)), lambda x: {_STRIP.format('x')}), lambda x: x <> ''), ' ') AS result FROM turns GROUP BY recording_id",
    "turns",
)
_MIN = "lpad((floor(s / 60)::BIGINT)::VARCHAR, 2, '0') || ':' || printf('%06.3f', s - floor(s / 60) * 60)"
register(
    "format_timestamp",
    lambda t: t.segments().select(ID, "pos", tx.format_timestamp("start_sec").alias("stamp"), tx.format_timestamp_short(F.col("start_sec") * 10).alias("short")),
    f"SELECT recording_id, pos, {_MIN} AS stamp, CASE WHEN s >= 360 THEN printf('%02d:', floor(s * 10 / 3600)::INT) ELSE '' END || printf('%02d:%02d', floor((s * 10) % 3600 / 60)::INT, floor((s * 10) % 60)::INT) AS short "
    "FROM (SELECT *, start_sec AS s FROM segments)",
    "segments",
)


def _pairs(t: Tables):
    tl = Timeline(("pos",), F.floor(F.col("pos") / 64))
    rows = t.read("documents").select(F.col("source").alias(ID), F.col("doc_id").alias("pos"), "text")
    return carry(rows, tl, {"before": ("lag", F.col("text"))}).filter("before is not null")


_W = "list_filter(string_split_regex({}, '\\s+'), lambda w: w <> '')"
_PAIR = f"pr AS (SELECT pos, list_distinct({_W.format('before')}) AS a, list_distinct({_W.format('text')}) AS b, {_W.format('before')} AS pw, {_W.format('text')} AS cw, text FROM (SELECT doc_id AS pos, text, lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS before FROM documents) WHERE before IS NOT NULL)"
register(
    "token_similarity",
    lambda t: _pairs(t).select("pos", tx.token_jaccard("before", "text").alias("jaccard"), tx.token_overlap("before", "text").alias("overlap")),
    "SELECT pos, CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0.0 END AS jaccard, "
    "CASE WHEN least(len(a), len(b)) > 0 THEN len(list_intersect(a, b)) / least(len(a), len(b)) ELSE 0.0 END AS overlap FROM pr",
    also=_PAIR, decimals="jaccard overlap",
)


def _overlapping(t: Tables):
    """Chunk transcripts with the chunk before."""
    tl = Timeline(("pos",), F.floor(F.col("pos") / 8))
    return carry(t.chunks(), tl, {"before": ("lag", F.col("text"))}).filter("before is not null")


_OVER = "list_max(list_filter(range(1, least(len(pw), len(cw), 16) + 1), lambda k: list_slice(pw, len(pw) - k + 1, len(pw)) = list_slice(cw, 1, k)))"
register(
    "word_overlap_suffix",
    lambda t: _overlapping(t).select(ID, "pos", tx.word_overlap_suffix("before", "text").alias("added")),
    f"SELECT recording_id, pos, CASE WHEN k IS NULL THEN text ELSE array_to_string(list_slice(cw, k + 1, len(cw)), ' ') END AS added FROM (SELECT *, {_OVER} AS k FROM ("
    f"SELECT *, {_W.format('before')} AS pw, {_W.format('text')} AS cw FROM (SELECT *, lag(text) OVER (PARTITION BY recording_id ORDER BY pos) AS before FROM chunks) WHERE before IS NOT NULL))",
    "chunks",
)

CUES = {"addresses_a": r"(?i)\bthe\b", "addresses_b": r"(?i)\band\b", "self_a": r"^In ", "self_b": r"^An ", "greeting": r"(?i)\bhe\b", "start": r"(?i)\ber\b", "follow_up": r"^[A-Za-z]+\.$"}


def _cue_flag(pattern: str) -> str:
    """The cue in SQL, whose own word edges know ASCII letters only."""
    edged = pattern.replace(r"(?i)\b", r"(?i)(?:^|[^\p{L}\p{N}_])").replace(r"\b", r"(?:$|[^\p{L}\p{N}_])").replace("'", "''")
    return f"regexp_matches(text, '{edged}')"


_CUE_FLAGS = {k: _cue_flag(p) for k, p in {**tx.DIALOGUE_CUES, **CUES}.items()}
register(
    "dialogue_cues",
    lambda t: transcripts.sentences(t.transcripts()).select(ID, F.col("pos").cast("long").alias("pos"), *[c.alias(n) for n, c in tx.dialogue_cues("text", CUES).items()]),
    "SELECT recording_id, pos, " + ", ".join(f"{v} AS {k}" for k, v in _CUE_FLAGS.items()) + f", {_CUE_FLAGS['addresses_a']} AND {_CUE_FLAGS['addresses_b']} AS strong FROM ({CATALOG['split_sentences'].sql})",
)


def _danda(t: Tables):
    """Words of which every third is a sentence mark and one letter: content only where that mark isn't stripped."""
    return t.words().withColumn("word", F.when(F.col("pos") % 3 == 0, F.concat(F.lit("।"), F.left("word", F.lit(1)))).otherwise(F.col("word")))


register("min_content_latin", lambda t: _danda(t).filter(~tx.shorter_than("word", 2, " .,?!")).select(ID, "pos", "word"), "SELECT recording_id, pos, word FROM (SELECT * REPLACE (CASE WHEN pos % 3 = 0 THEN '।' || left(word, 1) ELSE word END AS word) FROM words) WHERE length(trim(word, ' .,?!')) >= 2", "words")
register("min_content", lambda t: t.words().filter(~tx.shorter_than("word", 2)).select(ID, "pos", "word"), "SELECT recording_id, pos, word FROM words WHERE length(trim(word, ' .,?!।')) >= 2", "words")

# --- languages
_EN = "lower(trim(lang))"
_NAMES = "names AS (SELECT unnest([" + ", ".join(f"'{c}'" for c in languages.LANGUAGES) + "]) AS c, unnest([" + ", ".join(f"'{n}'" for n in languages.LANGUAGES.values()) + "]) AS n)"


def _language_names(t: Tables):
    """Codes, names and unknown values."""
    name = F.when(F.col(ID) % 3 == 0, F.col("lang")).when(F.col(ID) % 3 == 1, F.initcap(languages.language_label("lang"))).otherwise(F.concat("lang", F.lit("-x")))
    return t.transcripts().select(ID, name.alias("v"))


_GIVEN = "given AS (SELECT recording_id, CASE recording_id % 3 WHEN 0 THEN lang WHEN 1 THEN (SELECT upper(n[1]) || n[2:] FROM names WHERE c = lang) ELSE lang || '-x' END AS v FROM transcripts)"
register(
    "language_code",
    lambda t: _language_names(t).select(ID, languages.language_code("v").alias("code"), languages.language_label("v").alias("label")),
    "SELECT recording_id, coalesce(a.c, lower(v)) AS code, coalesce(upper(b.n[1]) || b.n[2:], upper(v)) AS label FROM given LEFT JOIN names a ON a.n = lower(v) LEFT JOIN names b ON b.c = coalesce(a.c, lower(v))",
    "transcripts", _NAMES + ", " + _GIVEN,
)
register(
    "language_from_token",
    lambda t: _language_names(t).select(ID, languages.language_from_token(F.concat(F.lit("<|"), F.lower("v"), F.lit("|>"))).alias("code")),
    "SELECT recording_id, coalesce(a.c, lower(v)) AS code FROM given LEFT JOIN names a ON a.n = lower(v)", "transcripts", _NAMES + ", " + _GIVEN,
)
register(
    "route_model",
    lambda t: t.transcripts().select(ID, languages.route_model("lang", "base", {"fr": "french-large", "de": ""}).alias("model")),
    "SELECT recording_id, CASE lang WHEN 'fr' THEN 'french-large' WHEN 'kn' THEN 'vasista22/whisper-kannada-base' ELSE 'base' END AS model FROM transcripts", "transcripts",
)

# --- files
register("describe_files", lambda t: fl.describe_files(t.files()), "SELECT path, string_split(path, '/')[-1] AS name, length, sha256(content) AS sha256 FROM files", "files")
register("mime_of", lambda t: t.files().select("id", fl.mime_of("path").alias("mime")), "SELECT id, CASE WHEN regexp_matches(path, '[^/]\\.wav$') THEN 'audio/wav' WHEN regexp_matches(path, '[^/]\\.mp3$') THEN 'audio/mpeg' ELSE 'application/octet-stream' END AS mime FROM files", "files")
register(
    "safe_stem",
    lambda t: t.files().select("id", fl.safe_stem("path").alias("stem")),
    "SELECT id, coalesce(nullif(substring(trim(regexp_replace(regexp_replace(string_split(path, '/')[-1], '^(.+)\\.[^.]+$', '\\1'), '[^\\p{L}\\p{N}_\\-]+', '_', 'g'), '_'), 1, 40), ''), 'audio') AS stem FROM files", "files",
)


def _requests(t: Tables):
    """Uploads with questions of various lengths and languages."""
    n = F.col("id") % 7
    return t.files().select(
        "id", F.when(n == 6, F.lit(" ")).otherwise(F.col("path")).alias("name"),
        F.when(n == 5, F.lit("")).otherwise(F.repeat(F.lit("why "), (n * 60).cast("int") + 1)).alias("question"),
        F.element_at(F.array(F.lit("EN"), F.lit(" kn "), F.lit("fr")), (F.col("id") % 3 + 1).cast("int")).alias("language"),
        F.when(n == 3, F.lit(0).cast("long")).otherwise(F.col("length")).alias("length"),
    )


register(
    "admit",
    lambda t: fl.admit(_requests(t), max_mb=1).select("id", "reject_reason", "language"),
    "SELECT id, CASE WHEN trim(name) = '' THEN 'no file' WHEN trim(q) = '' THEN 'empty question' WHEN length(q) > 1000 THEN 'question too long' WHEN NOT regexp_matches(name, '[^/]\\.(wav|mp3|flac|ogg|m4a|mp4|mkv|webm|avi|mov)$') "
    "THEN 'file type not allowed' WHEN len = 0 THEN 'empty file' WHEN len / 1048576 > 1 THEN 'file too large' END AS reject_reason, CASE WHEN lower(trim(l)) IN ('en', 'kn') THEN lower(trim(l)) ELSE '' END AS language FROM ("
    "SELECT id, CASE WHEN id % 7 = 6 THEN ' ' ELSE path END AS name, CASE WHEN id % 7 = 5 THEN '' ELSE repeat('why ', (id % 7 * 60)::INT + 1) END AS q, ['EN', ' kn ', 'fr'][id % 3 + 1] AS l, CASE WHEN id % 7 = 3 THEN 0 ELSE length END AS len FROM files)",
    "files",
)


def _decoded(t: Tables, max_sec: float | None):
    """Waveforms written as WAV files and read back."""
    folder = t.scratch("wav")
    fl.write_pcm_wav(t.waveforms(), folder, 30000.0).count()
    files = t.spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(folder)
    files = files.select(fl.stem("path").cast("long").alias(ID), "content")
    rows = fl.unpack_pcm_wav(files, max_sec, size=100).select(ID, "sample_rate", "first_sample", F.posexplode("samples").alias("i", "x"))
    return rows.select(ID, "sample_rate", (F.col("first_sample") + F.col("i")).alias("i"), F.col("x").cast("double").alias("x"))


def _scanned(t: Tables):
    """Pages written as files and read back."""
    folder = t.scratch("pages")
    pages = t.read("pages").filter("html is not null")
    fl.write_files(pages.select(F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.encode("html", "UTF-8").alias("content")), folder).count()
    return fl.scan_recordings(t.spark, folder, "*.html").select("name", "length", "sha256")


register(
    "scan_recordings", _scanned,
    "SELECT 'page_' || page_id || '.html' AS name, octet_length(encode(html)) AS length, sha256(html) AS sha256 FROM pages WHERE html IS NOT NULL",
)
register(
    "unpack_pcm_wav", lambda t: _decoded(t, None),
    "SELECT recording_id, sample_rate, unnest(range(len(samples))) AS i, unnest(list_transform(samples, lambda s: round(s::DOUBLE * 30000) / 32768)) AS x FROM waveforms", "waveforms", decimals="x",
)
register(
    "unpack_pcm_wav_limited", lambda t: _decoded(t, 0.2),
    "SELECT recording_id, sample_rate, unnest(range(least(len(samples), 40))) AS i, unnest(list_transform(samples[1:40], lambda s: round(s::DOUBLE * 30000) / 32768)) AS x FROM waveforms", "waveforms", decimals="x",
)
register(
    "identity_record",
    lambda t: fl.identity_record(
        t.transcripts().select(ID, F.concat(F.lit("doc"), F.col(ID).cast("string")).alias("upload_name"), F.octet_length("text").cast("long").alias("audio_bytes"), F.sha2("text", 256).alias("audio_sha256"),
                               (F.length("text") - F.length("text") % 1000).cast("long").alias("wav_samples"), F.lit(16000).alias("sample_rate"), "text", "lang").withColumn("language", F.when(F.col("lang") == "fr", F.lit("")).otherwise(F.col("lang"))),
        "upload",
    ),
    "SELECT 'upload' AS stage, 'doc' || recording_id AS upload_name, octet_length(encode(text)) AS audio_bytes, sha256(text) AS audio_sha256, n AS wav_samples, CASE WHEN n > 0 THEN round(n / 16000, 3) END AS wav_duration_sec, "
    "CASE WHEN lang = 'fr' THEN 'auto' ELSE lang END AS language, CASE WHEN length(p) > 160 THEN substring(p, 1, 160) || '…' ELSE p END AS whisper_preview FROM ("
    f"SELECT *, (length(text) - length(text) % 1000)::BIGINT AS n, {_STRIP.format(chr(39).join(['replace(text, chr(10), ', ' ', ')']))} AS p FROM transcripts)",
    "transcripts",
)
