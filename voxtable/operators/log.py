"""Queries on the analysis log, users and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..sources.log import read_analysis

PAYLOAD = "audio_data"


def history_view(logs: DataFrame) -> DataFrame:
    """Everything but the binary payload; the scan never reads it."""
    return logs.select([c for c in logs.columns if c not in (PAYLOAD, "audio_mime")])


def history(logs: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest entries first; the page size is clamped to 1..100."""
    limit, offset = min(max(limit, 1), 100), max(offset, 0)
    return history_view(logs).orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def get_by_id(logs: DataFrame, id_: int) -> DataFrame:
    """One entry without its payload, the list of sounds decoded where there is one."""
    found = history_view(logs).filter(F.col("id") == id_)
    return read_analysis(found) if "sounds_json" in found.columns else found


def get_audio(logs: DataFrame, id_: int | None = None) -> DataFrame:
    """Stored payloads with defaults for type and name; entries without payload give nothing."""
    rows = logs if id_ is None else logs.filter(F.col("id") == id_)
    return rows.filter(F.length(PAYLOAD) > 0).select(
        "id", PAYLOAD,
        F.coalesce(F.nullif(F.col("audio_mime"), F.lit("")), F.lit("application/octet-stream")).alias("audio_mime"),
        F.coalesce(F.nullif(F.col("audio_filename"), F.lit("")), F.lit("audio")).alias("audio_filename"),
    )


def active_sessions(users: DataFrame, sessions: DataFrame, now) -> DataFrame:
    """Users of tokens that have not expired."""
    live = sessions.filter(F.col("expires_at") > now)
    return live.join(users, live["user_id"] == users["id"]).select("token", "id", "email", "expires_at")


def end_sessions(sessions: DataFrame, tokens: DataFrame) -> DataFrame:
    return sessions.join(tokens.select("token"), "token", "left_anti")


def find_user(users: DataFrame, email: str | Column) -> DataFrame:
    wanted = F.lower(strip(F.lit(email) if isinstance(email, str) else email))
    return users.filter(F.lower("email") == wanted)


def triage_worker_log(lines: DataFrame, key: str = "run", longest: int = 280, mark: str = "[worker]") -> DataFrame:
    """One message per worker run: its last stage, then the other lines that are not noise, cut.

    ``lines`` has the run key, ``pos`` and ``line``; ``mark`` opens a stage line.  Only lines that can still fall
    within the cut are brought together: lengths are summed up first.
    """
    from .ordered import by_position, carry, join_text

    text = strip("line")
    low = F.lower(text)
    noise = low.contains("unauthenticated requests to the hf hub") | (low.contains("hf_token") & low.contains("rate limit"))
    told = lines.select(key, "pos", text.alias("line")).filter((F.col("line") != "") & ~noise)
    is_stage = F.col("line").startswith(mark)
    stage = told.groupBy(key).agg(F.max_by("line", F.when(is_stage, F.col("pos"))).alias("stage"))
    tl = by_position(key=(key,))
    body = carry(told.filter(~is_stage), tl, {"before": ("sum_before", F.length("line") + 1)})
    body = body.filter(F.coalesce("before", F.lit(0)) < longest)
    body = join_text(body, tl, {"body": (F.substring("line", 1, longest), " ")})
    tip = F.concat(F.lit("Last stage: "), F.replace("stage", F.lit(mark + " "), F.lit("")), F.lit("."))
    out = stage.join(body, key, "left")
    message = F.concat_ws(" ", tip, F.nullif(F.substring("body", 1, longest), F.lit("")))
    return out.select(key, strip(message).alias("message"))
