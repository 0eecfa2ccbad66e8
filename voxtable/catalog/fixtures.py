"""Views that give the operators' input shapes from the given tables, in Spark and in SQL.

Each view exists twice, as a DataFrame function and as a SQL common table
expression with the same rows, so that a query can be checked against its oracle.
"""

from __future__ import annotations

import os
import tempfile
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import words as split_words
from ..operators import waveforms
from ..operators.ordered import Timeline, by_position, carry

EPOCH_US = 1704067200000000  # 2024-01-01T00:00:00Z
RATE = 200
SCRIPTS = {
    "kn": "ಅಆಇಈಉಊಎಏಐಒಓಔಕಖಗಘಚಛಜಝಟಠಡಢಣತ",
    "hi": "अआइईउऊएऐओऔकखगघचछजझटठडढणतथद",
}
LETTERS = "abcdefghijklmnopqrstuvwxyz"
LABELS = {"click": "mouse_click", "view": "Bark", "purchase": "dog", "error": "Siren", "signup": "White noise"}


class Tables:
    """The given tables and the views on them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def scratch(self, name: str) -> str:
        """A new folder next to the checkpoints, where every executor can write."""
        base = self.spark.conf.get("spark.checkpoint.dir", None)
        if base:
            return f"{base}/{name}-{os.urandom(6).hex()}"
        if self.spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        return tempfile.mkdtemp(prefix=f"voxtable-{name}-") + "/data"

    def _events(self) -> DataFrame:
        micros = lambda c: F.unix_micros(c.cast("timestamp_ntz").cast("timestamp"))
        hours = (micros(F.col("ts")) - micros(F.lit("2024-01-01"))) / F.lit(3.6e9)
        return self.read("events").withColumn("t", hours)

    def segments(self) -> DataFrame:
        return self._events().select(
            F.col("user_id").alias("recording_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("speaker"),
            F.col("t").alias("start_sec"), (F.col("t") + F.col("value") / 10).alias("end_sec"),
        )

    def frames(self) -> DataFrame:
        tl = Timeline(("t", "event_id"), F.floor(F.col("t") / 240), ("user_id",))
        rows = carry(self._events(), tl, {"nth": ("sum", F.lit(1).cast("long"))})
        return rows.select(
            F.col("user_id").alias("recording_id"), (F.col("nth") - 1).alias("frame_idx"), (F.col("value") / 500).alias("rms"),
        )

    def clips(self) -> DataFrame:
        """Recordings the frames belong to."""
        n = self.read("events").groupBy(F.col("user_id").alias("recording_id")).agg(F.count("*").alias("n"))
        return n.select("recording_id", (F.col("n") * 2 + 3).alias("n_samples"), F.lit(RATE).alias("sample_rate"))

    def waveforms(self) -> DataFrame:
        """The values of each user's events as samples, in short blocks."""
        sign = F.when(F.col("event_id") % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
        rows = self._events().withColumn("x", (F.col("value") / 500 * sign).cast("float"))
        return waveforms.gather(rows, Timeline(("t", "event_id"), F.floor(F.col("t") / 240), ("user_id",)), "x", F.lit(RATE), 64)

    def turns(self) -> DataFrame:
        c = self.read("conversations").select(
            F.col("conv_id").alias("recording_id"), "turn", "role", "text", F.size(split_words("text")).cast("long").alias("n")
        )
        c = carry(c, by_position("turn"), {"done": ("sum", F.col("n"))})
        return c.select(
            "recording_id", "turn", F.concat(F.lit("spk_"), (F.col("n") % 2).cast("string")).alias("speaker"), "role", "text",
            F.col("text").alias("text_original"), ((F.col("done") - F.col("n")) * 0.25).alias("start_sec"), (F.col("done") * 0.25).alias("end_sec"),
        )

    def turns_untimed(self) -> DataFrame:
        none = F.lit(None).cast("double")
        return self.turns().withColumns({"start_sec": none, "end_sec": none})

    def words(self) -> DataFrame:
        t = self.turns().select("recording_id", "start_sec", F.posexplode(split_words("text")).alias("i", "word"))
        pos = (F.col("start_sec") * 4).cast("long") + F.col("i")
        return t.select(
            "recording_id", pos.alias("pos"), "word", (pos * 0.25).alias("start_sec"), ((pos + 1) * 0.25).alias("end_sec"),
            F.lit(0.9).alias("score"), F.lit(None).cast("string").alias("speaker"), F.lit(None).cast("double").alias("confidence"),
        )

    def phrases(self) -> DataFrame:
        w = self.words().withColumn("g", F.floor(F.col("pos") / 8))
        ordered = F.array_sort(F.collect_list(F.struct("pos", "word")))
        return w.groupBy("recording_id", "g").agg(
            F.array_join(F.transform(ordered, lambda x: x["word"]), " ").alias("text"),
            F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"),
        ).select("recording_id", F.col("g").alias("pos"), "text", "start_sec", "end_sec")

    def chunks(self) -> DataFrame:
        """Windows of 18 words, a new one every 16."""
        w = self.words()
        g = F.floor(F.col("pos") / 16)
        both = F.when((F.col("pos") % 16 < 2) & (g > 0), F.array(g, g - 1)).otherwise(F.array(g))
        w = w.select("recording_id", "pos", "word", F.explode(both).alias("g"))
        ordered = F.array_sort(F.collect_list(F.struct("pos", "word")))
        return w.groupBy("recording_id", F.col("g").alias("pos")).agg(
            F.array_join(F.transform(ordered, lambda x: x["word"]), " ").alias("text")
        )

    def turn_segments(self) -> DataFrame:
        return self.turns().select(
            "recording_id", F.col("turn").alias("pos"), "speaker", (F.col("start_sec") + 0.4).alias("start_sec"), (F.col("end_sec") + 0.4).alias("end_sec"),
        )

    def hits(self) -> DataFrame:
        label = F.create_map(*[F.lit(x) for x in chain.from_iterable(LABELS.items())])[F.col("event_type")]
        ast = F.col("event_id") % 2 == 1
        return self.read("events").select(
            F.col("user_id").alias("recording_id"), F.when(ast, "ast").otherwise("cnn").alias("detector"), ast.cast("int").alias("detector_rank"),
            F.dayofmonth("ts").cast("long").alias("window_id"), F.col("event_id").alias("pos"), label.alias("label"), (F.col("value") / 500).alias("score"),
        )

    def embeddings(self) -> DataFrame:
        return self.read("embeddings").select(
            F.floor(F.col("vec_id") / 20).alias("recording_id"), (F.col("vec_id") % 20).alias("pos"), F.col("embedding").alias("vec"), "label",
        )

    def transcripts(self) -> DataFrame:
        """Documents; one in five in Kannada letters, one in Devanagari, one tagged, one with a loop at its end."""
        kind = F.col("doc_id") % 5
        low = F.lower("text")
        looped = F.concat(F.col("text"), F.lit(" "), F.repeat(F.concat(F.regexp_extract("text", r"[A-Za-z]+", 0), F.lit(" ")), F.lit(5)))
        text = (
            F.when(kind == 0, F.translate(low, LETTERS, SCRIPTS["kn"]))
            .when(kind == 1, F.translate(low, LETTERS, SCRIPTS["hi"]))
            .when(kind == 2, F.concat(F.lit("[Tag] "), F.col("text")))
            .when(kind == 3, looped)
            .otherwise(F.col("text"))
        )
        lang = F.when(kind == 0, F.lit("kn")).otherwise(F.col("lang"))
        return self.read("documents").select(F.col("doc_id").alias("recording_id"), text.alias("text"), lang.alias("lang"), "source")

    def votes(self) -> DataFrame:
        return self.read("documents").select(F.col("source").alias("recording_id"), F.col("doc_id").alias("pos"), F.col("lang").alias("code"))

    def files(self) -> DataFrame:
        end = F.element_at(F.array(F.lit(".wav"), F.lit(".mp3"), F.lit(".txt")), (F.col("page_id") % 3 + 1).cast("int"))
        content = F.encode("html", "UTF-8")
        return self.read("pages").select(
            F.col("page_id").alias("id"), F.concat("url", end).alias("path"), content.alias("content"), F.octet_length("html").cast("long").alias("length"),
        )

    def log(self) -> DataFrame:
        return self.read("orders").select(
            F.col("o_orderkey").alias("id"), F.concat(F.lit("clip_"), F.col("o_custkey").cast("string"), F.lit(".wav")).alias("audio_filename"),
            F.lit("audio/wav").alias("audio_mime"), F.encode("o_orderpriority", "UTF-8").alias("audio_data"),
            F.col("o_orderpriority").alias("question"), F.col("o_orderstatus").alias("answer"), F.col("o_orderdate").alias("created_at"),
        )

    def users(self) -> DataFrame:
        return self.read("customer").select(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit("@Mail.org")).alias("email"))

    def sessions(self) -> DataFrame:
        return self.read("orders").select(
            F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("token"), F.col("o_orderdate").alias("expires_at")
        )

    def manifest(self) -> DataFrame:
        types = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
        target = F.array_position(F.array(*[F.lit(t) for t in types]), F.col("p_type"))
        return self.read("part").select(
            F.concat(F.lit("clip"), F.col("p_partkey").cast("string"), F.lit(".wav")).alias("filename"), target.cast("int").alias("target"),
            F.col("p_type").alias("category"), (F.col("p_size") % 5 + 1).cast("int").alias("fold"),
        )

    def predictions(self) -> DataFrame:
        return self.read("labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("y_true"), F.col("toxic").alias("y_pred"))

    def history(self) -> DataFrame:
        """Users as training runs, their events as epochs."""
        f = self.frames()
        return f.select(
            F.col("recording_id").alias("run"), (F.col("frame_idx") + 1).alias("epoch"), F.round(F.col("rms"), 1).alias("accuracy"), F.col("rms").alias("macro_f1"),
        )


_WORDS = "list_filter(string_split_regex({t}, '\\s+'), lambda x: x <> '')"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": ((), f"SELECT *, (epoch_us(ts) - {EPOCH_US}) / 3.6e9 AS t FROM events"),
    "segments": (
        ("ev",),
        "SELECT user_id AS recording_id, event_id AS pos, event_type AS speaker, t AS start_sec, t + value / 10 AS end_sec FROM ev",
    ),
    "frames": (
        ("ev",),
        "SELECT user_id AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS frame_idx, value / 500 AS rms FROM ev",
    ),
    "clips": ((), f"SELECT user_id AS recording_id, count(*) * 2 + 3 AS n_samples, {RATE} AS sample_rate FROM events GROUP BY user_id"),
    "waveforms": (
        ("ev",),
        f"SELECT user_id AS recording_id, {RATE} AS sample_rate, "
        "list((value / 500 * CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE -1.0 END)::FLOAT ORDER BY t, event_id) AS samples FROM ev GROUP BY user_id",
    ),
    "turns": (
        (),
        f"SELECT conv_id AS recording_id, turn, 'spk_' || (n % 2) AS speaker, role, text, text AS text_original, (done - n) * 0.25::DOUBLE AS start_sec, "
        f"done * 0.25::DOUBLE AS end_sec FROM (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS done FROM "
        f"(SELECT *, len({_WORDS.format(t='text')}) AS n FROM conversations))",
    ),
    "turns_untimed": (("turns",), "SELECT * REPLACE (NULL::DOUBLE AS start_sec, NULL::DOUBLE AS end_sec) FROM turns"),
    "words": (
        ("turns",),
        "SELECT recording_id, pos, word, pos * 0.25::DOUBLE AS start_sec, (pos + 1) * 0.25::DOUBLE AS end_sec, 0.9::DOUBLE AS score, "
        "NULL::VARCHAR AS speaker, NULL::DOUBLE AS confidence FROM (SELECT recording_id, unnest(w) AS word, "
        "(start_sec * 4)::BIGINT + unnest(range(len(w))) AS pos FROM "
        f"(SELECT recording_id, start_sec, {_WORDS.format(t='text')} AS w FROM turns))",
    ),
    "phrases": (
        ("words",),
        "SELECT recording_id, pos // 8 AS pos, string_agg(word, ' ' ORDER BY words.pos) AS text, min(start_sec) AS start_sec, max(end_sec) AS end_sec "
        "FROM words GROUP BY recording_id, words.pos // 8",
    ),
    "chunks": (
        ("words",),
        "SELECT recording_id, g AS pos, string_agg(word, ' ' ORDER BY p) AS text FROM (SELECT recording_id, pos AS p, word, "
        "unnest(CASE WHEN pos % 16 < 2 AND pos >= 16 THEN [pos // 16, pos // 16 - 1] ELSE [pos // 16] END) AS g FROM words) GROUP BY recording_id, g",
    ),
    "turn_segments": (
        ("turns",),
        "SELECT recording_id, turn AS pos, speaker, start_sec + 0.4::DOUBLE AS start_sec, end_sec + 0.4::DOUBLE AS end_sec FROM turns",
    ),
    "hits": (
        (),
        "SELECT user_id AS recording_id, CASE WHEN event_id % 2 = 1 THEN 'ast' ELSE 'cnn' END AS detector, (event_id % 2)::INT AS detector_rank, "
        "day(ts)::BIGINT AS window_id, event_id AS pos, CASE event_type "
        + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items())
        + " END AS label, value / 500 AS score FROM events",
    ),
    "emb": ((), "SELECT vec_id // 20 AS recording_id, vec_id % 20 AS pos, embedding AS vec, label FROM embeddings"),
    "transcripts": (
        (),
        "SELECT doc_id AS recording_id, CASE doc_id % 5 "
        f"WHEN 0 THEN translate(lower(text), '{LETTERS}', '{SCRIPTS['kn']}') WHEN 1 THEN translate(lower(text), '{LETTERS}', '{SCRIPTS['hi']}') "
        "WHEN 2 THEN '[Tag] ' || text WHEN 3 THEN text || ' ' || repeat(regexp_extract(text, '[A-Za-z]+', 0) || ' ', 5) ELSE text END AS text, "
        "CASE WHEN doc_id % 5 = 0 THEN 'kn' ELSE lang END AS lang, source FROM documents",
    ),
    "votes": ((), "SELECT source AS recording_id, doc_id AS pos, lang AS code FROM documents"),
    "files": (
        (),
        "SELECT page_id AS id, url || ['.wav', '.mp3', '.txt'][page_id % 3 + 1] AS path, encode(html) AS content, octet_length(encode(html)) AS length FROM pages",
    ),
    "log": (
        (),
        "SELECT o_orderkey AS id, 'clip_' || o_custkey || '.wav' AS audio_filename, 'audio/wav' AS audio_mime, encode(o_orderpriority) AS audio_data, "
        "o_orderpriority AS question, o_orderstatus AS answer, o_orderdate AS created_at FROM orders",
    ),
    "users": ((), "SELECT c_custkey AS id, c_name || '@Mail.org' AS email FROM customer"),
    "sessions": ((), "SELECT o_custkey AS user_id, o_orderkey AS token, o_orderdate AS expires_at FROM orders"),
    "manifest": (
        (),
        "SELECT 'clip' || p_partkey || '.wav' AS filename, list_position(['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD'], p_type)::INT AS target, "
        "p_type AS category, (p_size % 5 + 1)::INT AS fold FROM part",
    ),
    "predictions": ((), "SELECT doc_id AS id, quality AS y_true, toxic AS y_pred FROM labels"),
    "history": (("frames",), "SELECT recording_id AS run, frame_idx + 1 AS epoch, round(rms, 1) AS accuracy, rms AS macro_f1 FROM frames"),
}


def with_views(sql: str, *names: str, also: str = "") -> str:
    """Prefix a query with the views it uses and further common table expressions."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        needs, body = VIEWS[name]
        for n in needs:
            add(n)
        done.setdefault(name, body)

    for n in names:
        add(n)
    parts = [f"{n} AS ({b})" for n, b in done.items()]
    if also:
        parts.append(also)
    return ("WITH " + ", ".join(parts) + " " + sql) if parts else sql
