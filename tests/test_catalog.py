"""A sample of the catalogue against its SQL on the smallest tables; the contract functions."""

import datetime
from pathlib import Path

import duckdb
import pytest

from voxtable.catalog import CATALOG, Tables

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = [
    "talk_report", "merge_asr_turns", "assign_words", "assign_phrases", "noise_threshold", "fuse_detectors", "language_vote",
    "infer_language", "keep_script", "read_analysis", "stratified_split", "label_ids", "best_epoch", "normalize_embeddings", "dialogue_speakers", "stream_log", "stream_windows",
    "stream_speech_sessions", "spoken_pieces", "analysis_log_roundtrip", "inference_log_roundtrip", "read_manifest_csv",
]


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return repr(float(v)) if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the given tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = CATALOG[name].build(Tables(spark, FOLDER))
    cols = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(cols).collect())
    cur = con.execute(CATALOG[name].sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    expected = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == expected
