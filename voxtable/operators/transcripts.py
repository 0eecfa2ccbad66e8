"""Transcript operators that need more than one expression."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_before_phrases, keep_script, phrases_once, split_sentences, squash_space
from ..functions.text import collapse_ngrams as in_row_ngrams


def collapse_ngrams(df: DataFrame, text: str = "text", longest: int = 8, min_count: int = 3, out: str | None = None) -> DataFrame:
    """Keep only the first of over-repeated word n-grams; each text inside its row."""
    return df.withColumn(out or text, in_row_ngrams(text, longest, min_count))


def collapse_phrases(df: DataFrame, text: str = "text") -> DataFrame:
    """Phrases said twice or more in a row are kept once; see :func:`~voxtable.functions.text.collapse_phrase_repeats`.

    A step of its own, as Spark cannot take a Python function out of an expression whose arguments bind names in names.
    """

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text)
            kept = pa.array(phrases_once(b.column(at).to_pylist()), b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at), kept)

    return df.mapInArrow(once, df.schema)


def clean_transcript(df: DataFrame, text: str = "text") -> DataFrame:
    """Full cleaning: stutters, word, sentence and phrase loops, then n-gram loops."""
    before = df.withColumn(text, clean_before_phrases(text))
    return collapse_ngrams(collapse_phrases(before, text), text).withColumn(text, squash_space(text))


def filter_script_mismatch(df: DataFrame, text: str = "text", language: str = "lang") -> DataFrame:
    """Clean, then blank texts that are clearly not in their language."""
    return clean_transcript(df, text).withColumn(text, keep_script(F.col(text), F.col(language)))


def sentences(df: DataFrame, key: str = "recording_id", text: str = "text") -> DataFrame:
    """One row per sentence with its position."""
    return df.select(key, F.posexplode(split_sentences(text)).alias("pos", "text"))
