"""Language identification by sparse multinomial regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import linear
from .common import draw_texts, groups_of, small_batches

ORDERS, BITS = (1, 2, 3), 16


@dataclass
class LanguageModel:
    """Languages in order, inverse document frequencies and the calibrated classifier."""

    languages: list[str]
    idf: np.ndarray
    softmax: linear.Softmax


def _features(text: str, idf: np.ndarray) -> linear.Sparse:
    ids, counts = linear.ngram_counts(text, ORDERS, BITS)
    values = (1.0 + np.log(counts)) * idf[ids]
    norm = np.sqrt(values @ values)
    return ids, values / norm if norm else values


def document_frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts, and in how many of them each hashed n-gram occurs; over all rows."""

    def count(batches):
        df, n = np.zeros(1 << BITS, np.int64), 0
        for (some,) in groups_of(batches, ["text"], 1 << 20):
            for text in some:
                df[linear.ngram_counts(text, ORDERS, BITS)[0]] += 1
            n += len(some)
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(df[found], n))], ["feature", "n"])

    sums = rows.select("text").mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    got = sums.toPandas()  # at most one row for each of the 2 ** BITS features
    out = np.zeros((1 << BITS) + 1, np.int64)
    out[got["feature"].to_numpy()] = got["n"].to_numpy()
    return int(out[-1]), out[:-1]


def train_language_model(labelled: DataFrame, max_rows: int = 8000, epochs: int = 3) -> LanguageModel:
    """Learn from ``text`` and ``lang`` of ``labelled``; rows without either are left out.

    Document frequencies cover all rows. The classifier is fitted on at most about ``max_rows`` distinct pairs of text and
    language, the same number for each language as far as it has them, drawn by hash of the text; every fifth
    of a language calibrates the temperature. Without any labelled row there is no language, and every text gets ``und``. Long texts are
    used whole.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    n, df = document_frequencies(rows)
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    sample, sizes, _ = draw_texts(rows, "lang", 17, max_rows)
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], idf, linear.Softmax(np.zeros((1 << BITS, 1), np.float32), np.zeros(1)))
    where = {x: i for i, x in enumerate(languages)}

    def train(batches):
        got = [r for b in batches for r in zip(b.column("drawn").to_pylist(), b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True)]
        seen, data, held = Counter(), [], []
        for _, lang, text in sorted(got):
            seen[lang] += 1
            (data if seen[lang] % 5 else held).append((_features(text, idf), where[lang]))
        model = linear.fit(data, 1 << BITS, len(languages), epochs)
        heat = linear.calibrate(model, held)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias.tobytes()], pa.binary()), pa.array([heat])], ["weights", "bias", "heat"])

    got = sample.repartition(1).mapInArrow(train, "weights binary, bias binary, heat double").first()
    if got is None:
        return LanguageModel(languages, idf, linear.Softmax(np.zeros((1 << BITS, len(languages)), np.float32), np.zeros(len(languages))))
    weights = np.frombuffer(got["weights"], np.float32).reshape(1 << BITS, len(languages))
    return LanguageModel(languages, idf, linear.Softmax(weights, np.frombuffer(got["bias"]), got["heat"]))


def identify(spark, model: LanguageModel):
    """A column function from text to struct(lang_pred, score).

    A null text or one without a letter gives ``und`` with score 0, as does a model without languages. The score is the
    calibrated probability of the predicted language; of equal ones the first in alphabetical order wins.
    """
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        m, out = sent.value, []
        for t in text:
            if t is None or not m.languages or not any(map(str.isalpha, t)):
                out.append(("und", 0.0))
            else:
                p = m.softmax.probabilities(_features(t, m.idf))
                best = int(p.argmax())
                out.append((m.languages[best], float(min(1.0, p[best]))))
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    def column(text: Column) -> Column:
        return predict(text.cast("string"))

    return column


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score, one row for each row of ``docs``."""
    small_batches(docs.sparkSession)
    out = docs.select(docs["doc_id"].alias("doc_id"), identify(docs.sparkSession, model)(docs["text"]).alias("p"))
    return out.select("doc_id", "p.lang_pred", "p.score")
