"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import linear
from .common import draw_texts, groups_of, small_batches, written

ORDERS, BITS = (3, 4, 5), 18


@dataclass
class ToxicityModel:
    """Scaled log-count ratios and the classifier on them."""

    ratios: np.ndarray
    softmax: linear.Softmax


def _features(text: str, ratios: np.ndarray) -> linear.Sparse:
    """Presence of each n-gram times its ratio; n-grams that tell nothing are left out."""
    ids = linear.ngram_counts(text, ORDERS, BITS)[0]
    values = ratios[ids]
    told = np.flatnonzero(values)
    return ids[told], values[told]


def log_count_ratios(rows: DataFrame, smoothing: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Log ratios of the share of toxic and of other texts with each n-gram, from all rows; and the texts of each class."""

    def count(batches):
        df, n = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
        for labels, some in groups_of(batches, ["toxic", "text"], 1 << 20):
            for y, text in zip(labels, some, strict=True):
                df[y, linear.ngram_counts(text, ORDERS, BITS)[0]] += 1
                n[y] += 1
        found = np.flatnonzero(df.any(axis=0))
        cols = [pa.array(np.append(found, -1)), *(pa.array(np.append(df[y, found], n[y])) for y in (0, 1))]
        yield pa.RecordBatch.from_arrays(cols, ["feature", "n0", "n1"])

    sums = rows.select("toxic", "text").mapInArrow(count, "feature long, n0 long, n1 long")
    got = sums.groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()  # one row a feature
    df = np.zeros((2, (1 << BITS) + 1), np.int64)
    df[:, got["feature"].to_numpy()] = got[["n0", "n1"]].to_numpy().T
    n, df = df[:, -1], df[:, :-1]
    share = (df + smoothing) / (n[:, None] + 2 * smoothing)
    ratios = np.log(share[1] / share[0])
    ratios[df.sum(axis=0) < 3] = 0.0
    return (ratios / max(1e-9, np.abs(ratios).max())).astype(np.float32), n


def train_toxicity_model(labelled: DataFrame, max_rows: int = 8000, epochs: int = 4) -> ToxicityModel:
    """Learn from ``text`` (null: empty) and ``toxic`` (0 or 1) of ``labelled``; rows with another label are left out.

    The ratios count all rows. The classifier is fitted on at most about ``max_rows`` distinct pairs of text and label,
    drawn by hash of the text and evenly from both classes; its bias is then moved to the classes' true shares of all rows.
    With one class or none, every text gets score 0 (or 1, where all labels are 1).
    """
    small_batches(labelled.sparkSession)
    rows = labelled.select(F.col("toxic").cast("int").alias("toxic"), F.coalesce("text", F.lit("")).alias("text")).where("toxic IN (0, 1)")
    rows = written(rows, "labelled")  # read three times, and most often made by a join of all texts
    ratios, n = log_count_ratios(rows)
    if not n.all():
        bias = np.array([0.0, 50.0 if n[1] else -50.0])
        return ToxicityModel(np.zeros_like(ratios), linear.Softmax(np.zeros((1 << BITS, 2), np.float32), bias))
    sample, sizes, shares = draw_texts(rows, "toxic", 23, max_rows)
    drawn = np.array([shares[y] * sizes[y] / n[y] for y in (0, 1)])

    def train(batches):
        got = [r for b in batches for r in zip(b.column("drawn").to_pylist(), b.column("toxic").to_pylist(), b.column("text").to_pylist(), strict=True)]
        data = [(_features(text, ratios), y) for _, y, text in sorted(got)]
        model = linear.fit(data, 1 << BITS, 2, epochs, rate=0.1, l1=0.05, l2=0.05)
        cols = [pa.array([x.tobytes()], pa.binary()) for x in (model.weights, model.bias)]
        yield pa.RecordBatch.from_arrays(cols, ["weights", "bias"])

    got = sample.repartition(1).mapInArrow(train, "weights binary, bias binary").first()
    bias = np.frombuffer(got["bias"]) - np.log(drawn)
    return ToxicityModel(ratios, linear.Softmax(np.frombuffer(got["weights"], np.float32).reshape(1 << BITS, 2), bias))


def toxicity(spark, model: ToxicityModel):
    """A column function from text (null: empty) to the probability that it is toxic."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        m = sent.value
        out = [m.softmax.probabilities(_features(t or "", m.ratios))[1] for t in text]
        return pd.Series(out, dtype="float64").clip(0.0, 1.0)

    def column(text: Column) -> Column:
        return score(text.cast("string"))

    return column


def labelled_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and toxic of the documents with a label; where labels repeat a document, the larger one counts."""
    marks = labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").alias("toxic")).where("toxic IS NOT NULL")
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # always by shuffle: a switch to broadcasting small labels would hide what larger inputs move
    return docs.select("doc_id", "text").join(marks.hint("merge"), "doc_id")


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score and predicted (1 from score 0.5), one row for each row of ``docs``.

    A null text is scored as the empty one; repeated rows and rows with a null doc_id are each scored; an empty table
    gives none; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    scored = docs.select(docs["doc_id"].alias("doc_id"), toxicity(docs.sparkSession, model)(docs["text"]).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
