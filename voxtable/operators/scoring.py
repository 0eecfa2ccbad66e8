"""Batched scoring with a user's model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def score_batches(
    df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str
) -> DataFrame:
    """Score rows in Arrow batches.

    ``load`` runs once per task in the worker and returns the function that scores a
    batch, so a model is read once and never shipped with each batch.  The batch size
    is ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for batch in batches:
            yield predict(batch)

    return df.mapInPandas(run, schema)


def linear_scorer(weights: np.ndarray, id_: str, vec: str) -> Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]:
    """A loader for a linear model: best class and its score per row."""

    def load() -> Callable[[pd.DataFrame], pd.DataFrame]:
        def predict(batch: pd.DataFrame) -> pd.DataFrame:
            logits = np.stack(batch[vec].to_numpy()).astype(float) @ weights
            return pd.DataFrame({id_: batch[id_], "best": logits.argmax(axis=1), "score": logits.max(axis=1)})

        return predict

    return load
