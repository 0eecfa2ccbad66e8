"""Evaluate an expression once and use it many times inside another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed a single time.

    Lambda bodies are not subject to common-subexpression elimination, and nested
    column functions would otherwise repeat their argument's whole expression.
    """
    return F.transform(F.array(value), body)[0]
