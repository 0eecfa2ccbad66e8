"""Column functions on sample and score arrays: one frame, vector or logit row per cell; whole waveforms are blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sum_of(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x.cast("double"))


def rms(samples, floor: float = 1e-12) -> Column:
    s = _c(samples)
    energy = sum_of(F.transform(s, lambda x: x.cast("double") * x.cast("double")))
    return F.sqrt(energy / F.size(s) + F.lit(floor))


def pad_or_crop(vector, n: int) -> Column:
    """Exactly ``n`` values: the centre of a longer vector, or the vector and its minimum repeated."""
    v = _c(vector)
    size = F.size(v)
    cut = F.slice(v, (F.floor((size - n) / 2) + 1).cast("int"), F.lit(n))
    padded = F.concat(v, F.array_repeat(F.array_min(v), F.greatest(F.lit(n) - size, F.lit(0))))
    return F.when(size >= n, cut).otherwise(padded)


def standardize(vector) -> Column:
    """Mean 0 and sample standard deviation 1 (at least 1e-6)."""
    v = _c(vector)

    def scaled(mean: Column) -> Column:
        squares = sum_of(F.transform(v, lambda x: (x.cast("double") - mean) * (x.cast("double") - mean)))
        spread = F.greatest(F.sqrt(squares / (F.size(v) - 1)), F.lit(1e-6))
        return let(spread, lambda d: F.transform(v, lambda x: (x.cast("double") - mean) / d))

    return let(sum_of(v) / F.size(v), scaled)


def softmax(logits) -> Column:
    v = _c(logits)
    exps = let(
        F.array_max(v).cast("double"),
        lambda top: F.transform(v, lambda x: F.exp(x.cast("double") - top)),
    )
    return let(
        exps,
        lambda es: let(sum_of(es), lambda total: F.transform(es, lambda e: F.round(e / total, 4))),
    )


def dot(a, b) -> Column:
    return sum_of(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def unit(vector) -> Column:
    v = _c(vector)
    return let(F.sqrt(dot(v, v)), lambda norm: F.transform(v, lambda x: x.cast("double") / norm))


def cosine_distance(a, b) -> Column:
    """One minus the dot product of two unit vectors, clipped to [-1, 1]."""
    return F.lit(1.0) - F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(a, b)))
