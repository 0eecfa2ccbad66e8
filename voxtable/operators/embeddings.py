"""Speaker embeddings: normalisation, clustering per recording, quality of a split."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.signal import cosine_distance, dot, unit
from .islands import ID, number_speakers
from .ordered import attach, by_position, carry, durable, number, spread

PITCH_DIMS, PITCH_WEIGHT, FULL_DIMS = 3, 3.0, 43
#: Embeddings, or cluster features, that one task clusters; and blocks whose features make up the next block.
MOST_ROWS, FAN_IN = 2048, 8


def normalize_embeddings(emb: DataFrame, vec: str = "vec") -> DataFrame:
    """Z-scores per dimension within the recording, pitch dimensions weighted, then unit length.

    Means and deviations are plain aggregates over (recording, dimension), so a long
    recording is summed up in parallel; per recording they form one short array.
    """
    values = emb.select(ID, F.posexplode(vec).alias("d", "x"))
    x = F.col("x").cast("double")
    stats = values.groupBy(ID, "d").agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"))
    stats = stats.groupBy(ID).agg(F.array_sort(F.collect_list(F.struct("d", "mean", "sd"))).alias("__stats"))
    joined = attach(emb, stats)
    size = F.size(vec)
    weight = lambda i: F.when((size >= FULL_DIMS) & (i >= size - PITCH_DIMS), F.lit(PITCH_WEIGHT)).otherwise(F.lit(1.0))
    z = F.transform(
        F.arrays_zip(F.col(vec).alias("x"), F.col("__stats").alias("s")),
        lambda p, i: (p["x"].cast("double") - p["s"]["mean"]) / (p["s"]["sd"] + 1e-6) * weight(i),
    )
    scaled = let(
        z, lambda v: let(F.sqrt(dot(v, v)) + 1e-8, lambda norm: F.transform(v, lambda y: y / norm))
    )
    return joined.withColumn(vec, scaled).drop("__stats")


def split_quality(labeled: DataFrame, strict: Column | bool | None = False, vec: str = "vec") -> DataFrame:
    """How good a speaker labelling is: silhouette, minority share, distance at switches.

    The mean cosine distance of a point to a cluster follows from the cluster's vector
    sum and size, so no pairs of rows are formed.  ``accepted`` is the verdict for two
    speakers; ``strict`` uses the higher bar (None: a column of the rows, constant within a recording).
    """
    rows = labeled.select(ID, "pos", "label", unit(vec).alias("u"))
    sums = rows.select(ID, "label", F.posexplode("u").alias("d", "x")).groupBy(ID, "label", "d").agg(F.sum("x").alias("x"))
    sums = sums.groupBy(ID, "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("total"))
    sizes = rows.groupBy(ID, "label").agg(F.count("*").alias("n"))
    clusters = attach(sums, sizes, (ID, "label")).groupBy(ID).agg(
        F.collect_list(F.struct("label", "n", "total")).alias("clusters"),
        (F.min("n") / F.sum("n")).alias("minority"),
        F.sum("n").alias("n_rows"),
    )
    own = F.filter("clusters", lambda c: c["label"] == F.col("label"))[0]
    others = F.filter("clusters", lambda c: c["label"] != F.col("label"))

    def silhouette(me: Column) -> Column:
        inner = (me["n"] - dot("u", me["total"])) / (me["n"] - 1)
        outer = F.array_min(F.transform(others, lambda c: F.lit(1.0) - dot("u", c["total"]) / c["n"]))
        score = let(
            F.struct(inner.alias("a"), outer.alias("b")),
            lambda x: (x["b"] - x["a"]) / F.nullif(F.greatest(x["a"], x["b"]), F.lit(0.0)),
        )
        return F.when(me["n"] > 1, F.coalesce(score, F.lit(0.0))).otherwise(F.lit(0.0))

    scored = attach(rows, clusters).withColumn("s", let(own, silhouette))
    marked = carry(scored, by_position(), {"prev": ("lag", F.struct("label", "u"))})
    step = F.when(F.col("prev.label") != F.col("label"), cosine_distance("u", F.col("prev.u")))
    out = marked.withColumn("step", step).groupBy(ID).agg(
        F.avg("s").alias("silhouette"), F.max("minority").alias("minority"), F.coalesce(F.avg("step"), F.lit(0.0)).alias("switch_distance"),
        F.max(F.size("clusters")).alias("n_labels"),
    )
    if strict is None:
        out, strict = attach(out, labeled.groupBy(ID).agg(F.max("strict").alias("strict"))), F.col("strict")
    hard = strict if isinstance(strict, Column) else F.lit(strict)
    bar = lambda a, b: F.when(hard, F.lit(a)).otherwise(F.lit(b))
    accepted = (
        (F.col("n_labels") >= 2)
        & (F.col("silhouette") >= bar(0.28, 0.08))
        & (F.col("minority") >= bar(0.32, 0.08))
        & (F.col("switch_distance") >= bar(0.35, 0.15))
    )
    sil = F.when(F.col("n_labels") >= 2, F.col("silhouette"))
    return out.select(ID, sil.alias("silhouette"), "minority", "switch_distance", accepted.alias("accepted"))


def average_linkage(sums: np.ndarray, sizes: np.ndarray) -> list[tuple[float, int, int]]:
    """Merges (distance, a, b) of average-linkage clustering under cosine distance.

    The mean distance of two clusters is one minus the product of their mean unit
    vectors, so vector sums and sizes are all the state: memory grows with the rows,
    not with their pairs.  Chains of nearest neighbours find the merges.
    """
    sums, sizes = sums.copy(), sizes.astype(float).copy()
    alive = np.ones(len(sizes), dtype=bool)
    merges: list[tuple[float, int, int]] = []
    chain: list[int] = []
    for _ in range(len(sizes) - 1):
        while True:
            if not chain:
                chain.append(int(np.argmax(alive)))
            tip = chain[-1]
            far = 1.0 - (sums @ sums[tip]) / (sizes * sizes[tip])
            far[~alive] = np.inf
            far[tip] = np.inf
            near = int(np.argmin(far))
            if len(chain) > 1 and far[chain[-2]] <= far[near]:
                near = chain[-2]
                break
            chain.append(near)
        chain = chain[:-2]
        a, b = min(tip, near), max(tip, near)
        merges.append((float(far[near]), a, b))
        sums[a] += sums[b]
        sizes[a] += sizes[b]
        alive[b] = False
        sums[b] = 0.0
    return sorted(merges, key=lambda m: m[0])


def cut_tree(n: int, merges: list[tuple[float, int, int]]) -> np.ndarray:
    """Cluster of each row after the given merges."""
    parent = np.arange(n)
    for _, a, b in merges:
        while parent[a] != a:
            a = parent[a]
        while parent[b] != b:
            b = parent[b]
        parent[max(a, b)] = min(a, b)
    while not np.array_equal(parent, parent[parent]):
        parent = parent[parent]
    return parent


def _quality(x: np.ndarray, w: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Silhouette (cosine) and minority share, from cluster sums."""
    names, idx = np.unique(labels, return_inverse=True)
    if len(names) < 2:
        return -1.0, float(len(names) == 1)
    hot = np.zeros((len(names), len(x)))
    hot[idx, np.arange(len(x))] = w
    sizes = hot.sum(axis=1)
    mean = 1.0 - (x @ (hot @ x).T) / sizes
    rows = np.arange(len(x))
    own = sizes[idx]
    inner = mean[rows, idx] * own / np.maximum(own - 1, 1)
    mean[rows, idx] = np.inf
    outer = mean.min(axis=1)
    top = np.maximum(inner, outer)
    s = np.where((own > 1) & (top > 0), (outer - inner) / np.where(top > 0, top, 1), 0.0)
    return float(np.average(s, weights=w)), float(sizes.min() / sizes.sum())


def _points(vec: pd.Series, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct vector sums, in order of appearance, with their weights; and each row's place among them.

    Exact copies merge at distance zero, so they can start as one weighted point.
    """
    x = np.stack(vec.to_numpy()).astype(float)
    directions = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    _, first, back = np.unique(directions, axis=0, return_index=True, return_inverse=True)
    back = first.argsort().argsort()[back.reshape(-1)]
    sums = np.zeros((len(first), x.shape[1]))
    np.add.at(sums, back, x)
    return sums, np.bincount(back, weight, len(first)), back


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _cuts(sums: np.ndarray, weight: np.ndarray, max_speakers: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Clusters of the points under the distance limit, at most ``max_speakers``; and the last two clusters."""
    m, merges = len(weight), average_linkage(sums, weight)
    labels = cut_tree(m, [g for g in merges if g[0] < limit])
    if len(set(labels)) > max_speakers:
        labels = cut_tree(m, merges[: max(m - max_speakers, 0)])
    return labels, cut_tree(m, merges[: max(m - 2, 0)])


def _decide(pdf: pd.DataFrame, max_speakers: int, threshold: float, gate: bool) -> np.ndarray:
    """Labels of one recording's rows."""
    x = _unit(np.stack(pdf["vec"].to_numpy()).astype(float))
    n = len(x)
    strict = bool(pdf["strict"].iloc[0])
    if n == 1 or max_speakers < 2:
        return np.zeros(n, dtype=int)
    points, weight, back = _points(pd.Series(list(x)), np.ones(n))
    labels, two = (c[back] for c in _cuts(points, weight, max_speakers, max(threshold, 0.55) if strict and gate else threshold))
    if not gate:
        return labels
    ones = np.ones(n)
    if n >= (6 if strict else 4) and len(points) >= 2:
        sil, minority = _quality(x, ones, two)
        turn = np.flatnonzero(two[1:] != two[:-1])
        jump = 1.0 - np.clip(np.einsum("ij,ij->i", x[turn + 1], x[turn]), -1, 1)
        far = float(jump.mean()) if len(jump) else 0.0
        bar = (0.28, 0.32, 0.35) if strict else (0.08, 0.08, 0.15)
        if sil >= bar[0] and minority >= bar[1] and far >= bar[2]:
            return two
    if len(set(labels)) < 2:
        return np.zeros(n, dtype=int)
    sil, minority = _quality(x, ones, labels)
    bar = (0.22, 0.30) if strict else (0.06, 0.06)
    return np.zeros(n, dtype=int) if sil < bar[0] or minority < bar[1] else labels


def _cluster(emb: DataFrame, max_speakers: int, threshold: float, strict, gate: bool, vec: str, bound: int) -> DataFrame:
    hard = strict if isinstance(strict, Column) else F.lit(bool(strict))
    rows = emb.select(ID, "pos", F.transform(vec, lambda v: v.cast("double")).alias("vec"), hard.alias("strict"))
    sized = attach(rows, rows.groupBy(ID).agg(F.count("*").alias("__n")))
    kind = rows.schema[ID].dataType.simpleString()

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", ignore_index=True)
        labels = _decide(pdf, max_speakers, threshold, gate)
        return pd.DataFrame({ID: pdf[ID], "pos": pdf["pos"], "label": labels.astype("int64")})

    # few bytes, but much work a byte: left to its size, all of it would go into one task
    small = spread(sized.filter(F.col("__n") <= bound).drop("__n"), ID).groupBy(ID).applyInPandas(label, f"{ID} {kind}, pos bigint, label bigint")
    longest = rows.groupBy(ID).count().agg(F.max("count")).first()[0] or 0
    if longest <= bound:
        return small
    large = durable(sized.filter(F.col("__n") > bound).drop("__n"))
    return small.unionByName(_cluster_large(large, max_speakers, threshold, gate, bound, longest))


def _cluster_large(rows: DataFrame, max_speakers: int, threshold: float, gate: bool, bound: int, longest: int) -> DataFrame:
    """Labels of recordings with more than ``bound`` rows, by cluster features in a tree.

    A feature is a vector sum and the number of its rows. The rows of a recording are numbered and cut into blocks of
    ``bound``; a block is reduced to at most an eighth as many features, equal directions first, then the nearest by
    average linkage. Eight blocks' features make the next block, until a recording has one. Average linkage on that
    gives the candidate clusters, and labels go back down the tree by joins. Silhouette, minority share and distance at
    switches are those of the rows themselves, computed from vector sums. No group has more than ``bound`` rows.
    """
    kind, target = rows.schema[ID].dataType.simpleString(), bound // FAN_IN
    numbered = number(rows.withColumn("u", unit("vec")).drop("vec"), by_position(chunk_rows=bound), "__nth")
    lowest = numbered.select(ID, F.floor((F.col("__nth") - 1) / bound).alias("block"), F.col("pos").alias("id"), F.col("u").alias("sum"), F.lit(1.0).alias("n"), "strict")
    schema = f"{ID} {kind}, block bigint, id bigint, feature bigint, sum array<double>, n double, strict boolean"

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        sums, weight, back = _points(pdf["sum"], pdf["n"].to_numpy())
        if len(weight) > target:
            group = np.unique(cut_tree(len(weight), average_linkage(sums, weight)[: len(weight) - target]), return_inverse=True)[1].reshape(-1)
            merged = np.zeros((group.max() + 1, sums.shape[1]))
            np.add.at(merged, group, sums)
            sums, weight, back = merged, np.bincount(group, weight), group[back]
        # first what feature each row goes into, then the features
        n, m = len(back), len(weight)
        out = {"id": pd.array([*pdf["id"], *[None] * m], "Int64"), "feature": [*back, *range(m)], "sum": [*[None] * n, *sums], "n": [*[0.0] * n, *weight]}
        return pd.DataFrame({ID: pdf[ID].iloc[0], "block": pdf["block"].iloc[0], **out, "strict": pdf["strict"].iloc[0]})

    levels, level, blocks = [], lowest, -(-longest // bound)
    while True:
        done = durable(level.groupBy(ID, "block").applyInPandas(reduce, schema))
        levels.append(done.filter("id is not null").select(ID, "block", "id", "feature"))
        # ids of features are unique within the next block: eight blocks, each of at most ``target`` features
        above = done.filter("id is null").select(
            ID, F.floor(F.col("block") / FAN_IN).alias("block"), (F.pmod("block", F.lit(FAN_IN)) * target + F.col("feature")).alias("id"), "sum", "n", "strict"
        )
        if blocks <= FAN_IN:
            break
        level, blocks = above, -(-blocks // FAN_IN)

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        sums, weight, back = _points(pdf["sum"], pdf["n"].to_numpy())
        limit = max(threshold, 0.55) if bool(pdf["strict"].iloc[0]) and gate else threshold
        labels, two = (c[back].astype("int64") for c in _cuts(sums, weight, max_speakers, limit))
        return pd.DataFrame({ID: pdf[ID], "block": pdf["block"], "id": pdf["id"], "label": labels, "two": two})

    named = above.groupBy(ID, "block").applyInPandas(decide, f"{ID} {kind}, block bigint, id bigint, label bigint, two bigint")
    for level in reversed(levels):
        below = level.withColumns({"__id": F.pmod("block", F.lit(FAN_IN)) * target + F.col("feature"), "__up": F.floor(F.col("block") / FAN_IN)})
        up = named.select(ID, F.col("block").alias("__up"), F.col("id").alias("__id"), "label", "two")
        named = attach(below, up, (ID, "__up", "__id")).select(ID, "block", "id", "label", "two")
    named = named.select(ID, F.col("id").alias("pos"), "label", "two")
    if not gate:
        return named.drop("two")
    named = durable(attach(rows, named, (ID, "pos")))
    bars = F.when(F.col("strict"), F.struct(F.lit(0.22).alias("sil"), F.lit(0.30).alias("share"))).otherwise(F.struct(F.lit(0.06).alias("sil"), F.lit(0.06).alias("share")))
    hard = named.groupBy(ID).agg(F.max("strict").alias("strict"))
    pair = split_quality(named.select(ID, "pos", "vec", F.col("two").alias("label"), "strict"), None).select(ID, F.col("accepted").alias("__two"))
    some = attach(split_quality(named.select(ID, "pos", "vec", "label", "strict"), None), hard)
    fine = (F.col("silhouette") >= bars["sil"]) & (F.col("minority") >= bars["share"])
    verdict = attach(some.select(ID, F.coalesce(fine, F.lit(False)).alias("__fine")), pair)
    chosen = F.when(F.col("__two"), F.col("two")).when(F.col("__fine"), F.col("label")).otherwise(F.lit(0))
    return attach(named, verdict).select(ID, "pos", chosen.cast("long").alias("label"))


def cluster_speakers(
    emb: DataFrame, max_speakers: int = 6, threshold: float = 0.35, strict: Column | bool = False, vec: str = "vec", bound: int = MOST_ROWS
) -> DataFrame:
    """Speaker labels per recording by average-linkage cosine clustering with quality gates.

    Recordings of at most ``bound`` embeddings are clustered each in one task, with memory linear in their number; longer
    ones in two levels, see :func:`_cluster_large`. As long as an eighth of ``bound`` directions differ in a block, both
    give the same clusters; beyond that the nearest ones count as one.
    """
    return _cluster(emb, max_speakers, threshold, strict, True, vec, bound)


def cluster_windows(emb: DataFrame, max_speakers: int = 6, threshold: float = 0.55, vec: str = "vec", bound: int = MOST_ROWS) -> DataFrame:
    """The plain variant: distance threshold, at most ``max_speakers``, no gates."""
    return _cluster(emb, max_speakers, threshold, False, False, vec, bound)


def cluster_global(emb: DataFrame, k: int, seed: int = 7, vec: str = "vec") -> DataFrame:
    """Voices across all recordings: bisecting k-means under cosine distance."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    rows = emb.withColumn("features", array_to_vector(F.transform(vec, lambda v: v.cast("double"))))
    model = BisectingKMeans(k=k, seed=seed, distanceMeasure="cosine", featuresCol="features").fit(rows)
    return model.transform(rows).withColumn("voice", F.col("prediction").cast("long")).drop("features", "prediction")


def label_speakers(
    region_emb: DataFrame, window_emb: DataFrame, max_speakers: int = 6, threshold: float = 0.35,
    strict: Column | None = None,
) -> DataFrame:
    """Speaker segments from region embeddings where a recording has three usable regions, else from windows.

    Both inputs have ``recording_id, pos, start_sec, end_sec, vec``; ``strict`` is a
    per-recording column of both (false if not given).  Vectors are normalised
    within what is used.
    """
    hard = F.lit(False) if strict is None else strict
    usable = region_emb.withColumn("strict", hard)
    usable = usable.filter(
        F.col("end_sec") - F.col("start_sec") >= F.when(F.col("strict"), F.lit(0.4)).otherwise(F.lit(0.2))
    )
    enough = usable.groupBy(ID).agg(F.count("*").alias("__n")).filter("__n >= 3").select(ID)
    enough = enough.withColumn("__enough", F.lit(True))
    regions = attach(usable, enough).filter("__enough")
    windows = attach(window_emb.withColumn("strict", hard), enough).filter("__enough is null")
    cols = [ID, "pos", "start_sec", "end_sec", "vec", "strict"]
    used = durable(normalize_embeddings(regions.select(cols).unionByName(windows.select(cols))))
    labels = cluster_speakers(used, max_speakers, threshold, F.col("strict"))
    named = attach(used.select(ID, "pos", "start_sec", "end_sec"), labels, (ID, "pos"), "inner")
    named = durable(named.withColumn("speaker", F.col("label").cast("string")))
    return number_speakers(named, ("pos",)).select(ID, "pos", "speaker", "start_sec", "end_sec")
