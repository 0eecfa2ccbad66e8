"""Near-duplicate documents by min-max hashing of word shingles, links confirmed on the full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups_of, small_batches, texts, written
from .components import components, files
from .lm import Hashes, tokens

WORDS = 5
#: Hash evaluations per shingle; each gives a minimum and a maximum, so a signature has twice as many values.
HASHES = 96
#: Values per band: the minima and the maxima of three evaluations. With 32 bands a pair of similarity 0.85 shares none
#: with probability (1 - 0.85 ** 6) ** 32, under 3e-7.
ROWS = 6
BANDS = 2 * HASHES // ROWS
#: Documents of one bucket compared with each other at a time.
BLOCK = 128
#: Below the wanted similarity by this much on the 192 values (over 4 standard errors), a pair isn't confirmed on its sets.
MARGIN = 0.12

_draw = np.random.default_rng(20)
_TIMES = _draw.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _draw.integers(0, 1 << 63, HASHES, np.uint64)
_hashes = Hashes()


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * seed)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """Distinct hashes of the text's five-word shingles, sorted; of fewer words, one hash of them all; of none, none."""
    words = tokens(text)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = min(WORDS, len(h))
    if not n:
        return h
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
        out ^= out >> np.uint64(29)
    return np.unique(mixed(out, 0))


def signature(found: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the set under each hash: rows of (minimum, maximum) by evaluation."""
    low, high = np.full(HASHES, 0xFFFFFFFF, np.uint64), np.zeros(HASHES, np.uint64)
    for at in range(0, len(found), 2048):
        v = (found[at : at + 2048, None] * _TIMES + _PLUS) >> np.uint64(32)
        low, high = np.minimum(low, v.min(axis=0)), np.maximum(high, v.max(axis=0))
    return np.stack([low, high], axis=1)


def bands(values: np.ndarray) -> np.ndarray:
    """One key for each band, of its number and its values."""
    rows = values.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k], 1)
    return key.view(np.int64)


def same_set(found: np.ndarray) -> tuple[int, int]:
    """Two sums of the set's elements; sets of one size with both equal are taken as equal."""
    return tuple(int(mixed(found, s).sum(dtype=np.uint64).view(np.int64)) for s in (2, 3))


def _described(batches) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
    for ids, some in groups_of(batches, ["doc_id", "text"], 1 << 21):
        rows = []
        for doc, text in zip(ids, some, strict=True):
            found = shingles(text)
            rows.append((doc, len(found), *same_set(found), bands(signature(found)) if len(found) else None))
        cols = [pa.array(list(v), k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "set1", "set2", "keys"])


def _sets(batches) -> Iterator[pa.RecordBatch]:
    for ids, some in groups_of(batches, ["doc_id", "text"], 1 << 21):
        data = [shingles(t).tobytes() for t in some]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary())], ["node", "found"])


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return bool(len(a) and 100 * common >= percent * (len(a) + len(b) - common))


def _confirmed(percent: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c) for c in ("a", "b", "found_a", "found_b")]
            keep = [linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(*cols[2:], strict=True)]
            yield pa.RecordBatch.from_arrays(cols[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _within(percent: int):
    """Links across components among the documents of one block, or between two blocks, of a bucket."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", kind="stable").reset_index(drop=True)
        sets = [np.frombuffer(x, np.uint64) for x in rows["found"]]
        drawn = np.stack([signature(x).reshape(-1).astype(np.uint32) for x in sets])
        group, out = rows["component"].to_numpy().copy(), []
        for i in range(len(sets)):
            near = (drawn[i + 1 :] == drawn[i]).mean(axis=1)
            for j in i + 1 + np.flatnonzero(near >= percent / 100 - MARGIN):
                if group[i] != group[j] and linked(sets[i], sets[j], percent):
                    out.append((rows["node"][i], rows["node"][j]))
                    group[group == group[j]] = group[i]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row: documents linked at 100 * |A and B| >= percent * |A or B|.

    Words are split at ASCII white space with A-Z in lower case; a set holds the distinct five-word shingles, or all words
    as one where there are fewer. component_id is the smallest doc_id that links reach, kept marks the row that has it. A
    null text or one without words has no set, is linked with nothing and kept. Rows that repeat a doc_id are one
    document, linked if any of their texts is. A row with a null doc_id is kept. An empty table gives none; other columns
    are ignored.

    Equal sets become one class first. A class's 32 band keys lead to buckets; in each bucket all are compared with one
    centre, the member that shares most with others, so groups of near copies need one comparison a member. Members of
    a bucket that are then still in different components are compared in blocks. All links are confirmed on full sets.
    """
    small_batches(docs.sparkSession)
    plain = texts(docs)
    kinds = "doc_id long, n_shingles long, set1 long, set2 long, keys array<long>"
    table = written(plain.mapInArrow(_described, kinds), "shingled")
    same = ["n_shingles", "set1", "set2"]
    classes = table.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*same).agg(F.min("doc_id").alias("node"), F.any_value("keys").alias("keys"))
    classes = written(classes, "classes")

    rows = classes.select("node", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    buckets = written(rows.join(shared, "key"), "buckets")
    n = files(buckets.count())  # a row of a bucket gives one link at most
    found = buckets.distinct()
    weight = found.groupBy("node").agg(F.sum("size").alias("weight"))
    best = found.join(weight, "node").groupBy("key").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("centre"))
    pairs = found.join(best, "key").where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()

    wanted = found.select(F.col("node").alias("doc_id")).distinct()
    # texts and sets always by shuffle: a switch to broadcasting a small side would hide what larger inputs move
    sets = written(plain.join(wanted.hint("merge"), "doc_id", "left_semi").mapInArrow(_sets, "node long, found binary"), "sets")
    left = sets.select(F.col("node").alias("a"), F.col("found").alias("found_a"))
    right = sets.select(F.col("node").alias("b"), F.col("found").alias("found_b"))
    links = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").mapInArrow(_confirmed(percent), "a long, b long")
    links = written(links.repartition(n), "links")  # the sets keep all tasks busy, the links fill few files
    label = components(links)

    placed = found.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed_ = placed.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who")
    )
    once = mixed_.where("low <> high").groupBy("members", "who").agg(F.min("key").alias("key")).select("key", "members")
    blocks = F.ceil(F.col("members") / BLOCK).cast("long")
    open_ = placed.join(once, "key").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("blocks")))
    open_ = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    open_ = open_.select("key", "node", "component", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    more = open_.join(sets.hint("merge"), "node").groupBy("key", "one", "two").applyInPandas(_within(percent), "a long, b long")
    more = written(more.repartition(n), "links")
    if not more.isEmpty():
        label = components(links.unionByName(more))

    reached = classes.join(label, "node", "left").select(*same, F.coalesce("component", "node").alias("reached"))
    out = table.drop("keys").join(reached, same, "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("reached", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents, with all their columns, one of each group of near duplicates.

    Each row is a document of its own, judged by its own text, whatever its doc_id. Of a group the row with the smallest
    doc_id stays (null last; ties: the least hash of the text, then the first row of the table), so rows without a doc_id
    and rows that share one are copies like others. Rows without words stay; an empty table gives an empty table.
    """
    # numbered once and written, as the numbers must be the same wherever the rows are read again
    docs = written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    order = F.struct(docs["doc_id"].isNull(), docs["doc_id"].cast("long"), F.xxhash64(docs["text"]), docs["__row"].alias("row"))
    found = near_duplicates(docs.select(docs["__row"].alias("doc_id"), docs["text"]), percent).select(F.col("doc_id").alias("__of"), "component_id")
    placed = found.join(docs.select(F.col("__row").alias("__of"), order.alias("order")), "__of")
    stays = placed.groupBy("component_id").agg(F.min("order").alias("first")).select(F.col("first.row").alias("__first"))
    return docs.join(stays, docs["__row"] == stays["__first"], "left_semi").drop("__row")
