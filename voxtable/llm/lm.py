"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, mapped into memory to score."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups_of, mounted, shared_folder, small_batches, texts

#: Tokens whose bigrams a task counts before it hands them on.
BLOCK_TOKENS = 4_000_000
#: Words whose hash a worker remembers.
KEPT_WORDS = 1 << 19
U64 = np.uint64


def word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


#: Hashes of the text's start (a context only) and of its end (a token only); neither is a word, as both hold a space.
START, END = word_hash(b" start"), word_hash(b" end")


class Hashes(dict):
    """Word hashes, forgotten when they are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        h = self[word] = word_hash(word)
        return h


_hashes = Hashes()


def tokens(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case; bytes.lower and bytes.split know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def token_hashes(some: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts: each token's context and the token, as hashes, and the number of tokens of each text."""
    flat: list[int] = []
    sizes = []
    for text in some:
        words = tokens(text)
        flat.extend(map(_hashes.__getitem__, words))
        flat.append(END)
        sizes.append(len(words) + 1)
    last = np.array(flat, U64)
    first = np.empty_like(last)
    first[1:] = last[:-1]
    n = np.array(sizes, np.int64)
    first[np.cumsum(n) - n] = START
    return first, last, n


def bigram_hash(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    h = first * U64(0x9E3779B97F4A7C15) + last
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts the keys, and where each distinct key begins in it."""
    order = np.argsort(keys)
    ranked = keys[order]
    return order, np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(keys) else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Grid:
    """How bigrams are dealt: rows by the first word, columns by the last, so that a frequent word is in a row or column of
    cells and never in one task alone; and words over the same number of parts by hash."""

    side: int

    def cell(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        n = U64(self.side)
        return ((first >> U64(40)) % n * n + (last >> U64(40)) % n).astype(np.int64)

    def part(self, word: np.ndarray) -> np.ndarray:
        return ((word >> U64(20)) % U64(self.side**2)).astype(np.int64)


def _save(folder: str, name: str, **arrays: np.ndarray) -> None:
    """Each array as one file, under its final name only when whole; a task that runs again writes the same bytes."""
    for key, array in arrays.items():
        path = f"{folder}/{name}.{key}.npy"
        own = f"{path}.{TaskContext.get().taskAttemptId()}.npy"
        np.save(own, array)
        os.replace(own, path)


@dataclass(frozen=True)
class Model:
    """Where the arrays are, how they are dealt, the totals and the discounts of both orders."""

    folder: str
    grid: Grid
    tokens: int
    vocabulary: int
    bigrams: int
    low: tuple[float, float, float]
    low_rest: float
    high: tuple[float, float, float]


def discounts(counts: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from how many items have counts 1 to 4.

    D_i = i - (i + 1) Y n_(i+1) / n_i with Y = n_1 / (n_1 + 2 n_2), kept within 0 and i; a D whose n_i is 0 is i / 2.
    """
    n1, n2, n3, n4 = (float(x) for x in counts)
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    pairs = ((1, n1, n2), (2, n2, n3), (3, n3, n4))
    d1, d2, d3 = (min(float(i), max(0.0, i - (i + 1) * y * b / a)) if a else i / 2 for i, a, b in pairs)
    return d1, d2, d3


def train(docs: DataFrame, side: int | None = None) -> Model:
    """Count the bigrams of all texts (null: empty) and write the model's arrays to the shared folder.

    A task counts its texts' bigrams and deals them, sorted, to the cells of a ``side`` x ``side`` grid; a cell's task adds
    them up, writes them as arrays sorted by hash and tells each word's figures there; those are added up by word, and
    written in the same way. Only totals and counts of counts come to the driver. By default the grid has twice as many
    cells as there are shuffle partitions. Repeated rows count as often as they occur; an empty table gives an empty model.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = mounted(shared_folder(spark, "lm"))
    os.makedirs(folder)
    grid = Grid(side or max(1, round((2 * int(spark.conf.get("spark.sql.shuffle.partitions"))) ** 0.5)))

    def count(batches) -> Iterator[pa.RecordBatch]:
        for (some,) in groups_of(batches, ["text"], 6 * BLOCK_TOKENS):
            first, last, _ = token_hashes(some)
            order, begin = _grouped(bigram_hash(first, last))
            n = np.diff(np.append(begin, len(order))).astype(np.uint32)
            first, last = first[order[begin]], last[order[begin]]
            cell = grid.cell(first, last)
            ranked = np.argsort((cell.astype(U64) << U64(44)) | (first >> U64(20)))
            first, last, n, cell = first[ranked], last[ranked], n[ranked], cell[ranked]
            edges = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
            for a, b in zip(edges, edges[1:], strict=False):
                row = (int(cell[a]), first[a:b].tobytes(), last[a:b].tobytes(), n[a:b].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["cell", "first", "last", "n"])

    def add(key, rows: pd.DataFrame) -> pd.DataFrame:
        first, last = (np.concatenate([np.frombuffer(x, U64) for x in rows[c]]) for c in ("first", "last"))
        n = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["n"]]).astype(np.int64)
        keys = bigram_hash(first, last)
        order, begin = _grouped(keys)
        n = np.add.reduceat(n[order], begin)
        first, last = first[order[begin]], last[order[begin]]
        _save(folder, f"bigrams-{key[0]}", hash=keys[order[begin]], n=n.astype(np.uint32 if n.max() < 1 << 32 else U64))
        tops = [int((n == i).sum()) for i in (1, 2, 3, 4)]
        out = []
        of, at = _grouped(first)
        n1, n2, n3 = (np.add.reduceat(x[of].astype(np.int64), at) for x in (n == 1, n == 2, n > 2))
        zero = np.zeros_like(n1)
        begun = (first[of[at]], n1, n2, n3, zero, zero)
        of, at = _grouped(last)
        ended, zero = np.diff(np.append(at, len(of))), np.zeros(len(at), np.int64)
        ends = (last[of[at]], zero, zero, zero, ended, np.add.reduceat(n[of], at))
        words = [np.concatenate(x) for x in zip(begun, ends, strict=True)]
        part = grid.part(words[0])
        ranked = np.argsort(part, kind="stable")
        edges = np.flatnonzero(np.r_[True, part[ranked][1:] != part[ranked][:-1], True])
        for a, b in zip(edges, edges[1:], strict=False):
            own = ranked[a:b]
            figures = np.stack([x[own].astype(np.int64) for x in words[1:]]).astype("<u4" if n.max() < 1 << 31 and len(n) < 1 << 31 else "<u8")
            out.append((int(part[own[0]]), words[0][own].tobytes(), figures.tobytes(), figures.itemsize, [0] * 4))
        out[0] = (*out[0][:4], tops)
        return pd.DataFrame(out, columns=["part", "word", "figures", "width", "tops"])

    def words(key, rows: pd.DataFrame) -> pd.DataFrame:
        word = np.concatenate([np.frombuffer(x, U64) for x in rows["word"]])
        figures = np.concatenate([np.frombuffer(x, f"<u{w}").reshape(5, -1) for x, w in zip(rows["figures"], rows["width"], strict=True)], axis=1)
        order, begin = _grouped(word)
        figures = np.add.reduceat(figures[:, order].astype(np.int64), begin, axis=1)
        _save(folder, f"words-{key[0]}", hash=word[order[begin]], figures=figures)
        ended, times = figures[3], figures[4]
        low = [int((ended == i).sum()) for i in (1, 2, 3, 4)]
        high = np.array(rows["tops"].tolist()).sum(axis=0).tolist()
        return pd.DataFrame([(int(times.sum()), int((times > 0).sum()), int(ended.sum()), low, high)], columns=["tokens", "vocabulary", "bigrams", "low", "high"])

    cells = texts(docs).select("text").mapInArrow(count, "cell long, first binary, last binary, n binary").groupBy("cell")
    shares = cells.applyInPandas(add, "part long, word binary, figures binary, width int, tops array<long>").groupBy("part")
    sums = shares.applyInPandas(words, "tokens long, vocabulary long, bigrams long, low array<long>, high array<long>")
    got = sums.agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "vocabulary", "bigrams")),
        *(F.coalesce(F.sum(F.col(c)[i]), F.lit(0)).alias(f"{c}{i}") for c in ("low", "high") for i in range(4)),
    ).first()
    low, high = ([got[f"{c}{i}"] for i in range(4)] for c in ("low", "high"))
    d = discounts(low)
    freed = d[0] * low[0] + d[1] * low[1] + d[2] * (got["vocabulary"] - low[0] - low[1])
    return Model(folder, grid, got["tokens"], got["vocabulary"], got["bigrams"], d, freed / max(1, got["bigrams"]), discounts(high))


class Reader:
    """The model's arrays, mapped into memory; pages come from the shared folder as they are needed."""

    def __init__(self, model: Model):
        self.model, self.maps = model, {}

    def _map(self, name: str) -> np.ndarray | None:
        if name not in self.maps:
            path = f"{self.model.folder}/{name}.npy"
            self.maps[name] = np.load(path, mmap_mode="r") if os.path.exists(path) else None
        return self.maps[name]

    def _find(self, kind: str, part: np.ndarray, keys: np.ndarray, figures: str, width: int) -> np.ndarray:
        """Figures of each distinct key (zeros if unknown), one part of the arrays after the other."""
        out = np.zeros((width, len(keys)), np.int64)
        order = np.lexsort((keys, part))
        edges = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1], True]) if len(keys) else []
        for a, b in zip(edges, edges[1:], strict=False):
            own = order[a:b]
            have = self._map(f"{kind}-{part[own[0]]}.hash")
            if have is None:
                continue
            at = np.minimum(np.searchsorted(have, keys[own]), len(have) - 1)
            hit = have[at] == keys[own]
            out[:, own[hit]] = self._map(f"{kind}-{part[own[0]]}.{figures}")[..., at[hit]]
        return out

    def score(self, some: list[str]) -> dict[str, np.ndarray]:
        """Of each text: tokens, known tokens, base score and model score."""
        m = self.model
        first, last, n = token_hashes(some)
        word, back = np.unique(np.concatenate([first, last]), return_inverse=True)
        before, after = back[: len(first)], back[len(first) :]
        n1, n2, n3, ended, times = self._find("words", m.grid.part(word), word, "figures", 5)
        keys = bigram_hash(first, last)
        order, begin = _grouped(keys)
        pick = order[begin]
        counts = self._find("bigrams", m.grid.cell(first[pick], last[pick]), keys[pick], "n", 1)[0]
        c = np.empty(len(keys), np.int64)
        c[order] = np.repeat(counts, np.diff(np.append(begin, len(order))))

        def less(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
            return count - np.array([0.0, *d])[np.minimum(count, 3)]

        # the lower order: the word's share of the distinct bigrams; what discounting frees goes to all words and one unknown
        uniform = 1.0 / (m.vocabulary + 1)
        low = less(ended, m.low) / m.bigrams + m.low_rest * uniform if m.bigrams else np.full(len(word), uniform)
        # the higher order: a context's tokens are its occurrences, those of the start as many as of the end
        total = np.where(word == U64(START), times[word == U64(END)].sum(), times)[before]
        rest = (m.high[0] * n1 + m.high[1] * n2 + m.high[2] * n3)[before]
        p = low[after]
        p = np.where(total > 0, (less(c, m.high) + rest * p) / np.maximum(total, 1), p)
        base = np.log10((times + 1.0) / (m.tokens + m.vocabulary + 1.0))[after]
        at = np.cumsum(n) - n
        return {
            "n_tokens": n, "n_known": np.add.reduceat((times > 0)[after].astype(np.int64), at),
            "base_score": np.add.reduceat(base, at), "score": np.add.reduceat(np.log10(p), at),
        }


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every whole text, one row for each row of ``docs``.

    Scores are log10 probabilities: base_score of the add-one unigram model, score of the Kneser-Ney model. A null or
    empty text is the end token alone. Perplexity is 10 ** (-score / n_tokens).
    """
    small_batches(docs.sparkSession)

    def run(batches) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for ids, some in groups_of(batches, ["doc_id", "text"], 1 << 21):
            got = reader.score(some)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, got.values())], ["doc_id", *got])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
