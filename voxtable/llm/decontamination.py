"""Benchmark decontamination: exact hits of pieces, verified by bit-parallel edit distance."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts, written

LEAKS = "array<struct<item_id: long, distance: int, start: long>>"
#: Characters of items that one pass over the documents looks for; larger sets take more passes.
BLOCK_CHARS = 1_000_000
#: Items under this length are matched only by a document that is nothing else; inside texts they mean nothing.
SHORT = 20


def normal(text: str) -> str:
    """Lower case, white space runs as one space."""
    return " ".join(text.lower().split())


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors`` + 1 pieces of nearly equal length with their offsets; a match with so many edits leaves one untouched."""
    n = errors + 1
    edges = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


class Pattern:
    """Myers' bit-parallel search: the best place of an item in a text, by edits, in one pass over the text."""

    def __init__(self, item: str):
        self.length, self.masks = len(item), defaultdict(int)
        for i, c in enumerate(item):
            self.masks[c] |= 1 << i
        self.masks = dict(self.masks)

    def best(self, text: str) -> tuple[int, int]:
        """Least edits between the item and any part of the text, and the end of the first such part."""
        m = self.length
        full, top = (1 << m) - 1, 1 << (m - 1)
        plus, minus, score = full, 0, m
        best, end = m, 0
        get = self.masks.get
        for i, c in enumerate(text):
            eq = get(c, 0)
            down = eq | minus
            cross = (((eq & plus) + plus) ^ plus) | eq
            hp = minus | (full & ~(cross | plus))
            hm = plus & cross
            if hp & top:
                score += 1
            elif hm & top:
                score -= 1
            hp = (hp << 1) & full
            hm = (hm << 1) & full
            plus = hm | (full & ~(down | hp))
            minus = hp & down
            if score < best:
                best, end = score, i + 1
        return best, end


class Item:
    """An item cut into pieces, and a binary tree over them: a node of p pieces may hold p - 1 edits.

    If the whole keeps its budget, then some piece is intact and every node above it keeps its own, as two children that
    both break theirs would break their parent's. So a hit is followed upwards, and given up at the first broken node.
    At the first node the other child is cut into budget + 1 parts, one of which must be there as it is; that is cheap.
    """

    def __init__(self, text: str, error_rate: float):
        self.length, self.errors = len(text), int(error_rate * len(text))
        self.pieces = pieces(text, self.errors)
        self.whole = Pattern(text)
        self.above: list[list[tuple[int, int, Pattern]]] = [[] for _ in self.pieces]
        self.beside: list[list[str]] = [[] for _ in self.pieces]
        todo = [(0, len(self.pieces))]
        while todo:
            a, b = todo.pop()
            begin, end = self.pieces[a][0], self.pieces[b - 1][0] + len(self.pieces[b - 1][1])
            if 1 < b - a < len(self.pieces):
                node = (begin, b - a - 1, Pattern(text[begin:end]))
                for i in range(a, b):
                    self.above[i].insert(0, node)
            if b - a > 1:
                mid = (a + b) // 2
                todo += [(a, mid), (mid, b)]
                cut = self.pieces[mid][0]
                if mid - a == 1:
                    self.beside[a] = [x for _, x in pieces(text[cut:end], b - a - 1)]
                if b - mid == 1:
                    self.beside[mid] = [x for _, x in pieces(text[begin:cut], b - a - 1)]

    def holds(self, text: str, piece: int, at: int) -> bool:
        """Whether the nodes above a piece found at ``at``, but for the whole, keep their budgets."""
        own = self.pieces[piece][0]
        if self.above[piece]:
            begin, budget, pattern = self.above[piece][0]
            start = at - own + begin
            near = text[max(0, start - budget) : start + pattern.length + budget]
            if not any(x in near for x in self.beside[piece]):
                return False
        for begin, budget, pattern in self.above[piece]:
            start = at - own + begin
            if pattern.best(text[max(0, start - budget) : start + pattern.length + budget])[0] > budget:
                return False
        return True


class Finder:
    """All items of a block, by any keys, and an automaton over their pieces."""

    def __init__(self, items: Iterable[tuple[int, str]], error_rate: float):
        import ahocorasick

        self.items: dict[int, Item] = {}
        self.equal, at, self.automaton = defaultdict(list), defaultdict(list), ahocorasick.Automaton()
        for item, text in items:
            if len(text) < SHORT:
                self.equal[text].append(item)
                continue
            self.items[item] = Item(text, error_rate)
            for i, (_, piece) in enumerate(self.items[item].pieces):
                at[piece].append((item, i))
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def leaks(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item, edits, start about there) for every item within its error budget somewhere in the text."""
        for item in self.equal.get(text, ()):
            yield item, 0, 0
        found = defaultdict(list)
        if self.items:
            for last, (size, places) in self.automaton.iter(text):
                for item, piece in places:
                    if self.items[item].holds(text, piece, last + 1 - size):
                        found[item].append(last + 1 - size - self.items[item].pieces[piece][0])
        for item, starts in found.items():
            own = self.items[item]
            starts.sort()
            best, at = (own.errors + 1, 0), 0
            while at < len(starts) and best[0]:
                begin, end = max(0, starts[at] - own.errors), starts[at] + own.length + own.errors
                while at < len(starts) and starts[at] - own.errors <= end:
                    end = starts[at] + own.length + own.errors
                    at += 1
                edits, stop = own.whole.best(text[begin:end])
                best = min(best, (edits, max(0, begin + stop - own.length)))
            if best[0] <= own.errors:
                yield item, *best


def _normal_items(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, some = (batch.column(c).to_pylist() for c in ("item_id", "text"))
        rows = [(item, normal(text)) for item, text in zip(ids, some, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.string())], ["item_id", "text"])


def leaks_in(items: DataFrame, error_rate: float = 0.1) -> Callable[[Column], Column]:
    """A column function from text (null: empty) to the items (item_id, distance, start) that it holds, as an array.

    Each distinct pair of an id, which may be null, and a text without case and white space is an item of its own: two texts
    under one id are both looked for, and ids of one text are all reported. Null or empty items are in nothing.
    """
    spark = items.sparkSession
    small_batches(spark)
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    wanted = written(wanted.mapInArrow(_normal_items, "item_id long, text string").where("text <> ''").distinct(), "items")
    total = wanted.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_CHARS))
    searches = []
    for block in range(blocks):
        ids = defaultdict(list)
        for r in wanted.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect():
            ids[r["text"]].append(r["item_id"])
        searches.append(_search(spark.sparkContext.broadcast(dict(ids)), error_rate))

    def column(text: Column) -> Column:
        found = [search(text.cast("string")) for search in searches]
        return F.concat(*found) if len(found) > 1 else found[0]

    return column


def _search(sent, error_rate: float):
    @F.pandas_udf(LEAKS)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids = list(sent.value.values())
        finder = Finder(enumerate(sent.value), error_rate)
        for some in batches:
            found = [[(item, *place) for k, *place in finder.leaks(normal(text or "")) for item in ids[k]] for text in some]
            yield pd.Series([[dict(zip(("item_id", "distance", "start"), x, strict=True)) for x in row] for row in found], dtype=object)

    return search


def find_leaks(docs: DataFrame, items: DataFrame, error_rate: float = 0.1) -> DataFrame:
    """Pairs of a document and an item of ``items`` (item_id, text) that it holds within the item's error budget.

    Both texts are compared in lower case with white space squashed; the budget is ``error_rate`` times the item's
    length, in edits of one character. Returns doc_id, item_id, distance (the least edits) and start (about where, in
    the squashed text). Null or empty texts hold nothing, null or empty items are in nothing; repeated documents give
    repeated pairs; of equal items with one id, or with none, one counts, while unequal ones that share an id give a pair
    each; an item under ``SHORT`` characters is held by a document that equals it. Other columns are ignored. Items are
    looked for block by block, each of a bounded size.
    """
    found = texts(docs).select("doc_id", leaks_in(items, error_rate)(F.col("text")).alias("leaks"))
    return found.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*")


def decontamination_report(docs: DataFrame, items: DataFrame, error_rate: float = 0.1) -> DataFrame:
    """One row for each row of ``docs``, judged by its own text whatever its doc_id.

    Returns doc_id, n_items it holds, the nearest item_id and its distance (null: none), kept (none held). At the same
    distance the smallest item_id is the nearest, and one that is null comes last.
    """
    found = texts(docs).select("doc_id", leaks_in(items, error_rate)(F.col("text")).alias("leaks"))
    order = F.transform("leaks", lambda x: F.struct(x["distance"].alias("distance"), x["item_id"].isNull().alias("without"), x["item_id"].alias("item_id")))
    out = found.select("doc_id", F.size("leaks").cast("long").alias("n_items"), F.array_min(order).alias("nearest"))
    return out.select("doc_id", "n_items", "nearest.item_id", "nearest.distance", (F.col("n_items") == 0).alias("kept"))


def decontaminate(docs: DataFrame, items: DataFrame, error_rate: float = 0.1) -> DataFrame:
    """The documents, with all their columns, that hold no item; each row is judged by its own text, whatever its doc_id."""
    small_batches(docs.sparkSession)
    return docs.where(F.size(leaks_in(items, error_rate)(docs["text"])) == 0)
