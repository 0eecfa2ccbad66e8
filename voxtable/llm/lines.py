"""Line deduplication by a deletion-neighbourhood join: copies and lines within one edit go, the earliest stays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups_of, small_batches, texts, written

#: Lines shorter than this only go as exact copies; one edit in a short line makes another word of it.
NEAR_CHARS = 20
#: Blocks that a line is seen as; a block variant lacks one of them.
BLOCKS = 3
#: Block edges keep to a grid of this many characters a block, so that lines one character apart have the same edges.
STEP = 4
#: The edit bound. A line of n characters has n + 1 variants for one edit, and would have some n * n / 2 for two.
EDITS = 1

_draw = np.random.default_rng(11)
_BASE = [int(x) * 2 + 1 for x in _draw.integers(0, 1 << 63, 2, np.uint64)]
_BACK = [pow(b, -1, 1 << 64) for b in _BASE]
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    if len(_powers.get(base, ())) < n:
        steps = np.full(max(n, 1 << 21), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps)
    return _powers[base][:n]


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def spread(codes: np.ndarray) -> np.ndarray:
    codes = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return codes ^ (codes >> np.uint64(31))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


class Polynomials:
    """Hashes of any parts of a text from running sums, under one of two bases: the part's characters with rising powers."""

    def __init__(self, codes: np.ndarray, which: int):
        self.back = powers(_BACK[which], len(codes) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers(_BASE[which], len(codes)), dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


def edges(length: np.ndarray) -> np.ndarray:
    """The block size of lines of a length."""
    return length // (BLOCKS * STEP) * STEP


class Scan:
    """The lines of some texts that have a character besides white space, with their hashes of 128 bits."""

    def __init__(self, some: list[str]):
        raw = codes_of("\n".join(some))
        ends = np.append(np.flatnonzero(raw == 10), len(raw))
        starts = np.append(0, ends[:-1] + 1)
        ink = np.concatenate([[0], np.cumsum((raw != 32) & ((raw < 9) | (raw > 13)))])
        per_text = np.array([t.count("\n") + 1 for t in some])
        self.text = np.repeat(np.arange(len(some)), per_text)
        self.line_no = np.arange(len(ends)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        seen = ink[ends] > ink[starts]
        self.text, self.line_no, self.start, self.end = self.text[seen], self.line_no[seen], starts[seen], ends[seen]
        codes = spread(raw)
        self.polynomials = [Polynomials(codes, 0), Polynomials(codes, 1)]
        size = (self.end - self.start).astype(np.uint64)
        self.hashes = [mixed(p.of(self.start, self.end) + size).view(np.int64) for p in self.polynomials]

    def block_variants(self) -> dict[str, np.ndarray]:
        """key, where, row and n of every line of NEAR_CHARS or more without each of its blocks, for its own block edges
        and, at a step of the grid, those of a line one shorter. ``where`` is twice the block, plus one for the latter.

        Blocks left of the missing one are cut from the line's start, those right of it from its end, so the lines of a
        pair within one edit agree on a variant: that without the block the edit lies in.
        """
        length = self.end - self.start
        near = np.flatnonzero(length >= NEAR_CHARS)
        both = np.concatenate([near, near[length[near] % (BLOCKS * STEP) == 0]])
        shift = np.repeat([0, 1], [len(near), len(both) - len(near)])
        size, start, end = edges(length[both] - shift), self.start[both], self.end[both]
        keys = []
        for j in range(BLOCKS):
            left = self.polynomials[0].of(start, start + j * size)
            right = self.polynomials[1].of(end - (BLOCKS - 1 - j) * size, end)
            keys.append(mixed(mixed(left + (size * BLOCKS + j).astype(np.uint64)) + right))
        where = np.concatenate([2 * j + shift for j in range(BLOCKS)])
        row = np.tile(both, BLOCKS)
        return {"key": np.concatenate(keys).view(np.int64), "where": where, "row": row, "n": length[row]}


def _batch(**columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))


def _lines(batches) -> Iterator[pa.RecordBatch]:
    for ids, rows, some in groups_of(batches, ["doc_id", "row", "text"], 1 << 20):
        s = Scan(some)
        of = pa.array(s.text)
        yield _batch(doc_id=pa.array(ids, pa.int64()).take(of), row=pa.array(rows, pa.int64()).take(of), line_no=s.line_no.astype(np.int32), h1=s.hashes[0], h2=s.hashes[1])


def _blocks(batches) -> Iterator[pa.RecordBatch]:
    for (some,) in groups_of(batches, ["text"], 1 << 20):
        s = Scan(some)
        v = s.block_variants()
        yield _batch(key=v["key"], where=v["where"].astype(np.int32), n=v["n"].astype(np.int32), h1=s.hashes[0][v["row"]], h2=s.hashes[1][v["row"]])


def lines_of(rows: DataFrame) -> DataFrame:
    """Each line with a character that isn't white space: doc_id, row, line_no (of all lines, from 0) and a hash of 128 bits."""
    return rows.select("doc_id", "row", "text").mapInArrow(_lines, "doc_id long, row long, line_no int, h1 long, h2 long")


def span(length: int, where: int) -> tuple[int, int]:
    """First and past-the-last character of the block that a block variant lacks."""
    size = int(edges(np.array(length - where % 2)))
    return where // 2 * size, length - (BLOCKS - 1 - where // 2) * size


def deletion_variants(line: str, same: list[int], longer: list[int], shorter: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys and roles of the line's variants: itself if it may be the shorter of a pair (role 0), it without each character
    of the blocks ``longer`` (1), and without each of the blocks ``same``, with the character's place (2).

    Without character p the terms of the line's polynomial after it lose one power, so all come from the running sums.
    """
    n = len(line)
    poly = Polynomials(spread(codes_of(line)), 0)
    one = np.array([n])

    def without(wheres: list[int]) -> tuple[np.ndarray, np.ndarray]:
        at = np.unique(np.concatenate([np.arange(*span(n, w)) for w in wheres])) if wheres else np.zeros(0, np.int64)
        return at, poly.sums[at] + np.uint64(_BACK[0]) * (poly.sums[n] - poly.sums[at + 1])

    (_, drop), (at, swap) = without(longer), without(same)
    whole = poly.sums[one] if shorter else np.zeros(0, np.uint64)
    keys = np.concatenate([mixed(whole), mixed(drop), mixed(mixed(swap) + at.astype(np.uint64) + np.uint64(1))])
    return keys.view(np.int64), np.repeat(np.array([0, 1, 2], np.int8), [len(whole), len(drop), len(swap)])


def _emit(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for h1, h2, same, longer, shorter, line in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "same", "longer", "shorter", "line")), strict=True):
            key, role = deletion_variants(line, same, longer, shorter)
            for a in range(0, len(key), 1 << 16):
                k = key[a : a + (1 << 16)]
                yield _batch(v=k, role=role[a : a + (1 << 16)], h1=np.full(len(k), h1), h2=np.full(len(k), h2))


def _matching(batches) -> Iterator[pa.RecordBatch]:
    """Rows whose line has the hashes it was looked up by; another row with the same doc_id may have another text."""
    for batch in batches:
        kept = []
        for h1, h2, line in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "line")), strict=True):
            s = Scan([line or ""])
            kept.append(len(s.text) == 1 and (h1, h2) == (s.hashes[0][0], s.hashes[1][0]))
        yield batch.filter(pa.array(kept, pa.bool_()))


def near_lines(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """h1, h2 of each distinct line that an earlier one is within one edit of, with the place of the earliest such line.

    ``rows`` are doc_id, row and text. ``firsts`` holds every distinct line's first place (h1, h2, at). Only lines that share a block variant with another
    one of the same length, or of a length one off, can have a neighbour; only they get deletion variants, and only in the
    blocks concerned. Equal variants with the same place are neighbours of each other (one character replaced), and of a
    line that equals a longer one's variant (one removed). So the earliest of a group is all that a member has to be
    verified against, and no pairs are listed.
    """
    blocks = rows.select("text").mapInArrow(_blocks, "key long, where int, n int, h1 long, h2 long")
    shared = written(blocks.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("key"), "shared")
    hits = written(blocks.join(shared, "key").distinct(), "hits")

    # by the shorter length of a pair: are there two lines of it, and a line of it besides a longer one?
    sides = hits.select("key", "h1", "h2", "n", "where", F.explode(F.array(F.lit(0), F.lit(1))).alias("over")).withColumn("m", F.col("n") - F.col("over"))
    short = F.when(F.col("over") == 0, F.col("h1"))
    groups = sides.groupBy("key", "m").agg(F.min(short).alias("a"), F.max(short).alias("b"), F.max("over").alias("longer"))
    told = sides.join(groups, ["key", "m"]).where("a IS NOT NULL")
    is_short, pair = F.col("over") == 0, F.col("a") != F.col("b")
    wanted = told.groupBy("h1", "h2").agg(
        F.collect_set(F.when(is_short & pair, F.col("where"))).alias("same"),
        F.collect_set(F.when(~is_short, F.col("where"))).alias("longer"),
        F.max(is_short & (F.col("longer") == 1)).alias("shorter"),
    ).where("size(same) > 0 OR size(longer) > 0 OR shorter")
    wanted = wanted.join(firsts, ["h1", "h2"]).select("h1", "h2", "same", "longer", "shorter", "at.doc_id", "at.row", "at.line_no")
    by_doc = written(wanted, "wanted").groupBy(F.col("doc_id").alias("__doc"), F.col("row").alias("__row")).agg(
        F.collect_set(F.struct("line_no", "h1", "h2", "same", "longer", "shorter", F.struct("doc_id", "row", "line_no").alias("at"))).alias("of")
    )
    # always by shuffle: a switch to broadcasting a small side would hide what larger inputs move
    full = rows.join(by_doc.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("row") == F.col("__row")))
    full = full.select(F.split("text", "\n").alias("all"), F.explode("of").alias("x")).select("x.*", F.get("all", "x.line_no").alias("line"))
    full = written(full.mapInArrow(_matching, full.schema).dropDuplicates(["h1", "h2"]), "lines")

    variants = written(full.mapInArrow(_emit, "v long, role byte, h1 long, h2 long"), "variants")
    twice = variants.groupBy("v").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("v")
    met = written(variants.join(twice, "v").join(full.select("h1", "h2", "at"), ["h1", "h2"]), "met")
    me = F.struct("at", "h1", "h2")
    first = lambda role: F.min(F.when(F.col("role") == role, me)).alias(f"first{role}")
    other = F.when(F.col("role") == 0, F.col("first1")).when(F.col("role") == 1, F.col("first0")).otherwise(F.col("first2"))
    near = met.join(met.groupBy("v").agg(first(0), first(1), first(2)), "v").withColumn("other", other)
    near = near.where(F.col("other.at") < F.col("at")).select("h1", "h2", "other").distinct()
    mine, theirs = full.select("h1", "h2", "line"), full.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("line").alias("other_line"))
    both = near.withColumns({"o1": F.col("other.h1"), "o2": F.col("other.h2")}).join(mine, ["h1", "h2"]).join(theirs, ["o1", "o2"])
    close = both.where(F.levenshtein("line", "other_line", EDITS).between(0, EDITS))
    return close.groupBy("h1", "h2").agg(F.min("other.at").alias("near"))


def judge_lines(rows: DataFrame) -> DataFrame:
    """One row for each line that isn't blank of ``rows`` (doc_id, row, text): its place, copy, near, kept and earliest.

    A place is (doc_id, row, line_no), in that order and null first; the rest is as in :func:`deduplicate_lines`.
    """
    small_batches(rows.sparkSession)
    place = F.struct("doc_id", "row", "line_no")
    every = written(lines_of(rows), "every")
    firsts = written(every.groupBy("h1", "h2").agg(F.min(place).alias("at")), "firsts")
    verdicts = firsts.join(near_lines(rows, firsts), ["h1", "h2"], "left")
    out = every.join(verdicts, ["h1", "h2"])
    copy, near = ~place.eqNullSafe(F.col("at")), F.col("near").isNotNull()
    return out.select(
        "doc_id", "row", "line_no", copy.alias("copy"), near.alias("near"), (~copy & ~near).alias("kept"), F.least("at", F.coalesce("near", "at")).alias("earliest")
    )


def deduplicate_lines(docs: DataFrame) -> DataFrame:
    """One row for each line that isn't blank: doc_id, line_no, copy, near, kept and earliest (doc_id, line_no).

    Lines are in the order of doc_id (null first), then line_no. ``copy``: an equal line comes before. ``near``: the line's
    first occurrence has an earlier line within one edit of one character, both of at least ``NEAR_CHARS`` characters.
    ``kept``: neither. ``earliest`` is the first equal line, or an earlier one within the bound. A null or empty text has
    no lines; rows that repeat a doc_id and a line count as one place; an empty table gives no row; other columns are
    ignored.
    """
    out = judge_lines(texts(docs).withColumn("row", F.lit(0).cast("long")))
    return out.select("doc_id", "line_no", "copy", "near", "kept", F.struct("earliest.doc_id", "earliest.line_no").alias("earliest"))


def remove_lines(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, without the lines that repeat an earlier one up to one edit.

    Each row is a document of its own, whatever its doc_id: lines are in the order of doc_id (null first), then of the row
    in the table, then line_no, and judged as in :func:`deduplicate_lines`. Blank lines stay. A row of which every line
    with a character goes is a copy as a whole and goes; one that had no such line stays as it is.
    """
    # numbered once and written, as the numbers must be the same wherever the rows are read again
    docs = written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    lines = judge_lines(texts(docs, docs["__row"].alias("row")))
    gone = lines.groupBy(F.col("row").alias("__of")).agg(F.count("*").alias("__n"), F.collect_list(F.when(~F.col("kept"), F.col("line_no"))).alias("__gone"))
    joined = docs.join(gone.where(F.size("__gone") > 0), F.col("__row") == F.col("__of"), "left")
    rest = F.array_join(F.filter(F.split(docs["text"], "\n"), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    text = F.when(F.col("__gone").isNull(), docs["text"]).otherwise(rest).alias("text")
    kept = joined.where(F.col("__gone").isNull() | (F.size("__gone") < F.col("__n")))
    return kept.select(*(text if c == "text" else docs[c] for c in docs.columns if c != "__row"))
