"""Spelling variants: words one edit apart, found by bit-parallel recurrences over a bit-sliced index of the vocabulary."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, groups_of, small_batches, texts, written

#: Letters of a word; all have one byte in Latin-1.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Words of a group that one bitset index holds; larger groups are compared block by block.
BLOCK = 1 << 15
#: Pairs of a word and 64 words of its group that are worked on at once.
AT_ONCE = 1 << 19
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)

_TO_LOWER = str.maketrans(UPPER, LOWER)


def dropped_letter(doc_id: int | None, run: str, every: int) -> str:
    """The run without one letter where the CRC-32 of `doc_id:run` is a multiple of ``every``; a null doc_id is written as nothing."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if every and h % every == 0:
        at = h % len(run)
        return run[:at] + run[at + 1 :]
    return run


def count_words(docs: DataFrame, shortest: int = 7, least: int = 2, every: int = 0) -> DataFrame:
    """word and n: the lower-cased (A-Z) letter runs of all texts with at least ``shortest`` letters and ``least`` occurrences.

    With ``every`` the runs are damaged first, see ``dropped_letter``. A null or empty text has no runs, repeated rows count
    again, an empty table has no words; other columns are ignored. Each task counts before the shuffle, so a word that holds
    a third of all runs is a few rows; a task's table of counts is passed on whenever it holds 2^18 words or 16 MB.
    """
    small_batches(docs.sparkSession)

    def count(batches) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        chars = 0
        for ids, some in groups_of(batches, ["doc_id", "text"], 1 << 20):
            for doc, text in zip(ids, some, strict=True):
                for run, n in Counter(RUN.findall(text.translate(_TO_LOWER))).items():
                    word = dropped_letter(doc, run, every)
                    if len(word) >= shortest:
                        chars += len(word) * (word not in held)
                        held[word] += n
            if len(held) >= 1 << 18 or chars >= 1 << 24:
                yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.int64())], ["word", "n"])
                held, chars = Counter(), 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    counted = texts(docs).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _halves(shortest: int) -> Column:
    """Keys under which a word meets every word one edit away: m, the shorter word's length; a side; that half of m letters."""
    n = F.char_length("word")
    keys = []
    for m, there in ((n, F.lit(True)), (n - 1, n > shortest)):
        first = F.floor(m / 2).cast("int")
        rest = (m - F.floor(m / 2)).cast("int")
        for side, half in ((0, F.substring(F.col("word"), F.lit(1), first)), (1, F.right(F.col("word"), rest))):
            keys.append(F.when(there, F.struct(m.cast("int").alias("m"), F.lit(side).alias("side"), half.alias("half"))))
    return F.array_compact(F.array(*keys))


def near_words(words: DataFrame, shortest: int = 7, block: int = BLOCK) -> DataFrame:
    """word, n_near, best_n and best: for each word with words exactly one inserted, deleted or replaced letter away their
    number, and the most frequent of them (ties: the least in code-point order).

    ``words`` has distinct words of at least ``shortest`` letters, all below U+0100, with their counts n. One edit leaves one
    half of the letters as it is, so two words of m and m or m + 1 letters meet in the group of their common first or last
    half. A group's words, most frequent first, are the bits of the index: for every position and letter a bitset of the words
    that have it there. A word is run over its group once, 64 words at a time, and only counts leave the task, never pairs.
    Groups of more than ``block`` words are split by hash, and each block's words are run over the index of each block.
    """
    keyed = words.select("word", "n", F.explode(_halves(shortest)).alias("k")).select("word", "n", "k.*")
    group = ["m", "side", "half"]
    sizes = keyed.groupBy(*group).count().where(F.col("count") > block).select(*group, F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    sized = keyed.join(sizes, group, "left").withColumn("own", F.pmod(F.xxhash64("word"), F.coalesce("blocks", F.lit(1))).cast("int"))
    both = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("listed"), F.lit(True).alias("asked")))
    crossed = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda x: F.array(
                F.struct(F.col("own").alias("i"), x.alias("j"), F.lit(True).alias("listed"), (x == F.col("own")).alias("asked")),
                F.when(x != F.col("own"), F.struct(x.alias("i"), F.col("own").alias("j"), F.lit(False).alias("listed"), F.lit(True).alias("asked"))),
            ),
        )
    )
    dealt = sized.select("word", "n", *group, F.explode(F.when(F.col("blocks").isNull(), both).otherwise(F.array_compact(crossed))).alias("b"))
    dealt = dealt.select("word", "n", *group, "b.*").repartition(*group, "i", "j")
    ordered = dealt.sortWithinPartitions("m", "side", "half", "i", "j", F.desc("n"), "word")
    found = ordered.mapInArrow(_search, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.less")).alias("best_n"), "b.best")


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole groups of one m and side, about 2^15 words or 4 MB at a time; rows come sorted by group, the most frequent word first."""
    held: list[tuple] = []
    kind = last = None
    letters = 0

    def flush() -> Iterator[pa.RecordBatch]:
        if len(held) > 1:
            yield from _compare(held, *kind)

    for b in batches:
        rows = zip(*(b.column(c).to_pylist() for c in ("word", "n", "m", "side", "half", "i", "j", "listed", "asked")), strict=True)
        for word, n, m, side, half, i, j, listed, asked in rows:
            group = (m, side, half, i, j)
            if group != last and (kind != (m, side) or len(held) >= BLOCK or letters >= 1 << 22):
                yield from flush()
                held, kind, letters = [], (m, side), 0
            last = group
            held.append((word, n, group, listed, asked))
            letters += len(word)
    yield from flush()


def _compare(rows: list[tuple], m: int, side: int) -> Iterator[pa.RecordBatch]:
    """Run each asked word over the listed words of its group."""
    words, counts, groups, listed, asked = zip(*rows, strict=True)
    size = len(words)
    starts = np.array([0] + [r for r in range(1, size) if groups[r] != groups[r - 1]], np.int64)
    ends = np.append(starts[1:], size)
    if not (ends - starts > 1).any():
        return
    place = np.repeat(np.arange(len(starts)), ends - starts)
    letters = np.array([w.encode("latin-1") for w in words], f"S{m + 1}").view(np.uint8).reshape(size, m + 1)
    used = np.unique(letters)
    code = np.zeros(256, np.int64)
    code[used] = np.arange(len(used))
    lanes = -(-size // 64)
    row = np.arange(size)
    lane, bit = row // 64, np.uint64(1) << (row % 64).astype(np.uint64)
    long = letters[:, m] != 0

    def bits(chosen: np.ndarray) -> np.ndarray:
        out = np.zeros(lanes, np.uint64)
        np.add.at(out, lane[chosen], bit[chosen])
        return out

    index = np.array(listed)
    short_words, long_words = bits(index & ~long), bits(index & long)

    def sliced(position: int) -> np.ndarray:
        """Bitsets of the words by lane and letter at a position, counted from 0."""
        out = np.zeros(lanes * len(used), np.uint64)
        if 0 <= position <= m:
            np.add.at(out, lane * len(used) + code[letters[:, position]], bit)
        return out

    ask = row[np.array(asked) & (ends - starts > 1)[place]]
    width = (ends[place[ask]] - 1) // 64 - starts[place[ask]] // 64 + 1
    done, results = 0, []
    upto = np.cumsum(width)
    while done < len(ask):
        stop = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + AT_ONCE, "right")))
        some, wide = ask[done:stop], width[done:stop]
        done = stop
        who = np.repeat(some, wide)
        step = np.arange(len(who)) - np.repeat(np.cumsum(wide) - wide, wide)
        at = starts[place[who]] // 64 + step
        low = np.maximum(starts[place[who]] - at * 64, 0).astype(np.uint64)
        high = np.minimum(ends[place[who]] - at * 64, 64).astype(np.uint64)
        inside = (ALL << low) & (ALL >> (np.uint64(64) - high))
        near = _one_edit(code[letters[who]], at * len(used), inside, long[who], short_words[at], long_words[at], sliced, side)
        hit = np.flatnonzero(near)
        if len(hit):
            near, who, at = near[hit], who[hit], at[hit]
            number = np.bitwise_count(near).astype(np.int64)
            first = at * 64 + np.bitwise_count((near & (~near + np.uint64(1))) - np.uint64(1)).astype(np.int64)
            begin = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
            results.append((who[begin], np.add.reduceat(number, begin), first[begin]))
    if results:
        who, number, first = (np.concatenate(x) for x in zip(*results, strict=True))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([words[r] for r in who]), pa.array(number, pa.int64()),
                pa.array([counts[r] for r in first], pa.int64()), pa.array([words[r] for r in first]),
            ],
            ["word", "n_near", "best_n", "best"],
        )


def _one_edit(asked, base, inside, long, short_words, long_words, sliced, side: int) -> np.ndarray:
    """Bitsets of the words one edit from each asked word, the recurrences over all of them at once, letter by letter.

    ``same`` holds the words that agree so far; ``changed``, ``longer`` and ``lacking`` those with one letter replaced, one
    more (read one position ahead) or one less (one behind). Asked words of m letters look for m and m + 1 letters, those
    of m + 1 for m. On side 1 words with the same first half are left out: they were found on side 0.
    """
    m = asked.shape[1] - 1
    none = np.zeros(len(base), np.uint64)
    same, changed, longer, lacking = inside.copy(), none.copy(), none.copy(), none.copy()
    before, here = none, sliced(0)
    first_half = inside
    for i in range(m):
        ahead = sliced(i + 1)
        to = base + asked[:, i]
        has = here[to]
        longer = (longer | same) & ahead[to]
        lacking = (lacking & before[to] if i else lacking) | same
        changed = (changed & has) | (same & ~has)
        same = same & has
        before, here = here, ahead
        if i + 1 == m // 2:
            first_half = same
    to = base + asked[:, m]
    lacking = (lacking & before[to]) | same
    near = np.where(long, lacking & short_words, (changed & short_words) | ((longer | same) & long_words))
    return near & ~first_half if side else near


def spelling_variants(words: DataFrame, shortest: int = 7, factor: int = 10, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near and form_n for each of the distinct ``words`` (word, n).

    A word's form is the most frequent word one edit away if it is at least ``factor`` times as frequent, else null; its root
    is where following forms ends. Counts grow by ``factor`` with each form, so doubling the steps a few times reaches every
    root. ``words`` is read several times: pass a written table.
    """
    near = near_words(words, shortest, block)
    formed = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *(F.when(F.col("best_n") >= factor * F.col("n"), F.col(c)).alias(to) for c, to in (("best", "form"), ("best_n", "form_n")))
    )
    formed = written(formed, "forms")
    most = formed.agg(F.max("form_n")).first()[0]
    steps = formed.where("form is not null").select("word", F.col("form").alias("to"))
    for _ in range(math.ceil(math.log2(max(1.0, math.log(most, factor)))) if most else 0):
        on = steps.select(F.col("word").alias("to"), F.col("to").alias("next"))
        steps = steps.join(on, "to", "left").select("word", F.coalesce("next", "to").alias("to"))
    return formed.join(steps, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")
