"""Harmonic packing of documents into training sequences."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups_of, small_batches, texts, written
from .tokens import encoder

PIECE = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"
COLUMNS = [x.split()[0] for x in PIECE.split(", ")]
#: Partitions of left-over pieces that one task of the next round takes together.
FAN_IN = 32


def cuts(length: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: the largest capacity / k that fits, again and again, and a short end.

    A cut piece is an exact reciprocal share of a sequence, so that its class fills sequences with nearly no padding. Each
    cut leaves less than the square of its share; two to four pieces are usual.
    """
    out = []
    while length * 16 > capacity:
        k = -(-capacity // length) if length < capacity else 1
        out.append(capacity // k)
        length -= capacity // k
    return out + [length] if length else out


class Bins:
    """Open sequences by class: class k takes pieces of length over capacity / (k + 1) up to capacity / k, k to a sequence."""

    def __init__(self, capacity: int, level: int, partition: int):
        self.capacity, self.next, self.open = capacity, (level << 58) | (partition << 34), defaultdict(list)

    def add(self, length: int, row: tuple) -> list[tuple]:
        """The rows of a sequence, with their places, if this piece is the last one of it."""
        k = self.capacity // length
        held = self.open[k]
        held.append((length, row))
        return self.close(self.open.pop(k)) if len(held) == k else []

    def close(self, held: Iterable[tuple[int, tuple]]) -> list[tuple]:
        offset, out = 0, []
        for length, row in held:
            out.append((*row, self.next, offset))
            offset += length
        self.next += 1
        return out

    def rest(self) -> list[tuple[int, tuple]]:
        return [x for k in sorted(self.open) for x in self.open[k]]


def best_fit(pieces: list[tuple[int, tuple]], bins: Bins) -> list[tuple]:
    """First fit by falling length; for the bounded number of pieces left at the very end."""
    room: list[int] = []
    held: list[list] = []
    at = 0
    for length, row in sorted(pieces, key=lambda x: (-x[0], x[1][0] is not None, x[1][0] or 0, x[1][1])):
        while at < len(room) and room[at] == 0:
            at += 1
        i = next((i for i in range(at, len(room)) if room[i] >= length), None)
        if i is None:
            room.append(bins.capacity)
            held.append([])
            i = len(room) - 1
        room[i] -= length
        held[i].append((length, row))
    return [row for x in held for row in bins.close(x)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary() if c == "ids" else pa.int64() for c in COLUMNS]
    return pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], COLUMNS)


def _in_batches(rows: Iterator[tuple], size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[4]) + 64
        if n > size:
            yield _batch(held)
            held, n = [], 0
    if held:
        yield _batch(held)


def pack(docs: DataFrame, tokenizer: str, end: int, capacity: int = 4096, cut: str = "words") -> DataFrame:
    """Pieces of all documents with their place: doc_id, start, length, doc_tokens, ids, sequence_id, offset.

    A document is its ids and ``end``; a null or empty text is the end id alone. Each id lies in one piece. ``ids`` holds
    the piece's ids as little-endian unsigned 32-bit integers. Repeated rows are packed as often as they occur; an empty
    table gives no piece; doc_id may be null; other columns are ignored.

    Every task fills its own sequences class by class while it reads. Only pieces of sequences that aren't full at its
    end go on, at most capacity / k less one for class k, ``FAN_IN`` tasks' rest to one task of the next round. The last
    task's rest, bounded whatever the input, is packed by first fit. Each round is a table in the shared folder.
    """
    small_batches(docs.sparkSession)

    def read(batches) -> Iterator[tuple[int, tuple]]:
        enc = encoder(tokenizer, cut)
        last = end.to_bytes(4, "little")
        for ids, some in groups_of(batches, ["doc_id", "text"], 1 << 19):
            for doc, data in zip(ids, enc.encode(some), strict=True):
                data += last
                total, start = len(data) // 4, 0
                for length in cuts(total, capacity):
                    yield length, (doc, start, length, total, data[4 * start : 4 * (start + length)])
                    start += length

    def again(batches) -> Iterator[tuple[int, tuple]]:
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in COLUMNS[:5]), strict=True):
                yield row[2], row

    def fill(level: int, source, last: bool):
        def run(batches):
            def rows():
                bins = Bins(capacity, level, TaskContext.get().partitionId())
                for length, row in source(batches):
                    yield from bins.add(length, row)
                if last:
                    yield from best_fit(bins.rest(), bins)
                else:
                    yield from ((*row, None, None) for _, row in bins.rest())

            yield from _in_batches(rows())

        return run

    spread = texts(docs)
    table = written(spread.mapInArrow(fill(0, read, False), PIECE).withColumn("task", F.spark_partition_id()), "packed")
    tasks = table.agg(F.max("task")).first()[0]
    out, level = table.where("sequence_id IS NOT NULL").select(*COLUMNS), 1
    rest, tasks = table.where("sequence_id IS NULL"), 0 if tasks is None else tasks + 1
    while tasks:
        tasks = -(-tasks // FAN_IN) if tasks > 1 else 1
        dealt = rest.select(*COLUMNS).repartition(tasks, "doc_id", "start")
        table = written(dealt.mapInArrow(fill(level, again, tasks == 1), PIECE), "packed")
        out = out.unionByName(table.where("sequence_id IS NOT NULL"))
        rest, level = table.where("sequence_id IS NULL"), level + 1
        tasks = 0 if tasks == 1 else tasks
    return out
