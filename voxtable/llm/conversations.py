"""Conversation repair: the cheapest edits that make roles alternate, computed once for each shared end of a conversation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written

#: ASCII white space, which a text of nothing else is blank by.
BLANKS = " \t\n\x0b\x0c\r"
#: Rows that one signature holds; longer conversations are cut into several, which are joined by grammar state.
LONGEST = 256

#: Grammar states: 0 nothing yet, 1 after the system's row, 2 after the user's, 3 after the assistant's. Complete: 0 and 3.
COMPLETE = (0, 3)
#: The state after the user's or assistant's row that a state waits for, and after a kept row by its role's initial.
AWAITED = (2, 2, 3, 2)
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: Symbols of a signature: a row's initial (- for others) and, in upper case, that it is cut short; X for rows that must go.
MUST_GO = "X"

Table = list[list[tuple[int, str] | None]]


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults by CRC-32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text, 2 takes its `.!?`, 3 repeats it, 4 makes it the user's.

    Nulls in that key, in role and in text are one space. Dropped rows stay as rows without a role, so that their
    conversation is still known; ``repair`` takes them for that.
    """
    text = lambda c: F.coalesce(conversations[c].cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", text("conv_id"), text("turn"))) % 20
    return conversations.select(
        conversations["conv_id"].alias("conv_id"),
        conversations["turn"].cast("long").alias("turn"),
        F.when(fault == 4, "user").when(fault != 0, text("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text")).alias("text"),
        F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"),
    )


def _signatures(rows: DataFrame) -> DataFrame:
    """conv_id, block, signature and the counts of each block of ``LONGEST`` rows of each conversation."""
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(F.col("role").isNull(), "gone").when(end == "", "blank").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated")
    digest = F.md5(F.col("text").cast("binary")).alias("digest")
    dealt = rows.select("conv_id", "turn", "role", digest, fault.alias("fault")).repartition("conv_id")
    # dealt by conversation already: numbering the rows with one text needs no further exchange
    like = Window.partitionBy("conv_id", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    again = F.row_number().over(like) > 1
    fault = F.when(F.col("fault").isin("gone", "blank"), F.col("fault")).when(F.col("again"), "duplicate").otherwise(F.col("fault"))
    listed = dealt.withColumn("again", again).sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "digest", "again")
    listed = listed.select("conv_id", "turn", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    counted = ("blank", "duplicate", "truncated", "illegal", "turns")
    schema = f"conv_id {kind}, block long, signature string, {', '.join(f'{c} long' for c in counted)}, low long, high long"
    names = ["conv_id", "block", "signature", *counted, "low", "high"]

    def read(batches) -> Iterator[pa.RecordBatch]:
        kinds: dict = {}
        out: list[tuple] = []
        conv, block, signature, before, turn = object(), 0, [], None, None
        counts, low, high = dict.fromkeys(counted, 0), None, None

        def close():
            out.append((conv, block, "".join(signature), *(counts[c] for c in counted), low, high))

        def batch():
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[i], kinds["conv_id"] if i == 0 else pa.string() if i == 2 else pa.int64()) for i in range(len(names))], names)

        started = False
        for b in batches:
            kinds["conv_id"] = b.schema.field("conv_id").type
            for c, t, initial, fault in zip(*(b.column(x).to_pylist() for x in ("conv_id", "turn", "initial", "fault")), strict=True):
                new = not started or c != conv
                if new or len(signature) == LONGEST:
                    if started:
                        close()
                    block, signature, counts, low, high = 0 if new else block + 1, [], dict.fromkeys(counted, 0), None, None
                    if new:
                        conv, before, turn, started = c, None, None, True
                if fault == "gone":
                    continue
                if t is not None:
                    counts["turns"] += t != turn
                    low, high, turn = t if low is None else low, t, t
                if before is not None:
                    counts["illegal"] += before + initial not in ("su", "ua", "au")
                before = initial
                if fault:
                    counts[fault] += 1
                symbol = initial if initial in ("s", "u", "a") else "-"
                signature.append(MUST_GO if fault in ("blank", "duplicate") else {"-": "_"}.get(symbol, symbol.upper()) if fault else symbol)
            if len(out) >= 4096:
                yield batch()
                out.clear()
        if started:
            close()
        if out:
            yield batch()

    return listed.mapInArrow(read, schema)


def _better(a: tuple[int, str] | None, cost: int, edits: str, rest: tuple[int, str] | None) -> tuple[int, str] | None:
    """The cheaper of ``a`` and ``edits`` before ``rest``; of equal ones the least in ASCII order."""
    if rest is None or a is not None and a[0] < cost + rest[0]:
        return a
    new = (cost + rest[0], edits + rest[1])
    return new if a is None else min(a, new)


def _inserted(table: Table) -> Table:
    """With up to two empty rows put in first: three would come back to a state that one has reached."""
    out = []
    for state, row in enumerate(table):
        once, twice = table[AWAITED[state]], table[AWAITED[AWAITED[state]]]
        out.append([_better(_better(x, 5, "I", once[o]), 10, "II", twice[o]) for o, x in enumerate(row)])
    return out


#: Cost and edits from each state to each state where no rows are left.
END: Table = _inserted([[(0, "") if s == o else None for o in range(4)] for s in range(4)])


def node(symbol: str, rest: Table) -> Table:
    """A node of the automaton: cost and edits from each grammar state to each, for a row and then the rows of ``rest``."""
    out: Table = []
    low = symbol.lower().replace("_", "-")
    late = 5 * (symbol.isupper() or symbol == "_")
    for state in range(4):
        row = [_better(None, 2, "D", x) for x in rest[state]]
        if symbol != MUST_GO:
            row = [_better(a, 1 + late, "R", x) for a, x in zip(row, rest[AWAITED[state]], strict=True)]
            if low in KEPT[state]:
                row = [_better(a, late, "K", x) for a, x in zip(row, rest[KEPT[state][low]], strict=True)]
        out.append(row)
    return _inserted(out)


def solved(signatures: DataFrame) -> DataFrame:
    """``signatures`` with the table of each: cost and edits from each grammar state to each, as arrays of 16.

    The signatures are ranged by their reversed symbols and sorted, so signatures with the same end lie side by side: the
    automaton is built from the end, one node for each distinct end, and a node's table is computed once and serves all
    conversations that share it. Only the nodes of one path are held. A range may begin within the same end, or the same
    signature, as the last; its path is computed again, so a signature that a third of all conversations have is no hot key.
    """
    names = signatures.columns
    ranged = signatures.withColumn("reversed", F.reverse("signature"))
    ranged = ranged.repartitionByRange(int(signatures.sparkSession.conf.get("spark.sql.shuffle.partitions")), "reversed", F.xxhash64(*names))
    sorted_ = ranged.sortWithinPartitions("reversed").drop("reversed")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in signatures.schema.fields)

    def solve(batches) -> Iterator[pa.RecordBatch]:
        path: list[tuple[str, Table]] = []  # from the end
        for b in batches:
            costs, edits = [], []
            for signature in b.column("signature").to_pylist():
                shared = 0
                while shared < min(len(path), len(signature)) and path[shared][0] == signature[-1 - shared]:
                    shared += 1
                del path[shared:]
                for symbol in reversed(signature[: len(signature) - shared]):
                    path.append((symbol, node(symbol, path[-1][1] if path else END)))
                table = path[-1][1] if path else END
                costs.append([x and x[0] for row in table for x in row])
                edits.append([x and x[1] for row in table for x in row])
            more = [pa.array(costs, pa.list_(pa.int64())), pa.array(edits, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *more], [*names, "costs", "edits"])

    return sorted_.mapInArrow(solve, f"{fields}, costs array<long>, edits array<string>")


def _joined(blocks: DataFrame) -> DataFrame:
    """conv_id, cost and audit: the blocks of a conversation joined from its end."""
    ordered = blocks.select("conv_id", "block", "costs", "edits").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block"))
    kind = blocks.schema["conv_id"].dataType.simpleString()

    def join(batches) -> Iterator[pa.RecordBatch]:
        best: list = []
        for b in batches:
            out = []
            for conv, block, costs, edits in zip(*(b.column(c).to_pylist() for c in ("conv_id", "block", "costs", "edits")), strict=True):
                best = best or [(0, "") if o in COMPLETE else None for o in range(4)]
                new: list = [None] * 4
                for s in range(4):
                    for o in range(4):
                        if costs[4 * s + o] is not None:
                            new[s] = _better(new[s], costs[4 * s + o], edits[4 * s + o], best[o])
                best = new
                if block == 0:
                    out.append((conv, *best[0]))
                    best = []
            columns = list(zip(*out, strict=True)) or [[], [], []]
            kinds = (b.schema.field("conv_id").type, pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(columns, kinds, strict=True)], ["conv_id", "cost", "audit"])

    return ordered.mapInArrow(join, f"conv_id {kind}, cost long, audit string")


def repair_report(rows: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit (the cheapest edits' initials).

    ``rows``: conv_id, turn, role, text, see ``damaged``. Rows are taken by turn, nulls first; rows of one turn by role,
    then by the text's MD5. Each row counts for its first fault: blank, duplicate (role and text seen earlier), truncated.
    Edits are K (keep), R (other role, 1), D (delete, 2; blank and duplicate rows must go), I (an empty row, 5), and 5 more
    for a truncated row that stays; the result's role initials are `(s?(ua)+)?` (an empty role fits nowhere), ties take the least audit in ASCII order.
    A null conv_id is a conversation like others; a row without a role only makes its conversation known, and one without
    any other row has zeros and an empty audit. Repeated rows are duplicates. An empty table has no rows; other columns
    are ignored. Conversations of any length: signatures of ``LONGEST`` rows are solved apart and joined.
    """
    small_batches(rows.sparkSession, 1 << 13)
    blocks = written(_signatures(rows), "signatures")
    edited = _joined(solved(blocks.select("conv_id", "block", "signature")))
    counts = blocks.groupBy("conv_id").agg(
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")),
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0)).cast("long").alias("gaps"),
    )
    other = edited.withColumnRenamed("conv_id", "id")
    report = counts.join(other, counts["conv_id"].eqNullSafe(other["id"]), "left")
    return report.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def repaired(rows: DataFrame, report: DataFrame) -> DataFrame:
    """The repaired conversations' rows, each conversation's in order: conv_id, position from 0, role, text.

    ``report`` is that of ``repair_report`` for the same rows. A conversation streams through one task in order, of which
    only its audit is held; an edited row has its text, an inserted one the empty text.
    """
    small_batches(rows.sparkSession)
    audits = report.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit("").alias("digest"), F.col("audit").alias("text"))
    listed = rows.where("role is not null").select("conv_id", F.lit(1).alias("kind"), "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"), "text")
    both = audits.unionByName(listed).repartition("conv_id")
    ordered = both.sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "role", "digest").select("conv_id", "kind", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def edit(batches) -> Iterator[pa.RecordBatch]:
        audit, at, position, offset = "", 0, 0, 0
        conv = None
        for b in batches:
            out: list[tuple] = []

            def put(role, text):
                nonlocal position
                awaited = "user" if (position - offset) % 2 == 0 else "assistant"
                out.append((conv, position, role or awaited, text))
                position += 1

            for c, sort, role, text in zip(*(b.column(x).to_pylist() for x in ("conv_id", "kind", "role", "text")), strict=True):
                if sort == 0:
                    conv, audit, at, position, offset = c, text, 0, 0, 0
                else:
                    edit_ = audit[at]
                    if edit_ == "K":
                        if position == 0 and role[:1] == "s":
                            offset = 1
                        put(role, text)
                    elif edit_ == "R":
                        put(None, text)
                    at += 1
                while at < len(audit) and audit[at] == "I":
                    put(None, "")
                    at += 1
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            kinds = (b.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(columns, kinds, strict=True)], ["conv_id", "position", "role", "text"])

    return ordered.mapInArrow(edit, f"conv_id {kind}, position long, role string, text string")


def digests(rows: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its `role:text` lines, of rows that come as ``repaired`` gives them; empty conversations have no row."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def digest(batches) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        for b in batches:
            out = []
            for c, position, role, text in zip(*(b.column(x).to_pylist() for x in ("conv_id", "position", "role", "text")), strict=True):
                if position == 0:
                    if state:
                        out.append((conv, state.hexdigest()))
                    conv, state = c, hashlib.sha256(f"{role}:{text}".encode())
                else:
                    state.update(f"\n{role}:{text}".encode())
            of = b.schema.field("conv_id").type
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], of), pa.array([x for _, x in out], pa.string())], ["conv_id", "sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([conv], of), pa.array([state.hexdigest()])], ["conv_id", "sha256"])

    return rows.mapInArrow(digest, f"conv_id {kind}, sha256 string")
