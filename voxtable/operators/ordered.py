"""Ordered computation inside a key, without putting a whole key into one task.

Almost every rule on a recording depends on time order.  A plain
``Window.partitionBy(recording)`` is right but sends a recording to one task,
and one recording may hold a large part of all rows.  The helpers here cut each
key into *chunks* along its order (an hour of audio, a block of turns, ...), run
the window inside ``(key, chunk)`` and carry the small state between chunks
through a table with one row per chunk:

* :func:`carry`    running sum / max / last / next value, in dependent steps
* :func:`number`   row number
* :func:`runs`     gaps and islands whose break looks at the previous row
* :func:`spans`    union of intervals with a gap tolerance
* :func:`fold`     state machines that depend on the last *kept* row
* :func:`join_text`  ordered concatenation in two levels

Only the chunk table is ever windowed by the bare key.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.binding import let

KEY, CHUNK = "__key", "__chunk"
CHUNK_SEC = 600.0
CHUNK_ROWS = 4096


@dataclass(frozen=True)
class Timeline:
    """Key columns, order columns and a chunk number that never falls along the order."""

    order: Sequence[str]
    chunk: Column
    key: Sequence[str] = field(default=("recording_id",))

    def tag(self, df: DataFrame) -> DataFrame:
        """The rows with their key and chunk, dealt out by both.

        The key columns go into one struct, which is never null and equal to itself where a key column is null, so rows
        without a key stay together in every join on it and are a key of their own.

        Rows that a join has dealt out by the key alone would count as dealt out by key and chunk as well, and a whole
        key would stay in one task; hence the explicit repartition.
        """
        return self.mark(df).repartition(*self.ids)

    def mark(self, df: DataFrame) -> DataFrame:
        """The rows with their key and chunk, where they lie."""
        whole = F.struct(*self.key) if self.key else F.lit(0)
        return df.withColumns({KEY: whole, CHUNK: F.coalesce(self.chunk.cast("long"), F.lit(-(2**62)))})

    @property
    def key_columns(self) -> list[Column]:
        """The key columns out of the struct."""
        return [F.col(KEY)[c].alias(c) for c in self.key]

    @property
    def ids(self) -> list[str]:
        return [KEY, CHUNK]

    @property
    def rows(self):
        return Window.partitionBy(*self.ids).orderBy(*self.order)

    @property
    def chunks(self):
        return Window.partitionBy(KEY).orderBy(CHUNK)

    @property
    def sort_key(self) -> Column:
        return F.struct(*self.order)


def by_time(
    start: str = "start_sec",
    order: Sequence[str] = ("start_sec", "end_sec", "pos"),
    key: Sequence[str] = ("recording_id",),
    chunk_sec: float = CHUNK_SEC,
) -> Timeline:
    return Timeline(order, F.floor(F.col(start) / F.lit(float(chunk_sec))), key)


def by_position(
    pos: str = "pos", key: Sequence[str] = ("recording_id",), chunk_rows: int = CHUNK_ROWS
) -> Timeline:
    return Timeline((pos,), F.floor(F.col(pos) / F.lit(chunk_rows)), key)


def durable(df: DataFrame) -> DataFrame:
    """Write a result as a table to the shared checkpoint folder and go on from there.

    The carries read their input twice, so a rule of several ordered steps would
    run its first step many times over; such rules cut the lineage between steps.
    It also means that a lost executor costs only the current step. A written table is
    preferred to a checkpoint, whose plan still drags along what it was made from: with
    some dozen joins behind it, planning the next step takes longer than running it.
    """
    spark = df.sparkSession
    if "void" in df.schema.simpleString():  # a column of nulls has no type in a file
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(_checkpoint_dir(spark))
        return df.checkpoint()
    folder = f"{_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Hash rows over all shuffle partitions; for work that is heavy per byte, which
    neither the input splits nor size-based coalescing know about."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *key)


def _checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder; in local mode, where one machine does all, a temporary one will do."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return configured or tempfile.mkdtemp(prefix="voxtable-checkpoint-")


def carry(df: DataFrame, tl: Timeline, *steps: dict[str, tuple[str, Column] | Column]) -> DataFrame:
    """Running values over the whole key; a step maps output name to (kind, column).

    Kinds: ``sum`` and ``max`` over the rows up to and including this one,
    ``sum_before`` / ``max_before`` over the rows before it, ``last`` the newest
    non-null value up to this row, ``last_before`` the newest before it, ``lag``
    the previous row's value, ``next`` the first non-null value after this row.
    A plain column in a step is added first. Later steps may use what earlier ones
    gave; the rows are dealt out once for all of them.
    """
    return carry_dealt(tl.tag(df), tl, df.columns, *steps).drop(*tl.ids)


def carry_dealt(out: DataFrame, tl: Timeline, columns: Sequence[str], *steps: dict[str, tuple[str, Column] | Column]) -> DataFrame:
    """``carry`` for ``columns`` of rows that ``tl.tag`` has dealt out; key and chunk stay on them."""
    names = list(columns)
    for step in steps:
        plain = {n: c for n, c in step.items() if isinstance(c, Column)}
        specs = {n: c for n, c in step.items() if n not in plain}
        names = [n for n in names if n not in step]
        out = _carried(out.withColumns(plain), tl, [*names, *plain], specs)
        names += step
    return out.select(*names, *tl.ids)


def _carried(tagged: DataFrame, tl: Timeline, kept: Sequence[str], specs: dict[str, tuple[str, Column]]) -> DataFrame:
    """One step of ``carry`` on rows that are dealt out already, which stay so."""
    for name, (_, column) in specs.items():
        tagged = tagged.withColumn(f"__in_{name}", column)

    totals, carried, local, merged = [], {}, {}, {}
    before = tl.chunks.rowsBetween(Window.unboundedPreceding, -1)
    after = tl.chunks.rowsBetween(1, Window.unboundedFollowing)
    upto = tl.rows.rowsBetween(Window.unboundedPreceding, 0)
    past = tl.rows.rowsBetween(Window.unboundedPreceding, -1)
    ahead = tl.rows.rowsBetween(1, Window.unboundedFollowing)
    for name, (kind, _) in specs.items():
        value, total = F.col(f"__in_{name}"), F.col(f"__tot_{name}")
        frame = past if kind.endswith("_before") else upto
        here, there = F.col(f"__loc_{name}"), F.col(f"__car_{name}")
        if kind.startswith("sum"):
            totals.append(F.sum(value).alias(f"__tot_{name}"))
            carried[name] = F.sum(total).over(before)
            local[name] = F.sum(value).over(frame)
            merged[name] = F.when(here.isNull() & there.isNull(), None).otherwise(
                F.coalesce(here, F.lit(0)) + F.coalesce(there, F.lit(0))
            )
        elif kind.startswith("max"):
            totals.append(F.max(value).alias(f"__tot_{name}"))
            carried[name] = F.max(total).over(before)
            local[name] = F.max(value).over(frame)
            merged[name] = F.greatest(here, there)
        elif kind == "lag":
            # wrapped in a struct, so that a null value differs from "no row"
            totals.append(F.max_by(F.struct(value.alias("v")), tl.sort_key).alias(f"__tot_{name}"))
            carried[name] = F.lag(total).over(tl.chunks)
            local[name] = F.lag(F.struct(value.alias("v"))).over(tl.rows)
            merged[name] = F.coalesce(here, there)["v"]
        elif kind.startswith("last"):
            present = F.when(value.isNotNull(), tl.sort_key)
            totals.append(F.max_by(value, present).alias(f"__tot_{name}"))
            carried[name] = F.last(total, ignorenulls=True).over(before)
            local[name] = F.last(value, ignorenulls=True).over(frame)
            merged[name] = F.coalesce(here, there)
        elif kind == "next":
            present = F.when(value.isNotNull(), tl.sort_key)
            totals.append(F.min_by(value, present).alias(f"__tot_{name}"))
            carried[name] = F.first(total, ignorenulls=True).over(after)
            local[name] = F.first(value, ignorenulls=True).over(ahead)
            merged[name] = F.coalesce(here, there)
        else:
            raise ValueError(f"unknown kind {kind}")

    chunk_table = tagged.groupBy(*tl.ids).agg(*totals)
    chunk_table = chunk_table.select(
        *tl.ids, *[c.alias(f"__car_{n}") for n, c in carried.items()]
    )
    out = tagged.withColumns({f"__loc_{n}": c for n, c in local.items()})
    out = out.join(chunk_table, tl.ids)
    return out.select(*kept, *tl.ids, *[c.alias(n) for n, c in merged.items()])


def number(df: DataFrame, tl: Timeline, out: str = "row_no") -> DataFrame:
    """Row number from 1 over the whole key."""
    return carry(df, tl, {out: ("sum", F.lit(1).cast("long"))})


def runs(
    df: DataFrame,
    tl: Timeline,
    breaks: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    needs: Sequence[str],
    out: str = "run",
) -> DataFrame:
    """Number the islands of consecutive rows; a row starts one when ``breaks(prev, cur)``.

    ``needs`` names the columns the break looks at.  The break of a chunk's first
    row and the number of islands before the chunk are settled on the chunk table,
    so one pass over the rows is enough.
    """
    tagged = tl.tag(df)
    seen = F.struct(*needs)
    tagged = tagged.withColumn("__prev", F.lag(seen).over(tl.rows))
    cut = breaks(lambda c: F.col("__prev")[c], lambda c: F.col(c))
    tagged = tagged.withColumn(
        "__cut", F.when(F.col("__prev").isNotNull() & F.coalesce(cut, F.lit(True)), 1).otherwise(0)
    )
    edges = tagged.groupBy(*tl.ids).agg(
        F.sum("__cut").alias("__cuts"),
        F.min_by(seen, tl.sort_key).alias("__first"),
        F.max_by(seen, tl.sort_key).alias("__last"),
    )
    edges = edges.withColumn("__left", F.lag("__last").over(tl.chunks))
    head = breaks(lambda c: F.col("__left")[c], lambda c: F.col("__first")[c])
    edges = edges.withColumn(
        "__head", F.when(F.col("__left").isNull() | F.coalesce(head, F.lit(True)), 1).otherwise(0)
    )
    before = tl.chunks.rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(
        *tl.ids,
        (F.coalesce(F.sum(F.col("__cuts") + F.col("__head")).over(before), F.lit(0)) + F.col("__head")).alias("__base"),
    )
    local = tagged.withColumn(
        "__local", F.sum("__cut").over(tl.rows.rowsBetween(Window.unboundedPreceding, 0))
    )
    joined = local.join(edges, tl.ids)
    return joined.select(*df.columns, (F.col("__base") + F.col("__local")).alias(out))


def spans(
    df: DataFrame, tl: Timeline, start: str, end: str, gap: float, out: str = "span"
) -> DataFrame:
    """Tag rows with the span they belong to when intervals at most ``gap`` apart unite.

    A row opens a span when it starts later than ``gap`` after every earlier end.
    Seen inside a chunk alone, too many rows may open one; the true openers are
    those that also clear the largest end carried in, and as starts never fall
    they form the tail of the local ones.  So the chunk table (largest end, last
    local opener) settles the carry.  The tag is the opener's order struct.
    """
    tagged = tl.tag(df).withColumn("__id", tl.sort_key)
    past = tl.rows.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(end).over(past)
    tagged = tagged.withColumn("__reach", reach)
    tagged = tagged.withColumn(
        "__opens", F.col("__reach").isNull() | (F.col(start) - F.col("__reach") > F.lit(gap))
    )
    edges = tagged.groupBy(*tl.ids).agg(
        F.max(end).alias("__end"),
        F.max_by(
            F.struct(F.col(start).alias("s"), F.col("__id").alias("id")),
            F.when(F.col("__opens"), F.col("__id")),
        ).alias("__opener"),
    )
    before = tl.chunks.rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumn("__carry", F.max("__end").over(before))
    clears = F.col("__carry").isNull() | (F.col("__opener.s") - F.col("__carry") > F.lit(gap))
    edges = edges.withColumn("__true", F.when(clears, F.col("__opener.id")))
    edges = edges.select(
        *tl.ids, "__carry", F.last("__true", ignorenulls=True).over(before).alias("__open_id")
    )
    joined = tagged.join(edges, tl.ids)
    opens = F.col("__opens") & (
        F.col("__carry").isNull() | (F.col(start) - F.col("__carry") > F.lit(gap))
    )
    upto = tl.rows.rowsBetween(Window.unboundedPreceding, 0)
    joined = joined.withColumn("__own", F.when(opens, F.col("__id")))
    joined = joined.withColumn("__local", F.last("__own", ignorenulls=True).over(upto))
    return joined.select(*df.columns, F.coalesce("__local", "__open_id").alias(out))


def fold(
    df: DataFrame,
    tl: Timeline,
    fields: Sequence[str],
    state: str,
    emitted: str,
    step: Callable[[Column, Column], tuple[Column, Column]],
    finish: Callable[[Column], Column],
    masked: Callable[[Column, Column], Column] | None = None,
    carried: Sequence[str] = (),
    seeds: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Run a state machine over each key in order and return what it emits, one row each.

    ``step(state, row)`` gives the next state (SQL type ``state``, a struct) and an array of finished items (element type
    ``emitted``); ``finish(state)`` gives the items left in the last state.

    Every chunk is run from no state first, and keeps a table of tries: the state it was entered with, and the one it
    ended in. Then the true states are followed along the chunk tables, which reads one row a chunk. A chunk that is
    entered with a state it was not yet run from is run again; all such chunks at once, the ones behind it on the guess
    that it ends as it did from no state. The result is that of the sequential machine, and a task never holds more rows
    than one chunk. What keeps the number of rounds small, whatever the number of chunks:

    * an entering state that the chunk's first row makes the machine forget counts as none;
    * only what later rows can see of a state is compared: ``masked(state, first row)`` leaves the rest null. The fields
      in ``carried`` pass through unseen; where they are null in the state a chunk ends in, they are those it was entered
      with. So a state that passes many chunks is the same to all of them;
    * ``seeds(items)`` lists all states a chunk may end in, for machines whose state always differs by where they began.
      When the next chunk has to be run again, it is run from each of them that it does not forget.
    """
    names = list(dict.fromkeys([*tl.order, *fields]))
    none = F.lit(None).cast(state)

    def machine(incoming: Column) -> Column:
        start = F.struct(incoming.alias("state"), F.array().cast(f"array<{emitted}>").alias("out"))

        def advance(acc: Column, row: Column) -> Column:
            after, done = step(acc["state"], row)
            return F.struct(after.cast(state).alias("state"), F.concat(acc["out"], done.cast(f"array<{emitted}>")).alias("out"))

        return F.aggregate("__items", start, advance)

    def last_state(incoming: Column) -> Column:
        return F.aggregate("__items", incoming, lambda acc, row: step(acc, row)[0].cast(state))

    def entered(by: Column, first: Column) -> Column:
        """What a chunk with this first row sees of the state it is entered with."""
        forgotten = step(by, first)[0].cast(state).eqNullSafe(step(none, first)[0].cast(state))
        return F.when(~forgotten, by if masked is None else masked(by, first).cast(state))

    def tried(seen: Column) -> Column:
        """A chunk's run from a state: that state, the one it ends in, and what the next chunk sees of that."""
        next_seen = lambda out: F.when(F.col("__next").isNotNull(), entered(out, F.col("__next")))
        return let(last_state(seen), lambda out: F.struct(seen.alias("seen"), out.alias("out"), next_seen(out).alias("next")))

    items = tl.tag(df).groupBy(*tl.ids).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("__items"))
    items = durable(items)
    edges = items.select(*tl.ids, F.element_at("__items", 1).alias("__first"), *([] if seeds is None else [seeds(F.col("__items")).cast(f"array<{state}>").alias("__ends")]))
    sides = [F.lead("__first").over(tl.chunks).alias("__next")]
    if seeds is not None:
        sides.append(F.lag("__ends").over(tl.chunks).alias("__seeds"))
    edges = edges.select(*tl.ids, *sides)
    held = items.join(edges, tl.ids)
    tries = durable(held.select(*tl.ids, F.array(tried(none)).alias("__tries")))
    while True:
        told = _follow(tries, tl, state, carried)
        unknown = told.filter(~F.col("__known"))
        if unknown.isEmpty():
            break
        runs_ = F.array(tried(F.col("__seen")))
        if seeds is not None:
            others = F.array_distinct(F.filter(F.transform("__seeds", lambda x: entered(x, F.element_at("__items", 1))), lambda x: x.isNotNull() & ~x.eqNullSafe(F.col("__seen"))))
            runs_ = F.concat(runs_, F.transform(F.coalesce(others, F.array().cast(f"array<{state}>")), tried))
        again = held.join(unknown.select(*tl.ids, "__seen"), tl.ids).select(*tl.ids, runs_.alias("__more"))
        more = F.concat("__tries", F.coalesce("__more", F.array_repeat(F.element_at("__tries", 1), 0)))
        tries = durable(tries.join(again, tl.ids, "left").select(*tl.ids, more.alias("__tries")))
    done = items.join(told.select(*tl.ids, "__in", "__rest"), tl.ids).withColumn("__run", machine(F.col("__in")))
    tail = F.when(
        F.col("__rest") & F.col("__run.state").isNotNull(),
        finish(F.col("__run.state")).cast(f"array<{emitted}>"),
    ).otherwise(F.array().cast(f"array<{emitted}>"))
    done = done.select(*tl.key_columns, F.explode(F.concat(F.col("__run.out"), tail)).alias("__item"))
    return done.select(*tl.key, "__item.*")


def _follow(tries: DataFrame, tl: Timeline, state: str, carried: Sequence[str]) -> DataFrame:
    """The state each chunk is entered with (``__in``), what it sees of it, whether it was run from that, and whether it is the last.

    The chunk tables of a key are read in order, as a stream of one row a chunk.
    """
    ordered = tries.repartition(KEY).sortWithinPartitions(*tl.ids)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in tries.schema.fields if f.name != "__tries"]

    def follow(batches):
        key = now = seen = held = None
        for b in batches:
            kinds = [b.schema.field(c).type for c in tries_ids]
            struct = b.schema.field("__tries").type.value_type.field("out").type
            out = []
            for *ids, some in zip(*(b.column(c).to_pylist() for c in (*tries_ids, "__tries")), strict=True):
                if held is None or ids[:-1] != key:
                    if held is not None:
                        out.append((*held, True))
                    key, now, seen = ids[:-1], None, None
                else:
                    out.append((*held, False))
                known = next((x for x in some if x["seen"] == seen), None)
                held = (*ids, now, seen, known is not None)
                taken = known or some[0]
                after = taken["out"]
                if after is not None and now is not None and known is not None:
                    after = after | {c: now[c] for c in carried if after[c] is None}
                now, seen = after, taken["next"]
            yield _batch(out, kinds, struct)
        if held is not None:
            yield _batch([(*held, True)], kinds, struct)

    def _batch(rows, kinds, struct):
        columns = list(zip(*rows, strict=True)) or [[] for _ in range(len(kinds) + 4)]
        types = [*kinds, struct, struct, pa.bool_(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], [*tries_ids, "__in", "__seen", "__known", "__rest"])

    tries_ids = tl.ids
    ordered = ordered.select(*tries_ids, "__tries")
    return ordered.mapInArrow(follow, ", ".join([*fields, f"__in {state}", f"__seen {state}", "__known boolean", "__rest boolean"]))


def join_text(
    df: DataFrame, tl: Timeline, texts: dict[str, tuple[Column, str]], extra: Sequence[Column] = ()
) -> DataFrame:
    """One row per key with ordered concatenations; ``texts`` maps name to (column, separator).

    Chunks are concatenated first, so that what travels per key is one string per
    chunk.  Null texts are left out.  ``extra`` aggregates must be plain sums,
    minima or maxima by alias ``sum_*``, ``min_*``, ``max_*`` or ordered picks
    ``first_*`` / ``last_*`` given as columns.
    """
    tagged = tl.tag(df)

    def glue(column: Column, sort: Column, sep: str) -> Column:
        kept = F.collect_list(F.when(column.isNotNull(), F.struct(sort.alias("k"), column.alias("v"))))
        return F.array_join(F.transform(F.array_sort(kept), lambda x: x["v"]), sep)

    first = [glue(c, tl.sort_key, sep).alias(f"__t_{n}") for n, (c, sep) in texts.items()]
    some = [F.count(c).alias(f"__n_{n}") for n, (c, _) in texts.items()]
    chunked = tagged.groupBy(*tl.ids).agg(*first, *some, *extra)
    second = []
    for n, (_, sep) in texts.items():
        part = F.when(F.col(f"__n_{n}") > 0, F.col(f"__t_{n}"))
        second.append(glue(part, F.col(CHUNK), sep).alias(n))
    rest = []
    for name in chunked.columns:
        kind, _, _ = name.partition("_")
        if name in tl.ids or name.startswith("__"):
            continue
        merge = {
            "sum": F.sum(name),
            "min": F.min(name),
            "max": F.max(name),
            "first": F.min_by(name, F.when(F.col(name).isNotNull(), F.col(CHUNK))),
            "last": F.max_by(name, F.when(F.col(name).isNotNull(), F.col(CHUNK))),
        }[kind]
        rest.append(merge.alias(name))
    whole = chunked.groupBy(KEY).agg(*second, *rest)
    return whole.select(*tl.key_columns, *[c for c in whole.columns if c != KEY])


def attach(df: DataFrame, per_key: DataFrame, key: Sequence[str] = ("recording_id",), how: str = "left") -> DataFrame:
    """Put per-key values on the rows; a join, so that adaptive skew handling can split a hot key.

    A null key meets a null key.
    """
    named = per_key.select(*[F.col(c).alias(f"__of_{c}") for c in key], *[c for c in per_key.columns if c not in key])
    same = [df[c].eqNullSafe(named[f"__of_{c}"]) for c in key]
    return df.join(named, same, how).drop(*[f"__of_{c}" for c in key])
