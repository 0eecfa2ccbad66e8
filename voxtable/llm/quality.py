"""Quality rules as a short-circuit cascade, in built-in functions only."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from .common import SPACE, texts, words_of

WINDOW = 5
Stat = Callable[[str], Column]


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of five words found twice or more in the text.

    Windows are compared by 64-bit hash. Only texts in which one repeats are sorted: equal neighbours in the order of
    (hash, position) give the repeated positions, whose union in order is the answer; n log n for a text of n words.
    """

    def covered(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
            at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: same(i, i + 1) | same(i, i - 1))
            return F.sort_array(F.transform(at, lambda i: F.get(s, i)["i"]))

        def union(p: Column) -> Column:
            step = lambda acc, i: acc + F.least(F.lit(WINDOW), F.get(p, i) - F.get(p, i - 1))
            more = F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(WINDOW), step)
            return F.when(F.size(p) > 1, more).otherwise(0)

        return let(ranked, lambda s: let(places(s), union))

    def count(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
        hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))
        repeats = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
        return F.when(F.size(w) > WINDOW, repeats).otherwise(0)

    return let(words, count).cast("long")


def statistics(text: Column) -> dict[str, Column]:
    """The statistics that rules look at, each as an expression over the whole text."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0)
    return {
        "n_words": F.size(words_of(text)).cast("long"),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words_of(text)),
        "n_capitals": (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long"),
    }


@dataclass(frozen=True)
class Rule:
    """A name and the condition, over the statistics, under which a document goes."""

    name: str
    rejects: Callable[[Stat], Column]


RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda s: s("n_words") < 10),
    Rule("repeated_words", lambda s: 100 * s("n_repeat_words") > 20 * s("n_words")),
    Rule("word_length", lambda s: (s("word_chars") > 20 * s("n_words")) | (s("word_chars") < 2 * s("n_words"))),
    Rule("symbols", lambda s: 10 * s("n_symbols") > s("n_words")),
    Rule("repeated_lines", lambda s: 100 * s("n_dup_lines") > 30 * s("n_lines")),
    Rule("capitals", lambda s: 2 * s("n_capitals") > s("word_chars")),
)


#: Statistics that a report gives of every document.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def order_by_gain(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 1000) -> list[Rule]:
    """The rules by rejections per second, best first, both estimated on a sample of about ``sample_rows`` documents.

    The sample is drawn where the rows lie, each with the same chance. Cost is the time to evaluate one rule on the sample
    beyond that of reading it; each rule runs twice and the second run counts, in which nothing is planned or compiled
    for the first time. The order decides only how much work the cascade does, never its verdicts. Rules without a
    rejection in the sample go last, cheapest first.
    """
    rows = docs.count()
    sample = texts(docs).sample(min(1.0, sample_rows / max(1, rows)), seed=7).cache()
    stats = statistics(F.col("text"))

    def timed(reject: Column) -> tuple[float, float]:
        found = sample.agg(F.avg(reject.cast("double")))
        found.first()
        began = time.perf_counter()
        share = found.first()[0]
        return share or 0.0, time.perf_counter() - began

    _, idle = timed(F.length("text") > 0)  # also fills the cache
    gain = []
    for rule in rules:
        share, took = timed(rule.rejects(stats.__getitem__))
        cost = max(took - idle, 1e-4)
        gain.append((-share / cost, cost, rule.name, rule))
    sample.unpersist()
    return [x[-1] for x in sorted(gain, key=lambda x: x[:3])]


def first_rejection(rules: Sequence[Rule], stat: Stat) -> Column:
    """The first rule that rejects the row, or null; branches after it aren't evaluated."""
    out = None
    for rule in rules:
        hit = F.coalesce(rule.rejects(stat), F.lit(False))
        out = F.when(hit, rule.name) if out is None else out.when(hit, rule.name)
    return F.lit(None).cast("string") if out is None else out


def quality_cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, order: Sequence[Rule] | None = None) -> DataFrame:
    """The documents with ``rejected_by``: the first rule of the cascade against them, null for those to keep.

    A document's rules stop at the first rejection. A null or empty text has no words and fails few_words; repeated rows
    get one verdict each; an empty table gives an empty table. The other columns stay as they are, but for one that is
    itself called rejected_by, which is replaced.
    """
    order = order_by_gain(docs, rules) if order is None else order
    stats = statistics(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.withColumn("rejected_by", first_rejection(order, stats.__getitem__))


def quality_report(docs: DataFrame, reported: Sequence[str] = REPORTED, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, the ``reported`` statistics and ``rejected_by``, the verdict of the cascade.

    Statistics that aren't reported are only computed inside the cascade, for documents that reach a rule on them; the
    reported ones are those of all documents and are computed once. Nulls, empty texts, repeated rows and empty tables are
    as in :func:`quality_cascade`; other columns are ignored.
    """
    order = order_by_gain(docs, rules)
    lazy = statistics(F.col("text"))
    base = texts(docs).withColumns({name: lazy[name] for name in reported})
    return base.withColumn("rejected_by", first_rejection(order, lambda name: F.col(name) if name in reported else lazy[name])).drop("text")
