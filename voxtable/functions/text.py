"""Column functions on transcripts: cleaning, script detection, formatting.

All of them are expressions on the whole text, built-in ones in the JVM but for :func:`collapse_phrase_repeats`.
Repetition patterns use possessive quantifiers, so that a text with very long
loops cannot exhaust the regex engine's stack.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

# White space in the sense of Unicode, word characters without
# combining marks, script ranges in order of preference, sentence ends.
SPACES = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
WORD_EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
SCRIPTS = {
    "kn": r"[\x{0C80}-\x{0CFF}]",
    "te": r"[\x{0C01}-\x{0C7F}]",
    "ta": r"[\x{0B80}-\x{0BFF}]",
    "ml": r"[\x{0D00}-\x{0D7F}]",
    "hi": r"[\x{0900}-\x{097F}]",
    "bn": r"[\x{0980}-\x{09FF}]",
    "gu": r"[\x{0A80}-\x{0AFF}]",
    "pa": r"[\x{0A00}-\x{0A7F}]",
    "or": r"[\x{0B00}-\x{0B7F}]",
}
ALL_SCRIPTS = r"\x{0900}-\x{0D7F}"
INDIC_WORD = (
    r"[\p{L}\p{N}_\x{0900}-\x{097F}\x{0980}-\x{09FF}\x{0A00}-\x{0A7F}\x{0A80}-\x{0AFF}"
    r"\x{0B00}-\x{0B7F}\x{0B80}-\x{0BFF}\x{0C00}-\x{0C7F}\x{0C80}-\x{0CFF}\x{0D00}-\x{0D7F}]+"
)
FOREIGN_SCRIPT = (
    r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]"
)
NO_SPEECH = "[No speech detected]"
VOCALIZATION = "[vocalization]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(text, extra: str = "") -> Column:
    return F.btrim(_c(text), F.lit(SPACES + extra))


def squash_space(text) -> Column:
    """Every run of white space becomes one space; ends are trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(_c(text), F.lit("")), SPACE + "+", " "))


def words(text) -> Column:
    """The words of a text, split at white space."""
    return F.filter(F.split(F.coalesce(_c(text), F.lit("")), SPACE + "+"), lambda w: w != "")


def script_counts(text) -> list[tuple[str, Column]]:
    return [(code, F.regexp_count(_c(text), F.lit(rng))) for code, rng in SCRIPTS.items()]


def infer_language(text) -> Column:
    """Code of the Indic script with most characters; null when there is too little of it."""
    return let(F.coalesce(_c(text), F.lit("")), _infer_language)


def _infer_language(t: Column) -> Column:
    """One scan leaves the characters of any of the scripts, mostly none; only those are counted by script."""

    def most(kept: Column) -> Column:
        counts = [
            F.struct(n.alias("n"), F.lit(-i).alias("rank"), F.lit(code).alias("code"))
            for i, (code, n) in enumerate(script_counts(kept))
        ]
        return F.when(kept != "", F.array_max(F.array(*counts)))

    found = let(F.regexp_replace(t, rf"[^{ALL_SCRIPTS}]+", ""), most)
    need = F.when(F.length(strip(t)) <= 24, F.lit(1)).otherwise(F.lit(2))
    return let(found, lambda f: F.when(f["n"] >= need, f["code"]))


def contains_indic(text) -> Column:
    return infer_language(text).isNotNull()


def has_script(text, language: Column) -> Column:
    """Whether the text has a character of the script of ``language``; false for other codes."""
    hit = F.lit(False)
    for code, rng in SCRIPTS.items():
        hit = hit | ((language == code) & _c(text).rlike(rng))
    return F.coalesce(hit, F.lit(False))


def is_low_quality(text) -> Column:
    return let(F.coalesce(_c(text), F.lit("")), _is_low_quality)


def _is_low_quality(t: Column) -> Column:
    low = F.lower(t)
    letters = F.regexp_extract_all(t, F.lit(SCRIPTS["kn"]), F.lit(0))
    looped = (F.size(letters) >= 8) & (F.size(F.array_distinct(letters)) <= 3)
    return (t == "") | low.contains("commission") | low.contains("subscribe") | looped


def is_meaningful_speech(text) -> Column:
    t = strip(F.coalesce(_c(text), F.lit("")))
    rest = strip(F.replace(t, F.lit(VOCALIZATION), F.lit("")))

    def wordy(r: Column) -> Column:
        return (F.length(r) >= 3) & (r.rlike(r"[A-Za-z\x{0900}-\x{0D7F}]{2}") | (F.length(r) >= 4))

    return (t != "") & (t != NO_SPEECH) & let(rest, wordy)


def is_likely_english(text) -> Column:
    """At least four letters, and 85 % of them Latin; runs of other characters go, and what is left is counted."""

    def latin_share(letters: Column) -> Column:
        n, latin = F.length(letters), F.length(F.regexp_replace(letters, "[^A-Za-z]+", ""))
        return (n >= 4) & (latin / F.greatest(n, F.lit(1)) >= 0.85)

    return let(F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"\P{L}+", ""), latin_share)


def strip_language_tag(text) -> Column:
    return strip(F.regexp_replace(strip(F.coalesce(_c(text), F.lit(""))), rf"^\[[^\]]+\]{SPACE}*", ""))


def mark_vocalization(text, equal_letters: bool = True) -> Column:
    """Stuttered single letters (``a-a-a-...``) become a marker."""
    edge = WORD_EDGE
    t = F.regexp_replace(_c(text), rf"(?:{edge}[A-Za-z]-){{12,}}[A-Za-z]?{edge}", VOCALIZATION)
    if equal_letters:
        t = F.regexp_replace(t, rf"{edge}([A-Za-z])(?:-\1){{8,}}{edge}", VOCALIZATION)
    return t


def collapse_word_repeats(text) -> Column:
    """A word said four or more times in a row is kept once, ignoring case."""
    return F.regexp_replace(
        _c(text), rf"(?iu){WORD_EDGE}({WORD}+)(?:{SPACE}+\1{WORD_EDGE}){{3,}}+", "$1"
    )


def collapse_script_word_repeats(text) -> Column:
    """The same for words of any script with combining marks, case-sensitive."""
    return F.regexp_replace(_c(text), rf"({INDIC_WORD})(?:{SPACE}+\1){{3,}}+", "$1")


def collapse_phrase_repeats(text, passes: int = 4) -> Column:
    """A phrase of 4 to 80 characters said twice or more in a row is kept once.

    Expects single spaces (:func:`squash_space`).  A pass that changes nothing is the
    last one, so most texts are read once.  A pattern (:func:`collapse_phrase_pattern`) tries
    all lengths at every character; here only spaces are looked at, for a batch of texts at once.
    """

    @F.pandas_udf("string")
    def collapse(texts: pd.Series) -> pd.Series:
        return pd.Series(phrases_once(texts.tolist(), passes), dtype=object)

    return collapse(_c(text))


def collapse_phrase_pattern(text, passes: int = 4) -> Column:
    """The same as :func:`collapse_phrase_repeats` by a pattern; many times slower, but one expression."""

    def run(t: Column, left: int) -> Column:
        once = F.regexp_replace(t, r"([^ ].{2,78}?[^ ])(?: \1)++", "$1")
        if left == 1:
            return once
        return let(once, lambda n: F.when(n == t, n).otherwise(run(n, left - 1)))

    return let(_c(text), lambda t: run(t, passes))


def phrases_once(texts: list[str | None], passes: int = 4) -> list[str | None]:
    """What :func:`collapse_phrase_repeats` makes of a batch of texts."""
    out = list(texts)
    todo = [i for i, t in enumerate(out) if t is not None and " " in t]
    for _ in range(passes):
        changed = []
        for group in _by_length(out, todo):
            for i, new in zip(group, _once_each([out[i] for i in group]), strict=True):
                if new != out[i]:
                    out[i] = new
                    changed.append(i)
        todo = changed
    return out


def _by_length(texts, places: list[int], size: int = 1 << 20):
    """The places in groups whose texts hold about ``size`` characters."""
    held, chars = [], 0
    for i in places:
        held.append(i)
        chars += len(texts[i])
        if chars >= size:
            yield held
            held, chars = [], 0
    if held:
        yield held


def _once_each(texts: list[str], shortest: int = 4, longest: int = 80) -> list[str]:
    """The texts after one pass over their repeated phrases, from left to right, the shortest phrase at each place.

    A phrase ends before a space and comes again behind it. So for each length, phrase and copy have a known place at
    every space; those whose first two and last characters agree are compared whole.
    """
    edge = 0x110000  # no character; stands before, between and after the texts
    gap = [edge] * (longest + 1)
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int32) for t in texts]
    begins = np.cumsum([longest + 1, *[len(c) + longest + 1 for c in codes]])[:-1]
    t = np.concatenate([gap, *[x for c in codes for x in (c, gap)]]).astype(np.int32)
    ends_line = np.isin(t, [0x0A, 0x0D, 0x85, 0x2028, 0x2029, edge])
    lines_any = np.isin(t, [0x0A, 0x0D, 0x85, 0x2028, 0x2029]).any()
    at = np.flatnonzero(t == 32)
    first, last = t[at + 1], t[at - 1]
    fine = (first != 32) & (first != edge) & (last != 32) & (last != edge)
    at, first, last = at[fine], first[fine], last[fine]
    second = t[at + 2]
    found = []
    for size in range(shortest, longest + 1):
        near = np.flatnonzero(t[at - size] == first)
        near = near[t[at[near] + size] == last[near]]
        s = at[near[t[at[near] - size + 1] == second[near]]]
        for part in np.array_split(s, len(s) // 4096 + 1):
            here = part[:, None] + np.arange(size)
            same = (t[here - size] == t[here + 1]).all(axis=1)
            if lines_any:
                same &= ~ends_line[here[:, 1:-1] - size].any(axis=1)
            else:
                same &= (t[here - size] != edge).all(axis=1)
            found += zip((part[same] - size).tolist(), [size] * int(same.sum()), strict=True)
    if not found:
        return texts
    out, at_text = list(texts), np.searchsorted(begins, [i for i, _ in found], side="right") - 1
    by_text: dict[int, list[tuple[int, int]]] = {}
    for k, (i, size) in zip(at_text.tolist(), found, strict=True):
        by_text.setdefault(k, []).append((i - int(begins[k]), size))
    for k, places in by_text.items():
        whole, parts, done = texts[k], [], 0
        for i, size in sorted(places):
            if i < done:
                continue
            parts.append(whole[done : i + size])
            copy, done = " " + whole[i : i + size], i + size
            while whole.startswith(copy, done):
                done += len(copy)
        out[k] = "".join([*parts, whole[done:]])
    return out


def collapse_whole_string_loop(text, shortest: int = 6, longest: int = 240) -> Column:
    """A text that is one unit copied, or starts with three copies of one, keeps the unit once.

    The second copy begins where the text's first ``shortest`` characters come again, and the unit is as long as that
    place, less white space before it. Only those lengths are tried, from the longest; a text in whose head its first
    characters don't come again is done with one search.
    """

    def bound(t: Column) -> Column:
        once = F.struct(F.length(t).alias("n"), F.substring(t, 1, 3 * longest).alias("head"), F.substring(t, 1, shortest).alias("first"))
        return let(once, lambda b: _collapse_loop(t, b["n"], b["head"], b["first"], shortest, longest))

    return let(strip(_c(text)), bound)


def _collapse_loop(t: Column, n: Column, head: Column, begin: Column, shortest: int, longest: int) -> Column:
    def block(k: int, size: Column) -> Column:
        return strip(F.substring(head, F.lit(1) + F.lit(k) * size, size))

    def whole(size: Column) -> Column:
        times = F.floor(n / size).cast("int")
        return (n % size == 0) & (t == F.repeat(F.substring(t, F.lit(1), size), times))

    def loops(size: Column) -> Column:
        unit = block(0, size)
        third = (n >= 3 * size) & (block(2, size) == unit)
        return (F.length(unit) >= shortest) & (block(1, size) == unit) & (third | whole(size))

    def lengths(at: Column) -> Column:
        before = F.length(F.rtrim(F.substring(head, F.lit(1), at), F.lit(SPACES)))
        return F.sequence(F.greatest(before, F.lit(shortest)), at)

    def shorten(size: Column) -> Column:
        pieces = F.regexp_extract_all(
            t, F.concat(F.lit("(?s).{"), size.cast("string"), F.lit("}")), F.lit(0)
        )
        same = let(block(0, size), lambda unit: F.transform(pieces, lambda p: strip(p) == unit))
        copies = let(
            same,
            lambda x: F.when(F.array_position(x, F.lit(False)) == 0, F.size(x)).otherwise(
                F.array_position(x, F.lit(False)) - 1
            ),
        )
        rest = strip(F.substring(t, (copies * size + 1).cast("int"), n))
        return F.when(whole(size), block(0, size)).otherwise(
            strip(F.concat_ws(" ", block(0, size), rest))
        )

    # beyond the longest unit a copy can only begin after white space that fills the rest of its block
    far = F.when(head.rlike(SPACE + "{2}"), F.lit(2 * longest - shortest)).otherwise(F.lit(longest + 1))
    again = F.filter(
        F.sequence(F.lit(shortest), F.greatest(F.least(far, n - shortest), F.lit(shortest))), lambda at: F.substring(head, at + 1, F.lit(shortest)) == begin
    )
    sizes = let(
        F.array_distinct(F.flatten(F.transform(again, lengths))),
        lambda all_: F.filter(F.sort_array(all_, asc=False), lambda z: (2 * z <= n) & (z <= longest) & loops(z)),
    )
    first = F.when((n >= 2 * shortest) & (F.position(begin, head, F.lit(2)) > 0), F.get(sizes, F.lit(0)))
    return let(first, lambda size: F.when(size.isNull(), t).otherwise(shorten(size)))


def drop_repeated_sentences(text) -> Column:
    """Consecutive equal sentences are kept once."""
    t = squash_space(text)
    pieces = F.transform(
        F.regexp_extract_all(t, F.lit(rf"[^.!?।॥]*[.!?।॥]{SPACE}*|[^.!?।॥]+$"), F.lit(0)),
        lambda p: strip(p),
    )
    kept = let(
        pieces,
        lambda all_: F.filter(all_, lambda x, i: (i == 0) | (x != F.get(all_, i - 1))),
    )
    return F.array_join(F.filter(kept, lambda x: x != ""), " ")


def clean_preserving(text) -> Column:
    """Light cleaning that keeps sentences: stutters and loops only."""
    t = mark_vocalization(strip(_c(text)), equal_letters=False)
    t = collapse_whole_string_loop(squash_space(t))
    return squash_space(collapse_script_word_repeats(t))


def collapse_ngrams(text, longest: int = 8, min_count: int = 3, letters: int = 8) -> Column:
    """Keep only the first of over-repeated word n-grams (2 to ``longest`` words, at least ``letters`` letters).

    All inside the row: n-grams are 64-bit hashes, and a gram of n + 1 words can only be frequent where its first n words
    are, so each length looks at the places that the length before left. Sorting brings equal grams together, and runs
    of ``min_count`` are frequent. Most texts end after the pairs. Reading a text is a walk that jumps over the longest
    frequent gram at each place; of those it meets the first of each kind stays. Texts under 12 words are left alone.
    """

    def frequent(places: Column) -> Column:
        def in_run(s: Column, k: Column) -> Column:
            same = lambda j: F.coalesce(F.get(s, k - j)["h"] == F.get(s, k - j + min_count - 1)["h"], F.lit(False))
            out = same(0)
            for j in range(1, min_count):
                out = out | same(j)
            return out

        return let(F.sort_array(places), lambda s: F.filter(s, lambda x, k: in_run(s, k)))

    def longer(base: Column, hot: Column, n: int) -> Column:
        inside = F.filter(hot, lambda p: p["i"] + n < F.size(base))
        return F.transform(inside, lambda p: F.struct(F.xxhash64(p["h"], F.get(base, p["i"] + n)).alias("h"), p["i"].alias("i")))

    def levels(t: Column, w: Column, base: Column, hot: Column, n: int, found: list[Column]) -> Column:
        found = [*found, F.transform(hot, lambda p: F.struct(p["i"].alias("i"), F.lit(-n).alias("less"), p["h"].alias("h")))]
        if n == longest:
            return let(F.flatten(F.array(*found)), lambda grams: without(t, w, grams))
        return let(frequent(longer(base, hot, n)), lambda h: levels(t, w, base, h, n + 1, found))

    def without(t: Column, w: Column, grams: Column) -> Column:
        enough = F.filter(grams, lambda g: F.length(F.array_join(F.slice(w, g["i"] + 1, -g["less"]), "")) >= letters)
        first_at = let(F.sort_array(enough), lambda s: F.filter(s, lambda g, k: ~F.coalesce(F.get(s, k - 1)["i"] == g["i"], F.lit(False))))
        met = "array<struct<n:int,h:bigint,i:int>>"
        start = F.struct(F.lit(0).alias("next"), F.array().cast(met).alias("met"))
        walk = F.aggregate(
            first_at,
            start,
            lambda acc, g: F.when(g["i"] < acc["next"], acc).otherwise(
                F.struct(
                    (g["i"] - g["less"]).alias("next"),
                    F.concat(acc["met"], F.array(F.struct((-g["less"]).alias("n"), g["h"].alias("h"), g["i"].alias("i")))).cast(met).alias("met"),
                )
            ),
        )["met"]
        again = lambda s: F.filter(s, lambda g, k: F.coalesce((F.get(s, k - 1)["h"] == g["h"]) & (F.get(s, k - 1)["n"] == g["n"]), F.lit(False)))
        gone = let(F.sort_array(walk), lambda s: F.sort_array(F.transform(again(s), lambda g: F.struct(g["i"].alias("i"), g["n"].alias("n")))))
        return let(gone, lambda g: F.when(F.size(g) == 0, t).otherwise(F.array_join(rest(w, g), " ")))

    def rest(w: Column, gone: Column) -> Column:
        end = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(gone, k - 1)["i"] + F.get(gone, k - 1)["n"])
        until = lambda k: F.when(k == F.size(gone), F.size(w)).otherwise(F.get(gone, k)["i"])
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda k: let(end(k), lambda a: F.slice(w, a + 1, until(k) - a))))

    def pairs(base: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(base) - 2), lambda i: F.struct(F.xxhash64(F.get(base, i), F.get(base, i + 1)).alias("h"), i.alias("i")))

    def run(t: Column, w: Column) -> Column:
        base = F.transform(w, lambda x: F.xxhash64(x))
        return let(
            base, lambda b: let(frequent(pairs(b)), lambda hot: F.when(F.size(hot) == 0, t).otherwise(levels(t, w, b, hot, 2, [])))
        )

    return let(_c(text), lambda t: let(words(t), lambda w: F.when(F.size(w) >= 12, run(t, w)).otherwise(t)))


def clean_before_phrases(text) -> Column:
    """Full cleaning up to the phrase loops."""
    t = collapse_word_repeats(mark_vocalization(strip(F.coalesce(_c(text), F.lit("")))))
    t = collapse_whole_string_loop(squash_space(t))
    return collapse_script_word_repeats(drop_repeated_sentences(t))


def clean_before_ngrams(text) -> Column:
    """Full cleaning up to the n-gram loops (:func:`collapse_ngrams`), as one expression."""
    return collapse_phrase_pattern(clean_before_phrases(text))


def keep_script(cleaned: Column, language: Column) -> Column:
    """Blank a cleaned text that is clearly not in the expected language."""
    lang = F.lower(strip(F.coalesce(language, F.lit(""))))
    return let(
        F.struct(F.coalesce(cleaned, F.lit("")).alias("t"), lang.alias("lang")),
        lambda x: _keep_script(x["t"], x["lang"]),
    )


def _keep_script(t: Column, lang: Column) -> Column:
    low = F.lower(t)
    boilerplate = (
        low.contains("commission") | low.contains("subscribe") | low.contains("thank you for watching")
    )
    dots = (F.regexp_count(t, F.lit("[.。]")) >= 3) & (F.length(t) < 80)
    target = has_script(t, lang)
    foreign = t.rlike(FOREIGN_SCRIPT) & ~target
    found = infer_language(t)
    good = ~is_low_quality(t)
    blank = F.lit("")
    return (
        F.when((t == "") | (lang == "") | lang.isin("en", "english"), t)
        .when(boilerplate | dots | foreign, blank)
        .when(found.isNull(), t)
        .when(found == lang, F.when(good, t).otherwise(blank))
        .when(lang.isin(*SCRIPTS), F.when(target & good, t).otherwise(blank))
        .otherwise(t)
    )


def resolve_language(text, given) -> Column:
    """Language code of a transcribed piece: its script, else the given code, else an English test."""
    code = F.lower(strip(F.coalesce(_c(given), F.lit(""))))
    code = F.when((code == "") | (code == "auto"), None).otherwise(code)

    def pick(t: Column) -> Column:
        english = F.when(is_likely_english(t), F.lit("en"))
        return F.coalesce(_infer_language(t), english, code, F.lit("en"))

    return let(F.coalesce(_c(text), F.lit("")), pick)


def display_text(original, translated, language) -> Column:
    """Translation where one is wanted and present, else the original."""
    own = strip(_c(original))
    other = strip(F.coalesce(_c(translated), F.lit("")))
    return F.when(_c(language).isin("en", "kn") | (other == ""), own).otherwise(other)


# Abbreviations whose dot ends no sentence, words that open one.
ABBREVIATIONS = r"(?i)\b(Mrs|Mr|Ms|Dr|Prof|Sr|Jr|vs|etc|i\.e|e\.g)\."
INTERJECTIONS = r"(?i)\s+(?=(?:Oh|Yeah|Hmm|OK|Okay|Yes|No|Mom|Dear)\b)"
DOT_LEADER = "․"


def split_sentences(text) -> Column:
    """Sentences of a dialogue text, also cut before interjections, each with an end mark."""
    masked = F.regexp_replace(squash_space(text), ABBREVIATIONS, "$1" + DOT_LEADER)
    clauses = F.flatten(
        F.transform(F.split(masked, r"(?<=[.!?])\s+"), lambda s: F.split(s, INTERJECTIONS))
    )
    clean = F.transform(
        clauses, lambda s: F.btrim(F.replace(s, F.lit(DOT_LEADER), F.lit(".")), F.lit(" ,"))
    )
    return F.transform(
        F.filter(clean, lambda s: s != ""),
        lambda s: F.when(s.rlike(r"[.!?]$"), s).otherwise(F.concat(s, F.lit("."))),
    )


def strip_speaker_prefixes(text) -> Column:
    prefix = rf"(?i)(?:Speaker|Person){SPACE}+\d+:{SPACE}*"
    t = F.coalesce(_c(text), F.lit(""))
    lines = F.transform(
        F.split(t, r"[\r\n]+"), lambda s: F.regexp_replace(strip(s), prefix.replace("(?i)", "(?i)^"), "")
    )
    joined = F.array_join(F.filter(lines, lambda s: s != ""), " ")
    return F.coalesce(F.nullif(joined, F.lit("")), strip(F.regexp_replace(t, prefix, "")))


def format_timestamp(sec) -> Column:
    """``MM:SS.mmm``; unknown times as dashes."""
    s = F.greatest(F.lit(0.0), _c(sec).cast("double"))
    minutes = F.floor(s / 60)
    rest = F.format_string("%06.3f", s - minutes * 60)
    return F.when(_c(sec).isNull(), F.lit("--:--.---")).otherwise(
        F.concat(F.lpad(minutes.cast("string"), F.greatest(F.length(minutes.cast("string")), F.lit(2)), F.lit("0")), F.lit(":"), rest)
    )


def format_timestamp_short(sec) -> Column:
    s = F.greatest(F.lit(0.0), _c(sec).cast("double"))
    hours, minutes, seconds = (
        F.floor(s / 3600), F.floor(s % 3600 / 60), F.floor(s % 60),
    )
    short = F.format_string("%02d:%02d", minutes, seconds)
    return F.when(hours > 0, F.concat(F.format_string("%02d:", hours), short)).otherwise(short)


def token_jaccard(a, b) -> Column:
    """Shared share of the distinct words of two texts."""
    def share(wa: Column, wb: Column) -> Column:
        shared, either = F.size(F.array_intersect(wa, wb)), F.size(F.array_union(wa, wb))
        return F.when((F.size(wa) > 0) & (F.size(wb) > 0), shared / F.greatest(either, F.lit(1))).otherwise(0.0)

    return _with_word_sets(a, b, share)


def token_overlap(a, b) -> Column:
    def share(wa: Column, wb: Column) -> Column:
        fewer = F.least(F.size(wa), F.size(wb))
        shared = F.size(F.array_intersect(wa, wb))
        return F.when(fewer > 0, shared / F.greatest(fewer, F.lit(1))).otherwise(0.0)

    return _with_word_sets(a, b, share)


def _with_word_sets(a, b, body) -> Column:
    sets = F.struct(
        F.array_distinct(words(a)).alias("a"), F.array_distinct(words(b)).alias("b")
    )
    return let(sets, lambda x: body(x["a"], x["b"]))


def word_overlap_suffix(previous, current, longest: int = 16) -> Column:
    """What ``current`` adds after the longest run of words it shares with the end of ``previous``."""
    text = F.coalesce(_c(current), F.lit(""))
    pair = F.struct(words(previous).alias("p"), words(text).alias("c"), text.alias("t"))
    return let(pair, lambda x: _overlap_suffix(x["p"], x["c"], x["t"], longest))


def _overlap_suffix(p: Column, c: Column, text: Column, longest: int) -> Column:
    most = F.least(F.size(p), F.size(c), F.lit(longest))
    shared = F.filter(
        F.sequence(F.lit(1), F.greatest(most, F.lit(1))),
        lambda k: (k <= most) & (F.slice(p, F.size(p) - k + 1, k) == F.slice(c, F.lit(1), k)),
    )
    def rest(k: Column) -> Column:
        tail = F.array_join(F.slice(c, k + 1, F.greatest(F.size(c), F.lit(1))), " ")
        return F.when(k == 0, text).otherwise(tail)

    kept = let(F.coalesce(F.array_max(shared), F.lit(0)), rest)
    return F.when(F.size(c) == 0, F.lit("")).otherwise(kept)


def shorter_than(text, n: int, marks: str = " .,?!।") -> Column:
    """Whether less than ``n`` characters remain without the ``marks`` around them."""
    return F.length(F.btrim(F.coalesce(_c(text), F.lit("")), F.lit(marks))) < n


def preview(text, n: int = 160) -> Column:
    one_line = strip(F.replace(F.coalesce(_c(text), F.lit("")), F.lit("\n"), F.lit(" ")))

    def cut(line: Column) -> Column:
        return F.when(F.length(line) > n, F.concat(F.substring(line, 1, n), F.lit("…"))).otherwise(line)

    return let(one_line, cut)


# What marks speakers A and B of the lesson dialogue.
DIALOGUE_CUES = {
    "addresses_a": r"(?i)\bmrs\.?\s*roy\b",
    "addresses_b": r"(?i)\bmrs\.?\s*gupt?a\b",
    "self_b": r"(?i)\b(?:i am|i'?m)\s+mrs\.?\s*gupt?a\b",
    "self_a": r"(?i)\b(?:i am|i'?m)\s+mrs\.?\s*roy\b",
    "start": r"(?i)let'?s start with the conversation|start with the conversation|without any delay|"
    r"let us start with the conversation|start the conversation",
    "greeting": r"(?i)\bgood morning mrs\.?\s",
    "follow_up": r"(?i)^(?:how are you|how are you doing|how'?s it going|and you)\??\.?$",
}


def dialogue_cues(text, cues: dict[str, str] | None = None) -> dict[str, Column]:
    """One flag per cue; ``strong`` when both people are addressed somewhere."""
    flags = {name: _c(text).rlike(p) for name, p in {**DIALOGUE_CUES, **(cues or {})}.items()}
    flags["strong"] = flags["addresses_a"] & flags["addresses_b"]
    return flags
