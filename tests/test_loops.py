"""Loops in texts against sequential restatements, on random texts that repeat in many ways."""

import random
from collections import Counter

import pytest

from voxtable.functions import text as tx


def ngrams(text, longest=8):
    words = text.split()
    if len(words) < 12:
        return text
    at = lambda i, n: tuple(words[i : i + n])
    counts = Counter(at(i, n) for n in range(2, longest + 1) for i in range(len(words) - n + 1) if sum(map(len, at(i, n))) >= 8)
    frequent = {g for g, c in counts.items() if c >= 3}
    if not frequent:
        return text
    out, seen, i = [], set(), 0
    while i < len(words):
        n = next((n for n in range(longest, 1, -1) if i + n <= len(words) and at(i, n) in frequent), 1)
        if n == 1 or at(i, n) not in seen:
            out += at(i, n)
        seen |= {at(i, n)} if n > 1 else set()
        i += n
    # a text from which nothing goes stays as it is
    return " ".join(out) if len(out) < len(words) else text


def loop(text, shortest=6, longest=240):
    t = text.strip()
    n = len(t)
    if n < 2 * shortest:
        return t
    for size in range(min(n // 2, longest), shortest - 1, -1):
        unit = t[:size].strip()
        if len(unit) < shortest:
            continue
        if n % size == 0 and t == t[:size] * (n // size):
            return unit
        copies = 0
        while (copies + 1) * size <= n and t[copies * size : (copies + 1) * size].strip() == unit:
            copies += 1
        if copies >= 3:
            return f"{unit} {t[copies * size :].strip()}".strip()
    return t


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(12)
    word = lambda: "".join(draw.choice("abcé") for _ in range(draw.randint(1, 6)))
    out = ["", "x", "ab" * 40, "a" * 500, "the loop " * 60, "no loop here at all but words", "abcdef  " * 9 + "tail", ("y" * 239 + " ") * 4, ("z" * 240) * 2, ("z" * 241) * 2]
    for _ in range(250):
        few = [word() for _ in range(draw.randint(2, 12))]
        body = [draw.choice(few) for _ in range(draw.randint(1, 80))]
        phrase = " ".join(draw.choice(few) for _ in range(draw.randint(1, 9)))
        for _ in range(draw.randint(0, 5)):
            body.insert(draw.randrange(len(body) + 1), phrase)
        sep = draw.choice([" ", "  ", " \n "])
        out += [" ".join(body), sep.join([phrase] * draw.randint(2, 5) + body[:10]), (phrase + draw.choice(["", " ", "  "])) * draw.randint(2, 6)]
    return out


def answers(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", column("t").alias("r"))
    return [r["r"] for r in rows.orderBy("i").collect()]


def test_ngrams(spark, texts):
    got = answers(spark, texts, tx.collapse_ngrams)
    want = [ngrams(t) for t in texts]
    # the rows' walk joins words by one space where something goes
    assert [g for g, w in zip(got, want, strict=True) if g != w] == []
    assert sum(g != t for g, t in zip(got, texts, strict=True)) > 100


def test_whole_loops(spark, texts):
    got = answers(spark, texts, tx.collapse_whole_string_loop)
    assert [(t, g) for t, g in zip(texts, got, strict=True) if g != loop(t)] == []
    assert sum(len(g) < len(t.strip()) for g, t in zip(got, texts, strict=True)) > 100


def test_cleaning_shuffles_nothing(spark, texts):
    df = spark.createDataFrame([(None, t) for t in texts], "id long, text string")
    from voxtable.operators import transcripts

    cleaned = transcripts.clean_transcript(df)
    assert "Exchange" not in cleaned._jdf.queryExecution().executedPlan().toString()
    got = Counter(r["text"] for r in cleaned.collect())
    assert got == Counter(" ".join(ngrams(x).split()) for x in answers(spark, texts, tx.clean_before_ngrams))


def test_long_text(spark):
    draw = random.Random(1)
    words = [f"w{draw.randrange(4000)}" for _ in range(20_000)]
    text = " ".join(words + ["one two three four"] * 50 + words[:100])
    assert answers(spark, [text], tx.collapse_ngrams) == [ngrams(text)]


def test_word_repeats(spark):
    """A word four or more times in a row, against walking over the words; case counts in the form for scripts."""
    draw = random.Random(7)
    texts = [" ".join(draw.choice(["an", "An", "ana", "été", "Été", "x1", "b"]) for _ in range(draw.randint(1, 30))) for _ in range(300)]

    def walk(text, same):
        words, out, i = text.split(" "), [], 0
        while i < len(words):
            n = next((k for k in range(i, len(words)) if not same(words[k], words[i])), len(words)) - i
            out += words[i : i + 1] if n > 3 else words[i : i + n]
            i += n
        return " ".join(out)

    assert answers(spark, texts, tx.collapse_word_repeats) == [walk(t, lambda a, b: a.lower() == b.lower()) for t in texts]


def test_phrase_repeats(spark):
    """Said twice or more in a row, a phrase stays once, and nothing that doesn't repeat goes."""
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    plain = [" ".join(word() for _ in range(12)) for _ in range(50)]
    looped = []
    for t in plain:
        w = t.split()
        i = draw.randrange(8)
        n = draw.randint(1, 4)
        looped.append(" ".join(w[:i] + w[i : i + n] * draw.randint(2, 5) + w[i + n :]))
    assert answers(spark, looped, tx.collapse_phrase_repeats) == plain
    assert answers(spark, plain, tx.collapse_phrase_repeats) == plain
