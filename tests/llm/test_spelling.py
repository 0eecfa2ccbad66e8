"""Spelling variants against a comparison of all pairs."""

import random
import zlib
from collections import Counter

import pytest

from voxtable.llm import spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def expected(words, factor=10):
    likes = {w: sorted((v for v in words if near(w, v)), key=lambda v: (-words[v], v)) for w in words}
    form = {w: v[0] if v and words[v[0]] >= factor * words[w] else None for w, v in likes.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(likes[w]), words.get(form[w])) for w, n in words.items()}


@pytest.fixture(scope="module")
def words():
    draw = random.Random(1)
    letters = "abéÿ"
    out = {}
    for _ in range(250):
        w = "".join(draw.choice(letters) for _ in range(draw.randint(7, 9)))
        out[w] = draw.choice([2, 3, 40, 500, 7000])
        for _ in range(3):
            i = draw.randrange(len(w))
            v = draw.choice([w[:i] + w[i + 1 :], w[:i] + draw.choice(letters) + w[i:], w[:i] + draw.choice(letters) + w[i + 1 :]])
            if len(v) > 6:
                out[v] = draw.choice([2, 5, 50, 400])
    # a chain of forms, and words much longer than the rest
    return out | {"a" * 40: 2, "a" * 41: 20, "a" * 42: 200, "a" * 43: 2000, "b" + "c" * 5000: 3, "c" * 5000: 30}


@pytest.mark.parametrize("block", [1 << 15, 6])
def test_variants_by_brute_force(spark, words, block):
    """Also with groups of several blocks: the common halves of these words hold up to some forty words."""
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = [tuple(r) for r in spelling.spelling_variants(df, block=block).collect()]
    assert len(got) == len(words)
    assert set(got) == expected(words)
    assert any(form and root != form for _, form, root, *_ in got)


def test_words_of_documents(spark):
    texts = [(1, "Straße straße Été été abcdefgh ABCDEFGH x"), (1, "Straße straße Été été abcdefgh ABCDEFGH x"), (None, "straße1abcdefgh-été"), (2, None), (3, ""), (4, "a" * 100_000)]
    texts += [(i, "misspelling MISSPELLING Misspelling") for i in range(200)]
    counts = Counter()
    for doc, text in texts:
        for run in spelling.RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    want = {(w, n) for w, n in counts.items() if len(w) >= 7 and n >= 2}
    rows = [(d, t, "k", 1) for d, t in texts]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, n int")
    got = {tuple(r) for r in spelling.count_words(df, every=31).collect()}
    assert got == want
    assert len(want) > 2  # some are damaged
    none = spelling.count_words(df.limit(0), every=31)
    assert none.count() == 0
    assert spelling.spelling_variants(none).count() == 0
