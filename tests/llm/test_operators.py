"""The operators on small literal rows: nulls, empty and repeated rows, clashing columns; brute force where there is no SQL."""

import random
import zlib
from itertools import pairwise

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxtable.llm import common, components, decontamination, language, lines, lm, near_duplicates, packing, personal, quality, token_files, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, key string"


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdeéo") for _ in range(draw.randint(2, 6)))
    texts = ["\n".join(" ".join(word() for _ in range(draw.randint(3, 14))) for _ in range(draw.randint(1, 5))) for _ in range(30)]
    texts += [texts[0], texts[1].replace("a", "b", 1), texts[2] + " more", texts[3].upper(), None, "", "  \n ", "x " * 6000, "." * 50]
    rows = [(i, t, "ab"[i % 2], "s", 0, 1.0, True, "k") for i, t in enumerate(texts)]
    rows += [rows[4], (None, texts[5], None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def plain(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < lines.NEAR_CHARS:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def test_lines_by_brute_force(spark):
    draw = random.Random(5)
    base = ["".join(draw.choice("ab é") for _ in range(draw.choice([19, 20, 23, 24, 35, 36, 37, 60]))) for _ in range(12)]

    def edited(s):
        i, kind = draw.randrange(len(s)), draw.randrange(4)
        return [s, s[:i] + "z" + s[i + 1 :], s[:i] + s[i + 1 :], s[:i] + "z" + s[i:]][kind]

    texts = ["\n".join(edited(edited(draw.choice(base)) if draw.random() < 0.4 else draw.choice(base)) for _ in range(6)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    places = [((d, n), x) for d, t in enumerate(texts) for n, x in enumerate(t.split("\n")) if x.strip()]
    first = {}
    for p, x in places:
        first.setdefault(x, p)
    near = {x: any(first[y] < first[x] and one_edit(x, y) for y in first if y != x) for x in first}
    got = {(r["doc_id"], r["line_no"]): (r["copy"], r["near"]) for r in lines.deduplicate_lines(df).collect()}
    assert got == {p: (first[x] != p, near[x]) for p, x in places}
    assert any(near.values())


def test_lines_rows_and_columns(docs):
    kept = lines.remove_lines(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert 0 not in ids or 30 not in ids  # one of two equal documents has nothing left
    assert {34, 35, 36} <= ids
    assert lines.deduplicate_lines(docs.limit(0)).count() == 0


def test_lines_of_rows_that_share_an_id(spark):
    """Rows with a null or the same doc_id are documents of their own; equal rows are copies of the first."""
    shared, long = "this line is in several rows", "a line of more than twenty characters"
    texts = [
        (7, "one\ntwo\nthree"), (7, "four\nfive\nthree"), (7, "four\nfive\nthree"), (8, "one\ntwo"), (8, "one\ntwo"), (8, " \n"), (8, " \n"),
        (None, f"{shared}\nsix"), (None, f"{shared}\nseven"), (None, f"{shared}\nseven"), (None, f"eight\n{long}"), (None, f"nine\n{long[:-1]}"),
    ]
    rows = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(texts)], "doc_id long, text string, i int")
    got = sorted((r["i"], r["text"]) for r in lines.remove_lines(rows).collect())
    assert got == [
        (0, "one\ntwo\nthree"), (1, "four\nfive"), (5, " \n"), (6, " \n"), (7, f"{shared}\nsix"), (8, "seven"), (10, f"eight\n{long}"), (11, "nine")
    ]
    judged = lines.deduplicate_lines(rows)
    assert {(r["doc_id"], r["line_no"]) for r in judged.where("kept").collect()} >= {(None, 0), (7, 0), (7, 1)}


def test_model_sums_to_one_and_beats_base(spark, docs):
    model = lm.train(docs)
    reader = lm.Reader(model)
    words = sorted({w.decode() for _, t in plain(docs) for w in lm.tokens(t)})
    # P(w | start) P(end | w) over P(end | w): with a long unknown tail the rest of both texts is the same
    end = {w: float(reader.score([f"zzzz {w}"])["score"][0] - reader.score(["zzzz"])["score"][0]) for w in ["zzzz"]}
    unknown_end = float(reader.score(["zzzz zzzz"])["score"][0] - reader.score(["zzzz"])["score"][0])
    assert end["zzzz"] == pytest.approx(unknown_end)
    after_unknown = [10 ** float(reader.score([f"zzzz {w} zzzz"])["score"][0] - reader.score([f"{w} zzzz"])["score"][0]) for w in words]
    assert all(p > 0 for p in after_unknown)
    scored = lm.score(docs, model).collect()
    assert len(scored) == docs.count()
    assert sum(r["score"] for r in scored) > sum(r["base_score"] for r in scored)
    empty = lm.train(docs.limit(0))
    assert all(r["score"] == pytest.approx(0.0) for r in lm.score(docs.where("doc_id = 34"), empty).collect())


def edits_within(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_leaks_by_brute_force(spark):
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcd") for _ in range(draw.randint(1, 5)))
    items = [(i, " ".join(word() for _ in range(12))) for i in range(12)] + [(20, "abc"), (21, None), (22, "  ")]

    def noisy(s, n):
        for _ in range(n):
            i = draw.randrange(len(s))
            s = draw.choice([s[:i] + "x" + s[i + 1 :], s[:i] + s[i + 1 :], s[:i] + "x" + s[i:]])
        return s

    texts = [f"{word()} {noisy(items[draw.randrange(12)][1], draw.randrange(8)).upper()}\n {word()} {word()}" for _ in range(60)] + [None, "", "ABC"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontamination.find_leaks(docs, bench).collect()}
    expected = {}
    for d, t in enumerate(texts):
        for i, x in items[:12]:
            n = edits_within(decontamination.normal(x), decontamination.normal(t or ""))
            if n <= int(0.1 * len(decontamination.normal(x))):
                expected[d, i] = n
    assert got == expected | {(62, 20): 0}
    assert 5 < len(expected) < 60
    report = decontamination.decontamination_report(docs, bench)
    assert report.count() == len(texts) and report.where("NOT kept").count() == len({d for d, _ in got})
    assert decontamination.decontaminate(docs, bench.limit(0)).count() == len(texts)


def test_leaks_of_items_and_rows_that_share_an_id(spark, monkeypatch):
    """Every text under an id, or under none, is looked for, in one block or in several, and every row judged by its own text."""
    a, b, c = "the first passage of one test set", "some question of quite another set", "a passage that came without any id"
    bench = spark.createDataFrame([(0, a), (0, b), (0, b), (None, c), (None, c.upper()), (None, None), (5, c)], "item_id long, text string")
    texts = [(1, f"x {a} y"), (1, "nothing here"), (None, f"x {b}"), (None, "nor there"), (2, f"{a[1:]} and {b}"), (3, c), (4, None)]
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(texts)], "doc_id long, text string, i int")
    for size in (1_000_000, 40):
        monkeypatch.setattr(decontamination, "BLOCK_CHARS", size)
        assert sorted(r["i"] for r in decontamination.decontaminate(docs, bench).collect()) == [1, 3, 6]
        got = [tuple(r) for r in decontamination.decontamination_report(docs, bench).collect()]
        none = (0, None, None, True)
        assert got == [(1, 1, 0, 0, False), (1, *none), (None, 1, 0, 0, False), (None, *none), (2, 2, 0, 0, False), (3, 2, 5, 0, False), (4, *none)]
        pairs = sorted((r["doc_id"] or 0, r["item_id"] or 0, r["distance"]) for r in decontamination.find_leaks(docs, bench).collect())
        assert pairs == [(0, 0, 0), (1, 0, 0), (2, 0, 0), (2, 0, 1), (3, 0, 0), (3, 5, 0)]


def test_near_duplicates(spark, docs):
    got = {r["doc_id"]: r for r in near_duplicates.near_duplicates(docs, 85).collect()}
    texts = {d: set(near_duplicates.shingles(t).tolist()) for d, t in plain(docs) if d is not None}
    parent = {d: d for d in texts}

    def root(d):
        return d if parent[d] == d else root(parent[d])

    for a in texts:
        for b in texts:
            if a < b and texts[a] and 100 * len(texts[a] & texts[b]) >= 85 * len(texts[a] | texts[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {d: got[d]["component_id"] for d in texts} == {d: root(d) for d in texts}
    assert got[None]["kept"] and got[34]["kept"] and got[34]["n_shingles"] == 0
    assert near_duplicates.keep_one(docs).columns == docs.columns
    assert near_duplicates.near_duplicates(docs.limit(0)).count() == 0


def test_similar_copies_of_one_original(spark):
    """Copies of an original are too unlike each other to be linked but for it, whatever its doc_id."""
    draw = random.Random(1)
    original = [f"w{i}" for i in range(300)]
    rows = [(500, " ".join(original))]
    for d in range(40):
        copy = list(original)
        copy[draw.randrange(20, 280)] = f"n{d}"
        copy[draw.randrange(20, 280)] = f"m{d}"
        rows.append((d, " ".join(copy)))
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 92)
    assert {r["component_id"] for r in got.collect()} == {0}


def test_links_and_labels_in_few_files(spark, monkeypatch):
    """Few links and labels are written to one file, however many tasks find them."""
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, tables = {k: spark.conf.get(k) for k in conf}, []

    def noted(df, purpose):
        tables.append((purpose, common.written(df, purpose)))
        return tables[-1][1]

    for module in (near_duplicates, components):
        monkeypatch.setattr(module, "written", noted)
    rows = [(2 * i + j, " ".join(f"w{i}x{k}" for k in range(40)) + " more" * j) for i in range(40) for j in range(2)]
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: d - d % 2 for d, _ in rows}
    assert {len(t.inputFiles()) for purpose, t in tables if purpose in ("links", "labels") and not t.isEmpty()} == {1}


def test_language(spark, docs):
    rows = [(i, ("the thing and that " if i % 2 else "der hund und das ") * (1 + i % 5), "en" if i % 2 else "de") for i in range(60)]
    model = language.train_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    test = spark.createDataFrame([(1, "that and the"), (2, "das und der"), (3, None), (4, "12 !"), (4, "12 !")], "doc_id long, text string")
    got = [(r["doc_id"], r["lang_pred"]) for r in language.predict_languages(test, model).collect()]
    assert got == [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (4, "und")]
    none = language.train_language_model(docs.limit(0))
    assert {r["lang_pred"] for r in language.predict_languages(docs, none).collect()} == {"und"}


def test_classes_made_of_copies(spark):
    """Copies of a text are drawn once: the bound holds, and a class of many rows but few texts is learned."""
    rows = [(f"the thing {i} and that", "en", 0) for i in range(300)]
    rows += [(f"der hund und das {x}", "de", 1) for x in "abcdefgh"] * 400 + [("la casa es", "es", 1)] * 2
    labelled = spark.createDataFrame(rows, "text string, lang string, toxic int")
    sample, sizes, shares = common.draw_texts(labelled, "lang", 17, 120)
    got = [(r["lang"], r["text"]) for r in sample.collect()]
    assert len(got) == len(set(got)) and 28 < len(got) < 62
    assert sizes == {"en": 300, "de": 8, "es": 1} and shares == {"en": 40 / 300, "de": 1.0, "es": 1.0}
    test = spark.createDataFrame([(1, "der hund und das"), (2, "the thing 7 and that")], "doc_id long, text string")
    model = language.train_language_model(labelled.where("lang <> 'es'"), max_rows=60)
    assert [r["lang_pred"] for r in language.predict_languages(test, model).collect()] == ["de", "en"]
    marked = toxicity.train_toxicity_model(labelled, max_rows=60)
    assert [r["predicted"] for r in toxicity.score_toxicity(test, marked).orderBy("doc_id").collect()] == [1, 0]


def test_quality(spark, docs):
    def repeated(words):
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        return len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)})

    draw = random.Random(2)
    rows = [(i, " ".join(draw.choice("abc") for _ in range(draw.randrange(40)))) for i in range(60)]
    got = quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["n_repeat_words"] for r in got.collect()} == {i: repeated(t.split()) for i, t in rows}
    judged = quality.quality_cascade(docs.withColumn("rejected_by", F.lit(1)))
    assert sorted(judged.columns) == sorted([*docs.columns, "rejected_by"])
    assert {r["rejected_by"] for r in judged.where("doc_id IN (34, 35, 36)").collect()} == {"few_words"}
    both = [quality.quality_cascade(docs, order=o).select("doc_id", F.col("rejected_by").isNull().alias("k")) for o in (quality.RULES, quality.RULES[::-1])]
    assert sorted(map(tuple, both[0].collect()), key=str) == sorted(map(tuple, both[1].collect()), key=str)
    assert quality.quality_cascade(docs.limit(0)).count() == 0


def test_toxicity(spark, docs):
    rows = [(i, f"some words {i % 7} here and {'vile' if i % 3 == 0 else 'nice'} others", int(i % 3 == 0)) for i in range(200)]
    model = toxicity.train_toxicity_model(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    test = spark.createDataFrame([(1, "a vile thing"), (2, "a nice thing"), (3, None)], "doc_id long, text string")
    assert [r["predicted"] for r in toxicity.score_toxicity(test, model).orderBy("doc_id").collect()][:2] == [1, 0]
    none = toxicity.train_toxicity_model(spark.createDataFrame([], "doc_id long, text string, toxic int"))
    assert toxicity.score_toxicity(docs, none).where("predicted = 1 OR score > 1 OR score < 0").count() == 0


def whole_ids(docs, file, end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
    return [(d, np.array([*tokenizer.encode(t, add_special_tokens=False).ids, end], "<u4").tobytes()) for d, t in plain(docs)]


def test_packing_is_whole_and_dense(docs):
    got = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end=2, capacity=64).collect()
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in pairwise(places)) and sum(places[-1]) <= 64
    total = sum(r["length"] for r in got)
    assert len(by_sequence) <= total / 64 * 1.1 + 2
    joined = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["start"], r["ids"]) for r in got)
    expected = whole_ids(docs, "word_bpe_49k.json", 2)
    assert total == sum(len(x) // 4 for _, x in expected)
    for d, ids in expected:
        own = [x for k, _, x in joined if k == (-1 if d is None else d)]
        assert b"".join(own) == ids or d == 4  # document 4 is there twice
    assert packing.pack(docs.limit(0), public_tokenizers.path("word_bpe_49k.json"), end=2).count() == 0


def test_cuts_are_whole():
    for n in [*range(1, 300), 1000, 4095, 4096, 4097, 10_001]:
        assert sum(packing.cuts(n, 4096)) == n and len(packing.cuts(n, 4096)) <= n // 4096 + 5


def test_personal_data(spark):
    texts = [
        "a.b@c.de, x@y and q@r.s.t", "1.2.3.4 256.1.1.1 1.2.3.4.5 0255.01.1.1", "4111 1111 1111 1111 and 4111 1111 1111 1112", "+1 (555) 123-4567 or +12",
        "@@a@b.c @x.y", "", None, "7" * 5000,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["sure"]] for r in personal.find_personal_data(docs, personal.train_span_model(docs)).collect()}
    import re

    base = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    right = {
        "email": lambda s: True, "ip": lambda s: all(int(x) <= 255 for x in s.split(".")),
        "card": lambda s: 16 <= len(personal.only_digits(s)) <= 19 and personal.luhn(personal.only_digits(s)), "phone": lambda s: 8 <= len(personal.only_digits(s)) <= 15,
    }
    for d, t in enumerate(texts):
        expected = [(k, *m.span()) for k, p in base.items() for m in re.finditer(p, t or "") if right[k](m[0])]
        assert got[d] == expected
    none = personal.train_span_model(docs.limit(0))
    assert personal.find_personal_data(docs, none).where("exists(spans, x -> NOT x.sure)").count() == 0


def test_token_files_round_trip(spark, docs, tmp_path):
    folder = f"{tmp_path}/ids"
    token_files.write_token_files(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), end=0)
    got = token_files.read_token_files(spark, folder).orderBy("start").collect()
    expected = sorted(whole_ids(docs, "byte_bpe_50k.json", 0), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [(r["doc_id"], zlib.crc32(r["ids"])) for r in got] == [(d, zlib.crc32(x)) for d, x in expected]
    starts = np.cumsum([0, *(len(x) // 4 for _, x in expected)])[:-1].tolist()
    assert [r["start"] for r in got] == starts
