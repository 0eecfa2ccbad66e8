"""The pipeline stage by stage against plain Python, and each registered query with its digest columns, on small tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from voxtable.llm import lines, near_duplicates, personal, queries, secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def fold(doc_id, divisor):
    return zlib.crc32(str(doc_id).encode()) % divisor


@pytest.fixture(scope="module")
def made():
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7)))
    body = lambda n: " ".join(word() for _ in range(n))
    shared, leak = body(14), "which of these words was never seen before in this place"
    texts = [body(60) + "\n" + body(12) for _ in range(40)]
    texts[3] += "\n" + shared
    texts[4] += "\n" + shared  # a repeated line
    texts[5] += "\n" + shared[:-1]  # and one an edit away
    texts[6] = texts[7].replace(" ", " ", 1) + " tail"  # near copies
    texts[8] = body(20) + " " + leak + " " + body(20)
    texts[9] = body(20) + " " + leak.replace("seen", "sean") + " " + body(20)
    texts[10] += " mail a.b@c.de ip 10.0.0.1 token = abcdef123 +49 (30) 1234567"
    rows = [(i, t) for i, t in enumerate(texts)]
    for i in range(40, 100):
        rows.append((i, body(12) + (" vile scum rot " if i % 3 == 0 else " kind fair good ") + body(12)))
    rows += [(100, None), (101, ""), (None, texts[11]), (None, texts[12]), (12, texts[13]), (2, texts[2]), (None, body(30)), (12, body(30))]
    labels = [(i, 1, int(i >= 40 and i % 3 == 0)) for i in range(100)]
    said = [(c, t, ["user", "assistant"][t % 2], f"line {c} {t}.") for c in range(30) for t in range(4)]
    return rows, labels, [(0, leak), (1, body(12))], said


@pytest.fixture(scope="module")
def folder(spark, made, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("sf"))
    rows, labels, items, said = made
    docs = [(d, t, "en" if (d or 0) % 2 else "de", "s", len(t or "")) for d, t in rows]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(f"{place}/conversations.parquet")
    return place


def pairs(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def without_lines(rows):
    """Rows in the order of the table; of equal or nearly equal lines the first in the order of doc_id stays."""
    first = {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    places = [((rank, n), x) for rank, i in enumerate(order) for n, x in enumerate((rows[i][1] or "").split("\n")) if x.strip()]
    for p, x in places:
        first.setdefault(x, p)

    def near(a, b):
        if min(len(a), len(b)) < lines.NEAR_CHARS or abs(len(a) - len(b)) > 1:
            return False
        i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]

    gone = {p for p, x in places if first[x] != p or any(first[y] < first[x] and near(x, y) for y in first if y != x)}
    out = Counter()
    for rank, i in enumerate(order):
        doc, text = rows[i]
        mine = [p for p, _ in places if p[0] == rank]
        if not mine or not all(p in gone for p in mine):
            out[doc, text if not gone.intersection(mine) else "\n".join(x for n, x in enumerate(text.split("\n")) if (rank, n) not in gone)] += 1
    return out


def one_of_each(rows, percent):
    sets = [set(near_duplicates.shingles(t or "").tolist()) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    out = Counter()
    for g in set(group):
        out[min((rows[i] for i in range(len(rows)) if group[i] == g), key=lambda r: (r[0] is None, r[0] or 0))] += 1
    return out


def test_copies_by_row(spark):
    """A copy goes by its own text: another row of its doc_id stays, and copies without a doc_id go."""
    long = {x: " ".join(f"{x}{i}" for i in range(20)) for x in "ABC"}
    rows = [(1, "A"), (7, "A"), (7, "B"), (9, "C"), (9, "C"), (None, "A"), (None, "A")]
    df = spark.createDataFrame([(d, long[x], x) for d, x in rows], "doc_id long, text string, component_id string")
    kept = near_duplicates.keep_one(df)
    assert sorted((r["doc_id"], r["component_id"]) for r in kept.collect()) == [(1, "A"), (7, "B"), (9, "C")]
    assert kept.columns == df.columns
    blank = spark.createDataFrame([(1, None), (1, None), (None, "")], "doc_id long, text string")
    assert near_duplicates.keep_one(blank).count() == 3
    assert near_duplicates.keep_one(df.limit(0)).count() == 0


def test_stages(spark, folder, made):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet").coalesce(1)
    kept = stages["toxicity"](spark, docs, folder)
    toxic = {(d, t) for d, t in made[0] if d is not None and 40 <= d < 100 and d % 3 == 0}
    left = pairs(kept)
    assert not [x for x in left if x in toxic] and sum(left.values()) == len(made[0]) - len(toxic)

    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    cut = stages["line_dedup"](spark, docs, folder)
    assert cut.columns == docs.columns
    assert pairs(cut) == without_lines(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in cut.where("text is not null").collect())

    got = pairs(stages["near_dedup"](spark, docs, folder))
    assert got == one_of_each(rows, 80)

    clean = pairs(stages["decontamination"](spark, docs, folder))
    assert Counter(rows) - clean == Counter(rows[8:10])

    packed = stages["packing"](spark, docs, folder).collect()
    assert Counter(r["doc_id"] for r in packed if r["start"] == 0) == Counter(d for d, _ in rows)
    for name, stage in stages.items():
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    whole = corpus_pipeline.run(spark, folder)
    assert whole.columns == stages["packing"](spark, docs, folder).columns and whole.count() > 50


def ids_crc(tokenizer, text, end):
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
    return len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def test_registered_queries(spark, folder, made):
    rows = made[0]
    got = {name: [r.asDict() for r in q(spark, folder).collect()] for name, q in queries.QUERIES.items()}
    assert all(got.values())
    for name, divisor, remainder in (("op2_lm_scoring", 7, 2), ("op5_language_id", 4, 2), ("op7_toxicity", 5, 0)):
        assert Counter(r["doc_id"] for r in got[name]) == Counter(d for d, _ in rows)
        assert all(r["held_out"] == (fold(r["doc_id"], divisor) == remainder) for r in got[name] if r["doc_id"] is not None)
    assert {r["doc_id"] for r in got["op3_decontaminate"] if r["n_items"]} == {8, 9}
    assert {r["doc_id"]: r["component_id"] for r in got["op4_near_duplicates"]}[7] == 6
    assert all(r["lang_pred"] in ("en", "de", "und") for r in got["op5_language_id"])
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in got["op7_toxicity"])

    byte = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got["op10_token_ids"]) == Counter((d, *ids_crc(byte, t, 0)) for d, t in rows)
    starts = sorted((r["start"], r["n_tokens"]) for r in got["op10_token_ids"])
    assert [s for s, _ in starts] == [sum(n for _, n in starts[:i]) for i in range(len(starts))]
    word = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    whole = [r for r in got["op8_packing"] if r["length"] == r["doc_tokens"]]
    want = Counter((d, *ids_crc(word, t, 2)) for d, t in rows)
    assert not Counter((r["doc_id"], r["length"], r["ids_crc32"]) for r in whole) - want

    bases = {}
    for doc, text in rows:
        found = sorted(personal.sure_spans(text or ""), key=lambda x: (personal.KINDS.index(x[0]), x[1]))
        bases.setdefault(doc, Counter())[(hashlib.sha256(joined(found).encode()).hexdigest(), *(sum(k == kind for k, *_ in found) for kind in personal.KINDS))] += 1
    for doc, want in bases.items():
        assert Counter((r["base_sha256"], *(r[f"n_{k}"] for k in personal.KINDS)) for r in got["op9_personal_data"] if r["doc_id"] == doc) == want
    assert any(r["n_email"] and r["n_ip"] and r["n_phone"] for r in got["op9_personal_data"])
    for r in got["op13_secret_scan"]:
        if r["doc_id"] == 10:
            found = sorted(secrets.sure_spans(dict(rows)[10]), key=lambda x: (x[1], secrets.KINDS.index(x[0])))
            assert (r["n_assign"], r["base_sha256"]) == (1, hashlib.sha256(joined(found).encode()).hexdigest())
    assert {r["conv_id"] for r in got["op12_conversation_repair"]} == set(range(30))


def test_added_spans_lie_beside_sure_ones():
    """Random texts of parts that look like personal data: no added span overlaps a base span or another added one."""
    draw = random.Random(5)
    parts = ["1.2.3.4", "%", "@a.bc", "555.123.4567", " ", "+1 (202) 555-0143", "4111 1111 1111 1111", "x", "a at b dot cc", "::", "1:2:3:4:5:6:7:8", "-"]
    fixed = ["1.2.3.4%1.2.3.4%1.2.3.4%1.2.3.4%1.2.3.4%555.123.4567@a.bc"]
    for text in fixed + ["".join(draw.choice(parts) for _ in range(draw.randint(1, 20))) for _ in range(2000)]:
        sure = personal.sure_spans(text)
        added = personal.candidates(text, sure)
        assert not [1 for _, s, e in added for _, a, b in sure if s < b and a < e], text
        assert all(x[2] <= y[1] for x, y in zip(added, added[1:], strict=False)), text
    assert personal.candidates(fixed[0], personal.sure_spans(fixed[0])) == []
    assert [k for k, *_ in personal.candidates("call 555 123 4567 or bob at host dot org, fe80:0:0:0:1:2:3:4", [])] == ["phone", "email", "ip"]
