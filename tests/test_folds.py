"""Ordered folds over many chunks against sequential restatements, and the number of passes they take."""

import random

import pytest

from voxtable.operators import folds, ordered

SEGMENT = "recording_id long, pos long, speaker string, start_sec double, end_sec double"
PHRASE = "recording_id long, pos long, text string, start_sec double, end_sec double"


def resolve(rows):
    out, last = [], None
    for pos, speaker, a, b in rows:
        if last is None or a >= last[3]:
            out += [last] if last else []
            last = [pos, speaker, a, b]
        elif speaker == last[1]:
            last[3] = max(last[3], b)
        else:
            cut = max(0.5 * (last[3] + a), last[2] + 0.05)
            last[3] = cut
            if b > cut + 0.15:
                out.append(last)
                last = [pos, speaker, cut, b]
    return [tuple(x) for x in [*out, *([last] if last else [])] if x[3] - x[2] >= 0.2]


def pack(rows, longest=18.0, join=0.6):
    out, cur = [], None
    for a, b in rows:
        if cur is None:
            cur = [a, b]
        elif a - cur[1] <= join and b - cur[0] <= longest:
            cur[1] = max(cur[1], b)
        else:
            out.append(tuple(cur))
            if b - a > longest:
                i = 0
                while a + i * longest < b:
                    out.append((a + i * longest, min(b, a + (i + 1) * longest)))
                    i += 1
                cur = [b, b]
            else:
                cur = [a, b]
    return [x for x in [*out, *([tuple(cur)] if cur else [])] if x[1] > x[0]]


def dedupe(rows):
    kept = []
    for pos, text, a, b in rows:
        last = kept[-1] if kept else None
        if last and text == last[1]:
            last[3] = max(last[3], b)
        elif last and text in last[1] and b <= last[3] + 0.5:
            pass
        elif last and last[1] in text and a <= last[3] + 0.5:
            last[0], last[1], last[3] = pos, text, max(last[3], b)
        else:
            kept.append([pos, text, a, b])
    return [tuple(k) for k in kept]


def stitch(rows):
    out, last = [], None
    for pos, text in rows:
        if last is None:
            added = text
        else:
            p, c = last.split(), text.split()
            k = next((k for k in range(min(len(p), len(c), 16), 0, -1) if p[-k:] == c[:k]), 0)
            added = " ".join(c[k:]) if k else text
        if added:
            out.append((pos, added))
            last = added
    return out


def segments(seed):
    """Gaps, overlaps, gapless stretches of one length, one span over a whole recording, very long and equal spans."""
    draw = random.Random(seed)
    rows = {}
    for rec in range(4):
        t, rows[rec] = 0.0, []
        for pos in range(60):
            t += draw.choice([0.0, 0.0, 0.1, 0.5, 1.0, 3.0])
            rows[rec].append((pos, draw.choice("ab"), round(t, 3), round(t + draw.choice([0.1, 0.3, 1.0, 2.0, 9.0, 30.0]), 3)))
    rows[4] = [(i, "ab"[i % 2], float(i), float(i + 1)) for i in range(150)]
    rows[5] = [(0, "a", 0.0, 500.0), *((i, "ab"[i % 3 == 0], 3.0 * i, 3.0 * i + 1) for i in range(1, 60))]
    rows[6] = [(i, "a", i * 0.5, 200.0) for i in range(100)]
    rows[None] = rows[0][:20]
    return {k: sorted(v, key=lambda r: (r[2], r[3], r[0])) for k, v in rows.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_segments_in_many_chunks(spark, seed):
    rows = segments(seed)
    df = spark.createDataFrame([(k, *r) for k, v in rows.items() for r in v], SEGMENT)
    got = folds.resolve_overlaps(df, chunk_sec=5.0).collect()
    packed = folds.pack_windows(df, chunk_sec=20.0).collect()
    for k, v in rows.items():
        assert sorted((r.pos, r.speaker, r.start_sec, r.end_sec) for r in got if r.recording_id == k) == sorted(resolve(v)), k
        assert sorted((r.start_sec, r.end_sec) for r in packed if r.recording_id == k) == sorted(pack([r[2:] for r in v])), k


def test_texts_in_many_chunks(spark):
    draw = random.Random(3)
    said = {k: [" ".join(draw.choice("abcd") for _ in range(draw.choice([1, 2, 2, 5, 20]))) for _ in range(80)] for k in range(3)}
    said[3] = ["the same words"] * 90
    said[4] = ["a b c", "a b", "b c"] * 30
    said[None] = said[0][:10]
    rows = {k: [(i, t, float(i), i + 1.4) for i, t in enumerate(v)] for k, v in said.items()}
    df = spark.createDataFrame([(k, *r) for k, v in rows.items() for r in v], PHRASE)
    phrases = folds.dedupe_phrases(df, chunk_rows=4).collect()
    pieces = folds.stitch_chunks(df, chunk_rows=4).collect()
    for k, v in rows.items():
        assert sorted((r.pos, r.text, r.start_sec, r.end_sec) for r in phrases if r.recording_id == k) == dedupe(v), k
        assert sorted((r.pos, r.text) for r in pieces if r.recording_id == k) == stitch([r[:2] for r in v if len(r[1].strip(" .,?!")) >= 2]), k


@pytest.mark.parametrize("rule", ["resolve_overlaps", "pack_windows", "dedupe_phrases", "stitch_chunks", "drop_near_repeats"])
def test_passes_do_not_grow_with_chunks(spark, monkeypatch, rule):
    """Equal texts, one speaker all along, and a gapless stretch: ten chunks and a hundred take the same number of written tables."""
    written = []
    monkeypatch.setattr(ordered, "durable", lambda df, keep=ordered.durable: written.append(1) or keep(df))
    counts = []
    for chunks in (10, 100):
        written.clear()
        if rule in ("resolve_overlaps", "pack_windows"):
            rows = [(1, i, "a", i * 1.0, i + 1.0 + 0.5 * (rule == "resolve_overlaps")) for i in range(chunks * 20)]
            out = getattr(folds, rule)(spark.createDataFrame(rows, SEGMENT), chunk_sec=20.0)
        else:
            rows = [(1, i, "all of these are the same", i * 1.0, i + 1.0) for i in range(chunks * 4)]
            out = getattr(folds, rule)(spark.createDataFrame(rows, PHRASE), chunk_rows=4)
        assert out.count() == (-(-chunks * 20 // 18) if rule == "pack_windows" else 1)
        counts.append(len(written))
    assert counts[0] == counts[1]
