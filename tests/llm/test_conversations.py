"""Conversation repair against all ways to edit short conversations, and against one pass over a long one."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from voxtable.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, cost string, audit int"
GRAMMAR = re.compile("(s?(ua)+)?")


def faulty(rows):
    """Rows of one conversation with the faults of `damaged`, in order."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        out += [(turn, "user" if f == 4 else role, text)] * (0 if f == 0 else 2 if f == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))


def faults(rows):
    out = []
    for i, (_, role, text) in enumerate(rows):
        end = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not end else "duplicate" if (role, text) in [r[1:] for r in rows[:i]] else "truncated" if end[-1] not in ".!?" else "")
    return out


def cheapest(rows, kinds):
    """Least (cost, audit) and its texts over all edits, with up to two insertions at each place."""
    best = None
    gaps = ["", "I", "II"]
    for ops in itertools.product("KRD", repeat=len(rows)):
        if any(k in ("blank", "duplicate") and o != "D" for k, o in zip(kinds, ops, strict=True)):
            continue
        for put in itertools.product(gaps, repeat=len(rows) + 1):
            audit = put[0] + "".join(o + p for o, p in zip(ops, put[1:], strict=True))
            cost = 5 * audit.count("I") + audit.count("R") + 2 * audit.count("D") + 5 * sum(k == "truncated" and o != "D" for k, o in zip(kinds, ops, strict=True))
            if best and (cost, audit) >= best[:2]:
                continue
            fixed = [rows[i][1][:1] or "-" for i, o in enumerate(ops) if o == "K"]
            free = audit.replace("D", "")
            for roles in itertools.product("ua", repeat=len(free) - len(fixed)):
                kept, new = iter(fixed), iter(roles)
                if GRAMMAR.fullmatch(initials := "".join(next(kept) if o == "K" else next(new) for o in free)):
                    texts, i = [], 0
                    for o in audit:
                        if o != "D":
                            name = rows[i][1] if o == "K" else {"u": "user", "a": "assistant"}[initials[len(texts)]]
                            texts.append(f"{name}:{'' if o == 'I' else rows[i][2]}")
                        i += o != "I"
                    best = (cost, audit, "\n".join(texts))
                    break
    return best


def answer(spark, rows):
    df = conversations.damaged(spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA))
    report = conversations.repair_report(df)
    shas = {r["conv_id"]: r["sha256"] for r in conversations.digests(conversations.repaired(df, report)).collect()}
    return {r["conv_id"]: (*(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")), shas.get(r["conv_id"])) for r in report.collect()}


@pytest.fixture(scope="module")
def made():
    draw = random.Random(8)
    rows = []
    for conv in [None, *range(140)]:
        for turn in range(draw.randint(1, 4)):
            role = draw.choice(["system", "user", "user", "assistant", "assistant", "tool", None, ""])
            rows.append((conv, draw.choice([turn, turn, turn + 3, None]), role, draw.choice(["Yes.", "No!", "so", "a. \t", None, "", "é?"])))
    return rows + rows[:3]


def test_repair_by_brute_force(spark, made):
    got = answer(spark, made)
    assert set(got) == {r[0] for r in made}
    audits = set()
    for conv in got:
        rows = faulty([r for r in made if r[0] == conv])
        kinds = faults(rows)
        turns = {t for t, *_ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        if len(rows) > 5:
            continue
        cost, audit, text = cheapest(rows, kinds)
        sha = hashlib.sha256(text.encode()).hexdigest() if text else None
        assert got[conv] == (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, sha), (conv, rows)
        audits.add(audit)
    assert {"K", "R", "D"} <= set("".join(audits)) and "" in audits  # deleting a neighbour is always cheaper than an insertion


def test_long_conversation_in_blocks(spark, monkeypatch):
    """Signatures cut every few rows give what one pass over all rows gives."""
    draw = random.Random(4)
    rows = [(7, t, draw.choice(["system", "user", "assistant"]), f"{t}" + draw.choice([".", "!", ""])) for t in range(700)]
    whole = answer(spark, rows)
    monkeypatch.setattr(conversations, "LONGEST", 3)
    assert answer(spark, rows) == whole
    state = conversations.END
    kept = faulty(rows)
    for (_, role, _), kind in zip(reversed(kept), reversed(faults(kept)), strict=True):
        state = conversations.node("X" if kind in ("blank", "duplicate") else role[0].upper() if kind else role[0], state)
    best = min(x for o, x in enumerate(state[0]) if o in conversations.COMPLETE)
    assert whole[7][5:7] == best
    assert answer(spark, rows[:0]) == {}
