"""Secret scans: base spans by trying every place, and what assignments give to sensitive names."""

import random
import re

from voxtable.llm import secrets

CODE = """
first = "q8R!x2#Lm9@zT4"
password = first
cfg["client_secret"] = "aB3$dE5^gH7&"
passphrase: correct-Horse7-battery
const authKey: string = 'Zx9!kk22LLmm';
a = b = "p4$$W0rd!!xyz"
self.dbPass = a
export SESSION_KEY=8f7d6c5b4a39281706
"private key": "MIIEvQ+/abc123DEF456=="
base = "xK9-pp" + "Qw7!rT55"
set_token = wrap(base)
credentials => "${first}"
'vault_passphrase' => 'C0mplex|Phrase+1'
"""
CLEAN = """
name = "John Smith"
url = "http://example.com/abc/Def123"
public_key = "MIIEvQ+/abc123DEF456=="
password_hint = "my first pet Rex99"
passphrase = "changeme"
credentials = os.environ["FOO"]
pwd = "<your password>"
later = password2
password2 = later
time: 12:30:45
"""


def brute(text):
    """Base spans, each kind by matching at every place from the left."""
    out = []
    patterns = {
        "assign": (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6),
        "access": ("AKIA[A-Z0-9]+", 0, 20),
        "hex": ("[0-9a-f]+", 0, 24),
    }
    for kind, (pattern, group, least) in patterns.items():
        at, find = 0, re.compile(pattern, re.A)
        while at < len(text):
            m = find.match(text, at)
            if m and len(m[group]) >= least:
                out.append((kind, m.start(), m.end()))
            at = m.end() if m else at + 1
    return out


def test_base_spans_by_brute_force():
    draw = random.Random(2)
    parts = ["password", "passwd", "SECRET", "token", "apikey", "api_key", "api__key", '"', "'", " ", ":", "=", "abcdef", "x1", "AKIA", "ABCDEFGHIJ", "0123456789abcdef", "f", "é", "ſecret", "toKen", "\n", "-", "."]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(1, 25)))
        assert sorted(secrets.sure_spans(text)) == sorted(brute(text)), text


def test_literals_of_sensitive_names():
    sure = secrets.sure_spans(CODE)
    found = {CODE[s:e]: name for _, s, e, _, name in secrets.literal_spans(CODE, sure, 0.8)}
    assert found == {
        "q8R!x2#Lm9@zT4": "password", "aB3$dE5^gH7&": "client_secret", "correct-Horse7-battery": "passphrase", "Zx9!kk22LLmm": "authKey",
        "p4$$W0rd!!xyz": "self.dbPass", "8f7d6c5b4a39281706": "SESSION_KEY", "MIIEvQ+/abc123DEF456==": "private key",
        "xK9-pp": "set_token", "Qw7!rT55": "set_token", "C0mplex|Phrase+1": "vault_passphrase",
    }
    assert secrets.literal_spans(CLEAN, [], 0.8) == []


def test_constants_follow_program_order():
    text = 'k = "Zx9!kk22LLmm"\npassword = k\nk = "plain words only"\nk2 = "Qw7!rT55-aa"\nk3 = k2\nk4 = k3 + "!"\npwd = k4\nk2 = "Unused9$zz"\n'
    got = {text[s:e] for _, s, e, _, _ in secrets.literal_spans(text, [], 0.8)}
    assert got == {"Zx9!kk22LLmm", "Qw7!rT55-aa"}


def test_rows(spark):
    rows = [(1, CODE, "x"), (1, CODE, "x"), (None, "token = abcdefgh", None), (2, None, "s"), (3, "", "s"), (4, "a = " * 100_000 + 'pwd = "Zx9!kk22LLmm"', "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = secrets.find_secrets(df).collect()
    assert sorted((r["doc_id"] or 0, len(r["spans"])) for r in got) == [(0, 1), (1, 10), (1, 10), (2, 0), (3, 0), (4, 1)]
    assert all(list(r["spans"]) == sorted(r["spans"], key=lambda x: (x["start"], secrets.KINDS.index(x["kind"]), x["end"])) for r in got)
    assert secrets.find_secrets(df.limit(0)).count() == 0
