"""Secrets in texts: sure patterns, and literals that assignments give to sensitive names."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import groups_of, small_batches, texts

KINDS = ("assign", "access", "hex", "literal")
SPANS = "array<struct<kind:string,start:long,end:long,sure:boolean,score:double,name:string>>"

_ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
_HEX = re.compile("[0-9a-f]{24,}")


def sure_spans(text: str) -> list[tuple[str, int, int]]:
    """The base patterns' spans: leftmost, not overlapping within a kind, failing matches dropped without another try."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end() - m.start(1) >= 6]
    out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    return out + [("hex", *m.span()) for m in _HEX.finditer(text)]


#: A name as source code and configuration write it, quoted or in brackets or not, and the sign that gives it a value.
_TARGET = re.compile(
    r"(?<![\w$.-])(?:[\"'`]([A-Za-z_][\w .$-]{0,78}[\w])[\"'`]\]?|([A-Za-z_$][\w$]*+(?:(?:[.-]|->|::)[\w$]++)*+)(?:\[[\"']([\w.$-]+)[\"']\])?)"
    r"[ \t]*+(?::[ \t]*+[A-Za-z_][\w.<>\[\]]*+[ \t]*+(?==[^=>]))?(?::=|=>|\?=|\+=|=(?![=~])|:(?!:|//))[ \t]*+",
    re.A,
)
#: Parts of a value: a quoted literal, an expansion, a call that reads a name, a name, and what joins parts.
_QUOTED = re.compile(r"[bfruBFRU]{0,2}(\"\"\"|'''|[\"'`])((?:\\.|(?!\1)[^\\\n])*+)\1")
_EXPANDED = re.compile(r"\$\{?([A-Za-z_][\w.]*)\}?|\{\{\s*([A-Za-z_][\w.]*)\s*\}\}|%\(?([A-Za-z_]\w*)\)?[s%]", re.A)
_CALL = re.compile(r"(?:new[ \t]+)?[A-Za-z_][\w.]*\([ \t]*", re.A)
_NAME = re.compile(r"[A-Za-z_$][\w$]*+(?:(?:[.]|->|::)[\w$]++)*+(?![\w$(])", re.A)
_JOIN = re.compile(r"\)*[ \t]*(?:\+|\.\.|\.(?=[ \t]*[\"'$])|\|\||&)[ \t]*")
_BESIDE_QUOTES = re.compile(r"[ \t]*(?:\\[ \t]*\n[ \t]*)?(?=[\"'])")
#: An unquoted literal of configuration: up to white space or a sign that ends values.
_BARE = re.compile(r"[^\s\"'`,;(){}<>\[\]|]{6,}+(?![\[(])")

#: Words of names that hold secrets, by strength. Fixed values of this detector.
STRONG = frozenset("password passwd passphrase passcode pwd secret token apikey credential credentials bearer privatekey secretkey accesskey authkey".split())
#: Words that make a secret only beside a second one, as in api key or db pass.
HALF = frozenset("key pass auth pin salt signature cert seed nonce code".split())
BESIDE = frozenset("api access private secret client encryption signing session master account auth db database admin root user login service shared storage webhook hmac aes jwt ssh license".split())
#: Words that say the value is about a secret, not one.
ABOUT = frozenset("public id name file path url uri type length len count size policy hint label field prompt format class header expires expiry ttl min max regex pattern index column enabled required".split())
_PLACEHOLDER = re.compile(r"(?i)example|change_?me|your[_-]|dummy|placeholder|redacted|sample|insert|todo|xxx|\*\*\*|\.\.\.|<|^\$|^%|\{\{|^(?:none|null|true|false|undefined|password|secret|string|token)$|^(.)\1*$")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_weight(name: str) -> float:
    """How much a target name speaks for a secret; below 0: for none."""
    parts = [w.lower() for w in _WORDS.findall(name)]
    joined = {a + b for a, b in zip(parts, parts[1:], strict=False)} | set(parts)
    strong = any(w in STRONG or w.rstrip("s") in STRONG for w in joined)
    half = any(w in HALF for w in parts) and any(w in BESIDE for w in parts)
    if not parts or parts[-1] in ABOUT or "public" in parts:
        return -3.0
    return 3.0 if strong else 2.5 if half else 0.5 if parts[-1] in HALF else -3.0


def literal_weight(value: str) -> float:
    """How much a literal looks like a secret: length, bits a character, kinds of characters; placeholders don't."""
    if len(value) < 6 or _PLACEHOLDER.search(value):
        return -6.0
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(bool(re.search(x, value)) for x in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9\s]"))
    prose = value.count(" ") >= 2 or value.isalpha() and (value.islower() or value.istitle())
    return min(2.0, (bits - 2.0) * 0.8) + 0.7 * (kinds - 1) + min(1.0, (n - 8) / 16) - 2.0 * prose - 1.0 * value.startswith(("/", "http"))


@dataclass
class Given:
    """What one assignment gives to its names: literals of its own (start, end) and what names in it stand for."""

    names: list[str]
    literals: list[tuple[int, int]]
    whole: str
    parts: list[Given]
    weight: float = -math.inf
    name: str = ""


def _value(text: str, at: int, known: dict[str, Given]) -> tuple[int, list[tuple[int, int]], list[Given]]:
    """Read an expression of quoted literals, names, expansions and calls around them: where it ends, its literals, its names' values."""
    literals, parts = [], []

    def meant(name: str) -> None:
        given = known.get(name) or known.get(_last(name))
        if given and (not parts or parts[-1] is not given):
            parts.append(given)

    while True:
        while call := _CALL.match(text, at):
            at = call.end()
        if quoted := _QUOTED.match(text, at):
            for e in _EXPANDED.finditer(quoted[2]):
                meant(e[1] or e[2] or e[3])
            if quoted[2] and not _EXPANDED.fullmatch(quoted[2]):
                literals.append(quoted.span(2))
            at = quoted.end()
            if beside := _BESIDE_QUOTES.match(text, at):
                at = beside.end()
                continue
        elif e := _EXPANDED.match(text, at):
            meant(e[1] or e[2] or e[3])
            at = e.end()
        elif (name := _NAME.match(text, at)) and (known.get(name[0]) or known.get(_last(name[0]))):
            meant(name[0])
            at = name.end()
        else:
            return at, literals, parts
        join = _JOIN.match(text, at)
        if not join:
            return at, literals, parts
        at = join.end()


def assignments(text: str) -> list[Given]:
    """What the text assigns to names, in order.

    Names, with or without quotes, are followed by =, :, :=, => and the like. A value is a row of quoted literals, names,
    expansions such as ${NAME} and calls around them, or one bare literal as configuration writes it. A name stands for
    what was last given to it before (its last part too: `key` for `self.key`); in `a = b = "x"` both get the literal.
    A bare word to which the text itself assigns something is a name, not a literal. The text is read once from left to
    right, in linear time.
    """
    out: list[Given] = []
    bare_words: list[Given] = []
    known: dict[str, Given] = {}
    names: list[str] = []
    at = 0
    while m := _TARGET.search(text, at):
        names.append(m[3] or m[1] or m[2])
        at, literals, parts = _value(text, m.end(), known)
        bare_end = -1
        if at == m.end():
            if (chained := _TARGET.match(text, at)) and chained[0].rstrip(" \t").endswith("="):
                continue
            if bare := _BARE.match(text, at):
                literals, at = [bare.span()], bare.end()
                bare_end = at
        if literals or parts:
            given = Given(names, literals, "".join(text[s:e] for s, e in literals), parts)
            out.append(given)
            for name in names:
                known[name] = known[_last(name)] = given
            if at == bare_end:
                bare_words.append(given)
        names = []
    for given in bare_words:
        if given.whole in known:
            given.literals = []
    return out


def weigh(given: list[Given]) -> None:
    """Give each the weight of the most sensitive name that it reaches: what is given on comes earlier in the text, so one pass back is enough."""
    for x in reversed(given):
        x.weight, x.name = max((x.weight, x.name), *((name_weight(n), n) for n in x.names))
        for part in x.parts:
            part.weight, part.name = max((part.weight, part.name), (x.weight, x.name))


def _last(name: str) -> str:
    return re.split(r"[.]|->|::", name)[-1]


def literal_spans(text: str, sure: list[tuple[str, int, int]], accept: float) -> list[tuple[str, int, int, float, str]]:
    """Assigned literals whose score is at least ``accept`` and that reach beyond every sure span, with the name that speaks most for it."""
    if ":" not in text and "=" not in text:
        return []
    given = assignments(text)
    weigh(given)
    inside, far = [], 0
    for s, e in sorted((s, e) for _, s, e in sure):
        far = max(far, e)
        inside.append((s, far))
    out, i = [], 0
    for x in given:
        score = 1.0 / (1.0 + math.exp(-(x.weight + literal_weight(x.whole) - 2.0))) if x.literals else 0.0
        for s, e in x.literals if score >= accept else []:
            while i < len(inside) and inside[i][0] <= s:
                i += 1
            if not i or inside[i - 1][1] < e:
                out.append(("literal", s, e, score, x.name))
    return out


def find_secrets(docs: DataFrame, accept: float = 0.8) -> DataFrame:
    """doc_id and spans, one row for each row of ``docs``: kind, start and end in code points, sure, score, name.

    Sure spans are the base patterns' and always stay, with score 1 and no name. Others are of kind `literal`: literals
    without their quotes that an assignment gives to a sensitive name, at once or through other names, scored by name and
    by literal; one that lies in a sure span is left out. Spans are ordered by start, then kind (assign, access, hex,
    literal), then end. A null or empty text has none, repeated rows are each reported, a null doc_id stays null, an empty
    table has no rows; other columns are ignored. Each text is read by itself, whole, in linear time.
    """
    small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("sure", pa.bool_()), ("score", pa.float64()), ("name", pa.string())]))

    def spans(text: str) -> list[dict]:
        sure = sure_spans(text)
        rows = [(k, s, e, True, 1.0, None) for k, s, e in sure]
        rows += [(k, s, e, False, score, name) for k, s, e, score, name in literal_spans(text, sure, accept)]
        rows.sort(key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
        return [dict(zip(("kind", "start", "end", "sure", "score", "name"), x, strict=True)) for x in rows]

    def find(batches) -> Iterator[pa.RecordBatch]:
        for ids, some in groups_of(batches, ["doc_id", "text"], 1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([spans(t) for t in some], kind)], ["doc_id", "spans"])

    return texts(docs).mapInArrow(find, f"doc_id long, spans {SPANS}")
