"""Personal data: sure patterns, and further spans that weak labelers vote for."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups_of, small_batches, texts

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:long,end:long,sure:boolean,score:double>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_NUMBER = re.compile(r"(?<![\w+.-])\+?\(?[0-9]{1,5}\)?(?:[ ./-]{1,2}\(?[0-9]{1,5}\)?){1,7}(?![\w])|(?<![\w+.-])[0-9]{7,19}(?![\w])")
_SPELLED = re.compile(r"\b[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{2,63}){1,4}\b", re.I)
_SIX = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])")

#: Words near a span that speak for its kind, and words that speak for another meaning of a number.
CUES = {
    "email": re.compile(r"\b(?:e-?mails?|mail|contact|write|reach|address)\b", re.I),
    "ip": re.compile(r"\b(?:ip|ipv6|host|server|address|client|ping)\b", re.I),
    "card": re.compile(r"\b(?:card|credit|debit|visa|mastercard|amex|payment)\b", re.I),
    "phone": re.compile(r"\b(?:tel|phones?|telephone|call|fax|mobile|cell|whatsapp|contact)\b", re.I),
}
OTHER = re.compile(r"\b(?:order|invoice|isbn|issn|version|token|date|year|page|pages|serial|ticket|id|no|nr|article|part|patent)\b", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def sure_spans(text: str) -> list[tuple[str, int, int]]:
    """The base patterns' spans: leftmost, not overlapping within a kind, failing matches dropped without another try.

    An email is looked for from its @, so that long runs of word characters cost one step a character.
    """
    out = []
    free = at = 0
    while (at := text.find("@", at)) >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at) if begin < at else None
        if found:
            out.append(("email", begin, found.end()))
        at = free = found.end() if found else at + 1
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = only_digits(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(only_digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def candidates(text: str, sure: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that may be personal data beyond the sure ones, none of which overlaps a sure one."""
    found = []
    for m in _NUMBER.finditer(text):
        n = len(only_digits(m[0]))
        if 7 <= n <= 19:
            found.append(("phone" if n <= 12 else "card", *m.span()))
    low = text.lower()
    if "at" in low and "dot" in low:
        found += [("email", *m.span()) for m in _SPELLED.finditer(text)]
    if ":" in text:
        found += [("ip", *m.span()) for m in _SIX.finditer(text)]
    starts, reach = [], []  # of the sure spans in order: where they begin, and how far any up to there goes
    for s, e in sorted((s, e) for _, s, e in sure):
        starts.append(s)
        reach.append(max(e, reach[-1]) if reach else e)
    out, end = [], -1
    for kind, s, e in sorted(found, key=lambda x: (x[1], -x[2])):
        i = bisect_left(starts, e)
        if s >= end and not (i and reach[i - 1] > s):
            out.append((kind, s, e))
            end = e
    return out


def votes(text: str, kind: str, start: int, end: int, sure: bool) -> tuple[int, ...]:
    """What each labeler says of a span: 1 personal, -1 not, 0 nothing.

    In order: the pattern (its strictness), the gazetteer of cue words before the span, the gazetteer of words for other
    numbers, the digits (checksum or usual length), and the context (the characters beside it).
    """
    body, digits = text[start:end], only_digits(text[start:end])
    before = text[max(0, start - 40) : start]
    grouped = len(re.findall(r"[ ()./-]+", body)) >= 2
    pattern = 1 if sure or kind in ("email", "ip") else (1 if kind == "phone" and grouped else 0)
    cue = 1 if CUES[kind].search(before) else 0
    other = -1 if OTHER.search(before) else 0
    if kind == "card":
        shape = 1 if luhn(digits) and len(digits) in (13, 14, 15, 16, 19) else -1
    elif kind == "phone":
        shape = 1 if 9 <= len(digits) <= 15 else -1
    else:
        shape = 0
    beside = text[max(0, start - 1) : start] + text[end : end + 1]
    context = -1 if any(c.isalnum() or c in "=_#\"'/$%&*" for c in beside) else (1 if cue else 0)
    return pattern, cue, other, shape, context


def described(text: str, kind: str, start: int, end: int, sure: bool) -> tuple[int, ...]:
    """The classifier's view of a span: kind, votes, number of digits and of separators; few distinct values."""
    body = text[start:end]
    gaps = sum(not c.isalnum() for c in body)
    return (KINDS.index(kind), *votes(text, kind, start, end, sure), min(20, len(only_digits(body))), min(4, gaps))


def _encoded(views: np.ndarray) -> np.ndarray:
    """One-hot columns of (kind), (kind, vote) for each labeler, and (kind, separators), with digits scaled."""
    kind = np.eye(len(KINDS))[views[:, 0]]
    said = [np.eye(3)[views[:, j] + 1] for j in range(1, 6)]
    gaps = np.eye(5)[views[:, 7]]
    both = [(kind[:, :, None] * x[:, None, :]).reshape(len(views), -1) for x in (*said, gaps)]
    return np.hstack([kind, *said, *both, views[:, 6:7] / 20.0])


@dataclass
class SpanModel:
    """Labeler reliabilities by kind (share of right votes as estimated) and the span classifier's weights."""

    reliability: np.ndarray
    weights: np.ndarray

    def score(self, views: list[tuple[int, ...]]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(_encoded(np.array(views)) @ self.weights)))


def expectation_maximisation(views: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior that each view is personal, and each labeler's reliability by kind, from votes alone.

    Labelers are taken as independent given the truth; P(vote | truth) is estimated for each kind with weak counts that
    favour labelers better than chance, starting from the majority of the votes.
    """
    said = views[:, 1:6]
    posterior = 1.0 / (1.0 + np.exp(-1.5 * (said.sum(axis=1) - 0.5)))
    reliability = np.full((len(KINDS), 5), 0.5)
    hope = np.array([[4.0, 2.0, 1.0], [1.0, 2.0, 4.0]])  # truth no or yes, vote -1, 0, 1
    for _ in range(rounds):
        for k in range(len(KINDS)):
            own = views[:, 0] == k
            if not own.any():
                continue
            weight = np.stack([(1 - posterior[own]) * counts[own], posterior[own] * counts[own]])
            prior = (weight.sum(axis=1) + 1.0) / (weight.sum() + 2.0)
            odds = np.log(prior)[:, None] + np.zeros((2, own.sum()))
            for j in range(5):
                v = said[own, j] + 1
                table = hope + np.stack([np.bincount(v, w, 3) for w in weight])
                table /= table.sum(axis=1, keepdims=True)
                odds += np.log(table)[:, v]
                right = weight[0] @ (v == 0) + weight[1] @ (v == 2)
                cast = weight.sum(axis=0) @ (v != 1)
                reliability[k, j] = (right + 1.0) / (cast + 2.0)
            posterior[own] = 1.0 / (1.0 + np.exp(np.clip(odds[0] - odds[1], -50, 50)))
    return posterior, reliability


def _regression(x: np.ndarray, soft: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Logistic regression on soft labels with a small ridge, by gradient steps with momentum."""
    w, speed = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    share = np.sqrt(counts) / np.sqrt(counts).sum()
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-(x @ w)))
        speed = 0.9 * speed - 0.5 * (x.T @ (share * (p - soft)) + 1e-3 * w)
        w = w + speed
    return w


def train_span_model(docs: DataFrame) -> SpanModel:
    """Estimate the labelers' reliabilities over all spans of all documents and train the span classifier on the result.

    Spans are counted by their view (kind, votes, digits, separators), of which there are at most some ten thousand
    whatever the input. Without any span the classifier accepts nothing.
    """
    small_batches(docs.sparkSession)
    width = 8

    def count(batches):
        seen: Counter = Counter()
        for (some,) in groups_of(batches, ["text"], 1 << 20):
            for text in some:
                sure = sure_spans(text)
                seen.update(described(text, *x, True) for x in sure)
                seen.update(described(text, *x, False) for x in candidates(text, sure))
        if seen:
            views = pa.array([list(v) for v in seen], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([views, pa.array(list(seen.values()))], ["view", "n"])

    got = texts(docs).select("text").mapInArrow(count, "view array<long>, n long").groupBy("view").agg(F.sum("n").alias("n")).orderBy("view").collect()
    views = np.array([r["view"] for r in got], np.int64).reshape(-1, width)
    counts = np.array([r["n"] for r in got], float)
    posterior, reliability = expectation_maximisation(views, counts)
    if not len(views):
        none = np.zeros(_encoded(np.zeros((1, width), np.int64)).shape[1])
        none[: len(KINDS)] = -50.0
        return SpanModel(reliability, none)
    return SpanModel(reliability, _regression(_encoded(views), posterior, counts))


def find_personal_data(docs: DataFrame, model: SpanModel, accept: float = 0.9) -> DataFrame:
    """doc_id and spans, one row for each row of ``docs``: kind, start and end in code points, sure, score.

    Sure spans are the base patterns' and always stay, with score 1; others are candidates whose score is at least
    ``accept`` and that overlap no sure span. Spans are ordered by kind (email, ip, card, phone), then start. A null or
    empty text has none; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("sure", pa.bool_()), ("score", pa.float64())]))

    def spans(text: str) -> list[dict]:
        sure = sure_spans(text)
        more = candidates(text, sure)
        scores = sent.value.score([described(text, *x, False) for x in more]) if more else []
        rows = [(*x, True, 1.0) for x in sure] + [(*x, False, float(s)) for x, s in zip(more, scores, strict=True) if s >= accept]
        rows.sort(key=lambda x: (KINDS.index(x[0]), x[1]))
        return [dict(zip(("kind", "start", "end", "sure", "score"), x, strict=True)) for x in rows]

    def find(batches) -> Iterator[pa.RecordBatch]:
        for ids, some in groups_of(batches, ["doc_id", "text"], 1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([spans(t) for t in some], kind)], ["doc_id", "spans"])

    return texts(docs).mapInArrow(find, f"doc_id long, spans {SPANS}")
