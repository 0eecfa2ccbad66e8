"""Token ids of whole texts by a public tokenizer, with the ids of frequent pieces remembered."""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Sequence
from itertools import islice

import numpy as np

#: Pieces remembered by one worker, by cut, and the longest one remembered; what is longer or forgotten is encoded again.
KEPT_PIECES, KEPT_CHARS = {"words": 3 << 19, "spaces": 1 << 20}, 48
#: Pieces that are encoded as one text, which costs little more than half of encoding each.
JOINED = 64
#: How a byte tokenizer writes a space and a line end in its vocabulary.
_SPACE, _LINE = "\u0120", "\u010a"
#: Marks a cut; texts that hold it are cut in another way.
CUT = "\x1f"
#: White space beside other white space, at an end, or of another kind; a space or line end in such a text isn't always a cut.
_ODD = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", CUT)
_ODD_WIDE = ("\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000")
_made: dict[tuple[str, str], Encoder] = {}


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes.

    Texts are cut only where the tokenizer itself always starts a new token, so that the pieces' ids joined are the
    text's ids. ``words``: the tokenizer drops white space and lower-cases; a piece lies between spaces and line ends. ``spaces``: a token may begin with one space; a piece starts at a space, and at and after a line end,
    where no other white space is beside it.
    """

    def __init__(self, path: str, cut: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if cut not in ("words", "spaces"):
            raise ValueError(f"unknown cut {cut}")
        self.tokenizer, self.kept = Tokenizer.from_file(path), KEPT_PIECES[cut]
        self.ids = {} if cut == "words" else _Known()
        self.pieces, self.found = (_words, self._by_set) if cut == "words" else (_spaces, self._by_lookup)
        vocabulary, line = self.tokenizer.get_vocab(), self.tokenizer.encode("\n", add_special_tokens=False).ids
        #: By id, whether the token begins with a space or line end; none where pieces can't be told apart by that.
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool) if cut == "spaces" and line == [vocabulary.get(_LINE)] else None
        if self.begins is not None:
            self.begins[[i for token, i in vocabulary.items() if token[:1] in (_SPACE, _LINE)]] = True

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        return self.found([self.pieces(t) for t in texts])

    def _by_set(self, cuts: list[list[str]]) -> list[bytes]:
        """Missing pieces by set operations, then the ids piece by piece; the faster way for words."""
        wanted = set().union(*cuts)
        missing = list(wanted.difference(self.ids))
        if len(self.ids) + len(missing) > self.kept:
            self._forget()
            missing = list(wanted.difference(self.ids))
        self.ids.update(self._direct(missing))
        out = [b"".join(map(self.ids.__getitem__, cut)) for cut in cuts]
        for p in missing:
            if len(p) > KEPT_CHARS:
                del self.ids[p]
        return out

    def _by_lookup(self, cuts: list[list[str]]) -> list[bytes]:
        """One look-up a piece gives its ids or notes that it is missing; the faster way for pieces with spaces."""
        missing, known = self.ids.missing, self.ids.__getitem__
        out = []
        for cut in cuts:
            n = len(missing)
            part = list(map(known, cut))
            out.append(part if len(missing) > n else b"".join(part))
        if missing:
            new, wanted = self._joined(list(dict.fromkeys(missing))), iter(missing)
            out = [x if isinstance(x, bytes) else b"".join([new[next(wanted)] if ids is None else ids for ids in x]) for x in out]
            missing.clear()
            if len(self.ids) + len(new) > self.kept:
                self._forget()
            self.ids.update((p, ids) for p, ids in new.items() if len(p) <= KEPT_CHARS)
        return out

    def _forget(self) -> None:
        """Keep the older half, in which frequent pieces are."""
        self.ids = type(self.ids)(islice(self.ids.items(), self.kept // 2))

    def _direct(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces that aren't remembered; a word with one stop after it is the word's ids and the stop's."""
        stopped = {p: p[:-1] for p in pieces if p[-1:] in (".", ",") and _letters(p[:-1])}
        bases = set(stopped.values())
        ids = self._each([p for p in pieces if p not in stopped and p not in bases] + [p for p in bases if p not in self.ids] + [".", ","])
        ids.update((p, self.ids[p]) for p in bases if p in self.ids)
        ids.update([(p, ids[base] + ids[p[-1]]) for p, base in stopped.items()])
        return ids

    def _joined(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces that aren't remembered; those without white space but a space in front come from joined texts."""
        if self.begins is None:
            return self._each(pieces)
        plain, other = [], []
        for p in pieces:
            (plain if p.split() == [p[p[:1] == " " :]] else other).append(p)
        ids = self._each(other)
        for at in range(0, len(plain), JOINED << 8):
            some = plain[at : at + (JOINED << 8)]
            whole = [p if p[0] == " " else "\n" + p for p in some]
            lines = ["".join(whole[i : i + JOINED]) for i in range(0, len(whole), JOINED)]
            flat = array("I")
            for x in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False):
                flat.extend(x.ids)
            begins = (4 * np.flatnonzero(self.begins[np.frombuffer(flat, "u4")])).tolist()
            if len(begins) != len(some):
                ids.update(self._each(some))
                continue
            data = flat.tobytes()
            ids.update([(p, data[a if p[0] == " " else a + 4 : b]) for p, a, b in zip(some, begins, [*begins[1:], len(data)], strict=True)])
        return ids

    def _each(self, pieces: list[str]) -> dict[str, bytes]:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return {p: array("I", x.ids).tobytes() for p, x in zip(pieces, found, strict=True)}


class _Known(dict):
    """Ids by piece; pieces looked up in vain are noted in ``missing``, in their order."""

    def __init__(self, *items):
        super().__init__(*items)
        self.missing: list[str] = []

    def __missing__(self, piece: str) -> None:
        self.missing.append(piece)


def _plain(text: str) -> bool:
    """Whether composing leaves the text as it is and no letter becomes a letter and a mark in lower case."""
    return text.isascii() or (unicodedata.is_normalized("NFC", text) and "\u0130" not in text)


def _letters(piece: str) -> bool:
    return piece[piece[:1] == " " :].isalpha() and _plain(piece)


def _words(text: str) -> list[str]:
    # lower case is the tokenizer's own next step; where composing or a letter's place may matter, it is left to it
    if _plain(text) and "\u03a3" not in text:
        text = text.lower()
    return text.replace("\n", " ").split(" ")


def _spaces(text: str) -> list[str]:
    odd = text[:1].isspace() or text[-1:].isspace() or any(x in text for x in _ODD)
    if odd or not text.isascii() and any(x in text for x in _ODD_WIDE):
        parts = re.split(r"(?<=\S) (?=\S)", text)
        return parts[:1] + [" " + p for p in parts[1:]]
    return text.replace("\n", f"{CUT}\n{CUT}").replace(" ", CUT + " ").split(CUT)


def encoder(path: str, cut: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if (path, cut) not in _made:
        _made[path, cut] = Encoder(path, cut)
    return _made[path, cut]
