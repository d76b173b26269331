"""Sentences and Chinese words: sequential rules, so functions of a whole text, run in Arrow batches."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicon import catalogue
from ..lexicon.words import HAN
from .batches import Table, kept, rowwise

ABBREVIATIONS = frozenset("dr mr mrs ms prof sr jr st vs etc inc ltd co corp dept est fig no nr vol art al approx dott sig ing avv ecc pag es tel bzw usw ggf evtl ca mme mlle av p ej ud uds".split())
_PIECES = re.compile(r"https?://\S+|[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}|[^\W\d_]+|\d+(?:[.,]\d+)*|\r?\n|[^\S\n]+|" + "|".join(re.escape(c) + "+" for c in ".!?…\"'”’»)]}") + "|.")
_STOPS = frozenset(".!?…\r\n")
_CLOSING = set("\"'”’»)]}")


def split_sentences(text: str, iso3: str = "eng") -> list[str]:
    """Sentences of a text. A run of . ! ? … ends one, unless it stands behind an abbreviation, a short function word of the language or a
    single letter, or is an ellipsis; it needs white space and a capital behind it, or a closing quote. An empty line ends one,
    so does a line end before a capital. What holds no word is no sentence."""
    short = kept(("short", iso3), lambda: _short(iso3))
    pieces = _PIECES.findall(text)
    out, begin = [], 0

    def close(end: int) -> None:
        nonlocal begin
        if any(p[0].isalpha() for p in pieces[begin:end]):
            out.append("".join(pieces[begin:end]).strip())
        begin = end

    n = len(pieces)
    for i in [i for i, p in enumerate(pieces) if p[0] in _STOPS]:
        p = pieces[i]
        after = pieces[i + 1] if i + 1 < n else ""
        if p[0] in "\r\n":
            if p in ("\n", "\r\n") and (after in ("\n", "\r\n") or after[:1].isupper()):
                close(i + 1)
            continue
        if p.startswith("...") or p == "…":
            continue
        last = pieces[i - 1].lower() if i else ""
        if p == "." and (last in short or (len(last) == 1 and last.isalpha())):
            continue
        if not after:
            close(i + 1)
        elif after[0] in _CLOSING:
            close(i + 2)
        elif after.isspace():
            j = i + 2
            while j < n and pieces[j].isspace():
                j += 1
            if j == n or pieces[j][0].isupper() or not pieces[j][0].isalpha():
                close(i + 1)
    close(n)
    return out


def _short(iso3: str) -> frozenset[str]:
    lex = catalogue().get(iso3) or catalogue()["eng"]
    return frozenset(w for w in lex.function_words if len(w) <= 4) | ABBREVIATIONS


def sentences(text: Column | str, iso3: Column | str = "eng") -> Column:
    """Array of sentences; iso3: a column, or one code for all."""
    return rowwise(lambda x, k: split_sentences(x or "", k or "eng"), "array<string>", text, iso3 if isinstance(iso3, Column) else F.lit(iso3))


def _lengths(words: frozenset[str], longest: int) -> dict[str, list[int]]:
    """By first character: lengths of the words that begin with it, over 1, rising."""
    out: dict[str, set[int]] = {}
    for w in words:
        if 1 < len(w) <= longest:
            out.setdefault(w[0], set()).add(len(w))
    return {k: sorted(v) for k, v in out.items()}


def segment_han(text: str, words: frozenset[str] = HAN, longest: int = 8) -> list[str]:
    """Words of a run of Han characters with the largest sum of squared lengths; characters in no word stand alone. Of equal
    segmentations, the one with the shorter word first."""
    lengths = kept(("han", words, longest), lambda: _lengths(words, longest))
    best, step = [0] * (len(text) + 1), [1] * (len(text) + 1)
    for i in reversed(range(len(text))):
        top = 1 + best[i + 1]
        for n in lengths.get(text[i], ()):
            if i + n <= len(text) and n * n + best[i + n] > top and text[i : i + n] in words:
                top, step[i] = n * n + best[i + n], n
        best[i] = top
    out, i = [], 0
    while i < len(text):
        out.append(text[i : i + step[i]])
        i += step[i]
    return out


_HAN_PIECES = re.compile(r"[一-鿿㐀-䶿]+|[^\W_]+|[^\s]")


def split_han(text: str) -> list[str]:
    """Tokens of a text; short runs of Han characters, which often come again, are segmented once."""
    short = kept("short han", lambda: Table(segment_han, 1 << 14))
    out: list[str] = []
    for run in _HAN_PIECES.findall(text):
        if "㐀" <= run[0] <= "鿿":
            out += short[run] if len(run) <= 16 else segment_han(run)
        else:
            out.append(run)
    return out


def han_words(text: Column | str) -> Column:
    """Array of tokens, runs of Han characters segmented, the rest by blanks and signs."""
    return rowwise(lambda x: split_han(x or ""), "array<string>", text)
