"""Tokenizer A and what is asked of its tokens, in Python. A token comes again and again, so what is known of it is made once and kept
by the worker; a text is then a few look-ups for each of its tokens."""

from __future__ import annotations

import re
from collections import Counter
from unicodedata import category

from ..lexicon import Lexicon, catalogue, descriptive_pattern, exclusive_markers
from .batches import Table, kept
from .text import TOKEN

ENDERS = (".", "!", "?", "…")
LEAST_RATIO = 0.02
#: Characters whose classes the quick patterns name one by one; of texts with any other, regex tells letters, marks and numbers.
_OTHER = re.compile("[^\x00-ɏ -⁯₠-⃀]")
_L, _N = "A-Za-z\xAA\xB5\xBA\xC0-\xD6\xD8-\xF6\xF8-ɏ", "0-9\xB2\xB3\xB9\xBC-\xBE"
_TOKEN = re.compile(rf"[{_L}]+(?:'[{_L}]+)?|[{_N}]+(?:[.,][{_N}]+)?|[^\t\n\x0B\f\r ]")
_TERM = re.compile(rf"[{_L}{_N}]+")
_LETTERS = re.compile(rf"[{_L}]+")


def tokens(text: str) -> list[str]:
    """Tokenizer A; blanks are those of Java's regular expressions."""
    if not _OTHER.search(text):
        return _TOKEN.findall(text)
    import regex

    return regex.findall(TOKEN.replace(r"[^\s]", r"[^\t\n\x0B\f\r ]"), text)


def letter_runs(lowered: str):
    """A function from a part of a text to its runs of letters and marks; the text in lower case tells which."""
    if not _OTHER.search(lowered):
        return _LETTERS.findall
    import regex

    return regex.compile(r"[\p{L}\p{M}]+").findall


def terms(lowered: str) -> list[str]:
    """Retrieval terms of a text in lower case."""
    if not _OTHER.search(lowered):
        return _TERM.findall(lowered)
    import regex

    return regex.findall(r"[\p{L}\p{N}\p{M}]+", lowered)


def is_punct(x: str) -> bool:
    return len(x) == 1 and not x.isalnum() and category(x)[0] not in "LNM"


class Word:
    """A token in a language. Pairs are what holds within a sentence and at its start."""

    __slots__ = ("text", "low", "lemma", "punct", "number", "stop", "dull", "ender", "guard", "light", "semantic", "hard", "stays", "verb", "glue", "category")

    def __init__(self, x: str, about: _About):
        low = x.lower()
        if low == x:
            low = x
        first = x[0]
        self.text, self.low = x, low
        if low not in about.known and x.isalpha():  # most words are in no list
            self.lemma = low
            self.punct = self.number = self.stop = self.dull = self.verb = self.glue = False
            self.ender, self.light = 0, True
            upper = low is not x and category(first) == "Lu"
            self.guard, self.category = (_NAME, "PROPN" if len(x) > 1 else "CONTENT") if upper else (_NO, "CONTENT")
            self.semantic = (x, x)
            if about.german:
                self.guard = _NO
            elif about.chinese and about.negation(low):
                self.guard = _YES
            if len(low) <= 1 or (about.describes and len(low) >= 4 and about.describes(low)):
                self.hard = (x if self.guard[0] else None, x if self.guard[1] else None)
                self.stays = self.guard
            else:
                self.hard, self.stays = self.semantic, _YES
            return
        self.lemma = lemma = about.forms.get(low, low)
        self.punct = punct = is_punct(x)
        self.number = number = not first.isalpha() and all(c in ".,-" or category(c) == "Nd" for c in x)
        self.stop = stop = low in about.stop
        self.ender = int(x in ENDERS)
        self.dull = stop or lemma in about.stop or lemma in about.generic
        negation, named, upper = about.negation(low), low in about.names, category(first) == "Lu"
        self.guard = (True, True) if negation else (named, named) if about.german else (upper, upper and named)
        self.light = not punct and (not stop or negation)
        self.verb = low in about.verbs
        self.glue = punct or self.verb or stop or low in about.modifiers
        self.category = "PUNCT" if punct else "FUNC" if stop else "NUM" if number else "PROPN" if upper and len(x) > 1 else "CONTENT"
        if punct:
            self.semantic = self.hard = _NEITHER
            self.stays = _NO
            return
        shown = x if lemma == low else lemma
        content = None if number or stop or lemma in about.stop else shown
        hard = None if content is None or lemma in about.generic or len(lemma) <= 1 or (about.describes and len(low) >= 4 and about.describes(low)) else shown
        self.semantic = tuple(x if g else content for g in self.guard)
        self.hard = self.semantic if hard is content else tuple(x if g else hard for g in self.guard)
        self.stays = (self.hard[0] is not None, self.hard[1] is not None)


_NEITHER, _NO, _YES, _NAME = (None, None), (False, False), (True, True), (True, False)


class _About:
    """What the words of a language are told by."""

    def __init__(self, lex: Lexicon):
        self.forms = {f: v for f, v in lex.forms.items() if f not in lex.adverbs}
        self.stop, self.generic, self.names, self.verbs, self.modifiers = lex.function_words, lex.generic_words(), lex.names, lex.verb_forms, lex.modifiers
        self.known = frozenset(self.forms) | self.stop | self.generic | self.names | self.verbs | self.modifiers | lex.negations
        self.german, self.chinese = lex.iso3 == "deu", lex.iso3 == "zho"
        begins = tuple(lex.negations)
        self.negation = (lambda low: low.startswith(begins)) if self.chinese else lex.negations.__contains__
        pattern = descriptive_pattern(lex.iso3)
        self.describes = re.compile(pattern).search if pattern else None


def _table(iso3: str) -> Table:
    about = _About(catalogue()[iso3])
    return Table(lambda x: Word(x, about), 1 << 15)


def words(found: list[str], iso3: str) -> list[Word]:
    """Tokens in a language; one without a lexicon is treated as English."""
    known = iso3 if iso3 in catalogue() else "eng"
    return list(map(kept(("words", known), lambda: _table(known)).__getitem__, found))


def _signs() -> Table:
    """Of a token: -1 for a sign, else which languages' function words and exclusive markers have it, as bits."""
    bits: dict[str, int] = {}
    for i, (k, lex) in enumerate(catalogue().items()):
        for at, has in ((i, lex.function_words), (len(catalogue()) + i, exclusive_markers()[k])):
            for w in has:
                bits[w] = bits.get(w, 0) | 1 << at

    def make(x: str) -> int:
        low = x.lower()
        return -1 if is_punct(low) else bits.get(low, 0)

    return Table(make, 1 << 16)


def detected(found: list[str]) -> str:
    """iso3 of a text by its tokens, as language.detected tells it."""
    langs = list(catalogue())
    counts = Counter(map(kept("signs", _signs).__getitem__, found))
    counts.pop(-1, None)
    n = sum(counts.values())
    hits, marks = ([sum(c for bits, c in counts.items() if bits >> i & 1) for i in range(at, at + len(langs))] for at in (0, len(langs)))
    best, mark = max(hits), max(marks)
    if not n or best < 1 or best < n * LEAST_RATIO:
        return "eng"
    if mark > 0 and marks.count(mark) == 1:
        return langs[marks.index(mark)]
    return langs[hits.index(best)]
