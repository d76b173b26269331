"""Word lists of a language: function words, negations, generic words, lemmas, parts of speech, names. Lists are our own and short;
a reader takes larger ones from YAML or CoNLL-U files (tokenpress.sources)."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cache

from .words import DATA


@dataclass(frozen=True)
class Lexicon:
    iso3: str
    iso1: str
    name: str
    function_words: frozenset[str]
    negations: frozenset[str] = frozenset()
    generic: frozenset[str] = frozenset()
    lemmas: dict[str, str] = field(default_factory=dict)
    verbs: dict[str, tuple[str, ...]] = field(default_factory=dict)
    names: frozenset[str] = frozenset()
    adverbs: frozenset[str] = frozenset()
    modifiers: frozenset[str] = frozenset()

    @property
    def forms(self) -> dict[str, str]:
        """form -> lemma. An explicit lemma beats one that a verb gives; of verbs, the last."""
        out = {f: v for v, fs in self.verbs.items() for f in fs}
        return {f: v for f, v in (out | self.lemmas).items() if f != v}

    @property
    def verb_forms(self) -> frozenset[str]:
        return frozenset(self.verbs) | {f for fs in self.verbs.values() for f in fs}

    def generic_words(self, most: int = 25) -> frozenset[str]:
        """Curated generic words; else, of ten verbs or more, the richest with four forms or more; else a short English list."""
        if self.generic:
            return self.generic
        rich = sorted((v for v in self.verbs if len(self.verbs[v]) >= 4), key=lambda v: (-len(self.verbs[v]), v))[:most]
        if len(self.verbs) >= 10 and rich:
            return frozenset(rich) | {f for v in rich for f in self.verbs[v]}
        return DATA["eng"]["generic"]


@cache
def catalogue() -> dict[str, Lexicon]:
    """All languages with a lexicon, in the order that breaks ties of detection."""
    out = {}
    for iso3, d in DATA.items():
        out[iso3] = Lexicon(iso3, d["iso1"], d["name"], frozenset(d["function_words"]), frozenset(d["negations"]), frozenset(d.get("generic", ())), d.get("lemmas", {}), d.get("verbs", {}), frozenset(d.get("names", ())), frozenset(d.get("adverbs", ())), frozenset(d.get("modifiers", ())))
    return out


@cache
def exclusive_markers() -> dict[str, frozenset[str]]:
    """Function words that one language alone has."""
    every = catalogue()
    return {k: lex.function_words - frozenset().union(*(o.function_words for j, o in every.items() if j != k)) for k, lex in every.items()}


#: ISO 639-1 to 639-3.
ISO = dict(x.split(":") for x in """
af:afr ar:ara be:bel bg:bul bn:ben ca:cat cs:ces cy:cym da:dan de:deu el:ell en:eng es:spa et:est eu:eus fa:fas fi:fin fr:fra ga:gle
gl:glg gu:guj he:heb hi:hin hr:hrv hu:hun hy:hye id:ind is:isl it:ita ja:jpn ka:kat kk:kaz kn:kan ko:kor la:lat lt:lit lv:lav mk:mkd
mr:mar nl:nld nb:nor no:nor pl:pol pt:por ro:ron ru:rus sa:san sk:slk sl:slv sq:sqi sr:srp sv:swe ta:tam te:tel th:tha tr:tur uk:ukr
ur:urd vi:vie zh:zho
""".split())


def iso3(code: str) -> str | None:
    """639-3 of a code of either kind, or None."""
    code = code.strip().lower()
    return ISO.get(code) or (code if code in ISO.values() else None)


GROUPS = {
    "en": {"eng"}, "romance": {"ita", "fra", "spa", "por", "ron", "cat", "glg", "lat"}, "germanic": {"deu", "nld", "afr", "swe", "dan", "nor", "isl"},
    "slavic": {"rus", "ukr", "bel", "bul", "srp", "hrv", "slv", "slk", "ces", "pol", "mkd"}, "semitic": {"ara", "heb", "fas", "urd"},
}


def descriptive_pattern(language: str) -> str | None:
    """Regular expression of words (lower case, four letters or more) that describe rather than say: by suffix and language group."""
    group = next((g for g, members in GROUPS.items() if language in members), None)
    return {
        "en": r"^(.{2,}(ly|wise|wards)|.{3,}(ous|ive|able|ible|ful|less|ic|ant|ent|ish|like|some))$",
        "romance": r"^(.{3,}mente|.{3,}(oso|osa|ivo|iva|abile|ibile|ale|ese|ista))$",
        "germanic": r"^.{3,}(lich|ig|isch|sam|bar|haft|los|voll|arm|reich)$",
        "slavic": r"^.{3,}(ский|ская|ское|ический|тельный|ьный|ивый|овый|астый|истый|оватый|ительно|чески)$",
        "semitic": r"^(al|el).{5,}$",
    }.get(group)
