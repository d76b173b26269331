"""Levels of word pruning, each one projection per document: nothing is shuffled. A text's language is told and its tokens are pruned in
one function, in Arrow batches: what a level makes of a token is kept by the worker, where expressions over the array of tokens asked
it of each of them anew. Filters of one's own are expressions. A level that drops every word of a text leaves it empty, but never fails."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import rowwise
from ..functions.text import is_number, is_punct, let, text_or_empty, token_count, word_tokens
from ..functions.words import ENDERS, Word, detected, tokens, words
from ..lexicon import Lexicon, catalogue, descriptive_pattern
from .language import detect

LEVELS = ("none", "light", "semantic", "aggressive", "statistical", "syntactic")


def per_language(iso3: Column, make: Callable[[Lexicon], Column]) -> Column:
    """make(lexicon) for the row's language; a language without a lexicon is treated as English."""
    langs = catalogue()
    out = None
    for k, lex in langs.items():
        if k != "eng":
            out = F.when(iso3 == k, make(lex)) if out is None else out.when(iso3 == k, make(lex))
    return out.otherwise(make(langs["eng"]))


def _in(low: Column, words) -> Column:
    return low.isin(sorted(words)) if words else F.lit(False)


def is_negation(low: Column, lex: Lexicon) -> Column:
    if lex.iso3 == "zho":
        return low.rlike("^(" + "|".join(sorted(lex.negations)) + ")")
    return _in(low, lex.negations)


def lemma_of(low: Column, lex: Lexicon) -> Column:
    """The lemma, else the form. An adverb keeps its form."""
    forms = {f: v for f, v in lex.forms.items() if f not in lex.adverbs}
    if not forms:
        return low
    table = F.create_map(*(F.lit(x) for kv in sorted(forms.items()) for x in kv))
    return F.when(_in(low, forms), F.try_element_at(table, low)).otherwise(low)


def is_protected(x: Column, low: Column, start: Column, lex: Lexicon) -> Column:
    """Negations, and names: capitalised within a sentence, or at its start if in the list of names; in German by the list alone."""
    named = _in(low, lex.names)
    return is_negation(low, lex) | (named if lex.iso3 == "deu" else x.rlike(r"^\p{Lu}") & (~start | named))


def _lowered(tokens: Column) -> Column:
    """Structs of text, lower case, and whether a sentence starts. Later steps build on fields, which cost nothing to read again."""
    start = lambda all_, i: (i == 0) | F.get(all_, i - 1).isin(*ENDERS)
    return let(tokens, lambda all_: F.transform(all_, lambda x, i: F.struct(x.alias("text"), F.lower(x).alias("low"), start(all_, i).alias("start"), is_punct(x).alias("punct"))))


def _annotated(tokens: Column, iso3: Column) -> Column:
    """Structs of each token with what the filters ask, in three steps: each computes once what the next uses often."""

    def one(lex: Lexicon) -> Column:
        stop, generic, pattern = lex.function_words, lex.generic_words(), descriptive_pattern(lex.iso3)
        low = F.transform(_lowered(tokens), lambda t: F.struct(t["text"], t["low"], t["start"], t["punct"], lemma_of(t["low"], lex).alias("lemma"), _in(t["low"], stop).alias("stop")))

        def mark(t: Column) -> Column:
            describes = (F.length(t["low"]) >= 4) & t["low"].rlike(pattern) if pattern else F.lit(False)
            return F.struct(
                t["text"], t["low"], t["lemma"], t["punct"], is_number(t["text"]).alias("number"), t["text"].isin(*ENDERS).alias("ender"), t["stop"],
                (t["stop"] | _in(t["lemma"], stop)).alias("stop_lemma"), _in(t["lemma"], generic).alias("generic"), describes.alias("describes"),
                is_protected(t["text"], t["low"], t["start"], lex).alias("protected"), is_negation(t["low"], lex).alias("negation"),
            )

        return F.transform(low, mark)

    return per_language(iso3, one)


def annotated(text: Column | str, iso3: Column) -> Column:
    return _annotated(word_tokens(text), iso3)


def with_tokens(docs: DataFrame, text: str = "text", iso3: str | None = None) -> DataFrame:
    """Adds iso3 (detected if no column is named) and tokens, annotated."""
    d = docs if iso3 else detect(docs, text)
    return d.withColumn("tokens", _annotated(word_tokens(text), F.col(iso3 or "iso3")))


def _kept(tokens: Column, keep, emit) -> Column:
    return F.array_join(F.transform(F.filter(tokens, keep), emit), " ")


def _guards(ws: list[Word]) -> list[bool]:
    """Of each word, whether it is a negation or a name, which depends on whether it starts a sentence."""
    start = [1, *(w.ender for w in ws)]
    return [w.guard[s] for w, s in zip(ws, start)]


def light(ws: list[Word]) -> str:
    """Without signs and function words; case and numbers stay, so do negations."""
    return " ".join([w.text for w in ws if w.light])


def semantic(ws: list[Word]) -> str:
    """Also without numbers, and lemmas for inflected words."""
    start = [1, *(w.ender for w in ws)]
    return " ".join([x for w, s in zip(ws, start) if (x := w.semantic[s]) is not None])


def aggressive(ws: list[Word]) -> str:
    """Also without generic and descriptive words; a text of which nothing would stay is left at the semantic level."""
    start = [1, *(w.ender for w in ws)]
    return " ".join([x for w, s in zip(ws, start) if (x := w.hard[s]) is not None]) or semantic(ws)


def statistical(ws: list[Word]) -> str:
    """Words of a TF-IDF score, over the sentences of the text, at or above the upper median of the positive scores of its distinct words;
    each sentence keeps its best word. All of it is within a text: nothing is shuffled, where rows of tokens would be, with a dozen
    window passes."""
    guard = _guards(ws)
    sent, n = [], 0
    for w in ws:
        sent.append(n)
        n += w.ender
    sents = n + 1
    named = [w.lemma if not (w.punct or g or w.number) else None for w, g in zip(ws, guard)]
    tf = Counter(w for w in named if w is not None)
    df = Counter(w for w, _ in {(w, s) for w, s in zip(named, sent) if w is not None})
    dull = {w.lemma for w in ws if w.dull}
    score = {w: 0.0 if w in dull else round(n * (1.0 if sents == 1 else log(sents / (1 + df[w])) + 1), 9) for w, n in tf.items()}
    some = sorted(v for v in score.values() if v > 0)
    if not some:
        return " ".join(w.text for w in ws if not w.punct and not w.number)
    cut = some[len(some) // 2]
    shown = [(g and not w.punct) or (x is not None and score[x] > 0 and score[x] >= cut) for x, g, w in zip(named, guard, ws)]
    full = {s for s, x in zip(sent, shown) if x}
    best: dict[int, int] = {}
    for i, x in enumerate(named):
        if x is not None and sent[i] not in full and (sent[i] not in best or score[x] > score[named[best[sent[i]]]]):
            best[sent[i]] = i
    for i in best.values():
        shown[i] = True
    return " ".join(w.text if g else x for w, x, g, k in zip(ws, named, guard, shown) if k)


def _sentences(ws: list[Word]) -> Iterator[list[Word]]:
    begin = 0
    for i in [i for i, w in enumerate(ws, 1) if w.ender]:
        yield ws[begin:i]
        begin = i
    if begin < len(ws):
        yield ws[begin:]


def syntactic(ws: list[Word]) -> str:
    """The aggressive rules, but a function word stays before a word that stays; of verbs that only glue joins, the last one and what
    follows; a sentence of which nothing would stay keeps its first word. Sequential within a text."""
    out: list[str] = []
    for s in _sentences(ws):
        stays = [s[0].stays[1], *(w.stays[0] for w in s[1:]), False]
        verbs = [k for k, w in enumerate(s) if w.verb]
        if len(verbs) > 1 and all(w.glue for w in s[verbs[0] : verbs[-1]]):
            # Before the last verb, only what is guarded isn't cut.
            cut = [not w.guard[k == 0] for k, w in enumerate(s[: verbs[-1]])] + [False] * (len(s) - verbs[-1] + 1)
            stays = [a and not c for a, c in zip(stays, cut)]
            shown = [not w.punct and not c and (a or (w.stop and b)) for w, a, b, c in zip(s, stays, stays[1:], cut)]
        else:
            shown = [a or (w.stop and b and not w.punct) for w, a, b in zip(s, stays, stays[1:])]
        if not any(shown):
            first = next((k for k, w in enumerate(s) if not w.punct), None)
            if first is None:
                continue
            shown[first] = True
        out += [w.text if w.stop or w.guard[k == 0] or w.lemma == w.low else w.lemma for k, (w, x) in enumerate(zip(s, shown)) if x]
    return " ".join(out)


MAKE: dict[str, Callable[[list[Word]], str]] = {"light": light, "semantic": semantic, "aggressive": aggressive, "statistical": statistical, "syntactic": syntactic}


def _syntactic_one(text: str, iso3: str) -> str:
    """One text at the syntactic level."""
    return syntactic(words(tokens(text), iso3))


def pruned(text: str | None, level: str, iso3: str | None = None) -> tuple[str, str]:
    """The language of a text, told if none is given, and the text at a level."""
    found = tokens(text or "")
    lang = iso3 or detected(found)
    return lang, MAKE[level](words(found, lang))


def custom(tokens: Column, keep_only: tuple[str, ...] = (), remove: tuple[str, ...] = (), predicate: Callable[[Column], Column] | None = None) -> Column:
    """A filter by category: PUNCT if removed goes first; keep_only decides alone where given; FUNC if removed goes next; then the
    predicate, on the token's text."""

    def keep(t: Column) -> Column:
        if keep_only:
            kept = category(t).isin(*keep_only)
        else:
            kept = F.lit(True)
            if "FUNC" in remove:
                kept = kept & ~t["stop"]
            if predicate:
                kept = kept & predicate(t["text"])
        return kept & ~t["punct"] if "PUNCT" in remove else kept

    return _kept(tokens, keep, lambda t: t["text"])


def category(t: Column) -> Column:
    return F.when(t["punct"], "PUNCT").when(t["stop"], "FUNC").when(t["number"], "NUM").when(t["text"].rlike(r"^\p{Lu}.") , "PROPN").otherwise("CONTENT")


def with_compressed(docs: DataFrame, level: str, text: str = "text", iso3: str | None = None) -> DataFrame:
    """Adds iso3 (told from the text if no column is named) and compressed."""
    if iso3:
        return docs.withColumn("iso3", F.col(iso3)).withColumn("compressed", rowwise(lambda t, k: pruned(t, level, k or "eng")[1], "string", text, "iso3"))
    made = docs.withColumn("_pruned", rowwise(lambda t: pruned(t, level), "struct<iso3:string,compressed:string>", text))
    return made.withColumns({"iso3": F.col("_pruned.iso3"), "compressed": F.col("_pruned.compressed")}).drop("_pruned")


def filtered(text: str | None, filters: dict[str, dict], counted: tuple[str, ...] = ()) -> tuple:
    """The text by filters of categories, each with keep_only and remove as in custom, and the numbers of tokens of other categories."""
    found = tokens(text or "")
    ws = words(found, detected(found))
    kept = lambda w, keep_only=(), remove=(): (w.category in keep_only if keep_only else "FUNC" not in remove or not w.stop) and not ("PUNCT" in remove and w.punct)
    return (*(" ".join([w.text for w in ws if kept(w, **f)]) for f in filters.values()), *(sum(w.category == c for w in ws) for c in counted))


def with_filtered(docs: DataFrame, filters: dict[str, dict], counts: dict[str, str], text: str = "text") -> DataFrame:
    """Adds a column for each filter by category, and counts of categories by name."""
    kinds = ",".join([*(f"{k}:string" for k in filters), *(f"{k}:bigint" for k in counts)])
    made = docs.withColumn("_filtered", rowwise(lambda t: filtered(t, filters, tuple(counts.values())), f"struct<{kinds}>", text))
    return made.withColumns({k: F.col(f"_filtered.{k}") for k in (*filters, *counts)}).drop("_filtered")


def compress(docs: DataFrame, level: str = "semantic", key: str = "doc_id", text: str = "text", iso3: str | None = None, counter: Callable[[Column], Column] = token_count) -> DataFrame:
    """key, iso3, compressed, original_tokens, compressed_tokens, saved_tokens, efficiency (percent), energy_mwh, co2_mg.

    None keeps texts as they are and counts pieces between single spaces. Blank text gives an empty result. counter: any function
    from a column to its number of tokens."""
    if level not in LEVELS:
        raise ValueError(f"no level {level}")
    if level == "none":
        d = (detect(docs, text) if not iso3 else docs.withColumn("iso3", F.col(iso3))).withColumn("compressed", text_or_empty(text))
    else:
        d = with_compressed(docs, level, text, iso3)
    count = (lambda c: F.size(F.filter(F.split(text_or_empty(c), " "), lambda x: x != "")).cast("bigint")) if level == "none" else counter
    d = d.select(key, "iso3", "compressed", count(text).alias("original_tokens"), count("compressed").alias("compressed_tokens"))
    return with_savings(d)


def with_savings(d: DataFrame) -> DataFrame:
    saved = F.greatest(F.col("original_tokens") - F.col("compressed_tokens"), F.lit(0)).cast("bigint")
    share = F.when(F.col("original_tokens") > 0, saved * 100.0 / F.col("original_tokens")).otherwise(0.0)
    return d.withColumn("saved_tokens", saved).withColumn("efficiency", F.round(share, 6)).withColumn("energy_mwh", F.round(saved * 0.005, 6)).withColumn("co2_mg", F.round(saved * 0.005 * 0.4, 6))

