"""Pieces of the checking SQL, made from the same word lists and patterns as the operators."""

from __future__ import annotations

from collections.abc import Callable

from ..functions.text import COUNTED, FACTORS, NUMBER, PUNCT, TOKEN
from ..lexicon import Lexicon, catalogue, descriptive_pattern, exclusive_markers


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def one_of(x: str, words) -> str:
    return f"({x} IN ({', '.join(map(lit, sorted(words)))}))" if words else "false"


def by_language(make: Callable[[Lexicon], str], iso3: str = "iso3") -> str:
    rest = "".join(f" WHEN {lit(k)} THEN {make(lex)}" for k, lex in catalogue().items() if k != "eng")
    return f"(CASE {iso3}{rest} ELSE {make(catalogue()['eng'])} END)"


def token_count(x: str, model: str = "gpt4") -> str:
    n = f"list_sum(list_transform(regexp_extract_all({x}, {lit(COUNTED)}), lambda w: CASE WHEN length(w) <= 4 THEN 1 WHEN length(w) <= 8 THEN 2 ELSE 2 + (length(w) - 5) // 4 END))"
    gaps = f"list_sum(list_transform(regexp_extract_all({x}, {lit(chr(92) + 's{4,}')}), lambda w: length(w) // 4))"
    total = f"greatest(coalesce({n}, 0) + coalesce({gaps}, 0), 1)"
    if FACTORS[model]:
        total = f"floor({total}::BIGINT::DOUBLE * {FACTORS[model]}::DOUBLE)"
    return f"(CASE WHEN NOT regexp_matches(coalesce({x}, ''), '[^\\s]') THEN 0 ELSE {total} END)::BIGINT"


def hits() -> str:
    """CTEs d and h: tokens, number of words and hits per language."""
    cols = []
    marks = exclusive_markers()
    for k, lex in catalogue().items():
        cols.append(f"len(list_filter(low, lambda x: {one_of('x', lex.function_words)}))::BIGINT AS hits_{k}")
        cols.append(f"len(list_filter(low, lambda x: {one_of('x', marks[k])}))::BIGINT AS marks_{k}")
    return f"""d AS (SELECT *, list_filter(list_transform(tok, lambda x: lower(x)), lambda x: NOT regexp_matches(x, {lit(PUNCT)})) AS low
        FROM (SELECT *, regexp_extract_all(coalesce(text, ''), {lit(TOKEN)}) AS tok FROM documents)),
        h AS (SELECT *, len(low)::BIGINT AS n_words, {', '.join(cols)} FROM d)"""


def detected() -> str:
    langs = list(catalogue())
    best, mark = (f"greatest({', '.join(f'{p}_{k}' for k in langs)})" for p in ("hits", "marks"))
    ties = " + ".join(f"(marks_{k} = {mark})::INT" for k in langs)
    first = lambda p, top: "CASE " + " ".join(f"WHEN {p}_{k} = {top} THEN {lit(k)}" for k in langs) + " END"
    return f"(CASE WHEN n_words = 0 OR {best} < 1 OR {best} < n_words * 0.02 THEN 'eng' WHEN {mark} > 0 AND {ties} = 1 THEN {first('marks', mark)} ELSE {first('hits', best)} END)"


def _lemma(lex: Lexicon) -> str:
    forms = {f: v for f, v in lex.forms.items() if f not in lex.adverbs}
    return "(CASE low " + " ".join(f"WHEN {lit(f)} THEN {lit(v)}" for f, v in sorted(forms.items())) + " ELSE low END)" if forms else "low"


def _protected(lex: Lexicon) -> str:
    named = one_of("low", lex.names)
    return f"({_negation(lex)} OR " + (named if lex.iso3 == "deu" else f"(regexp_matches(x, '^\\p{{Lu}}') AND (NOT start OR {named}))") + ")"


def _negation(lex: Lexicon) -> str:
    if lex.iso3 == "zho":
        return f"regexp_matches(low, {lit('^(' + '|'.join(sorted(lex.negations)) + ')')})"
    return one_of("low", lex.negations)


def tokens() -> str:
    """CTEs up to t: a row per token with what the filters ask."""
    described = lambda lex: f"(length(low) >= 4 AND regexp_matches(low, {lit(p)}))" if (p := descriptive_pattern(lex.iso3)) else "false"
    return f"""{hits()},
        k AS (SELECT doc_id, tok, {detected()} AS iso3 FROM h),
        t0 AS (SELECT doc_id, iso3, x, lower(x) AS low, i, i = 1 OR coalesce(tok[i - 1] IN ('.', '!', '?', '…'), false) AS start
               FROM (SELECT doc_id, iso3, tok, unnest(tok) AS x, generate_subscripts(tok, 1) AS i FROM k)),
        t1 AS (SELECT *, {by_language(_lemma)} AS lemma, regexp_matches(x, {lit(PUNCT)}) AS punct, regexp_matches(x, {lit(NUMBER)}) AS num, x IN ('.', '!', '?', '…') AS ender,
               {by_language(_protected)} AS prot, {by_language(_negation)} AS neg FROM t0),
        t AS (SELECT *, {by_language(lambda lex: one_of('low', lex.function_words))} AS stop,
              {by_language(lambda lex: f"({one_of('low', lex.function_words)} OR {one_of('lemma', lex.function_words)})")} AS stop_lemma,
              {by_language(lambda lex: one_of('lemma', lex.generic_words()))} AS generic, {by_language(described)} AS descr FROM t1)"""


CONTENT = "(NOT punct AND (prot OR (NOT num AND NOT stop_lemma)))"
HARD = f"({CONTENT} AND (prot OR (NOT generic AND NOT descr AND length(lemma) > 1)))"
SHOWN = "CASE WHEN prot OR lemma = low THEN x ELSE lemma END"


def joined(what: str, keep: str) -> str:
    return f"coalesce(string_agg({what}, ' ' ORDER BY i) FILTER (WHERE {keep}), '')"


def savings(before: str = "original_tokens", after: str = "compressed_tokens") -> str:
    saved = f"greatest({before} - {after}, 0)::BIGINT"
    return f"""{saved} AS saved_tokens, round(CASE WHEN {before} > 0 THEN {saved} * 100.0::DOUBLE / {before} ELSE 0 END, 6)::DOUBLE AS efficiency,
        round({saved} * 0.005::DOUBLE, 6) AS energy_mwh, round({saved} * 0.005::DOUBLE * 0.4::DOUBLE, 6) AS co2_mg"""
