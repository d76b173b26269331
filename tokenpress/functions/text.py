"""Tokenizers, counters and predicates as column expressions. Patterns work alike in Java's and in RE2's regular expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokenizer A: words with one inner apostrophe, numbers with one group, any other character.
TOKEN = r"[\p{L}\p{M}]+(?:'[\p{L}\p{M}]+)?|\p{N}+(?:[.,]\p{N}+)?|[^\s]"
#: Tokenizer B: URL, e-mail, word, number, line ends, blanks, a run of one emoji or sign.
URL, EMAIL = r"https?://[^\s]+", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
PIECE = rf"{URL}|{EMAIL}|[\p{{L}}\p{{M}}]+|\p{{N}}+|\r?\n|[^\S\n]+|{EMOJI}|([^\s\p{{L}}\p{{N}}])\1*"
TERM = r"[\p{L}\p{N}\p{M}]+"
COUNTED = r"[a-zA-Z0-9_]+|[^\s]"
PUNCT = r"^[^\p{L}\p{N}\p{M}]$"
NUMBER = r"^[\p{Nd}.,-]+$"
FACTORS = {"gpt4": None, "gpt35": None, "llama3": 1.05, "gemma3": 1.02, "claude3": 0.98}
PRICES = {"gpt4": "0.03", "gpt35": "0.0015", "claude3": "0.015"}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, then) -> Column:
    """then(value), with value computed once, however deep in lambdas `then` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def blank(c: Column | str) -> Column:
    return ~F.coalesce(col(c).rlike(r"[^\s]"), F.lit(False))


def word_tokens(c: Column | str) -> Column:
    """Tokenizer A."""
    return F.regexp_extract_all(text_or_empty(c), F.lit(TOKEN), 0)


def pieces(c: Column | str) -> Column:
    """Tokenizer B: structs of value and category, which put together give the text."""
    category = lambda x: (
        F.when(x.rlike(rf"^{URL}$"), "Url").when(x.rlike(rf"^{EMAIL}$"), "Email").when(x.rlike(r"^[\p{L}\p{M}]+$"), "Word").when(x.rlike(r"^\p{N}+$"), "Number")
        .when(x.rlike(r"^\r?\n$"), "Newline").when(x.rlike(r"^\s+$"), "Whitespace").when(x.rlike(rf"^{EMOJI}+$"), "Emoji").otherwise("Punctuation")
    )
    return F.transform(F.regexp_extract_all(text_or_empty(c), F.lit(PIECE), 0), lambda x: F.struct(x.alias("value"), category(x).alias("category")))


def terms(c: Column | str) -> Column:
    """Retrieval terms."""
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(TERM), 0)


def json_terms(c: Column | str) -> Column:
    return F.filter(F.split(F.lower(text_or_empty(c)), r"(?U)\W+"), lambda x: F.length(x) >= 2)


def paragraphs(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(text_or_empty(c), r"\n\s*\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def lines(c: Column | str) -> Column:
    return F.split(text_or_empty(c), "\n")


def shingles(words: Column, n: int) -> Column:
    """Runs of n words; single words where there are fewer."""
    some = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, some).otherwise(words)


def token_count(c: Column | str, model: str = "gpt4") -> Column:
    """Estimated tokens of a model: by length of words, one for each sign, a quarter of long blank runs. Blank text has none."""
    # A run of letters costs one for each four of them, begun or whole; a run of blanks one for each whole four.
    total = F.greatest(F.regexp_count(text_or_empty(c), F.lit(r"[a-zA-Z0-9_]{1,4}|[^\s]|\s{4}")), F.lit(1))
    if FACTORS[model]:
        total = (total * F.lit(FACTORS[model])).cast("int")
    return F.when(blank(c), 0).otherwise(total).cast("bigint")


def cost(tokens: Column, model: str = "gpt4", euro: bool = False) -> Column:
    """Price of tokens in a model, DECIMAL(18,6)."""
    rate = Decimal(PRICES.get(model, "0")) / 1000 * (Decimal("0.92") if euro else 1)
    return (tokens.cast("decimal(18,0)") * F.lit(rate).cast("decimal(18,9)")).cast("decimal(18,6)")


def fingerprint(c: Column | str) -> Column:
    """16 hex digits of the SHA-256 of text in lower case with blanks squeezed."""
    squeezed = F.lower(F.regexp_replace(F.regexp_replace(text_or_empty(c), r"\s+", " "), r"^ | $", ""))
    return F.upper(F.substring(F.sha2(squeezed, 256), 1, 16))


def is_punct(x: Column) -> Column:
    return x.rlike(PUNCT)


def is_number(x: Column) -> Column:
    return x.rlike(NUMBER)
