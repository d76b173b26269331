"""Language detection by function words, as one projection per document: no shuffle, no lookup table to send."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_punct, word_tokens
from ..lexicon import catalogue, exclusive_markers

LEAST_RATIO = 0.02


def is_one_of(x: Column, words) -> Column:
    return x.isin(sorted(words))


def with_hits(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words and, per language of the catalogue, hits_<iso3> and marks_<iso3> (exclusive markers)."""
    d = docs.withColumn("_low", F.filter(F.transform(word_tokens(text), lambda x: F.lower(x)), lambda x: ~is_punct(x)))
    marks = exclusive_markers()
    cols = {"n_words": F.size("_low").cast("bigint")}
    for k, lex in catalogue().items():
        cols[f"hits_{k}"] = F.size(F.filter("_low", _member(lex.function_words))).cast("bigint")
        cols[f"marks_{k}"] = F.size(F.filter("_low", _member(marks[k]))).cast("bigint")
    return d.withColumns(cols).drop("_low")


def _member(words):
    return lambda x: is_one_of(x, words)


def detected() -> Column:
    """iso3 from the columns of with_hits. Without words, without hits or with hits on under 2 % of the words: English. A language
    strictly best in exclusive markers wins, then the best in hits, the first of the catalogue in a tie."""
    langs = list(catalogue())
    best = F.greatest(*(F.col(f"hits_{k}") for k in langs))
    mark = F.greatest(*(F.col(f"marks_{k}") for k in langs))
    at_mark = sum((F.when(F.col(f"marks_{k}") == mark, 1).otherwise(0) for k in langs), F.lit(0))
    first = lambda prefix, top: F.coalesce(*(F.when(F.col(f"{prefix}_{k}") == top, F.lit(k)) for k in langs))
    poor = (F.col("n_words") == 0) | (best < 1) | (best < F.col("n_words") * LEAST_RATIO)
    return F.when(poor, "eng").when((mark > 0) & (at_mark == 1), first("marks", mark)).otherwise(first("hits", best))


def detect(docs: DataFrame, text: str = "text", out: str = "iso3") -> DataFrame:
    """Adds the detected language."""
    found = with_hits(docs, text).withColumn(out, detected())
    return found.select(*docs.columns, out)


def scores(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds scores: a map of hits per word by language, {eng: 1} where there are none."""
    found = with_hits(docs, text)
    entries = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), (F.col(f"hits_{k}") / F.greatest("n_words", F.lit(1))).alias("value")) for k in catalogue())), lambda e: e["value"] > 0)
    none = F.create_map(F.lit("eng"), F.lit(1.0))
    return found.withColumn("scores", F.when(F.size(entries) > 0, F.map_from_entries(entries)).otherwise(none)).select(*docs.columns, "scores")
