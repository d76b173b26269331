"""Ranking: BM25+ and RM3 retrieval, relevance, extractive summaries, topic segments."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from math import log, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import rowwise
from ..functions.sentences import split_sentences
from ..functions.text import let, terms
from ..functions.words import detected, letter_runs, tokens
from ..lexicon import catalogue

K1, B, DELTA = 1.5, 0.75, 1.0
MMR_TFIDF, MMR_TEXTRANK = 0.55, 0.5


def bm25_scores(texts: list[list[str]], query: dict[str, float]) -> list[float]:
    """BM25+ of tokenized texts, for small collections within one row."""
    n = len(texts)
    counts = [Counter(t) for t in texts]
    mean = sum(map(len, texts)) / n or 1.0
    out = [0.0] * n
    for w, weight in query.items():
        df = sum(w in c for c in counts)
        idf = log((n - df + 0.5) / (df + 0.5) + 1)
        for i, c in enumerate(counts):
            if c[w]:
                out[i] += weight * idf * (DELTA + c[w] * (K1 + 1) / (c[w] + K1 * (1 - B + B * len(texts[i]) / mean)))
    return out


def with_term_counts(docs: DataFrame, words: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, dl and tf (a struct with the count of each word): one projection; only words that are asked for are counted."""
    d = docs.select(key, terms(text).alias("_t"))
    count = lambda w: F.size(F.filter("_t", lambda x: x == w)).cast("bigint")
    return d.select(key, F.size("_t").cast("bigint").alias("dl"), *(count(w).alias(f"tf{i}") for i, w in enumerate(words)))


def bm25(docs: DataFrame, query: str | dict[str, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of documents with a score above zero. A query is text, its distinct terms weighing one each, or terms with weights.

    Documents are not shuffled: each is reduced to its counts of the query's terms; the corpus' size, mean length and document
    frequencies are one row, which every task gets."""
    weights = dict.fromkeys(_query_terms(query), 1.0) if isinstance(query, str) else query
    words = sorted(weights)
    d = with_term_counts(docs, words, key, text)
    if not words:
        return d.select(key, F.lit(0.0).alias("score")).filter("false")
    stats = d.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean"), *(F.sum((F.col(f"tf{i}") > 0).cast("bigint")).alias(f"df{i}") for i in range(len(words))))
    d = d.filter(" or ".join(f"tf{i} > 0" for i in range(len(words)))).crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i, w in enumerate(words):
        idf = F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5) + 1)
        part = F.lit(DELTA) + F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
        score = score + F.when(F.col(f"tf{i}") > 0, weights[w] * idf * part).otherwise(0.0)
    return d.select(key, F.round(score, 6).alias("score")).filter("score > 0")


def _query_terms(query: str) -> list[str]:
    import regex

    return list(dict.fromkeys(regex.findall(r"[\p{L}\p{N}\p{M}]+", query.lower())))


def top(scored: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """The k best, ties by key: a top-k of each partition, then of those."""
    return scored.orderBy(F.col("score").desc(), key).limit(k)


def retrieve(docs: DataFrame, query: str | dict[str, float], k: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    return top(bm25(docs, query, key, text), k, key)


def expanded_query(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text", feedback: int = 10, more: int = 10, original: float = 0.6, stop: frozenset[str] = frozenset()) -> dict[str, float]:
    """RM3: terms of the first ten results, in proportion to their share of each and its score, blended with the query. Ten rows of
    the feedback and `more` terms come to the driver."""
    words = _query_terms(query)
    if not words:
        return {}
    best = top(bm25(docs, query, key, text), feedback, key)
    hits = docs.join(F.broadcast(best), key).select("score", F.sum("score").over(Window.partitionBy()).alias("all"), terms(text).alias("t"))
    model = hits.select((F.col("score") / F.col("all") / F.size("t")).alias("p"), F.explode("t").alias("term")).groupBy("term").agg(F.round(F.sum("p"), 12).alias("p"))
    rows = model.filter(~F.col("term").isin(*words, *stop)).orderBy(F.col("p").desc(), "term").limit(more).collect()
    total = sum(r.p for r in rows)
    if not total:
        return dict.fromkeys(words, 1.0 / len(words))
    return {w: original / len(words) for w in words} | {r.term: (1 - original) * r.p / total for r in rows}


def retrieve_rm3(docs: DataFrame, query: str, k: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    return retrieve(docs, expanded_query(docs, query, key, text), k, key, text)


def relevance(text: Column | str, query: str, iso3: str = "eng") -> Column:
    """Shared content terms of the text and the query, over those of the query; lemmas of words that aren't function words."""
    lex = catalogue()[iso3]
    forms = lex.forms
    wanted = sorted({forms.get(w, w) for w in _query_terms(query) if w not in lex.function_words})
    if not wanted:
        return F.lit(0.0)
    # A term counts if any of its forms is there.
    every = {w: sorted({w} | {f for f, v in forms.items() if v == w}) for w in wanted}
    found = lambda t: sum((F.arrays_overlap(t, F.array(*map(F.lit, v))).cast("int") for v in every.values()), F.lit(0))
    return F.round(let(terms(text), lambda t: found(t)) / len(wanted), 6)


# Summaries, of one text each


def _bags(sentences: list[str], stop: frozenset[str]) -> list[list[str]]:
    """Of each sentence, its words that are no function words."""
    low = [x.lower() for x in sentences]
    find = letter_runs("\n".join(low))
    return [[w for w in find(x) if w not in stop] for x in low]


def transitions(bags: list[list[str]], block: int = 256) -> np.ndarray:
    """From each set of words to the others, shares by Jaccard similarity; rows without any pass nothing on. Made a few rows at a time: of
    a text's square of sentences there is this one alone."""
    sets = [set(b) for b in bags]
    df = Counter(w for x in sets for w in x)
    index = {w: i for i, w in enumerate(w for w, d in df.items() if d > 1)}  # the others are shared by no two
    n = len(bags)
    a = np.zeros((n, max(len(index), 1)), np.float32)
    for i, x in enumerate(sets):
        a[i, [index[w] for w in x if w in index]] = 1
    size = np.array([len(x) for x in sets], np.float32)
    out = np.empty((n, n))
    for i in range(0, n, block):
        p = out[i : i + block]
        both = a[i : i + block] @ a.T
        union = np.maximum(size[i : i + block, None] + size[None, :] - both, 1)  # at 0, both is 0 too
        both /= union
        p[:] = both
        p[np.arange(len(p)), np.arange(i, i + len(p))] = 0
        total = p.sum(1)[:, None]
        total[total == 0] = 1
        p /= total
    return out


def likeness(bags: list[list[str]]) -> Callable[[int], np.ndarray]:
    """Jaccard similarities of a set of words to all, made when they are asked for: a choice of a few sentences needs no others."""
    sets = [frozenset(b) for b in bags]
    size = np.array([len(x) for x in sets], np.float32)

    def row(i: int) -> np.ndarray:
        mine = sets[i]
        both = np.array([len(mine & x) for x in sets], np.float32)
        union = size[i] + size - both
        return np.divide(both, union, out=np.zeros_like(both), where=union > 0).astype(float)

    return row


def page_rank(p: np.ndarray, damping: float = 0.85, steps: int = 100, tol: float = 1e-4) -> np.ndarray:
    """Scores on a graph given by the shares that go from each row to the others."""
    n = len(p)
    r = np.full(n, 1 / n)
    for _ in range(steps):
        new = (1 - damping) / n + damping * (r @ p)
        if np.abs(new - r).sum() < tol:
            return new
        r = new
    return r


def diverse(score: np.ndarray, like: Callable[[int], np.ndarray], k: int, weight: float) -> list[int]:
    """Greedy choice of k by weight * score less the rest of the weight times the nearest choice; the first of equals. In order of place.
    like(i): how like i each is."""
    near = np.zeros(len(score))
    left = np.ones(len(score), bool)
    chosen = []
    for _ in range(min(k, len(score))):
        value = np.where(left, weight * score - (1 - weight) * near, -np.inf)
        i = int(value.argmax())
        chosen.append(i)
        left[i] = False
        near = np.maximum(near, like(i))
    return sorted(chosen)


def textrank(text: str, k: int, iso3: str = "eng") -> str:
    s = split_sentences(text, iso3)
    if len(s) <= k:
        return text
    lex = catalogue().get(iso3) or catalogue()["eng"]
    bags = _bags(s, lex.function_words)
    return " ".join(s[i] for i in diverse(page_rank(transitions(bags)), likeness(bags), k, MMR_TEXTRANK))


def sentence_scores(bags: list[list[str]], names: frozenset[str] = frozenset()) -> np.ndarray:
    """TF-IDF of sentences within their text, with a bonus for first, early and late places and for names."""
    n = len(bags)
    df = Counter(w for b in bags for w in set(b))
    idf = {d: log(n / (1 + d)) for d in set(df.values())}
    out = np.zeros(n)
    for i, b in enumerate(bags):
        if b:
            size = len(b)
            # In the order of first places; most sentences have each word once.
            out[i] = sum([c / size * idf[df[w]] for w, c in Counter(b).items()] if len(set(b)) < size else [1 / size * idf[df[w]] for w in b])
        out[i] += 0.30 if i == 0 else 0.15 if i / n < 0.15 else 0.10 if i / n > 0.85 else 0.0
        out[i] += 0.0 if names.isdisjoint(b) else 0.08
    return out


def _tfidf_sums(sentences: list[list[str]]) -> list[float | None]:
    counts = [Counter(b) for b in sentences]
    n = len(counts)
    df = Counter(w for c in counts for w in c)
    idf = {d: log(n / (1 + d)) for d in set(df.values())}
    return [sum([c / size * idf[df[w]] for w, c in b.items()]) if (size := b.total()) else None for b in counts]


def tfidf_sums(sentences: Column) -> Column:
    """Of each sentence of a text, given as its words, the sum of TF-IDF over the text's sentences; null where it has no words. A text stays
    in its row: as rows of words, with a window for each count, its words were shuffled three times."""
    return rowwise(lambda x: _tfidf_sums(x or []), "array<double>", sentences)


def _condensed(s: list[str], k: int, iso3: str) -> list[str]:
    lex = catalogue().get(iso3) or catalogue()["eng"]
    bags = _bags(s, lex.function_words)
    return [s[i] for i in diverse(sentence_scores(bags, lex.names), likeness(bags), k, MMR_TFIDF)]


def tfidf_summary(text: str, k: int | None = None, iso3: str = "eng", ratio: float | None = None) -> str:
    s = split_sentences(text, iso3)
    k = k if k is not None else max(1, int(len(s) * (ratio or 0.3) + 0.5))
    return text if len(s) <= k else " ".join(_condensed(s, k, iso3))


def segments(sents: list[str], iso3: str = "eng", block: int = 3) -> list[tuple[int, int]]:
    """TextTiling: half-open ranges of sentences, cut where the likeness of neighbouring blocks of three has a valley deeper than the
    mean less half a standard deviation."""
    lex = catalogue().get(iso3) or catalogue()["eng"]
    bags = _bags(sents, lex.function_words)
    blocks = [Counter(w for b in bags[i : i + block] for w in b) for i in range(0, len(sents), block)]
    if len(blocks) < 3:
        return [(0, len(sents))] if sents else []
    norm = [sqrt(sum(v * v for v in b.values())) for b in blocks]
    like = [sum(v * b[w] for w, v in a.items()) / (x * y) if x and y else 0.0 for a, b, x, y in zip(blocks, blocks[1:], norm, norm[1:])]
    depth = []
    for i, v in enumerate(like):
        left, right = v, v
        for j in range(i - 1, -1, -1):
            if like[j] < left:
                break
            left = like[j]
        for j in range(i + 1, len(like)):
            if like[j] < right:
                break
            right = like[j]
        depth.append((left - v) + (right - v))
    cut = float(np.mean(depth) - 0.5 * np.std(depth))
    edges = [0, *((i + 1) * block for i, d in enumerate(depth) if d > cut and d > 0), len(sents)]
    return list(zip(edges, edges[1:]))


def apportion(sizes: list[int], total: int) -> list[int]:
    """Shares of a total by size: whole parts first, what is left to the largest fractions, earlier ones first."""
    whole = sum(sizes) or 1
    exact = [n * total / whole for n in sizes]
    out = [int(x) for x in exact]
    for i in sorted(range(len(sizes)), key=lambda i: (-(exact[i] - out[i]), i))[: total - sum(out)]:
        out[i] += 1
    return out


def topic_summary(text: str, k: int, iso3: str = "eng") -> str:
    s = split_sentences(text, iso3)
    if len(s) <= k:
        return text
    parts = segments(s, iso3)
    if len(parts) <= 1:
        return " ".join(_condensed(s, k, iso3))
    return " ".join(x for (a, b), n in zip(parts, apportion([b - a for a, b in parts], k)) if n for x in _condensed(s[a:b], n, iso3))


SUMMARIES = {"textrank": textrank, "tfidf": tfidf_summary, "topic": topic_summary}


def summary(text: Column | str, k: int = 3, how: str = "textrank", iso3: Column | str | None = "eng") -> Column:
    """A summary of k sentences in each row, by textrank, tfidf or topic; a shorter text stays as it is. Without iso3 the language is told
    from the text, in the same function."""
    make = SUMMARIES[how]
    if iso3 is None:
        return rowwise(lambda x: make(x or "", k, detected(tokens(x or ""))), "string", text)
    return rowwise(lambda x, y: make(x or "", k, y or "eng"), "string", text, iso3 if isinstance(iso3, Column) else F.lit(iso3))


def topic_segments(text: Column | str, iso3: Column | str = "eng") -> Column:
    """Array of begin, end (sentences, half open) and text."""

    def one(x: str | None, y: str | None) -> list[dict]:
        sents = split_sentences(x or "", y or "eng")
        return [{"begin": a, "end": b, "text": " ".join(sents[a:b])} for a, b in segments(sents, y or "eng")]

    return rowwise(one, "array<struct<begin:int,end:int,text:string>>", text, iso3 if isinstance(iso3, Column) else F.lit(iso3))


def keywords(docs: DataFrame, key: str, text: str = "text", k: int = 10, iso3: str = "eng") -> DataFrame:
    """key, rank, word, n: words of four letters or more that are no function words; ever capitalised first, then by number, then by
    letters; shown as first met."""
    stop = sorted(catalogue()[iso3].function_words)
    w = docs.select(key, F.posexplode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[\p{L}\p{M}]{4,}"), 0)).alias("pos", "w"))
    w = w.withColumn("low", F.lower("w")).filter(~F.col("low").isin(stop))
    g = w.groupBy(key, "low").agg(F.count(F.lit(1)).alias("n"), F.min_by("w", "pos").alias("word"), F.max(F.col("w").rlike(r"^\p{Lu}").cast("int")).alias("cap"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("cap").desc(), F.col("n").desc(), "low"))
    return g.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= k).select(key, "rank", "word", "n")


def focus(text: Column | str, query: str, k: int = 3, iso3: str = "eng") -> Column:
    """The k paragraphs that share most terms with the query, in their order; a text of fewer stays as it is. Ties go to earlier ones."""
    from ..functions.text import paragraphs, text_or_empty

    scored = F.transform(paragraphs(text), lambda p, i: F.struct((-relevance(p, query, iso3)).alias("s"), i.alias("i"), p.alias("p")))
    best = F.array_sort(F.transform(F.slice(F.array_sort(scored), 1, k), lambda x: F.struct(x["i"], x["p"])))
    return let(paragraphs(text), lambda ps: F.when(F.size(ps) <= k, text_or_empty(text)).otherwise(F.array_join(F.transform(best, lambda x: x["p"]), "\n\n")))
