"""Tokenizers, counters, languages and levels."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tokenpress.functions import sentences, sketch, text, words
from tokenpress.lexicon import catalogue, iso3
from tokenpress.operators import chat, compress, language


def col(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr.alias("x")).first().x


TEXTS = ["", "   ", "!!! ...", "the of and to", "Hello 世界 123! Привет!", "Ciao, mondo! 🎉", "The invoice 4500 was not sent to Maria. It's 3,5 percent?\n\nNext: a@b.org http://x.y/z", "Nicht alle Häuser sind alt.", "je ne sais pas où"]


@pytest.mark.parametrize("t", TEXTS)
def test_pieces_give_the_text(spark, t):
    got = col(spark, t, text.pieces("t"))
    assert "".join(p.value for p in got) == t
    assert all(p.value.isalpha() for p in got if p.category == "Word" and p.value.isascii())


def test_categories(spark):
    kinds = [p.category for p in col(spark, "Hello 世界 123! Привет!", text.pieces("t"))]
    assert kinds.count("Word") == 3 and kinds.count("Number") == 1 and kinds.count("Punctuation") == 2
    assert [p.category for p in col(spark, "Ciao, mondo! 🎉", text.pieces("t"))] == ["Word", "Punctuation", "Whitespace", "Word", "Punctuation", "Whitespace", "Emoji"]
    assert [p.value for p in col(spark, "Writer is 10/10!", text.pieces("t")) if p.category == "Word"] == ["Writer", "is"]


def test_null_texts(spark):
    d = spark.createDataFrame([(1, None), (2, "Some words here, and more.")], "doc_id long, text string")
    for level in compress.LEVELS:
        got = {r.doc_id: r for r in compress.compress(d, level).collect()}
        assert got[1].compressed == "" and got[1].original_tokens == 0 and got[2].compressed


@pytest.mark.parametrize("level", compress.LEVELS)
def test_levels_never_expand(spark, level):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in compress.compress(d, level).collect():
        assert r.compressed_tokens <= max(r.original_tokens, len(TEXTS[r.doc_id].split(" "))) and 0 <= r.efficiency <= 100


def test_facts_survive(spark):
    rows = [(1, "eng", "The report about Python was not written by Maria in Berlin."), (2, "deu", "Die Rechnung ist nicht in Berlin."), (3, "spa", "La factura de Madrid no es correcta."), (4, "fra", "Le document de Paris n'est jamais complet."), (5, "ita", "La fattura di Roma non è pronta.")]
    keep = {1: ["not", "Python", "Berlin"], 2: ["nicht"], 3: ["no", "Madrid"], 4: ["jamais", "Paris"], 5: ["non", "Roma"]}
    d = spark.createDataFrame(rows, "doc_id long, iso3 string, text string")
    for level in compress.LEVELS[1:]:
        for r in compress.compress(d, level, iso3="iso3").collect():
            words = r.compressed.split(" ")
            assert all(k in words for k in keep[r.doc_id]), (level, r.compressed)
            assert all(a != b for a, b in zip(words, words[1:]))


def test_numbers_stay_in_light_alone(spark):
    d = spark.createDataFrame([(1, "The invoice of 4500 euros has to be paid by the customer.")], "doc_id long, text string")
    for level in compress.LEVELS[1:]:
        assert ("4500" in compress.compress(d, level).first().compressed) == (level == "light")


def test_aggressive_falls_back(spark):
    d = spark.createDataFrame([(1, "things wonderful beautiful")], "doc_id long, text string")
    assert compress.compress(d, "aggressive").first().compressed == compress.compress(d, "semantic").first().compressed


def test_lemmas(spark):
    d = spark.createDataFrame([(1, "Many documents and reports about children")], "doc_id long, text string")
    assert compress.compress(d, "semantic").first().compressed == "Many document report child"


def test_syntactic_keeps_the_last_verb():
    assert compress._syntactic_one("I really want to run tests", "eng").split()[0] == "run"
    assert compress._syntactic_one("Of the.", "eng") == "Of"


ODD = ["Ⅷ x² 3.5 ½ a\u00a0b. \u00a0Next İstanbul ΑΣ.Β ΟΔΟΣ", "l'été n’est PAS là… Où? Straße's", "emoji 🎉🎉 e\u0301té café-au-lait A1b2 -- 12,5 -,.", "没有 人 不好 学习 中国 bonjour", "Não é fácil. Gli amici non ci sono! Sehr freundlich, nicht wunderbar. Carefully, not awesome."]


def test_words_are_as_expressions_tell_them(spark):
    """What the worker keeps of tokens, against the column functions."""
    every = [(i * 10 + j, k, t) for i, t in enumerate(TEXTS + ODD) for j, k in enumerate(catalogue())]
    d = compress.with_tokens(spark.createDataFrame(every, "i int, iso3 string, text string"), iso3="iso3")
    for r in d.collect():
        found = words.tokens(r.text)
        assert found == [t.text for t in r.tokens]
        start = True
        for w, t in zip(words.words(found, r.iso3), r.tokens):
            assert (w.low, w.lemma, w.punct, w.number, w.stop, bool(w.ender), w.dull, w.guard[start]) == (t.low, t.lemma, t.punct, t.number, t.stop, t.ender, t.stop_lemma or t.generic, t.protected), (r.iso3, t)
            content = not t.punct and (t.protected or not (t.number or t.stop_lemma))
            hard = content and (t.protected or not (t.generic or t.describes or len(t.lemma) <= 1))
            shown = t.text if t.protected or t.lemma == t.low else t.lemma
            assert w.semantic[start] == (shown if content else None) and w.hard[start] == (shown if hard else None) and w.light == (not t.punct and (not t.stop or t.negation))
            assert w.stays[start] == hard
            start = t.ender
    told = language.detect(spark.createDataFrame(list(enumerate(TEXTS + ODD)), "i int, text string")).collect()
    assert [words.detected(words.tokens(r.text)) for r in told] == [r.iso3 for r in told]


@pytest.mark.parametrize("name", ["semantic_filter", "aggressive_filter", "syntactic_filter", "custom_filter_categories"])
def test_levels_look_tokens_up(spark, sf_dir, name):
    """No expression asks each token of a text for each language, or whether it is a name."""
    from tokenpress.plans import catalogue as plans

    plan = plans.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and "hits_eng" not in plan


def test_sentence_scores_stay_in_their_rows(spark, sf_dir):
    from tokenpress.operators import rank
    from tokenpress.plans import catalogue as plans

    out = plans.QUERIES["sentence_tfidf_scores"](spark, sf_dir)
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert rank._tfidf_sums([]) == [] and rank._tfidf_sums([["a", "b", "a"], [], ["b"]]) == [2 / 3 * math.log(3 / 2), None, 0.0]


def test_custom(spark):
    d = compress.with_tokens(spark.createDataFrame([(1, "the Cat saw 12 birds!")], "doc_id long, text string"))
    show = lambda **k: d.select(compress.custom(F.col("tokens"), **k).alias("x")).first().x
    assert show(keep_only=("NUM", "PROPN")) == "Cat 12" and show(remove=("PUNCT", "FUNC")) == "Cat saw 12 birds" and show(predicate=lambda x: F.length(x) > 3) == "birds"


def test_detection(spark):
    rows = [("il gatto non è sulla sedia perché la porta è aperta", "ita"), ("the cat is not on the chair", "eng"), ("der hund ist nicht in dem haus und das ist gut", "deu"), ("", "eng"), ("xyz qqq", "eng"), ("los niños no están en la casa porque es tarde", "spa")]
    got = language.detect(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, text string")).collect()
    assert [r.iso3 for r in sorted(got)] == [k for _, k in rows]
    assert iso3("de") == "deu" and iso3("ENG") == "eng" and iso3("xx") is None and len(catalogue()) == 7


def test_token_counts(spark):
    for t in TEXTS + ["a    b        c", "internationalization of words_with_9"]:
        assert col(spark, t, text.token_count("t")) == chat.count_tokens(t)
    assert col(spark, None, text.token_count("t")) == 0
    long = "several words of some length " * 50
    assert col(spark, long, text.token_count("t", "llama3")) > col(spark, long, text.token_count("t")) > col(spark, long, text.token_count("t", "claude3"))


def test_sentences():
    assert len(sentences.split_sentences("One is ready today. Two came! Three went? Four are gone.")) == 4
    assert len(sentences.split_sentences("Dr. Smith came. Then Mary left.")) == 2
    assert len(sentences.split_sentences("First line\n\nsecond line")) == 2
    assert sentences.split_sentences("Wait... what happened here") == ["Wait... what happened here"]
    assert sentences.split_sentences("") == [] and sentences.split_sentences("?!") == []


def test_han():
    assert sentences.segment_han("我们学习自然语言处理") == ["我们", "学习", "自然语言处理"]
    assert sentences.segment_han("龘龘") == ["龘", "龘"]


def test_results_are_made_by_slices(spark):
    """What a batch of long texts becomes is never there as a whole."""
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, StringType

    from tokenpress.functions import batches

    run = batches.sliced(lambda rows: [sentences.split_han(x) for (x,) in rows], ArrayType(StringType()))
    long = "我们学习自然语言处理x" * 5000
    got = list(run(iter([pa.array([long] * 20 + ["a 龘", ""]), pa.array([], pa.string())])))
    assert sum(map(len, got)) == 22 and max(map(len, got)) <= 3 and got[-2].to_pylist()[-2:] == [["a", "龘"], []]
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
    d = spark.createDataFrame([("我们学习 ab, 龘",), (None,)], "t string").select(sentences.han_words("t").alias("w"))
    assert [r.w for r in d.collect()] == [["我们", "学习", "ab", ",", "龘"], []]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == batches.BATCH_BYTES


def test_simhash_text():
    a, b, c = "user 12 logged in from host alpha at noon", "user 13 logged in from host alpha at noon", "completely different words without anything shared"
    f = sketch.simhash_text
    assert f(a) == f(a) and sketch.hamming(f(a), f(b)) < sketch.hamming(f(a), f(c)) and f("  ") == 0
    assert sketch.fnv1a("") == 0xCBF29CE484222325


def test_similar_pairs(spark):
    rows = [(1, 0), (2, 1), (3, 7), (4, 255), (5, -1), (6, -3), (7, 0)]
    got = {(r.a, r.b, r.distance) for r in sketch.similar_pairs(spark.createDataFrame(rows, "doc_id long, simhash long")).collect()}
    assert got == {(1, 2, 1), (1, 3, 3), (2, 3, 2), (5, 6, 1)}


def test_fingerprints_meet_by_two_blocks(spark):
    """All pairs are found, and a block that many share makes no square of them."""
    rng = random.Random(2)
    some = [rng.getrandbits(63) for _ in range(150)]
    near = some + [x ^ sum(1 << b for b in rng.sample(range(63), rng.randint(1, 5))) for x in some]
    d = spark.createDataFrame(list(enumerate(near)), "doc_id long, simhash long")
    for bits in (0, 1, 3):
        got = sorted((r.a, r.b, r.distance) for r in sketch.similar_pairs(d, bits=bits).collect())
        assert got == [(i, j, n) for i in range(300) for j in range(i + 1, 300) if 0 < (n := sketch.hamming(near[i], near[j])) <= bits]
    shared = spark.createDataFrame([(i, (0x2BCD << 48) | rng.getrandbits(48)) for i in range(2000)], "k long, simhash long")
    assert sketch._meetings(shared, "simhash", 3).filter("ka <> kb").count() < 20_000


def test_simhashes_of_many():
    texts = TEXTS + ODD + ["a b c", "x" * 3000 + " y z", "𝒳𝒴 x 🎉 z", "one two " * 300]
    for n in (1, 3):
        by_hand = []
        for t in texts:
            w = words.terms(t.lower())
            hs = [sketch.fnv1a(u) for u in [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or w]
            by_hand.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
        assert [int(x) & (1 << 64) - 1 for x in sketch.simhashes(texts, n)] == by_hand == [sketch.simhash_text(t, n) for t in texts]


def test_same_pairs(spark, tmp_path):
    from tokenpress.plans import texts

    rows = [(3, 9), (1, 9), (2, 9), (2, 9), (4, 8), (5, -1), (None, -1)]
    got = sorted((r.a, r.b, r.distance) for r in sketch.same_pairs(spark.createDataFrame(rows, "doc_id long, simhash long")).collect() if r.b)
    assert got == [(1, 2, 0), (1, 3, 0)]
    d = spark.createDataFrame([(1, "one two three four"), (2, "One, two: three four!"), (3, "other words that are far away"), (4, "one two three four")], "doc_id long, text string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    assert {(1, 2, 0), (1, 4, 0)} == {tuple(r) for r in texts.simhash_pairs(spark, str(tmp_path)).collect()}
