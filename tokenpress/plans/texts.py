"""Queries on documents: tokens, languages, levels, scans, ranking, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sentences, sketch, text
from ..operators import compress, language, rank, scan
from ..sources import stores
from . import sqltools as q

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
TEXTS = ("documents", "pages")


def docs(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of texts. One small file is one task's work, whatever it takes: rows of tables with fewer splits than there are cores are
    spread once. Tables of a usual size have more, and stay as they are."""
    d = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return d.repartition(cores) if name in TEXTS and d.rdd.getNumPartitions() < cores else d


def rounded(x, digits: int = 6):
    """As the SQL rounds: the product, not the decimals as they are written; 41 of 640 is a tie for one and none for the other."""
    return F.round(x * 10.0**digits) / 10.0**digits


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"SELECT doc_id, {', '.join(f'{q.token_count('text', m)} AS {m}' for m in text.FACTORS)} FROM documents")
def token_count_by_model(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", *(text.token_count("text", m).alias(m) for m in text.FACTORS))


@query(f"""WITH c AS (SELECT lang, sum({q.token_count('text')})::BIGINT AS tokens FROM documents GROUP BY lang)
    SELECT lang, tokens, (tokens::DECIMAL(18,0) * 0.00003::DECIMAL(18,9))::DECIMAL(18,6)::DOUBLE AS gpt4_usd FROM c""")
def cost_estimate_by_lang(spark, sf_dir):
    d = docs(spark, sf_dir).groupBy("lang").agg(F.sum(text.token_count("text")).alias("tokens"))
    return d.select("lang", "tokens", text.cost(F.col("tokens")).cast("double").alias("gpt4_usd"))


@query(f"SELECT doc_id, len(t)::BIGINT AS n, md5(array_to_string(t, chr(1))) AS digest FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {q.lit(text.TOKEN)}) AS t FROM documents)")
def word_tokens_per_doc(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", text.word_tokens("text").alias("t"))
    return d.select("doc_id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t", "\x01")).alias("digest"))


_PIECES = "https?://[^\\s]+|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}|[\\p{L}\\p{M}]+|\\p{N}+|\\r?\\n|[^\\S\\n]+|[^\\s]"


@query(rf"""WITH p AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {q.lit(_PIECES)}) AS l FROM documents)),
    c AS (SELECT *, CASE WHEN regexp_matches(x, '^https?://[^\s]+$') THEN 'Url' WHEN regexp_matches(x, '^{text.EMAIL}$') THEN 'Email' WHEN regexp_matches(x, '^[\p{{L}}\p{{M}}]+$') THEN 'Word' WHEN regexp_matches(x, '^\p{{N}}+$') THEN 'Number'
        WHEN regexp_matches(x, '^\r?\n$') THEN 'Newline' WHEN regexp_matches(x, '^\s+$') THEN 'Whitespace' WHEN regexp_matches(x, '^{text.EMOJI}+$') THEN 'Emoji' ELSE 'Punctuation' END AS category FROM p),
    r AS (SELECT *, category = 'Punctuation' AND x IS NOT DISTINCT FROM lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS again FROM c)
    SELECT doc_id, category, count(*) FILTER (WHERE NOT again)::BIGINT AS n, sum(length(x))::BIGINT AS chars FROM r GROUP BY doc_id, category""")
def token_categories(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.explode(text.pieces("text")).alias("p"))
    return d.groupBy("doc_id", F.col("p.category").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("p.value")).alias("chars"))


@query(r"""SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''))::BIGINT AS paragraphs,
    len(string_split(coalesce(text, ''), chr(10)))::BIGINT AS n_lines FROM documents""")
def paragraphs_and_lines(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(text.paragraphs("text")).cast("bigint").alias("paragraphs"), F.size(text.lines("text")).cast("bigint").alias("n_lines"))


def _level(name):
    def run(spark, sf_dir):
        return compress.compress(docs(spark, sf_dir), name).select("doc_id", "iso3", "compressed", "original_tokens", "compressed_tokens", "saved_tokens", "efficiency", "energy_mwh", "co2_mg")

    return run


def _level_sql(out: str, keep_all: str = "") -> str:
    return f"""WITH {q.tokens()},
        o AS (SELECT doc_id, {out} AS compressed FROM t GROUP BY doc_id),
        r AS (SELECT k.doc_id, k.iso3, coalesce(compressed, '') AS compressed, {q.token_count('s.text')} AS original_tokens, {q.token_count("coalesce(compressed, '')")} AS compressed_tokens
              FROM k JOIN documents s USING (doc_id) LEFT JOIN o USING (doc_id))
        SELECT *, {q.savings()} FROM r"""


_SEMANTIC = q.joined(q.SHOWN, q.CONTENT)
for _name, _sql in (
    ("light", q.joined("x", "NOT punct AND (NOT stop OR neg)")),
    ("semantic", _SEMANTIC),
    ("aggressive", f"CASE WHEN {q.joined(q.SHOWN, q.HARD)} = '' AND bool_or(NOT punct) THEN {_SEMANTIC} ELSE {q.joined(q.SHOWN, q.HARD)} END"),
):
    QUERIES[f"{_name}_filter"] = _level(_name)
    ORACLE_SQL[f"{_name}_filter"] = _level_sql(_sql)
QUERIES["syntactic_filter"] = _level("syntactic")
QUERIES["none_filter"] = _level("none")
ORACLE_SQL["none_filter"] = f"""WITH {q.hits()}, r AS (SELECT doc_id, {q.detected()} AS iso3, coalesce(text, '') AS compressed, len(list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> ''))::BIGINT AS original_tokens FROM h),
    t AS (SELECT *, original_tokens AS compressed_tokens FROM r) SELECT *, {q.savings()} FROM t"""


@query(f"""WITH {q.tokens()},
    s0 AS (SELECT *, coalesce(sum(ender::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent,
           CASE WHEN NOT punct AND NOT prot AND NOT num THEN lemma END AS word FROM t),
    g AS (SELECT doc_id, word, count(*) AS tf, count(DISTINCT sent) AS df, min(i) AS lead FROM s0 WHERE word IS NOT NULL GROUP BY doc_id, word),
    n AS (SELECT doc_id, sum(ender::INT) + 1 AS s FROM t GROUP BY doc_id),
    sc AS (SELECT s0.*, CASE WHEN s0.word IS NULL THEN NULL WHEN stop_lemma OR generic THEN 0 ELSE round(tf * CASE WHEN s = 1 THEN 1.0::DOUBLE ELSE ln(s::DOUBLE / (1 + df)) + 1 END, 9) END AS score, i = lead AS lead
           FROM s0 LEFT JOIN g ON g.doc_id = s0.doc_id AND g.word = s0.word JOIN n ON n.doc_id = s0.doc_id),
    c AS (SELECT doc_id, list_sort(list(score) FILTER (WHERE lead AND score > 0)) AS l, coalesce(max(score) > 0, false) AS any_ FROM sc GROUP BY doc_id),
    kp AS (SELECT sc.*, any_, coalesce((prot AND NOT punct) OR (score > 0 AND score >= l[len(l) // 2 + 1]), false) AS keep FROM sc JOIN c USING (doc_id)),
    f AS (SELECT *, NOT bool_or(keep) OVER (PARTITION BY doc_id, sent) AND score IS NOT NULL
                 AND row_number() OVER (PARTITION BY doc_id, sent ORDER BY score DESC NULLS LAST, i) = 1 AS floor FROM kp),
    o AS (SELECT doc_id, string_agg(CASE WHEN any_ AND NOT prot THEN word ELSE x END, ' ' ORDER BY i) AS compressed FROM f WHERE CASE WHEN any_ THEN keep OR floor ELSE NOT punct AND NOT num END GROUP BY doc_id)
    SELECT doc_id, coalesce(compressed, '') AS compressed FROM documents LEFT JOIN o USING (doc_id)""")
def statistical_filter(spark, sf_dir):
    return compress.compress(docs(spark, sf_dir), "statistical").select("doc_id", "compressed")


@query(f"""WITH {q.tokens()},
    c AS (SELECT *, CASE WHEN punct THEN 'PUNCT' WHEN stop THEN 'FUNC' WHEN num THEN 'NUM' WHEN regexp_matches(x, '^\\p{{Lu}}.') THEN 'PROPN' ELSE 'CONTENT' END AS cat FROM t)
    SELECT doc_id, {q.joined('x', "cat = 'PROPN'")} AS names, {q.joined('x', "NOT punct AND NOT stop")} AS no_func, count(*) FILTER (WHERE cat = 'NUM')::BIGINT AS numbers FROM c GROUP BY doc_id""")
def custom_filter_categories(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "text").filter(F.col("text").rlike(r"[^\s]"))
    made = compress.with_filtered(d, {"names": {"keep_only": ("PROPN",)}, "no_func": {"remove": ("PUNCT", "FUNC")}}, {"numbers": "NUM"})
    return made.select("doc_id", "names", "no_func", "numbers")


@query(f"""WITH {q.tokens()},
    o AS (SELECT doc_id, {q.joined("x", "NOT punct AND (NOT stop OR neg)")} AS compressed FROM t GROUP BY doc_id),
    r AS (SELECT lang, source, {q.token_count('s.text')} AS b, {q.token_count("coalesce(compressed, '')")} AS a FROM documents s LEFT JOIN o USING (doc_id))
    SELECT lang, source, count(*)::BIGINT AS n, sum(b)::BIGINT AS original_tokens, sum(a)::BIGINT AS compressed_tokens, sum(greatest(b - a, 0))::BIGINT AS saved_tokens,
           round(sum(greatest(b - a, 0)) * 100.0::DOUBLE / sum(b), 6) AS percent FROM r WHERE b > 0 GROUP BY ROLLUP (lang, source)""")
def savings_rollup(spark, sf_dir):
    d = docs(spark, sf_dir)
    done = compress.with_compressed(d.select("doc_id", "text", "lang", "source"), "light")
    r = done.select("lang", "source", text.token_count("text").alias("original_tokens"), text.token_count("compressed").alias("compressed_tokens"))
    return stores.savings(r, "lang", "source")


@query(f"WITH {q.hits()} SELECT doc_id, n_words, {', '.join(f'hits_{k}' for k in language.catalogue())} FROM h")
def lang_hits(spark, sf_dir):
    return language.with_hits(docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_words", *(f"hits_{k}" for k in language.catalogue()))


@query(f"WITH {q.hits()} SELECT doc_id, iso3, round(score, 6) AS score FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS iso3, hits_{k}::DOUBLE / greatest(n_words, 1) AS score FROM h WHERE hits_{k} > 0" for k in language.catalogue())
       + f" UNION ALL SELECT doc_id, 'eng', 1.0 FROM h WHERE {' AND '.join(f'hits_{k} = 0' for k in language.catalogue())})")
def lang_scores(spark, sf_dir):
    # Maps are never empty. Of explode, the optimizer makes a filter on that, which counts the hits of a text anew wherever it names them.
    return language.scores(docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.explode_outer("scores").alias("iso3", "score")).select("doc_id", "iso3", rounded(F.col("score")).alias("score"))


@query(f"WITH {q.hits()} SELECT doc_id, {q.detected()} AS iso3 FROM h")
def lang_detect(spark, sf_dir):
    return language.detect(docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", "iso3")


@query(f"WITH {q.hits()} SELECT lang, count(*)::BIGINT AS n, sum(({q.detected()} = CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'deu' WHEN 'es' THEN 'spa' END)::INT)::BIGINT AS right_ones FROM h GROUP BY lang")
def lang_detect_accuracy(spark, sf_dir):
    from ..lexicon import ISO

    code = F.create_map(*(F.lit(x) for kv in ISO.items() for x in kv))
    d = language.detect(docs(spark, sf_dir).select("doc_id", "text", "lang"))
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("iso3") == F.try_element_at(code, F.col("lang"))).cast("bigint")).alias("right_ones"))


@query("SELECT doc_id, fp AS fingerprint, min(doc_id) OVER (PARTITION BY fp) AS first, count(*) OVER (PARTITION BY fp) AS copies FROM (SELECT doc_id, upper(substr(sha256(lower(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g'))), 1, 16)) AS fp FROM documents)")
def fingerprint_dups(spark, sf_dir):
    return scan.fingerprint_duplicates(docs(spark, sf_dir))


_S = "coalesce(text, '')"


def _first_sql(patterns) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({_S}, {q.lit(scan.bounded(p))}) THEN {q.lit(p)}" for p in patterns) + " END"


def _safety_sql(table: str, key: str) -> str:
    return f"""WITH s AS (SELECT {key}, {_first_sql(scan.CRITICAL)} AS c, {_first_sql(scan.DESTRUCTIVE)} AS x, {_first_sql(scan.WARNING)} AS w FROM {table})
        SELECT {key}, CASE WHEN c IS NOT NULL OR x IS NOT NULL THEN 'Critical' WHEN w IS NOT NULL THEN 'Warning' ELSE 'Normal' END AS level, coalesce(c, x, w) AS pattern FROM s"""


@query(_safety_sql("documents", "doc_id"))
def safety_verdict(spark, sf_dir):
    return scan.safety_of(docs(spark, sf_dir)).select("doc_id", "safety.level", "safety.pattern")


def _waste_sql(x: str) -> dict[str, str]:
    cost = lambda p: f"coalesce(list_sum(list_transform(regexp_extract_all(coalesce({x}, ''), {q.lit(p)}), lambda w: greatest(1, length(w) // 4))), 0)::BIGINT"
    return {"html": cost(scan.HTML_TAG), "base64": cost(scan.BASE64), "blanks": cost(scan.BLANKS)}


@query("SELECT page_id, " + ", ".join(f"{v} AS {k}" for k, v in _waste_sql("html").items()) + ", (" + " + ".join(_waste_sql("html").values()) + ")::BIGINT AS total FROM pages")
def waste_scan(spark, sf_dir):
    return docs(spark, sf_dir, "pages").select("page_id", scan.waste("html").alias("w")).select("page_id", "w.html", "w.base64", "w.blanks", "w.total")


@query("SELECT role, sum(" + " + ".join(_waste_sql("text").values()) + ")::BIGINT AS total, count(*)::BIGINT AS n FROM conversations GROUP BY role")
def waste_by_role(spark, sf_dir):
    return docs(spark, sf_dir, "conversations").groupBy("role").agg(F.sum(scan.waste("text")["total"]).alias("total"), F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, label, sample FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS label, substr(regexp_extract(text, {q.lit(p)}), 1, 40) AS sample FROM documents" for k, p in scan.VOLATILE.items()) + ") WHERE sample <> ''")
def volatile_scan(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.explode(scan.volatile("text")).alias("v")).select("doc_id", "v.label", "v.sample")


QUERY = "the onand erere"


def _bm25_sql(weights: dict[str, float]) -> str:
    words = sorted(weights)
    tf = ", ".join(f"len(list_filter(t, lambda x: x = {q.lit(w)}))::BIGINT AS tf{i}" for i, w in enumerate(words))
    df = ", ".join(f"sum((tf{i} > 0)::INT) AS df{i}" for i in range(len(words)))
    score = " + ".join(f"CASE WHEN tf{i} > 0 THEN {weights[w]}::DOUBLE * ln((n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE) + 1) * (1.0::DOUBLE + tf{i} * 2.5::DOUBLE / (tf{i} + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))) ELSE 0 END" for i, w in enumerate(words))
    return f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}\\p{{M}}]+') AS t FROM documents),
        c AS (SELECT doc_id, len(t)::BIGINT AS dl, {tf} FROM w), s AS (SELECT count(*) AS n, avg(dl) AS mean, {df} FROM c),
        r AS (SELECT doc_id, round({score}, 6) AS score FROM c, s) SELECT doc_id, score FROM r WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20"""


@query(_bm25_sql(dict.fromkeys(QUERY.split(), 1.0)))
def bm25_topk(spark, sf_dir):
    return rank.retrieve(docs(spark, sf_dir), QUERY, 20)


@query(_bm25_sql({"the": 0.5, "con": 2.0, "erste": 1.5, "que": 0.25}))
def bm25_weighted(spark, sf_dir):
    return rank.retrieve(docs(spark, sf_dir), {"the": 0.5, "con": 2.0, "erste": 1.5, "que": 0.25}, 20)


_RM3 = f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}\\p{{M}}]+') AS t FROM documents), tok AS (SELECT doc_id, len(t) AS dl, unnest(t) AS w FROM w),
    st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM w), tf AS (SELECT doc_id, dl, w, count(*)::DOUBLE AS tf FROM tok GROUP BY ALL), df AS (SELECT w, count(*)::DOUBLE AS df FROM tf GROUP BY w),
    part AS (SELECT doc_id, w, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * (1 + tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))) AS s FROM tf JOIN df USING (w), st),
    asked AS (SELECT unnest([{', '.join(map(q.lit, QUERY.split()))}]) AS w),
    best AS (SELECT doc_id, round(sum(s), 6) AS score FROM part WHERE w IN (FROM asked) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10),
    model AS (SELECT w, round(sum(score / total / dl), 12) AS p FROM tok JOIN (SELECT doc_id, score, sum(score) OVER () AS total FROM best) USING (doc_id) WHERE w NOT IN (FROM asked) GROUP BY w ORDER BY p DESC, w LIMIT 10),
    wanted AS (SELECT w, 0.6::DOUBLE / {len(QUERY.split())} AS weight FROM asked UNION ALL SELECT w, 0.4::DOUBLE * p / sum(p) OVER () FROM model)
    SELECT doc_id, round(sum(weight * s), 6) AS score FROM part JOIN wanted USING (w) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20"""


@query(_RM3)
def rm3_topk(spark, sf_dir):
    return rank.retrieve_rm3(docs(spark, sf_dir), QUERY, 20)


@query(r"""WITH c AS (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}\p{M}]+') AS t FROM conversations)
    SELECT conv_id, turn, round((list_contains(t, 'report')::INT + list_contains(t, 'reports')::INT - (list_contains(t, 'report') AND list_contains(t, 'reports'))::INT
           + list_contains(t, 'erste')::INT + list_contains(t, 'thing')::INT) / 3.0::DOUBLE, 6) AS score FROM c""")
def relevance_rank(spark, sf_dir):
    return docs(spark, sf_dir, "conversations").select("conv_id", "turn", rank.relevance("text", "the reports erste thing").alias("score"))


@query()
def sentence_split(spark, sf_dir):
    d = language.detect(docs(spark, sf_dir).select("doc_id", "text"))
    return d.select("doc_id", F.posexplode(sentences.sentences("text", F.col("iso3"))).alias("idx", "sentence"))


def _summary(how):
    def run(spark, sf_dir):
        return docs(spark, sf_dir).select("doc_id", rank.summary("text", 3, how, None).alias("summary"))

    return run


for _how in ("textrank", "tfidf", "topic"):
    QUERIES[f"{_how}_summary"] = _summary(_how)


@query()
def topic_segments(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.explode(rank.topic_segments("text")).alias("s")).select("doc_id", "s.begin", "s.end", "s.text")


@query()
def summarize_and_compress(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", rank.summary("text", 3, "tfidf").alias("text"))
    return compress.compress(d, "semantic")


@query(r"""WITH s AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS i, len(l) AS n FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?]\s+'), lambda x: regexp_matches(x, '\p{L}')) AS l FROM documents)),
    w AS (SELECT doc_id, i, n, unnest(regexp_extract_all(lower(s), '[\p{L}\p{M}]+')) AS w FROM s), tf AS (SELECT doc_id, i, n, w, count(*) AS c FROM w GROUP BY ALL),
    df AS (SELECT doc_id, w, count(*) AS df FROM tf GROUP BY ALL), len AS (SELECT doc_id, i, sum(c) AS l FROM tf GROUP BY ALL)
    SELECT doc_id, i::INT AS idx, round(sum(c::DOUBLE / l * ln(n::DOUBLE / (1 + df))) + CASE WHEN i = 0 THEN 0.3::DOUBLE WHEN i::DOUBLE / n < 0.15::DOUBLE THEN 0.15::DOUBLE WHEN i::DOUBLE / n > 0.85::DOUBLE THEN 0.1::DOUBLE ELSE 0 END, 6) AS score
    FROM tf JOIN df USING (doc_id, w) JOIN len USING (doc_id, i) GROUP BY doc_id, i, n""")
def sentence_tfidf_scores(spark, sf_dir):
    l = F.filter(F.split(text.text_or_empty("text"), r"[.!?]\s+"), lambda x: x.rlike(r"\p{L}"))
    words = F.transform(l, lambda x: F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{M}]+"), 0))
    d = docs(spark, sf_dir).select("doc_id", rank.tfidf_sums(words).alias("sums")).select("doc_id", F.size("sums").alias("n"), F.posexplode_outer("sums").alias("idx", "s")).filter("s IS NOT NULL")
    place = F.when(F.col("idx") == 0, 0.3).when(F.col("idx") / F.col("n") < 0.15, 0.15).when(F.col("idx") / F.col("n") > 0.85, 0.1).otherwise(0.0)
    return d.select("doc_id", "idx", rounded(F.col("s") + place).alias("score"))


@query(r"""WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}\p{M}]+')) AS w FROM benchmark),
    h AS (SELECT item_id, list_reduce([14695981039346656037::HUGEINT] || list_transform(string_split(w, ''), lambda c: unicode(c)::HUGEINT), lambda a, c: (xor(a, c) * 1099511628211) % 18446744073709551616) AS h FROM w),
    v AS (SELECT item_id, b, sum(CASE WHEN (h // (1::HUGEINT << b)) % 2 = 1 THEN 1 ELSE -1 END) AS v FROM h, (SELECT unnest(range(64))::INT AS b) GROUP BY item_id, b),
    s AS (SELECT item_id, sum(CASE WHEN v > 0 THEN 1::HUGEINT << b ELSE 0 END) AS u FROM v GROUP BY item_id)
    SELECT item_id, (CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END)::BIGINT AS simhash FROM s""")
def simhash64(spark, sf_dir):
    return docs(spark, sf_dir, "benchmark").select("item_id", sketch.simhash("text").alias("simhash"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}\p{M}]+') AS w FROM documents),
    u AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) ELSE w END) AS u FROM w),
    h AS (SELECT u, list_reduce([14695981039346656037::HUGEINT] || list_transform(string_split(u, ''), lambda c: unicode(c)::HUGEINT), lambda a, c: (xor(a, c) * 1099511628211) % 18446744073709551616) AS h FROM (SELECT DISTINCT u FROM u)),
    c AS (SELECT doc_id, h, count(*) AS c FROM u JOIN h USING (u) GROUP BY ALL),
    v AS (SELECT doc_id, b, sum(CASE WHEN (h // (1::HUGEINT << b)) % 2 = 1 THEN c ELSE -c END) AS v FROM c, (SELECT unnest(range(64))::INT AS b) GROUP BY doc_id, b),
    s AS (SELECT doc_id, sum(CASE WHEN v > 0 THEN 1::HUGEINT << b ELSE 0 END) AS f FROM v GROUP BY doc_id), a AS (SELECT doc_id, coalesce(f, 0::HUGEINT) AS f FROM documents LEFT JOIN s USING (doc_id)),
    one AS (SELECT f, min(doc_id) AS k FROM a GROUP BY f)
    SELECT least(x.k, y.k) AS a, greatest(x.k, y.k) AS b, bit_count(xor(x.f, y.f))::BIGINT AS distance FROM one x JOIN one y ON x.f < y.f AND bit_count(xor(x.f, y.f)) <= 3
    UNION ALL SELECT k, doc_id, 0 FROM a JOIN one USING (f) WHERE doc_id <> k""")
def simhash_pairs(spark, sf_dir):
    """Pairs of the smallest documents of their fingerprints, and each other document with the smallest of its own, at distance 0."""
    # Known to be never null, no join filters it: all sides share one pass over the texts.
    d = docs(spark, sf_dir).select("doc_id", F.coalesce(sketch.simhash("text", 3), F.lit(0).cast("bigint")).alias("simhash"))
    return sketch.similar_pairs(d).unionByName(sketch.same_pairs(d))


LATIN, CHINESE = "abcdefghijklmnopqrstuvw", "我们学习自然语言处理北京大的生今天没有来中国"


@query()
def han_segment(spark, sf_dir):
    """Texts with each letter put as a Chinese character, segmented."""
    d = docs(spark, sf_dir).select("doc_id", F.translate(F.lower(text.text_or_empty("text")), LATIN, CHINESE).alias("text"))
    return d.select("doc_id", F.array_join(sentences.han_words("text"), "|").alias("words"))


@query(r"SELECT doc_id, len(t)::BIGINT AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{Nd}_]+'), lambda x: length(x) >= 2) AS t FROM documents)")
def json_terms_per_doc(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.json_terms("text").alias("t")).select("doc_id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(r"""WITH c AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}\p{M}]+') AS t FROM documents)
    SELECT doc_id, round((list_has_any(t, ['report', 'reports'])::INT + list_contains(t, 'erste')::INT + list_contains(t, 'que')::INT + list_contains(t, 'onand')::INT) / 4.0::DOUBLE, 6) AS score FROM c ORDER BY score DESC, doc_id LIMIT 10""")
def relevance_topk(spark, sf_dir):
    return rank.top(docs(spark, sf_dir).select("doc_id", rank.relevance("text", "the reports erste que onand").alias("score")), 10)


@query("SELECT doc_id, len(t)::BIGINT AS n, len(list_distinct(t))::BIGINT AS n_distinct FROM (SELECT doc_id, list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i:i + 2], ' ')) AS t FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}\\p{M}]+') AS w FROM documents) WHERE len(w) >= 3)")
def shingles_per_doc(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", text.terms("text").alias("w")).filter(F.size("w") >= 3).select("doc_id", text.shingles(F.col("w"), 3).alias("t"))
    return d.select("doc_id", F.size("t").cast("bigint").alias("n"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"))
