"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, langid, packing, quality, quality_rules, secret_scan, simhash, substring, suffix, warc
from .common import table


def op1_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.outliers(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.drop_repeated_windows(table(spark, sf_dir, "documents"))


def op3_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.drop_repeated_bytes(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(table(spark, sf_dir, "documents")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_robust_outliers, op2_substring_dedup, op3_warc_transactions, op4_suffix_array_dedup, op5_simhash, op6_language_id, op7_quality_classifier, op8_packing, op9_secret_scan, op10_decontamination,
    )
}



def _power(e: str, base: int, mod: int) -> str:
    """SQL for base ** e modulo mod (of at most 31 bits), e of at most 20 bits."""
    out = "1::BIGINT"
    for k in range(20):
        out = f"({out} * CASE WHEN ({e}) >> {k} & 1 = 1 THEN {pow(base, 1 << k, mod)} ELSE 1 END % {mod})"
    return out


#: RE2's folding of case goes beyond ASCII, so cases are spelt out.
_ASSIGN_SQL = "'(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'"""

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": r"""
        WITH d AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        win AS MATERIALIZED (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d)),
        bad AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k) AS lo FROM win) WHERE lo < doc_id),
        cut AS (SELECT DISTINCT doc_id, p + o AS i FROM bad, (SELECT unnest(range(50)) AS o)),
        word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
        rest AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN cut USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256,
               coalesce(s, 0)::BIGINT AS n_spans
        FROM d LEFT JOIN rest USING (doc_id)
        LEFT JOIN (SELECT doc_id, count(*) AS s FROM cut c WHERE NOT EXISTS (SELECT 1 FROM cut b WHERE b.doc_id = c.doc_id AND b.i = c.i - 1) GROUP BY doc_id) USING (doc_id)
    """,
    "op10_decontamination": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
        bs AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT item_id, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
        ds AS (SELECT DISTINCT doc_id, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM bs))),
        n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id)
        SELECT doc_id, item_id, count(*)::BIGINT AS n_shared, any_value(n)::BIGINT AS n_shingles, round(count(*) / any_value(n), 6) AS containment
        FROM ds JOIN bs USING (k, s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n)
    """,
    "op3_warc_transactions": r"""
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS x, min(page_id) OVER (PARTITION BY sha1(b)) AS lo FROM p),
        bits AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: bin(16 + ('0x' || x[i:i])::INT)[2:5]), '') AS z FROM h)
        SELECT page_id, n::BIGINT AS payload_bytes,
               array_to_string(list_transform(list_transform(range(0, 32), lambda i: 16 * z[5*i+1:5*i+1]::INT + 8 * z[5*i+2:5*i+2]::INT + 4 * z[5*i+3:5*i+3]::INT + 2 * z[5*i+4:5*i+4]::INT + z[5*i+5:5*i+5]::INT), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[k + 1:k + 1]), '') AS payload_digest,
               CASE WHEN lo < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN lo < page_id THEN lo END AS refers_to
        FROM bits
    """,
    "op4_suffix_array_dedup": rf"""
        -- Windows meet by two polynomial hashes modulo primes of 31 bits, made from prefix sums over the bytes.
        WITH b AS MATERIALIZED (SELECT doc_id, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS x FROM documents)),
        top AS (SELECT max(i) AS top FROM b),
        p AS MATERIALIZED (SELECT i, {_power("i", 131, 2147483647)} AS p, {_power("i", 137, 2147483629)} AS q, {_power("top - i", 131, 2147483647)} AS pr, {_power("top - i", 137, 2147483629)} AS qr
              FROM (SELECT unnest(range(0, top + 1)) AS i, top FROM top)),
        s AS (SELECT doc_id, i, x, sum(v * p) OVER w::BIGINT AS sp, sum(v * q) OVER w::BIGINT AS sq, pr, qr FROM (SELECT b.*, ('0x' || x)::BIGINT + 1 AS v FROM b) JOIN p USING (i) WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 399 FOLLOWING)),
        h AS (SELECT doc_id, i, x, CASE WHEN count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 399 FOLLOWING) = 400 THEN ((sp % 2147483647) * pr % 2147483647) * 4294967296 + (sq % 2147483629) * qr % 2147483629 END AS h FROM s),
        f AS (SELECT *, h IS NOT NULL AND count(*) OVER (PARTITION BY h) > 1 AS f FROM h),
        c AS (SELECT doc_id, i, x, max(f::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 399 PRECEDING AND CURRENT ROW) = 1 AS c FROM f),
        e AS (SELECT *, c AND NOT coalesce(lag(c) OVER (PARTITION BY doc_id ORDER BY i), false) AS new FROM c),
        o AS (SELECT doc_id, count(*) AS n, sum(c::INT) AS cut, sum(new::INT) AS spans, sha256(unhex(coalesce(string_agg(x, '' ORDER BY i) FILTER (WHERE NOT c), ''))) AS sha FROM e GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_bytes, coalesce(cut, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, coalesce(sha, sha256('')) AS kept_sha256 FROM documents LEFT JOIN o USING (doc_id)
    """,
    "op9_secret_scan": rf"""
        WITH pat(kind, k, p) AS (VALUES ('assign', 0, {_ASSIGN_SQL}), ('access', 1, 'AKIA[A-Z0-9]+'), ('hex', 2, '[0-9a-f]+'), ('pair', 3, '[A-Za-z0-9+/_-]+')),
        -- Matches between marks; where each begins from the lengths of what is before it.
        cut AS (SELECT doc_id, source, kind, k, p, string_split(regexp_replace(coalesce(text, ''), p, chr(57344) || '\0' || chr(57344), 'g'), chr(57344)) AS l FROM documents, pat),
        part AS (SELECT doc_id, source, kind, k, p, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM cut),
        placed AS (SELECT *, coalesce(sum(length(x)) OVER (PARTITION BY doc_id, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM part),
        found AS (SELECT doc_id, coalesce(source, '') AS owner, kind, k, b, b + length(x) AS e, CASE WHEN kind = 'assign' THEN regexp_extract(x, p, 2) ELSE x END AS v FROM placed WHERE i % 2 = 0),
        base AS (SELECT * FROM found WHERE (kind = 'assign' AND length(v) >= 6) OR (kind = 'access' AND length(v) >= 20) OR (kind = 'hex' AND length(v) >= 24)),
        mixed AS (SELECT * FROM found WHERE kind = 'pair' AND length(v) >= 32 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')),
        sure AS (SELECT v FROM (SELECT v, c, count(*) AS n FROM (SELECT v, unnest(string_split(v, '')) AS c FROM (SELECT DISTINCT v FROM mixed)) GROUP BY v, c) GROUP BY v HAVING -sum(n / length(v)::DOUBLE * log2(n / length(v)::DOUBLE)) >= 3.5),
        pair AS (SELECT * FROM mixed m WHERE v IN (FROM sure) AND NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = m.doc_id AND base.b < m.e AND m.b < base.e)),
        cand AS (SELECT * FROM base UNION ALL SELECT * FROM pair),
        spread AS (SELECT v, count(DISTINCT owner) <= 2 AND count(DISTINCT doc_id) <= 100 AS live FROM cand GROUP BY v),
        s AS (SELECT doc_id, k, b, kind || ':' || b || ':' || e AS t, k < 3 AS base, live FROM cand JOIN spread USING (v) WHERE k < 3 OR live),
        o AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex, string_agg(t, ',' ORDER BY b, k) FILTER (WHERE base) AS base,
              string_agg(t, ',' ORDER BY b, k) AS spans, count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_examples FROM s GROUP BY doc_id)
        SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
               coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_examples, 0)::BIGINT AS n_examples FROM documents LEFT JOIN o USING (doc_id)
    """,
}
