"""The library's functions by name in SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..lexicon import iso3
from . import sentences, sketch


def register(spark: SparkSession, prefix: str = "tp_") -> list[str]:
    """Registers scalar functions and the table function tp_parse_conversation(raw); returns their names.

    Expressions become SQL functions, which the optimizer opens up; sequential ones are Arrow functions."""
    from ..operators import chat, rank

    count = "aggregate(regexp_extract_all({t}, r'[a-zA-Z0-9_]+|[^\\s]', 0), 0, (a, w) -> a + CASE WHEN length(w) <= 4 THEN 1 WHEN length(w) <= 8 THEN 2 ELSE 2 + int((length(w) - 5) / 4) END)"
    gaps = "aggregate(regexp_extract_all({t}, r'\\s{{4,}}', 0), 0, (a, w) -> a + int(length(w) / 4))"
    some = "coalesce(t, '')"
    plain = {
        "token_count": ("BIGINT", f"CASE WHEN NOT {some} RLIKE r'[^\\s]' THEN 0 ELSE greatest({count.format(t=some)} + {gaps.format(t=some)}, 1) END"),
        "fingerprint": ("STRING", f"upper(substring(sha2(lower(regexp_replace(regexp_replace({some}, r'\\s+', ' '), r'^ | $', '')), 256), 1, 16))"),
        "terms": ("ARRAY<STRING>", f"regexp_extract_all(lower({some}), r'[\\p{{L}}\\p{{N}}\\p{{M}}]+', 0)"),
    }
    for name, (kind, body) in plain.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(t STRING) RETURNS {kind} RETURN {body}")

    @F.pandas_udf("long")
    def simhash(s: pd.Series) -> pd.Series:
        return s.map(lambda x: sketch.simhash_text(x or "")).map(lambda x: x - (1 << 64) if x >> 63 else x)

    @F.pandas_udf("array<string>")
    def sentence_list(s: pd.Series, lang: pd.Series) -> pd.Series:
        return pd.Series([sentences.split_sentences(x or "", y or "eng") for x, y in zip(s, lang)])

    @F.pandas_udf("string")
    def textrank(s: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([rank.textrank(x or "", int(n)) for x, n in zip(s, k)], dtype=object)

    @F.pandas_udf("string")
    def to_iso3(s: pd.Series) -> pd.Series:
        return pd.Series([iso3(x) if x else None for x in s], dtype=object)

    for name, f in (("simhash", simhash), ("sentences", sentence_list), ("textrank", textrank), ("iso3", to_iso3)):
        spark.udf.register(prefix + name, f)

    class Parse:
        def eval(self, raw: str):
            kind, turns = chat.parse_conversation(raw or "")
            for t in turns:
                yield kind, t["turn"], t["role"], t["raw_role"], t["content"]

    spark.udtf.register(f"{prefix}parse_conversation", F.udtf(Parse, returnType="format string, turn int, role string, raw_role string, content string"))
    return [prefix + n for n in (*plain, "simhash", "sentences", "textrank", "iso3", "parse_conversation")]
