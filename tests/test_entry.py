"""The driver's contract: names, types, and results against SQL in DuckDB."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from tokenpress.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(names, found):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in at], sorted(tuple(repr(r[i]) for i in at) for r in found)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_oracle(spark, duck, sf_dir, name):
    got = catalogue.QUERIES[name](spark, sf_dir)
    want = duck.execute(catalogue.ORACLE_SQL[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows([c[0] for c in want.description], want.fetchall())


def test_plans_do_not_shuffle_texts(spark, sf_dir):
    for name in ("light_filter", "semantic_filter", "aggressive_filter", "statistical_filter", "lang_detect", "safety_verdict", "token_count_by_model"):
        plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        # Rows of a single small file are spread over the cores; nothing else moves.
        assert not re.search(r"hashpartitioning|SinglePartition|CartesianProduct", plan) and plan.count("Exchange") <= 1, name
    plan = catalogue.QUERIES["lang_detect"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_texts_are_told_apart_once(spark, sf_dir):
    """No filter that the optimizer infers repeats what is costly of a text."""
    plan = catalogue.QUERIES["lang_scores"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 1


def test_scores_are_rounded_as_in_sql(spark, tmp_path):
    spark.createDataFrame([(1, "que " * 41 + "xx " * 599, "es", "a", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = catalogue.QUERIES["lang_scores"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.iso3, r.score) for r in got) == sorted(c.execute(catalogue.ORACLE_SQL["lang_scores"]).fetchall())
