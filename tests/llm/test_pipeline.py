"""The stages one by one in plain terms, and the run over odd documents."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tokenpress.llm import decontam, quality, secret_scan, simhash  # noqa: E402
from tokenpress.llm.common import table  # noqa: E402


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels, items = table(spark, sf_dir, "labels"), table(spark, sf_dir, "benchmark")
    stage = dict(corpus_pipeline.STAGES)
    good = {r.doc_id for r in quality.scored(docs, labels).collect() if r.predicted == 1}
    one = stage["quality_classifier"](spark, docs, sf_dir)
    assert {r.doc_id for r in one.collect()} == good and one.columns == docs.columns
    first = {r.doc_id for r in simhash.near_duplicates(one).collect() if r.doc_id == r.component_id}
    two = stage["simhash_near_dedup"](spark, one, sf_dir)
    assert sorted(r.doc_id for r in two.collect()) == sorted(first) and len(first) < len(good)
    leaks = {r.doc_id for r in decontam.contaminated(two, items).collect()}
    three = stage["benchmark_decontamination"](spark, two, sf_dir)
    assert {r.doc_id for r in three.collect()} == first - leaks and leaks
    four = stage["secret_scan"](spark, three, sf_dir)
    was, now = ({r.doc_id: r.text for r in d.collect()} for d in (three, four))
    live = {r.doc_id: [s for s in r.spans if s.live] for r in secret_scan.scan(three).collect()}
    assert four.columns == docs.columns and was.keys() == now.keys() and {k for k in was if was[k] != now[k]} == {k for k, v in live.items() if v}
    five = stage["best_fit_packing"](spark, four, sf_dir).collect()
    fill = defaultdict(int)
    for r in five:
        fill[r.sequence_id] += r.length
    assert {r.doc_id for r in five} == set(now) and max(fill.values()) <= 1024


def test_odd_documents(spark, sf_dir, tmp_path):
    d = table(spark, sf_dir, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (900001, None, "en", None, 0), (900002, "", None, "s", None), (900003, "w " * 40_000, "en", "s", 1)], d.schema)
    d.unionByName(odd).withColumn("extra", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, sf_dir, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    table(spark, sf_dir, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 100
    empty = tmp_path / "empty"
    for t in ("documents", "labels", "benchmark"):
        table(spark, sf_dir, t).limit(0).write.parquet(f"{empty}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
