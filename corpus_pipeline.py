"""From raw documents to packed training sequences, stage by stage. Counts as part of tokenpress.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenpress.llm import decontam, packing, quality, secret_scan, simhash
from tokenpress.llm.common import LAST, Scratch, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; it learns from these documents and `labels`."""
    return quality.good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, the document with the smallest doc_id. Rows that share a doc_id are one document and
    stay or go together. Only the ids that go are joined with the documents: as a table whose size decides whether every task
    gets it or both sides are shuffled."""
    named = simhash.near_duplicates(docs).select("doc_id", "component_id")
    stays = F.coalesce(F.col("component_id"), F.lit(LAST)) == F.coalesce(F.col("doc_id"), F.lit(LAST))
    goes = Scratch(spark, "pipeline").save(named.groupBy("doc_id").agg(F.max(stays).alias("stays")).filter("not stays").select(F.col("doc_id").alias("_gone")), "goes")
    return docs.join(goes, docs["doc_id"].eqNullSafe(goes["_gone"]), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of `benchmark`."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with owner-specific secrets masked in their texts; n_chars follows the text."""
    out = secret_scan.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, placed in sequences of 1024 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", keep_quality),
    ("simhash_near_dedup", keep_one_of_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack_sequences),
]

#: Fitted models, fingerprints and tokenizers are beyond SQL; the tests hold run() against the stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    scratch = Scratch(spark, "stages")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
