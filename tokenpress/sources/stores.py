"""Stores as tables: conversations, dropped rows, shared context, statistics, memory notes."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.chat import as_json


def safe_name(x: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]", "_", x)


class ConversationStore:
    """A conversation per partition folder, overwritten whole: saving some conversations leaves the others as they are."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, turns: DataFrame, conv: str = "session_id") -> None:
        d = as_json(turns, conv).withColumn(conv, F.regexp_replace(F.col(conv).cast("string"), r"[^A-Za-z0-9._-]", "_"))
        d.withColumnRenamed(conv, "session_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").json(self.path)

    def load(self, *sessions: str) -> DataFrame:
        """session_id, turn, role, content; partition pruning reads only what is asked for."""
        d = self.spark.read.schema("messages string, session_id string").json(self.path)
        if sessions:
            d = d.filter(F.col("session_id").isin(*map(safe_name, sessions)))
        return d.select("session_id", F.posexplode(F.from_json("messages", "array<struct<role:string,content:string>>")).alias("turn", "m")).select("session_id", "turn", "m.*")

    def sessions(self) -> DataFrame:
        return self.spark.read.schema("messages string, session_id string").json(self.path).select("session_id").distinct()


def put(store: DataFrame | None, rows: DataFrame, now: datetime, ttl: timedelta) -> DataFrame:
    """A side store (hash, value, expires) with more rows: the latest of a hash stays."""
    new = rows.select("hash", "value").withColumn("expires", F.lit(now + ttl))
    both = new if store is None else store.unionByName(new)
    return both.groupBy("hash").agg(F.max_by("value", "expires").alias("value"), F.max("expires").alias("expires"))


def get(store: DataFrame, wanted: DataFrame, now: datetime) -> DataFrame:
    """hash and value of what is wanted and hasn't expired."""
    return wanted.select("hash").join(store.filter(F.col("expires") > F.lit(now)), "hash").select("hash", "value")


def latest(writes: DataFrame, now: datetime, ttl: timedelta = timedelta(minutes=30), most: int = 500) -> DataFrame:
    """Shared context: the last write of each key (key, content, agent, at) that hasn't expired; beyond `most` keys the oldest go."""
    d = writes.groupBy("key").agg(F.max_by(F.struct("content", "agent"), "at").alias("v"), F.max("at").alias("at")).filter(F.col("at") > F.lit(now - ttl))
    return d.orderBy(F.col("at").desc(), "key").limit(most).select("key", "v.*", "at")


def savings(results: DataFrame, *by: str) -> DataFrame:
    """Sums over results with original_tokens and compressed_tokens, with subtotals of each column: rows without original tokens, or
    with an error, don't count."""
    d = results.filter("original_tokens > 0")
    if "error" in d.columns:
        d = d.filter("error is null")
    saved = F.greatest(F.col("original_tokens") - F.col("compressed_tokens"), F.lit(0))
    g = d.rollup(*by) if by else d.groupBy()
    out = g.agg(F.count(F.lit(1)).alias("n"), F.sum("original_tokens").alias("original_tokens"), F.sum("compressed_tokens").alias("compressed_tokens"), F.sum(saved).alias("saved_tokens"))
    return out.withColumn("percent", F.round(F.col("saved_tokens") * 100.0 / F.col("original_tokens"), 6))


def first_seen(rows: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """The first row of each text of a group, in any case and with blanks squeezed."""
    key = F.sha2(F.lower(F.trim(F.regexp_replace(F.col(text), r"\s+", " "))), 256)
    d = rows.withColumn("_n", F.row_number().over(Window.partitionBy(group, key).orderBy(order)))
    return d.filter("_n = 1").drop("_n")
