"""Facts, chunks and graph edges derived from plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str, vectors: bool = True) -> DataFrame:
    """Bi-temporal facts: one per event, with a vector by position where asked."""
    ev = table(spark, sf_dir, "events")
    k = F.col("event_id")
    at = F.col("ts").cast("timestamp")
    out = ev.select(
        k.alias("fact_id"), F.concat(F.lit("user:"), "user_id").alias("subject"), F.col("event_type").alias("predicate"), F.get_json_object("props", "$.k").alias("object_value"),
        F.concat(F.lit("event "), k.cast("string")).alias("provenance_text"), F.least(F.lit(1.0), F.col("value") / 100).alias("confidence"), at.alias("observed_at"),
        at.alias("valid_from"), F.when(k % 11 == 0, at + F.expr("INTERVAL 10 DAYS")).alias("valid_to"), F.when(k % 13 == 0, k + 1).alias("superseded_by"),
        F.when(k % 17 == 0, "inactive").when(k % 3 == 0, "pending").otherwise("active").alias("status"),
        F.lit(1.0).alias("salience"), (0.01 * (1 + k % 5)).alias("decay_rate"), F.lit(None).cast("timestamp").alias("last_accessed_at"))
    if not vectors:
        return out
    emb = table(spark, sf_dir, "embeddings")
    n = emb.count()
    return out.withColumn("vec_id", k_mod(F.col("fact_id"), n)).join(emb.select("vec_id", "embedding", "label"), "vec_id").drop("vec_id")


def k_mod(x, n: int):
    return F.pmod(x, F.lit(n).cast("long"))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed part -> supplier edges with a weight."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).cast("double").alias("weight")).select(
        F.concat(F.lit("p:"), "l_partkey").alias("source"), F.concat(F.lit("s:"), "l_suppkey").alias("target"), "weight")


def read_files(spark: SparkSession, root: str, pattern: str = "*", excluded: list[str] | None = None, max_bytes: int = 100 << 20) -> DataFrame:
    """Files below ``root`` with a ``status``; names match ``pattern``, folders in ``excluded`` are left out."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    if excluded:
        df = df.where(~F.arrays_overlap(F.split(F.upper("path"), "/"), F.array(*(F.lit(x.upper()) for x in excluded))))
    return df.withColumn("status", F.when(F.col("length") > max_bytes, "skipped_oversize").when(F.col("length") == 0, "skipped_empty").otherwise("ok"))
