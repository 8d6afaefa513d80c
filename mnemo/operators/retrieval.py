"""Lexical, vector and hybrid retrieval of chunks, for one query or many."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemo.functions.expressions import cosine, route_query
from mnemo.operators import neighbours

#: Query rows that are broadcast to the corpus at most.
MAX_QUERIES = 2000


def lexical(chunks: DataFrame, text: str, k: int) -> DataFrame:
    """The newest ``k`` chunks that hold ``text`` (wildcards stay live); newest is by doc_id, then ordinal."""
    return chunks.where(F.col("content").ilike(f"%{text}%")).orderBy(F.desc("doc_id"), "ordinal").limit(k)


def semantic(chunks: DataFrame, query: list[float], k: int) -> DataFrame:
    scored = chunks.where(F.col("embedding").isNotNull()).withColumn("raw", cosine(F.col("embedding"), F.array(*map(F.lit, query))))
    return scored.orderBy(F.desc("raw"), "doc_id", "ordinal").limit(k).withColumn("score", F.round("raw", 4)).drop("raw")


def hybrid(chunks: DataFrame, text: str, query: list[float], k: int) -> DataFrame:
    """Semantic hits, then lexical ones; the first occurrence of a chunk counts; ``k`` at most."""
    s = semantic(chunks, query, k).select("doc_id", "ordinal", F.lit(0).alias("mode"), F.row_number().over(W.orderBy(F.desc("score"), "doc_id", "ordinal")).alias("pos"))
    x = lexical(chunks, text, k).select("doc_id", "ordinal", F.lit(1).alias("mode"), F.row_number().over(W.orderBy(F.desc("doc_id"), "ordinal")).alias("pos"))
    both = s.unionByName(x)  # at most 2 * k rows
    first = both.groupBy("doc_id", "ordinal").agg(F.min(F.struct("mode", "pos")).alias("m")).select("doc_id", "ordinal", "m.mode", "m.pos")
    return first.orderBy("mode", "pos").limit(k)


def top_k_of_each(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, rank, similarity): the k nearest vectors of every query.

    Up to ``MAX_QUERIES`` queries are sent to the corpus, which is read once; more go to the cells of ``neighbours.nearest``, which leave out those that can hold none of the nearest.
    Where fewer than k vectors have a similarity to a query, others follow with none, in order of vec_id.
    """
    few = queries.limit(MAX_QUERIES + 1).count() <= MAX_QUERIES
    found = neighbours.nearest_of_few(corpus, queries, k) if few else neighbours.nearest(corpus, queries, k)[0]
    n = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    short = queries.select("query_id").join(n, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < k)
    lowest = corpus.select("vec_id").orderBy("vec_id").limit(2 * k)  # fewer than k are found or the query's own
    more = short.join(F.broadcast(lowest)).where("query_id <> vec_id").join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_anti")
    place = F.row_number().over(W.partitionBy("query_id").orderBy("vec_id")) + F.col("n")
    more = more.withColumn("rank", place).where(F.col("rank") <= k)
    return found.unionByName(more.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.lit(None).cast("double").alias("similarity")))


def context_bundle(query: str, facts: DataFrame, passages: DataFrame, warnings: list[str] | None = None) -> DataFrame:
    """One row (query, route_paths, facts, passages, citations, warnings) from ranked facts and passages, a few rows each and in order.

    ``facts`` has fact_id and score; ``passages`` has doc_id, ordinal, mode and pos.
    """
    spark = facts.sparkSession
    some = lambda df, order, *cols: df.agg(F.array_sort(F.collect_list(F.struct(*order, *cols))).alias("x"))
    f = some(facts.select((-F.col("score")).alias("o"), "fact_id", "score"), ("o", "fact_id"), "score").select(F.transform("x", lambda r: F.struct(r["fact_id"].alias("fact_id"), r["score"].alias("score"))).alias("facts"))
    p = some(passages, ("mode", "pos"), "doc_id", "ordinal").select(F.col("x").alias("passages"), F.transform("x", lambda r: F.struct(
        F.concat_ws(":", r["doc_id"].cast("string"), r["ordinal"].cast("string")).alias("chunk_id"), r["doc_id"].alias("document_id"), F.when(r["mode"] == 0, "semantic").otherwise("lexical").alias("retrieval_mode"))).alias("citations"))
    q = spark.range(1).select(F.lit(query).alias("query"), route_query(F.lit(query)).alias("route_paths"), F.array(*map(F.lit, warnings or [])).cast("array<string>").alias("warnings"))
    return q.join(F.broadcast(f)).join(F.broadcast(p)).select("query", "route_paths", "facts", "passages", "citations", "warnings")  # one row each
