"""Personalised PageRank, reachability and entity scores on edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemo.functions.expressions import cosine
from mnemo.operators.trigrams import contained
from mnemo.sources.shared import cut_lineage

#: Edges of one source that stay together.
SPLIT = 1_000_000


def undirected(edges: DataFrame) -> DataFrame:
    both = edges.select("source", "target", "weight").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight"))
    return both


def pagerank(edges: DataFrame, seeds: DataFrame, restart: float = 0.5, iterations: int = 10, tolerance: float | None = None, cut_every: int = 1) -> DataFrame:
    """(node, rank) after ``iterations`` steps v <- (1 - restart) W'v + restart v0; dangling mass goes to v0.

    ``seeds`` is (node, rank) and sums to 1.  ``edges`` are directed; give ``undirected(edges)`` for the other kind.
    With a tolerance it stops once the L1 change is below it.

    Nodes are numbered once, and the numbered edges are cached in order of source and the seeds in order of node, so that a step moves ranks
    and partial sums only.  The edges of a source with more than ``SPLIT`` are spread over several groups.  The caches are
    rebuilt from written tables if executors are lost.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = cut_lineage(edges.select("source", "target", "weight"), "edges")
    out = edges.groupBy("source").agg(F.sum("weight").alias("total"), F.ceil(F.count(F.lit(1)) / SPLIT).alias("splits"))
    ends = out.select(F.col("source").alias("node"), "splits", F.lit(0.0).alias("start")).unionByName(edges.select(F.col("target").alias("node"), F.lit(0).cast("long").alias("splits"), F.lit(0.0).alias("start")))
    nodes = ends.unionByName(seeds.select("node", F.lit(0).cast("long").alias("splits"), F.col("rank").alias("start"))).groupBy("node").agg(F.max("splits").alias("splits"), F.sum("start").alias("start"))
    nodes = cut_lineage(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    number = nodes.select("node", "id")
    share = edges.join(out, "source").join(number.toDF("source", "from"), "source").join(number.toDF("target", "to"), "target")
    share = share.select("from", F.pmod(F.xxhash64("to"), "splits").alias("slot"), "to", (F.col("weight") / F.col("total")).alias("share"))
    step = cut_lineage(share, "shares").repartition(parts, "from", "slot").sortWithinPartitions("from", "slot").persist()
    base = nodes.select("id", "splits", "start").repartition(parts, "id").sortWithinPartitions("id").persist()
    dangling = not base.where("splits = 0").isEmpty()
    cut_every = 1 if dangling or tolerance is not None else cut_every  # each step then needs the ranks before it more than once
    rank = base.select("id", "splits", F.col("start").alias("rank"))
    for k in range(1, iterations + 1):
        sent = rank.where("splits > 0 and rank > 0").select("id", "rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("splits") - 1)).alias("part"))
        got = sent.join(step, (sent["id"] == step["from"]) & (sent["part"] == step["slot"])).groupBy(F.col("to").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        loose = (rank.where("splits = 0").agg(F.sum("rank")).first()[0] or 0.0) if dangling else 0.0
        moved = F.coalesce("got", F.lit(0.0)) + F.lit(loose) * F.col("start")
        new = base.join(got, "id", "left").select("id", "splits", ((1 - restart) * moved + restart * F.col("start")).alias("rank"))
        if k % cut_every == 0 or k == iterations:
            new = cut_lineage(new, "ranks")
        change = None
        if tolerance is not None:
            change = new.join(rank.select("id", F.col("rank").alias("old")), "id").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0
        rank = new
        if change is not None and change < tolerance:
            break
    step.unpersist()
    base.unpersist()
    return number.join(rank, "id").select("node", "rank")


def reachable(edges: DataFrame, roots: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node): everything reachable from ``roots`` (node) along source -> target; safe on cycles."""
    seen = cut_lineage(roots.select("node").distinct())
    frontier = seen
    for _ in range(max_rounds):
        following = frontier.join(edges, frontier["node"] == edges["source"]).select(F.col("target").alias("node")).distinct()
        frontier = cut_lineage(following.join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = cut_lineage(seen.unionByName(frontier))
    raise RuntimeError("not all nodes reached")


def entity_init(mean: Column, degree: Column) -> Column:
    """max(0, mean similarity) damped by ln(degree + 1 + e); 0 where there is none."""
    return F.when(mean.isNotNull(), F.greatest(F.lit(0.0), mean) / F.log(degree + F.lit(1.0) + F.e())).otherwise(F.lit(0.0))


def normalised(df: DataFrame, value: str) -> DataFrame:
    """Positive values scaled to sum 1; others are dropped."""
    some = df.where(F.col(value) > 0)
    total = some.agg(F.sum(value).alias("__total"))
    return some.crossJoin(F.broadcast(total)).withColumn(value, F.col(value) / F.col("__total")).drop("__total")


def ppr_graph(facts: DataFrame, bridges: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, seeds) of the fact, passage and entity graph.

    ``facts`` is (fact_id, similarity, text), at most a few thousand; ``bridges`` (fact_id, passage) and ``entities`` (entity, name) may be of any size.
    A fact is linked to its passages with weight 1 and to the entities whose name its text holds with 0.5.
    """
    facts = facts.withColumn("similarity", F.greatest(F.lit(0.0), "similarity"))
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    held = bridges.select("fact_id", "passage").distinct().join(F.broadcast(facts.select("fact_id", "similarity")), "fact_id")
    found = contained(entities.select("name"), facts.select(F.col("fact_id").alias("id"), "text")).withColumnRenamed("name", "_name")
    named = entities.join(found, F.trim(F.lower("name")) == F.col("_name")).select("entity", F.col("id").alias("fact_id")).join(F.broadcast(facts.select("fact_id", "similarity")), "fact_id").select("entity", "fact_id", "similarity").distinct()
    edges = held.select(node("f", "fact_id").alias("source"), node("p", "passage").alias("target"), F.lit(1.0).alias("weight")).unionByName(
        named.select(node("e", "entity").alias("source"), node("f", "fact_id").alias("target"), F.lit(0.5).alias("weight")))
    seeds = facts.select(node("f", "fact_id").alias("node"), F.col("similarity").alias("rank"))
    seeds = seeds.unionByName(held.groupBy(node("p", "passage").alias("node")).agg(F.avg("similarity").alias("rank")))
    seeds = seeds.unionByName(named.groupBy(node("e", "entity").alias("node")).agg(entity_init(F.avg("similarity"), F.count(F.lit(1))).alias("rank")))
    return edges, normalised(seeds, "rank")


def ppr_retrieve(facts: DataFrame, bridges: DataFrame, entities: DataFrame, query: list[float], k: int = 8, max_facts: int = 2000, restart: float = 0.5, iterations: int = 40, tolerance: float = 1e-6) -> DataFrame:
    """(kind, id, ppr_score): the ``k`` facts and the ``k`` passages of highest rank in a walk that restarts at what is similar to the query.

    The ``max_facts`` facts nearest to the query take part, those without a vector none; passages of rank 0 are left out.  Equal
    ranks go by similarity, then by id.
    """
    sim = cosine(F.col("embedding"), F.array(*map(F.lit, query)))
    top = facts.where(F.col("embedding").isNotNull()).select("fact_id", sim.alias("similarity"), F.concat_ws(" ", "subject", "object_value").alias("text"))
    top = cut_lineage(top.orderBy(F.desc("similarity"), "fact_id").limit(max_facts))
    edges, seeds = ppr_graph(top, bridges, entities)
    rank = pagerank(undirected(cut_lineage(edges)), cut_lineage(seeds), restart, iterations, tolerance)
    found = top.select(F.lit("fact").alias("kind"), F.col("fact_id").cast("string").alias("id"), F.concat(F.lit("f:"), F.col("fact_id").cast("string")).alias("node"), "similarity").join(rank, "node", "left")
    first = found.orderBy(F.desc(F.coalesce("rank", F.lit(0.0))), F.desc("similarity"), F.col("id").cast("long")).limit(k)
    passages = rank.where(F.col("node").startswith("p:") & (F.col("rank") > 0)).select(F.lit("passage").alias("kind"), F.expr("substring(node, 3)").alias("id"), "rank").orderBy(F.desc("rank"), "id").limit(k)
    return first.select("kind", "id", F.coalesce("rank", F.lit(0.0)).alias("ppr_score")).unionByName(passages.withColumnRenamed("rank", "ppr_score"))
