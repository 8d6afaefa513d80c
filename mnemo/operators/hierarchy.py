"""Domain -> theme -> subtheme -> fact -> passage: nodes, edges and routed retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.functions.expressions import candidate_score, cosine, route_query, subtheme, theme_of
from mnemo.operators.facts import matches

#: layer pair -> edge weight.
WEIGHTS = {"domain": 0.7, "theme": 0.8, "subtheme": 0.9, "evidence": 1.0, "entity": 0.6}


def _labels(facts: DataFrame, domain: str) -> DataFrame:
    d, s = F.col(domain), subtheme(F.col("predicate"))
    theme = F.concat_ws("/", d, s)
    return facts.select(d.alias("domain"), theme.alias("theme"), F.concat_ws("/", theme, s).alias("subtheme"), F.concat(F.lit("fact:"), "fact_id").alias("fact"),
                        F.concat(F.lit("passage:"), "provenance_text").alias("passage"))


LAYERS = ["domain", "theme", "subtheme", "fact", "passage"]


def nodes(facts: DataFrame, domain: str) -> DataFrame:
    """(layer, label, node_id), each once; ids are hashes of the natural key."""
    rows = _labels(facts, domain).select(F.explode(F.array(*(F.struct(F.lit(x).alias("layer"), F.col(x).alias("label")) for x in LAYERS))).alias("n"))
    return rows.select("n.layer", "n.label").distinct().withColumn("node_id", F.sha2(F.concat_ws("|", "layer", "label"), 256))


def edges(facts: DataFrame, domain: str) -> DataFrame:
    """(source, target, edge_type, weight) between labels, each once."""
    steps = [("domain", "theme", "routes_to", WEIGHTS["domain"]), ("theme", "subtheme", "routes_to", WEIGHTS["theme"]),
             ("subtheme", "fact", "routes_to", WEIGHTS["subtheme"]), ("fact", "passage", "evidences", WEIGHTS["evidence"])]
    parts = [F.struct(F.concat_ws(":", F.lit(a), a).alias("source"), F.concat_ws(":", F.lit(b), b).alias("target"), F.lit(t).alias("edge_type"), F.lit(w).alias("weight")) for a, b, t, w in steps]
    return _labels(facts, domain).select(F.explode(F.array(*parts)).alias("e")).select("e.*").distinct()


def entity_edges(entities: DataFrame) -> DataFrame:
    """Domain -> theme of the entity's type -> entity, from (entity, entity_type, domain), each edge once."""
    theme = F.concat_ws("/", "domain", theme_of(F.col("entity_type")))
    edge = lambda a, b, w: F.struct(a.alias("source"), b.alias("target"), F.lit("routes_to").alias("edge_type"), F.lit(w).alias("weight"))
    at = lambda layer, label: F.concat_ws(":", F.lit(layer), label)
    both = F.array(edge(at("domain", F.col("domain")), at("theme", theme), WEIGHTS["domain"]), edge(at("theme", theme), at("entity", F.col("entity")), WEIGHTS["entity"]))
    return entities.select(F.explode(both).alias("e")).select("e.*").distinct()


def route_domains(domains: DataFrame, query: list[float], k: int = 3) -> DataFrame:
    """The ``k`` domains (domain, embedding) nearest to the query, of those with a vector."""
    scored = domains.where(F.col("embedding").isNotNull()).withColumn("similarity", cosine(F.col("embedding"), F.array(*map(F.lit, query))))
    return scored.orderBy(F.desc("similarity"), "domain").limit(k)


def retrieve(facts: DataFrame, query: list[float], k: int, domains: DataFrame | None = None, domain: str = "domain") -> DataFrame:
    """Top-k facts by similarity, below the routed domains if given, then sorted by the combined score.

    ``domains`` is small: what ``route_domains`` returns.  Facts without a vector are never found.
    """
    pool = facts.where(F.col("embedding").isNotNull())
    pool = pool if domains is None else pool.join(domains.select(domain), domain, "left_semi")
    top = pool.withColumn("similarity", cosine(F.col("embedding"), F.array(*map(F.lit, query)))).orderBy(F.desc("similarity"), "fact_id").limit(k)
    salience = F.coalesce(F.col("salience").cast("double"), F.lit(1.0))
    return top.withColumn("score", candidate_score(F.col("similarity"), salience)).orderBy(F.desc("score"), "fact_id")


def below(edges: DataFrame, domains: DataFrame) -> DataFrame:
    """(fact) labels below the domains (domain) along ``routes_to`` edges: theme, subtheme, fact."""
    step = edges.where("edge_type = 'routes_to'").select("source", "target")
    at = domains.select(F.concat(F.lit("domain:"), "domain").alias("node"))
    for _ in range(3):  # the layers below a domain
        at = at.join(step, F.col("node") == F.col("source")).select(F.col("target").alias("node")).distinct()
    return at.where(F.col("node").startswith("fact:")).select(F.expr("substring(node, 6)").alias("fact"))


def retrieve_routed(facts: DataFrame, edges: DataFrame, domains: DataFrame, query: list[float] | None, k: int, text: str = "", top_domains: int = 3) -> DataFrame:
    """(mode, fact_id, similarity, score): down the hierarchy from the nearest domains; over all facts where no domain has a vector; by text where the query has none."""
    if query is None:
        hits = facts.where(matches(text)).orderBy(F.desc("confidence"), F.desc("observed_at"), "fact_id").limit(k)
        return hits.select(F.lit("lexical_fallback").alias("mode"), "fact_id", F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("double").alias("score"))
    routed = route_domains(domains, query, top_domains)
    mode, pool = "hierarchical_semantic_flat", facts
    if not routed.isEmpty():
        mode = "hierarchical_index_routing"
        pool = facts.join(below(edges, routed), F.concat(F.lit("fact:"), facts["fact_id"]) == F.col("fact"), "left_semi")
    return retrieve(pool, query, k).select(F.lit(mode).alias("mode"), "fact_id", "similarity", "score")


def evidence_passages(facts: DataFrame, edges: DataFrame, passages: DataFrame) -> DataFrame:
    """(fact_id, passage, passage_text) of the facts, each once: fact node -> 'evidences' edge -> passage node -> passage (passage, passage_text)."""
    start = facts.select("fact_id", F.concat(F.lit("fact:fact:"), "fact_id").alias("source"))
    hop = edges.where("edge_type = 'evidences'").select("source", F.expr("substring(target, 17)").alias("passage"))
    return start.join(hop, "source").join(passages, "passage").select("fact_id", "passage", "passage_text").distinct()


def answer(facts: DataFrame, edges: DataFrame, domains: DataFrame, passages: DataFrame, question: str, query: list[float] | None, k: int, top_domains: int = 3) -> DataFrame:
    """The whole answer to a question as rows (mode, kind, id, score): its routing path, the chosen domains, the facts and their passages, each passage once.

    Steps of the path are ``level:label``.  Without a query vector facts are found by the question's text, no domain is chosen, and no passages are given.
    """
    found = retrieve_routed(facts, edges, domains, query, k, question, top_domains)
    spark = facts.sparkSession
    path = spark.range(1).select(F.explode(route_query(F.lit(question))).alias("s")).select(F.lit("path").alias("kind"), F.concat_ws(":", "s.level", "s.label").alias("id"), F.col("s.score").alias("score"))
    out = path.unionByName(found.select(F.lit("fact").alias("kind"), F.col("fact_id").cast("string").alias("id"), "score"))
    if query is not None:
        chosen = route_domains(domains, query, top_domains).select(F.lit("domain").alias("kind"), F.col("domain").alias("id"), F.col("similarity").alias("score"))
        texts = evidence_passages(facts.join(found.select("fact_id"), "fact_id", "left_semi"), edges, passages)
        out = out.unionByName(chosen).unionByName(texts.select(F.lit("passage").alias("kind"), F.col("passage").alias("id")).distinct().withColumn("score", F.lit(None).cast("double")))
    mode = found.agg(F.first("mode").alias("mode"))
    return out.crossJoin(F.broadcast(mode)).select("mode", "kind", "id", "score")  # one row


def backfill_candidates(facts: DataFrame, indexed: DataFrame, documents: DataFrame, default: str = "bibliotheque") -> DataFrame:
    """(fact_id, domain) of facts that have no node in ``indexed`` (fact_id); the domain is their document's, or the default."""
    todo = facts.join(indexed.select("fact_id"), "fact_id", "left_anti").select("fact_id", "doc_id")
    return todo.join(documents.select("doc_id", "domain"), "doc_id", "left").select("fact_id", F.coalesce("domain", F.lit(default)).alias("domain"))
