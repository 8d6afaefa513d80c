"""The hierarchy kept up to date: only nodes and edges that are not stored yet are made."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemo.functions.expressions import theme_of
from mnemo.operators import hierarchy
from mnemo.operators.store import KEEP_FIRST, StoredTable
from mnemo.sources.shared import cut_lineage, exists


def entity_nodes(entities: DataFrame) -> DataFrame:
    """(layer, label, node_id) of entities (entity, entity_type, domain), their domains and themes, each once."""
    node = lambda layer, label: F.struct(F.lit(layer).alias("layer"), label.alias("label"))
    labels = F.array(node("domain", F.col("domain")), node("theme", F.concat_ws("/", "domain", theme_of(F.col("entity_type")))), node("entity", F.col("entity")))
    rows = entities.select(F.explode(labels).alias("n")).select("n.layer", "n.label").distinct()
    return rows.withColumn("node_id", F.sha2(F.concat_ws("|", "layer", "label"), 256))


@dataclass
class StoredHierarchy:
    """Nodes and edges of the layers, each stored once."""

    spark: SparkSession
    path: str
    buckets: int = 64

    def __post_init__(self):
        self.nodes_ = StoredTable(self.spark, f"{self.path}/nodes", ["layer", "label"], "layer string, label string, node_id string", {"node_id": KEEP_FIRST}, self.buckets)
        self.edges_ = StoredTable(self.spark, f"{self.path}/edges", ["source", "target", "edge_type"], "source string, target string, edge_type string, weight double", {"weight": KEEP_FIRST}, self.buckets)

    def nodes(self) -> DataFrame:
        return self.nodes_.read()

    def edges(self) -> DataFrame:
        return self.edges_.read()

    def missing(self, facts: DataFrame) -> DataFrame:
        """Facts (fact_id) without a node."""
        known = self.nodes().where("layer = 'fact'").select(F.expr("substring(label, 6)").alias("_known"))
        return facts.join(known, F.col("fact_id").cast("string") == F.col("_known"), "left_anti")

    def index(self, facts: DataFrame, batch: str, entities: DataFrame | None = None, domain: str = "domain") -> DataFrame:
        """Index facts (fact_id, predicate, provenance_text and ``domain``) and entities (entity, entity_type, domain); (kind, created) of nodes and edges.

        Facts that have a node are left out; of the rest only what is not stored is made.  A batch that was broken off is run again under its name and gives the same counts.
        """
        counts = f"{self.path}/created/{batch}"
        new = cut_lineage(self.missing(facts.select("fact_id", "predicate", "provenance_text", domain)), "unindexed")  # nodes and edges read it many times
        nodes, edges = hierarchy.nodes(new, domain), hierarchy.edges(new, domain)
        if entities is not None:
            nodes, edges = nodes.unionByName(entity_nodes(entities)).distinct(), edges.unionByName(hierarchy.entity_edges(entities)).distinct()
        if not exists(self.spark, counts):
            nodes = cut_lineage(nodes.join(self.nodes().select("layer", "label"), ["layer", "label"], "left_anti"), "nodes")
            edges = cut_lineage(edges.join(self.edges().select("source", "target", "edge_type"), ["source", "target", "edge_type"], "left_anti"), "edges")
            n = lambda df, kind: df.agg(F.count(F.lit(1)).alias("created")).withColumn("kind", F.lit(kind))
            n(nodes, "nodes").unionByName(n(edges, "edges")).write.mode("overwrite").parquet(counts)
        # edges first: a fact counts as indexed by its node
        self.edges_.merge(edges, batch)
        self.nodes_.merge(nodes, batch)
        return self.spark.read.schema("created long, kind string").parquet(counts).select("kind", "created")
