"""From model replies to the end: passages, facts, links, entities, hierarchy and conflicts, stored and continued."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemo.operators import conflicts, extraction, facts as facts_
from mnemo.operators.indexing import StoredHierarchy
from mnemo.operators.store import KEEP_FIRST, MERGE, StoredTable
from mnemo.sources.shared import cut_lineage

PASSAGE = "passage_id long, passage_text string, provenance_text string, status string"
FACT = "fact_id long, subject string, predicate string, object_value string, provenance_text string, observed_at timestamp, valid_from timestamp, status string, to_embed string, embedding array<float>, confidence double, chunk_id long"
LINK = "fact_id long, passage long, kind string, weight double"
NAMED = "name string, entity_type string, metadata map<string,string>"


@dataclass
class ExtractionStore:
    """What has been extracted; a chunk counts as extracted by its passage, which is stored last, so a batch that broke off is run again whole."""

    spark: SparkSession
    path: str
    buckets: int = 64

    def __post_init__(self):
        table = lambda name, key, schema, policies=None: StoredTable(self.spark, f"{self.path}/{name}", key, schema, policies or {}, self.buckets)
        self.passages_ = table("passages", ["passage_id"], PASSAGE)
        self.facts_ = table("facts", ["fact_id"], FACT)
        self.links_ = table("links", ["fact_id", "passage"], LINK, {"kind": KEEP_FIRST, "weight": KEEP_FIRST})
        self.entities_ = table("entities", ["name", "entity_type"], NAMED, {"metadata": MERGE})
        self.hierarchy = StoredHierarchy(self.spark, f"{self.path}/hierarchy", self.buckets)

    def pending(self, chunks: DataFrame) -> DataFrame:
        return extraction.not_extracted(chunks, self.passages_.read())

    def run(self, chunks: DataFrame, batch: str, as_of: str, domain: str = "bibliotheque", least: int = facts_.FREQUENCY) -> DataFrame:
        """Extract chunks (chunk_id, text, observed_at, reply) that have no passage yet; (chunk_id, ok, error) of them.

        The uses of a predicate are counted over all stored facts in order of time, and new facts are linked to their passage from the ``least``-th on.  Entities are merged by name and
        type, and facts and entities are indexed below ``domain``.  Chunks with unreadable replies get no passage, so a later run tries them again.
        """
        done = cut_lineage(extraction.extract(self.pending(chunks)), "extracted")
        passages, made, _ = extraction.store(done, as_of, least)
        entities = done.where("ok").select(F.explode("entities").alias("e")).select(F.col("e.name").alias("name"), F.coalesce(F.when(F.col("e.type") != "", F.col("e.type")), F.lit("other")).alias("entity_type")).distinct()
        self.entities_.merge(entities.withColumn("metadata", F.create_map(F.lit("origin"), F.lit("extraction"))), batch)
        self.facts_.merge(made, batch)
        gated = facts_.schema_gate(self.facts_.read(), least).where("linked").select("fact_id", F.col("chunk_id").alias("passage"), F.lit("supported_by").alias("kind"), F.lit(1.0).alias("weight"))
        self.links_.merge(gated.join(made.select("fact_id"), "fact_id", "left_semi"), batch)
        self.hierarchy.index(made.withColumn("domain", F.lit(domain)), batch, entities.select(F.concat_ws(":", "entity_type", "name").alias("entity"), "entity_type", F.lit(domain).alias("domain")))
        self.passages_.merge(passages, batch)
        return done.select("chunk_id", "ok", "error")

    def conflicts(self, threshold: float = 0.8) -> DataFrame:
        """Conflicts that the linked facts meet among all facts, of every type."""
        every = self.facts_.read().withColumn("superseded_by", F.lit(None).cast("long"))
        linked = self.links_.read().select("fact_id").distinct()
        return conflicts.detect(every, threshold).join(linked, "fact_id", "left_semi")
