"""Facts and entities out of the replies of a language model: parsing, cleaning, storing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemo.functions.expressions import clamp01
from mnemo.operators import facts as facts_
from mnemo.sources.shared import cut_lineage

REPLY = "entities array<struct<name:string,type:string>>, facts array<struct<subject:string,predicate:string,object:string,confidence:string>>"
#: Fixed value: an object between fences.
FENCE = r"(?s)```(?:json)?\s*(\{.*\})\s*```"

#: Before a brace that opens an object with a quoted key.
OPENING = r"(?=\{\s*[\"'])"


def coerce_json(raw: Column) -> Column:
    """The reply as struct<entities, facts>; null where no object with either is in it.

    A fenced object is taken out of its fence.  Else the whole text is tried, then the text from each brace before a quoted key
    on, the first one that parses to an object with entities or facts; what follows a whole object does no harm.
    """
    text = F.trim(raw)
    fenced = F.regexp_extract(text, FENCE, 1)
    body = F.when(fenced != "", fenced).otherwise(text)
    parse = lambda x: F.from_json(x, REPLY, {"mode": "PERMISSIVE"})
    keys = lambda x: F.json_object_keys(x)
    good = lambda x: F.coalesce(F.arrays_overlap(keys(x), F.array(F.lit("entities"), F.lit("facts"))), F.lit(False))
    # only a brace before a quoted key can open such an object; the text is split there once, as the only element of an array
    split = F.array(F.split(F.when(body.rlike("entities|facts"), body), OPENING, -1))
    suffix = lambda pieces, k: F.array_join(F.slice(pieces, k, F.size(pieces)), "")
    tried = lambda pieces, k: F.transform(F.array(suffix(pieces, k)), lambda x: F.when(good(x), x))[0]
    first = F.transform(split, lambda pieces: F.aggregate(F.sequence(F.lit(1), F.size(pieces)), F.lit(None).cast("string"), lambda found, k: F.coalesce(found, tried(pieces, k))))  # stops building at the first
    return parse(F.coalesce(F.when(good(body), body), F.get(first, F.lit(0))))


def cleaned(reply: Column) -> Column:
    """struct<entities, facts> with named entities, and facts with subject, predicate and object; a confidence is brought into 0..1, 0.5 where there is none."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    entities = F.filter(F.coalesce(reply["entities"], F.array().cast("array<struct<name:string,type:string>>")), lambda e: some(e["name"]))
    facts = F.filter(F.coalesce(reply["facts"], F.array().cast("array<struct<subject:string,predicate:string,object:string,confidence:string>>")), lambda f: some(f["subject"]) & some(f["predicate"]) & some(f["object"]))
    facts = F.transform(facts, lambda f: F.struct(f["subject"].alias("subject"), f["predicate"].alias("predicate"), f["object"].alias("object"), F.coalesce(clamp01(f["confidence"].try_cast("double")), F.lit(0.5)).alias("confidence")))
    return F.struct(entities.alias("entities"), facts.alias("facts"))


def extract(chunks: DataFrame, reply: str = "reply") -> DataFrame:
    """(all columns of ``chunks``, ok, error, entities, facts): one unreadable reply leaves the other chunks alone."""
    parsed = chunks.withColumn("__reply", coerce_json(F.col(reply)))
    ok = F.col("__reply").isNotNull()
    out = cleaned(F.col("__reply"))
    return parsed.select(*chunks.columns, ok.alias("ok"), F.when(~ok, F.lit("reply holds no JSON object with entities or facts")).alias("error"), F.when(ok, out["entities"]).alias("entities"), F.when(ok, out["facts"]).alias("facts"))


def store(extracted: DataFrame, as_of: str, least: int = facts_.FREQUENCY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(passages, facts, links) of extracted chunks (chunk_id, text, observed_at and what ``extract`` adds).

    A fact's number is a hash of its chunk, place and content.  Links are made for facts whose predicate has been used ``least`` times.
    """
    good = extracted.where("ok")
    passages = facts_.passages(good.select(F.col("chunk_id").alias("passage_id"), "text"))
    rows = good.select("chunk_id", "text", "observed_at", F.posexplode("facts").alias("at", "f"))
    rows = rows.select(F.xxhash64("chunk_id", "at", "f.subject", "f.predicate", "f.object").alias("fact_id"), F.col("f.subject").alias("subject"), F.col("f.predicate").alias("predicate"), F.col("f.object").alias("object_value"),
                       F.col("text").alias("provenance_text"), "observed_at", F.col("f.confidence").alias("confidence"), "chunk_id")
    made = cut_lineage(facts_.created(rows, as_of, "confidence", "chunk_id"), "made")  # links read it twice; replies are parsed once
    links = facts_.schema_gate(made, least).where("linked").select("fact_id", F.col("chunk_id").alias("passage"), F.lit("supported_by").alias("kind"), F.lit(1.0).alias("weight"))
    return passages, made, links


def not_extracted(chunks: DataFrame, passages: DataFrame) -> DataFrame:
    """The chunks (chunk_id) that have no passage (passage_id) yet."""
    return chunks.join(passages.select(F.col("passage_id").alias("chunk_id")), "chunk_id", "left_anti")
