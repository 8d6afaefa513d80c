"""Documents to chunks: sanitise, deduplicate by content, cut into overlapping windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.functions.expressions import token_estimate

SIZE, OVERLAP = 1200, 120


def chunk_text(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ordinal, char_start, content) of raw windows; an empty text has none."""
    if overlap >= size:
        overlap = size // 4
    step, n = size - overlap, F.length("text")
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / step)).cast("int")
    cut = docs.where(n > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("ordinal"))
    start = F.col("ordinal") * step
    return cut.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), start.cast("long").alias("char_start"), F.substr("text", start + 1, F.lit(size)).alias("content"))


def chunk_pages(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of documents given as ``pages`` array<string>, with the pages each one spans.

    Pages are joined by a line end; contents are stripped; blank chunks take no ordinal.
    """
    if overlap >= size:
        overlap = size // 4
    step = size - overlap
    bounds = F.aggregate("pages", F.expr("struct(0L as at, cast(array() as array<struct<start:bigint,end:bigint>>) as spans)"), lambda a, p: F.struct(
        (a["at"] + F.length(p) + 1).alias("at"), F.concat(a["spans"], F.array(F.struct(a["at"].alias("start"), (a["at"] + F.length(p)).alias("end")))).alias("spans")), lambda a: a["spans"])
    docs = pages.select("doc_id", F.array_join("pages", "\n").alias("text"), bounds.alias("spans"))
    last = F.when(F.length("text") <= size, F.lit(0)).otherwise(F.ceil((F.length("text") - size) / step)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct((k * step).cast("long").alias("char_start"), F.substr("text", k * step + 1, F.lit(size)).alias("raw")))
    cut = F.transform(cut, lambda c: F.struct(c["char_start"].alias("char_start"), (c["char_start"] + F.length(c["raw"])).alias("char_end"), F.regexp_replace(c["raw"], r"(?U)^\s+|\s+$", "").alias("content")))
    chunks = docs.where(F.length("text") > 0).select("doc_id", "spans", F.posexplode(F.filter(cut, lambda c: c["content"] != "")).alias("ordinal", "c")).select("doc_id", "spans", "ordinal", "c.*")
    numbered = F.transform("spans", lambda s, i: F.struct((i + 1).alias("page"), s["start"].alias("start"), s["end"].alias("end")))
    hit = F.transform(F.filter(numbered, lambda s: (s["start"] < F.col("char_end")) & (s["end"] >= F.col("char_start"))), lambda s: s["page"])
    return chunks.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "content", "char_start", "char_end", F.array_min(hit).alias("page_start"), F.array_max(hit).alias("page_end"), token_estimate(F.col("content")).alias("token_count"))


def content_dedup(docs: DataFrame) -> DataFrame:
    """(content_hash, doc_id, copies): the first document of each content."""
    return docs.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
