"""Registered queries over stored tables: ingestion, entities, jobs, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemo.operators import store
from mnemo.plans.catalogue import query
from mnemo.sources.derived import table
from mnemo.sources.shared import new_path


def titled(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("title"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("source_uri"), "text")


@query("""WITH d AS (SELECT sha256(text) AS content_hash, 'doc:' || doc_id AS source_uri, length(text) AS n, row_number() OVER (PARTITION BY text ORDER BY source NULLS FIRST, 'doc:' || doc_id) AS k FROM documents WHERE trim(text) <> ''),
c AS (SELECT *, CASE WHEN n <= 1200 THEN 1 ELSE CAST(ceil((n - 1200) / 1080) AS BIGINT) + 1 END AS n_chunks FROM d WHERE k = 1)
SELECT content_hash, source_uri, n_chunks, n_chunks AS chunks, n + 120 * (n_chunks - 1) AS chars FROM c""")
def store_documents(spark, sf_dir):
    """All documents stored, the same batch again, and all once more as another batch: each content once, with its chunks."""
    docs = titled(spark, sf_dir)
    stored = store.DocumentStore(spark, new_path(spark, "documents"), 16)
    for batch in ("first", "first", "second"):
        stored.ingest(docs, batch)
    lengths = stored.chunks("document_id", F.length("content").cast("long").alias("chars"))
    chunks = lengths.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("chars").alias("chars"))
    return stored.documents().join(chunks, "document_id").select("content_hash", "source_uri", "n_chunks", "chunks", "chars")


@query("""WITH c AS (SELECT text IS NULL OR trim(text) = '' AS blank, count(*) AS n FROM documents GROUP BY text), t AS (SELECT blank, count(*) AS contents, CAST(sum(n) AS BIGINT) AS files FROM c GROUP BY 1)
SELECT 'first' AS batch, CASE WHEN blank THEN 'skipped_empty' ELSE 'ingested' END AS status, contents, files FROM t UNION ALL SELECT 'second', CASE WHEN blank THEN 'skipped_empty' ELSE 'skipped' END, contents, files FROM t""")
def ingest_run_summary(spark, sf_dir):
    """What two runs over the same documents did, by status."""
    docs = titled(spark, sf_dir)
    stored = store.DocumentStore(spark, new_path(spark, "documents"), 16)
    told = None
    for batch in ("first", "second"):
        report = stored.ingest(docs, batch).groupBy("status").agg(F.count(F.lit(1)).alias("contents"), F.sum("n").alias("files")).withColumn("batch", F.lit(batch))
        told = report if told is None else told.unionByName(report)
    return told.select("batch", "status", "contents", "files")


@query("""WITH c AS (SELECT c_mktsegment AS name, 'nation ' || c_nationkey AS entity_type, arg_max(c_name, c_custkey) AS customer, max(c_custkey)::VARCHAR AS number, arg_max(c_acctbal, c_custkey) FILTER (c_acctbal > 0) AS balance FROM customer GROUP BY 1, 2),
o AS (SELECT c_mktsegment AS name, 'nation ' || c_nationkey AS entity_type, arg_max(o_orderpriority, o_orderkey) AS priority FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)
SELECT c.name, c.entity_type, customer, number, priority, balance FROM c LEFT JOIN o ON o.name = c.name AND o.entity_type = c.entity_type""")
def entity_store(spark, sf_dir):
    """Entities upserted from customers, then from their orders: metadata is merged and the balance of the first batch stays."""
    c = table(spark, sf_dir, "customer")
    key = [F.col("c_mktsegment").alias("name"), F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("entity_type")]
    entities = store.entity_table(spark, new_path(spark, "entities"), 16)
    entities.merge(c.select(*key, "c_custkey", F.create_map(F.lit("customer"), "c_name", F.lit("number"), F.col("c_custkey").cast("string")).alias("metadata"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("double")).alias("balance")), "customers", "c_custkey")
    o = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    rows = o.select(*key, "o_orderkey", F.create_map(F.lit("priority"), "o_orderpriority").alias("metadata"))
    for batch in ("orders", "orders", "orders again"):
        entities.merge(rows, batch, "o_orderkey")
    m = F.col("metadata")
    return entities.read().select("name", "entity_type", m["customer"].alias("customer"), m["number"].alias("number"), m["priority"].alias("priority"), "balance")


@query("""WITH e AS (SELECT 'user:' || user_id AS job, *, max(ts) FILTER (event_type = 'view') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS start FROM events WHERE event_type <> 'click'),
l AS (SELECT job, max(ts) FILTER (event_type = 'view') AS last_started_at, arg_max(event_type, (ts, event_id)) FILTER (event_type <> 'signup') AS state, arg_max(CAST(trunc(value) AS BIGINT), (ts, event_id)) FILTER (event_type = 'purchase') AS items_processed FROM e GROUP BY 1),
d AS (SELECT job, ts, start, event_type, props, row_number() OVER (PARTITION BY job ORDER BY ts DESC, event_id DESC) AS k FROM e WHERE event_type IN ('purchase', 'error'))
SELECT l.job, CASE state WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'error' ELSE 'idle' END AS status, last_started_at, d.ts AS last_completed_at, round((epoch_us(d.ts) - epoch_us(start)) / 1e6, 3) AS last_duration_s,
items_processed, CASE WHEN d.event_type = 'error' THEN substr(props, 1, 500) END AS last_error FROM l LEFT JOIN d ON d.job = l.job AND k = 1""")
def job_store(spark, sf_dir):
    """Jobs whose events arrive in three batches: states, times, the duration of the last run, counters that only a success sets, and the last error until a success."""
    e = table(spark, sf_dir, "events")
    kind = F.create_map(*(F.lit(x) for pair in (("signup", "registered"), ("view", "started"), ("purchase", "completed"), ("error", "error")) for x in pair))[F.col("event_type")]
    events = e.select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("job"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("value").cast("long").alias("items"), F.lit(0).alias("failed"), F.col("props").alias("message"))
    jobs = store.job_table(spark, new_path(spark, "jobs"), 16)
    day = F.to_date("at")
    for batch, some in (("a", day < "2024-01-10"), ("b", (day >= "2024-01-10") & (day < "2024-01-20")), ("c", day >= "2024-01-20")):
        jobs.merge(store.job_changes(events.where(some), jobs), batch, "place")
    time = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return jobs.read().select("job", "status", time("last_started_at"), time("last_completed_at"), F.round("last_duration_s", 3).alias("last_duration_s"), "items_processed", "last_error")
