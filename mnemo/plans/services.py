"""Registered queries of extraction, evidence, backfill, reconciliation, context and streams, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemo.functions import expressions as X
from mnemo.functions import sql as functions
from mnemo.operators import conflicts, extraction, facts as facts_, graph, hierarchy, monitoring, retrieval
from mnemo.plans.catalogue import AS_OF, CHUNKS, DOMAINS_SQL, FACTS, ORACLE_SQL, PAIRS, THRESHOLD, chunks, domains, labelled, query, query_vector
from mnemo.sources.derived import facts, table
from mnemo.sources.shared import new_path
from mnemo.streaming import live

LEXICAL = "the"
#: Name space of identifiers that come from an older store.
LEGACY = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def replies(spark, sf_dir):
    """Replies of a model made of the events: fenced, with words around, plain, unreadable, and without the keys."""
    fact = F.to_json(F.struct(F.array(F.struct(F.col("event_type").alias("name"), F.lit("concept").alias("type")), F.struct(F.lit("").alias("name"), F.lit("other").alias("type"))).alias("entities"), F.array(
        F.struct(F.concat(F.lit("user:"), "user_id").alias("subject"), F.col("event_type").alias("predicate"), F.get_json_object("props", "$.k").alias("object"), (F.col("value") / 100).cast("string").alias("confidence")),
        F.struct(F.lit("x").alias("subject"), F.lit("").alias("predicate"), F.lit("y").alias("object"), F.lit("high").alias("confidence"))).alias("facts")))
    k = F.col("event_id") % 5
    raw = F.when(k == 0, F.concat(F.lit("Here it is:\n```json\n"), fact, F.lit("\n```\nDone."))).when(k == 1, F.concat(F.lit("I think {so}: "), fact, F.lit(" and {more}"))).when(k == 2, fact).when(k == 3, F.lit("no object {here")).otherwise(F.lit('{"other": 1}'))
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("event_id").alias("chunk_id"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("text"), F.col("ts").cast("timestamp").alias("observed_at"), raw.alias("reply"))


@query("""SELECT event_id AS chunk_id, event_id % 5 < 3 AS ok, CASE WHEN event_id % 5 < 3 THEN event_type END AS entity, CASE WHEN event_id % 5 < 3 THEN 'user:' || user_id END AS subject,
CASE WHEN event_id % 5 < 3 THEN json_extract_string(props, '$.k') END AS object_value, CASE WHEN event_id % 5 < 3 THEN round(greatest(0, least(1, value / 100)), 6) END AS confidence FROM events""")
def clean_extraction(spark, sf_dir):
    """Every reply gives one named entity and one whole fact, or an error of its own."""
    out = extraction.extract(replies(spark, sf_dir))
    f = F.try_element_at("facts", F.lit(1))
    return out.select("chunk_id", "ok", F.try_element_at("entities", F.lit(1))["name"].alias("entity"), f["subject"].alias("subject"), f["object"].alias("object_value"), F.round(f["confidence"], 6).alias("confidence"))


@query("SELECT event_id % 5 AS kind, count(*) AS n, count(*) FILTER (event_id % 5 < 3) AS read FROM events GROUP BY 1")
def coerce_json(spark, sf_dir):
    r = replies(spark, sf_dir).withColumn("read", extraction.coerce_json(F.col("reply")).isNotNull())
    return r.groupBy((F.col("chunk_id") % 5).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if("read").alias("read"))


@query("""WITH u AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events WHERE event_id % 5 < 3)
SELECT event_type AS predicate, count(*) AS facts, count(*) FILTER (n >= 3) AS links FROM u GROUP BY 1""")
def extract_and_store(spark, sf_dir):
    """Facts stored and links made, by predicate."""
    _, made, links = extraction.store(extraction.extract(replies(spark, sf_dir)), AS_OF)
    linked = links.select("fact_id", F.lit(1).alias("linked"))
    return made.join(linked, "fact_id", "left").groupBy("predicate").agg(F.count(F.lit(1)).alias("facts"), F.count("linked").alias("links"))


@query(f"WITH {FACTS} SELECT fact_id, 'user:' || split_part(subject, ':', 2) || ' ' || predicate || ' ' || object_value AS to_embed, 'pending' AS status, coalesce(CASE WHEN fact_id % 2 = 0 THEN observed_at END, TIMESTAMP '{AS_OF}') AS observed_at FROM facts")
def created_facts(spark, sf_dir):
    rows = facts(spark, sf_dir, False).withColumn("observed_at", F.when(F.col("fact_id") % 2 == 0, F.col("observed_at")))
    return facts_.created(rows, AS_OF).select("fact_id", "to_embed", "status", "observed_at")


@query("SELECT doc_id AS passage_id, sha256(substr(text, 1, 500)) AS provenance_hash, 'active' AS status FROM documents WHERE text IS NOT NULL")
def created_passages(spark, sf_dir):
    rows = facts_.passages(table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("passage_id"), "text"))
    return rows.select("passage_id", F.sha2("provenance_text", 256).alias("provenance_hash"), "status")


@query("SELECT event_id AS fact_id, 'event ' || event_id AS passage, 'supported_by' AS kind, 1.0::DOUBLE AS weight FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events) WHERE n >= 3")
def fact_bridges(spark, sf_dir):
    return facts_.bridges(facts(spark, sf_dir, False))


@query("SELECT event_id AS fact_id, (SELECT count(*) FROM lineitem WHERE l_orderkey = event_id) AS access_count FROM events")
def touch_access(spark, sf_dir):
    return facts_.touched(facts(spark, sf_dir, False), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("fact_id")))


@query("SELECT DISTINCT event_id AS fact_id, 'event ' || event_id AS passage, sha256('text of event ' || event_id) AS text_hash FROM events")
def evidence_passages(spark, sf_dir):
    f = labelled(spark, sf_dir)
    passages = f.select(F.col("provenance_text").alias("passage"), F.concat(F.lit("text of "), "provenance_text").alias("passage_text"))
    found = hierarchy.evidence_passages(f, hierarchy.edges(f, "domain"), passages)
    return found.select("fact_id", "passage", F.sha2("passage_text", 256).alias("text_hash"))


@query("SELECT event_id AS fact_id, coalesce(d.source, 'bibliotheque') AS domain FROM events LEFT JOIN documents d ON d.doc_id = event_id WHERE event_id % 4 = 0")
def hierarchy_backfill_candidates(spark, sf_dir):
    f = facts(spark, sf_dir, False).withColumn("doc_id", F.col("fact_id"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("domain"))
    return hierarchy.backfill_candidates(f, f.where("fact_id % 4 <> 0"), docs)


@query("""WITH e AS (SELECT DISTINCT user_id, event_type FROM events), t AS (SELECT 'entity:user:' || user_id AS entity, event_type, CASE event_type WHEN 'view' THEN 'acteurs' WHEN 'click' THEN 'organisations' ELSE 'divers' END AS theme FROM e)
SELECT DISTINCT 'domain:web' AS source, 'theme:web/' || theme AS target, 'routes_to' AS edge_type, 0.7::DOUBLE AS weight FROM t UNION ALL SELECT DISTINCT 'theme:web/' || theme, entity, 'routes_to', 0.6 FROM t""")
def hierarchy_entity_edges(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "person").when(F.col("event_type") == "click", "org").otherwise(F.col("event_type"))
    ev = table(spark, sf_dir, "events").select(F.concat(F.lit("user:"), "user_id").alias("entity"), kind.alias("entity_type"), F.lit("web").alias("domain"))
    return hierarchy.entity_edges(ev)


ROUTED = "SELECT fact_id, round(sim, 4) AS similarity, round(greatest(0, least(1, 0.6 * sim + 0.3 + 0.1)), 4) AS score FROM (SELECT fact_id, list_cosine_similarity(embedding, q) AS sim FROM facts, query {where} ORDER BY sim DESC, fact_id LIMIT 20)"


@query(f"WITH {FACTS}, {DOMAINS_SQL} SELECT 'hierarchical_index_routing' AS mode, * FROM (" + ROUTED.format(where="WHERE 'd' || label IN (SELECT domain FROM top)") + ")")
def hmem_routed(spark, sf_dir):
    """Down the ``routes_to`` edges from the three nearest domains."""
    f = labelled(spark, sf_dir)
    found = hierarchy.retrieve_routed(f, hierarchy.edges(f, "domain"), domains(spark, sf_dir), query_vector(spark, sf_dir), 20)
    return found.select("mode", "fact_id", F.round("similarity", 4).alias("similarity"), F.round("score", 4).alias("score"))


@query(f"WITH {FACTS} SELECT 'hierarchical_semantic_flat' AS mode, * FROM (" + ROUTED.format(where="WHERE fact_id % 7 <> 0") + ")")
def hmem_without_domain_vectors(spark, sf_dir):
    """No domain has a vector, and every seventh fact has none."""
    f = labelled(spark, sf_dir).withColumn("embedding", F.when(F.col("fact_id") % 7 != 0, F.col("embedding")))
    none = domains(spark, sf_dir).withColumn("embedding", F.lit(None).cast("array<float>"))
    found = hierarchy.retrieve_routed(f, hierarchy.edges(f, "domain"), none, query_vector(spark, sf_dir), 20)
    return found.select("mode", "fact_id", F.round("similarity", 4).alias("similarity"), F.round("score", 4).alias("score"))


@query(f"WITH {FACTS} SELECT 'lexical_fallback' AS mode, fact_id FROM (SELECT fact_id FROM facts WHERE subject ILIKE '%user:2%' OR predicate ILIKE '%user:2%' OR object_value ILIKE '%user:2%' OR provenance_text ILIKE '%user:2%' ORDER BY confidence DESC, observed_at DESC, fact_id LIMIT 20)")
def hmem_lexical_fallback(spark, sf_dir):
    f = labelled(spark, sf_dir)
    return hierarchy.retrieve_routed(f, hierarchy.edges(f, "domain"), domains(spark, sf_dir), None, 20, "user:2").select("mode", "fact_id")


def ppr_inputs(spark, sf_dir):
    f = facts(spark, sf_dir)
    bridges = f.select("fact_id", F.concat(F.lit("doc"), (F.col("fact_id") % 50).cast("string")).alias("passage"))
    entities = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("name"))
    return f, bridges, entities


@query(None)
def ppr_retrieve(spark, sf_dir):
    """Facts and passages by the walk over the fact, passage and entity graph, to a tolerance of 1e-6; tested against brute force."""
    return graph.ppr_retrieve(*ppr_inputs(spark, sf_dir), query_vector(spark, sf_dir)).select("kind", "id", F.round("ppr_score", 5).alias("ppr_score"))


@query(f"""SELECT '{LEXICAL}' AS query, (SELECT string_agg(fact_id, ',' ORDER BY s DESC, fact_id) FROM (WITH {FACTS} SELECT fact_id, salience_now * list_cosine_similarity(embedding, q) AS s FROM active, query ORDER BY s DESC, fact_id LIMIT 8)) AS facts,
(SELECT string_agg(doc_id || ':' || ordinal, ',' ORDER BY doc_id, ordinal) FROM ({ORACLE_SQL["chunks_hybrid"]})) AS citations, 5::BIGINT + 1 AS steps""")
def context_bundle(spark, sf_dir):
    q = query_vector(spark, sf_dir)
    top = facts_.rank_facts(facts(spark, sf_dir), q, AS_OF, 8).select("fact_id", "score")
    row = retrieval.context_bundle(LEXICAL, top, retrieval.hybrid(chunks(spark, sf_dir), LEXICAL, q, 8))
    ids = F.transform("facts", lambda x: x["fact_id"].cast("string"))
    cited = F.transform(F.array_sort(F.transform("citations", lambda c: F.struct(c["document_id"].alias("d"), F.split(c["chunk_id"], ":")[1].cast("long").alias("o")))), lambda c: F.concat_ws(":", c["d"].cast("string"), c["o"].cast("string")))
    return row.select("query", F.array_join(ids, ",").alias("facts"), F.array_join(cited, ",").alias("citations"), F.size("route_paths").cast("long").alias("steps"))


def contradicting(spark, sf_dir):
    """Facts whose objects are negated by position, so that all types of conflict occur."""
    base = F.concat(F.lit("is "), (F.col("fact_id") % 5).cast("string"))
    return facts(spark, sf_dir).withColumn("object_value", F.when(F.col("fact_id") % 4 == 0, F.concat(F.lit("not "), base)).otherwise(base))


def pairs_sql(tail: str) -> str:
    """The conflict SQL over the facts of ``contradicting``."""
    made = FACTS.replace("json_extract_string(props, '$.k') AS object_value", "CASE WHEN event_id % 4 = 0 THEN 'not is ' ELSE 'is ' END || (event_id % 5) AS object_value")
    rest = PAIRS[PAIRS.index("pairs AS ("):]
    low = """low AS (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY conflicting_fact_id) AS l FROM named),
exclusive AS (SELECT fact_id, conflicting_fact_id, 'mutually_exclusive' AS conflict_type, NULL::DOUBLE AS similarity, stronger, evidence_confidence FROM low
  WHERE l <= 10 AND (po LIKE 'not %') <> (oo LIKE 'not %') AND replace(po, 'not ', '') = replace(oo, 'not ', '')),
every AS (SELECT * FROM temporal UNION ALL SELECT * FROM granularity UNION ALL SELECT * FROM exclusive)"""
    return f"WITH {made}, {rest}, {low} {tail}"


@query(pairs_sql("SELECT * FROM every"))
def conflicts_all(spark, sf_dir):
    return conflicts.detect(contradicting(spark, sf_dir), THRESHOLD)


@query(pairs_sql("SELECT conflict_type, count(*) AS n, count(*) FILTER (stronger = 'first') AS superseding FROM every GROUP BY 1"))
def conflicts_all_by_type(spark, sf_dir):
    found = conflicts.resolve(conflicts.detect(contradicting(spark, sf_dir), THRESHOLD))
    return found.groupBy("conflict_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("action") == "supersede").alias("superseding"))


@query(None)
def supersession_replay(spark, sf_dir):
    """Facts arriving one by one; tested against a sequential fold."""
    return conflicts.replay(facts(spark, sf_dir, False))


@query(f"WITH {CHUNKS} SELECT doc_id, count(*) AS chunks, CAST(sum(length(content)) AS BIGINT) AS chars, CAST(max(length(content)) AS BIGINT) AS longest FROM chunks GROUP BY 1")
def chunk_lengths(spark, sf_dir):
    n = F.length("content").cast("long")
    return chunks(spark, sf_dir, False).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(n).alias("chars"), F.max(n).alias("longest"))


@query(f"WITH {CHUNKS} SELECT doc_id, ordinal FROM chunks WHERE (doc_id + ordinal) % 5 = 0 AND length(trim(content)) > 0")
def missing_embeddings(spark, sf_dir):
    """Every fifth chunk has no vector."""
    c = chunks(spark, sf_dir).withColumn("embedding", F.when((F.col("doc_id") + F.col("ordinal")) % 5 != 0, F.col("embedding")))
    return monitoring.to_embed(c).select("doc_id", "ordinal")


@query("""SELECT done, done - 100 AS added, greatest(0, 200000 - done) AS remaining, round((done - 100) / hours, 4) AS per_hour, round(greatest(0, 200000 - done) / ((done - 100) / hours), 4) AS eta_hours
FROM (SELECT count(*) AS done, (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(min(ts))) / 3600e6 AS hours FROM events)""")
def ingestion_progress(spark, sf_dir):
    return monitoring.progress(table(spark, sf_dir, "events"), AS_OF, 100, 200000)


@query("SELECT min(ts) AS first, max(ts) AS last FROM events")
def ingestion_span(spark, sf_dir):
    """The first and last time in JSON metadata."""
    meta = table(spark, sf_dir, "events").select(F.to_json(F.struct(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ingested_at"))).alias("metadata"))
    at = F.to_timestamp(F.get_json_object("metadata", "$.ingested_at"))
    return meta.agg(F.min(at).alias("first"), F.max(at).alias("last"))


@query(f"""WITH {CHUNKS} SELECT * FROM (SELECT 'chunks' AS name, (SELECT count(*) FROM chunks) AS source_rows, (SELECT count(*) FROM chunks WHERE doc_id % 10 <> 0) AS target_rows UNION ALL
SELECT 'documents', (SELECT count(*) FROM documents), (SELECT count(*) FROM documents)), LATERAL (SELECT source_rows = target_rows AS matches)""")
def reconcile_counts(spark, sf_dir):
    c, d = chunks(spark, sf_dir, False), table(spark, sf_dir, "documents")
    return monitoring.reconcile({"documents": d, "chunks": c}, {"documents": d, "chunks": c.where("doc_id % 10 <> 0")})


@query("""SELECT event_id, user_id AS job, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'success' ELSE 'running' END AS status,
round((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6, 3) AS duration_s, substr(props, 1, 200) AS message FROM events""")
def job_runs(spark, sf_dir):
    runs = monitoring.job_runs(table(spark, sf_dir, "events"))
    return runs.withColumn("duration_s", F.round("duration_s", 3))


@query("""WITH j AS (SELECT user_id AS job, CASE WHEN arg_max(event_type, (ts, event_id)) = 'error' THEN 'error' ELSE 'success' END AS status FROM events WHERE user_id % 2 = 0 GROUP BY 1)
SELECT event_id, user_id AS job, event_type, j.status FROM events LEFT JOIN j ON j.job = user_id ORDER BY ts DESC, event_id DESC LIMIT 50""")
def events_with_jobs(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    jobs = monitoring.jobs_summary(ev.where("user_id % 2 = 0"), AS_OF)
    return monitoring.events_with_jobs(ev, jobs, 50).select("event_id", "job", "event_type", "status")


@query("SELECT s.source AS domain, count(*) AS documents FROM (SELECT DISTINCT source FROM documents) s JOIN documents d ON true WHERE d.doc_id IN (SELECT x.doc_id FROM documents x JOIN labels l ON l.doc_id = x.doc_id WHERE x.source = s.source AND l.quality = 1) GROUP BY 1")
def cross_filtered(spark, sf_dir):
    """A join on true with a correlated IN, as the equi-join it stands for."""
    d, good = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return d.where("source is not null").join(good, "doc_id", "left_semi").groupBy(F.col("source").alias("domain")).agg(F.count(F.lit(1)).alias("documents"))


@query("SELECT d.doc_id, d.lang, coalesce(s.n, 0) AS source_documents FROM documents d LEFT JOIN (SELECT source, count(*) AS n FROM documents WHERE source <> 'src3' GROUP BY 1) s ON s.source = d.source WHERE d.doc_id > 50 ORDER BY d.doc_id LIMIT 100")
def legacy_page(spark, sf_dir):
    """The page of documents behind a key, with what is known of their sources."""
    d = table(spark, sf_dir, "documents")
    known = d.where("source <> 'src3'").groupBy("source").agg(F.count(F.lit(1)).alias("source_documents"))
    page = d.where("doc_id > 50").orderBy("doc_id").limit(100)
    return page.join(known, "source", "left").select("doc_id", "lang", F.coalesce("source_documents", F.lit(0)).alias("source_documents"))


@query(None)
def legacy_id_map(spark, sf_dir):
    """A stable UUID for each document of an older store; of versions of one key the latest counts.  Tested against the uuid module."""
    d = table(spark, sf_dir, "documents")
    latest = d.groupBy((F.col("doc_id") % 1000).alias("legacy_id")).agg(F.max("doc_id").alias("doc_id"))
    return latest.select("legacy_id", "doc_id", X.uuid5(LEGACY, F.concat(F.lit("rag:documents:"), F.col("legacy_id").cast("string"))).alias("id"))


@query(f"WITH {FACTS} SELECT fact_id, round(greatest(0, least(1, coalesce(CASE WHEN fact_id % 3 <> 0 THEN 0.8 END, 1) * exp(-coalesce(CASE WHEN fact_id % 2 = 0 THEN decay_rate END, 0.01) * (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(observed_at)) / 86400e6))), 6) AS salience, round(list_cosine_similarity(embedding, q), 4) AS similarity FROM facts, query")
def sql_functions(spark, sf_dir):
    """``salience_now`` and ``cosine_sim`` as functions of the SQL session."""
    functions.register(spark)
    q = ", ".join(f"{float(x)!r}D" for x in query_vector(spark, sf_dir))
    return facts(spark, sf_dir).selectExpr(
        "fact_id", f"round(salience_now(if(fact_id % 3 <> 0, 0.8D, null), if(fact_id % 2 = 0, decay_rate, null), observed_at, timestamp '{AS_OF}'), 6) AS salience",
        f"round(cosine_sim(cast(embedding AS array<double>), array({q})), 4) AS similarity")


@query("SELECT doc_id, CASE WHEN length(source) <= 8 THEN '***' ELSE substr(source, 1, 4) || '...' || substr(source, -4) END AS token, lang AS lang, n_chars AS chars FROM documents")
def metadata_update(spark, sf_dir):
    """Two keys set in nested metadata, and secret-looking values masked."""
    d = table(spark, sf_dir, "documents")
    meta = F.map_concat(F.create_map(F.lit("token"), "source"), F.create_map(F.lit("lang"), "lang", F.lit("chars"), F.col("n_chars").cast("string")))
    return d.select("doc_id", X.mask_mapping(meta).alias("m")).select("doc_id", F.col("m")["token"].alias("token"), F.col("m")["lang"].alias("lang"), F.col("m")["chars"].cast("long").alias("chars"))


@query("SELECT vec_id, len(embedding) AS n, round(embedding[1]::DOUBLE, 5) AS first FROM embeddings")
def vector_round_trip(spark, sf_dir):
    """Vectors written as text and parsed again."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", X.parse_vector(X.vector_text(F.col("embedding"))).alias("v"))
    return v.select("vec_id", F.size("v").cast("long").alias("n"), F.round(F.col("v")[0].cast("double"), 5).alias("first"))


def event_stream(spark, sf_dir):
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '2024-01-01 00:00:00') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_events_24h(spark, sf_dir):
    """Events a type and day by a stream that reads all there is; counts are written as they stand at the end of each batch."""
    path = new_path(spark, "stream")
    counts = live.event_counts(event_stream(spark, sf_dir), "24 hours")
    done = counts.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(lambda b, k: b.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{path}/out/batch={k}")).start()
    done.awaitTermination()
    rows = spark.read.parquet(f"{path}/out")
    return rows.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT event_type AS predicate, event_id AS fact_id, f AS frequency, f >= 3 AS linked FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS f FROM events)")
def stream_schema_gate(spark, sf_dir):
    """The uses of each predicate, numbered in order of time by a stream with keyed state and timers; the stream is closed at the end."""
    rows = event_stream(spark, sf_dir).select(F.col("event_type").alias("predicate"), F.col("event_id").alias("fact_id"), F.col("ts").cast("timestamp").alias("observed_at"))
    return live.run_closed(rows, "observed_at", live.schema_gate, new_path(spark, "stream"))


STREAM_SALIENCE = """WITH RECURSIVE log AS (SELECT user_id AS fact_id, event_id AS feedback_id, ts, CASE event_type WHEN 'purchase' THEN 'approval' WHEN 'error' THEN 'rebuttal' WHEN 'view' THEN 'neutral' ELSE event_type END AS signal,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT fact_id, 0::BIGINT AS feedback_id, 0::BIGINT AS k, 1.0::DOUBLE AS salience, 0::BIGINT AS reinforced, epoch_us(ts) AS since FROM log WHERE k = 1
  UNION ALL SELECT log.fact_id, log.feedback_id, log.k, CASE WHEN signal IN ('approval', 'rebuttal') THEN round(greatest(0, least(1, greatest(0, least(1, salience * exp(-0.01 * (epoch_us(ts) - since) / 86400e6))) * CASE signal WHEN 'approval' THEN 1.3 ELSE 0.5 END)), 4) ELSE salience END::DOUBLE,
  reinforced + CASE WHEN signal = 'approval' THEN 1 ELSE 0 END, CASE WHEN signal IN ('approval', 'rebuttal') THEN epoch_us(ts) ELSE since END FROM f JOIN log ON log.fact_id = f.fact_id AND log.k = f.k + 1)
SELECT fact_id, feedback_id, salience, reinforced FROM f WHERE k > 0"""


@query(STREAM_SALIENCE)
def stream_salience(spark, sf_dir):
    """Salience after each signal of a feedback stream, folded in order of time."""
    kind = F.col("event_type")
    signal = F.when(kind == "purchase", "approval").when(kind == "error", "rebuttal").when(kind == "view", "neutral").otherwise(kind)
    rows = event_stream(spark, sf_dir).select(F.col("user_id").cast("long").alias("fact_id"), F.col("event_id").alias("feedback_id"), F.col("ts").cast("timestamp").alias("ts"), signal.alias("signal"))
    return live.run_closed(rows, "ts", live.salience, new_path(spark, "stream")).drop("ts")
