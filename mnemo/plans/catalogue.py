"""The registered queries of the memory engine and their SQL, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemo.functions import expressions as X
from mnemo.operators import conflicts, facts as facts_, graph, hierarchy, ingest, monitoring, retrieval, trigrams
from mnemo.sources.derived import facts, graph_edges, k_mod, table

AS_OF, PAST = "2024-02-01 00:00:00", "2024-01-15 00:00:00"
THRESHOLD, TEXT = 0.25, "the"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

FACTS = f"""n AS (SELECT count(*) AS n FROM embeddings),
facts AS (SELECT event_id AS fact_id, 'user:' || user_id AS subject, event_type AS predicate, json_extract_string(props, '$.k') AS object_value,
  'event ' || event_id AS provenance_text, least(1.0, value / 100) AS confidence, ts AS observed_at, CASE WHEN event_id % 11 = 0 THEN ts + INTERVAL 10 DAY END AS valid_to,
  CASE WHEN event_id % 13 = 0 THEN event_id + 1 END AS superseded_by, CASE WHEN event_id % 17 = 0 THEN 'inactive' WHEN event_id % 3 = 0 THEN 'pending' ELSE 'active' END AS status,
  0.01 * (1 + event_id % 5) AS decay_rate, embedding::DOUBLE[] AS embedding, label FROM events, n, embeddings WHERE vec_id = event_id % n.n),
query AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
active AS (SELECT *, greatest(0, least(1, exp(-decay_rate * (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(observed_at)) / 86400e6))) AS salience_now FROM facts
  WHERE superseded_by IS NULL AND (valid_to IS NULL OR valid_to > TIMESTAMP '{AS_OF}') AND status <> 'inactive')"""
CHUNKS = """n AS (SELECT count(*) AS n FROM embeddings),
chunks AS (SELECT doc_id, k AS ordinal, k * 1080 AS char_start, substr(text, k * 1080 + 1, 1200) AS content
  FROM documents, unnest(range(0, CASE WHEN length(text) <= 1200 THEN 1 ELSE CAST(ceil((length(text) - 1200) / 1080.0) AS BIGINT) + 1 END)) AS u(k) WHERE length(text) > 0),
vectors AS (SELECT c.*, embedding::DOUBLE[] AS embedding FROM chunks c, n, embeddings WHERE vec_id = (doc_id * 7 + ordinal) % n.n),
query AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"""
PAIRS = f"""WITH {FACTS},
pairs AS (SELECT p.fact_id, o.fact_id AS conflicting_fact_id, p.object_value AS po, o.object_value AS oo, p.provenance_text AS pp, o.provenance_text AS op, list_cosine_similarity(p.embedding, o.embedding) AS sim
  FROM facts p JOIN facts o ON lower(p.subject) = lower(o.subject) AND lower(p.predicate) = lower(o.predicate) WHERE p.fact_id <> o.fact_id AND lower(p.object_value) <> lower(o.object_value) AND o.superseded_by IS NULL),
near AS (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY sim DESC, conflicting_fact_id) AS r FROM pairs),
named AS (SELECT *, CASE WHEN length(pp) = length(op) THEN 'tie' WHEN length(pp) > length(op) THEN 'first' ELSE 'second' END AS stronger,
  CASE WHEN length(pp) = length(op) THEN 0.5 ELSE round(least(0.95, 0.5 + 0.45 * greatest(length(pp), length(op)) / (length(pp) + length(op))), 4) END AS evidence_confidence FROM near),
temporal AS (SELECT fact_id, conflicting_fact_id, 'temporal' AS conflict_type, round(sim, 4) AS similarity, stronger, evidence_confidence FROM named WHERE r <= 5 AND round(sim, 4) >= {THRESHOLD}),
granularity AS (SELECT fact_id, conflicting_fact_id, 'granularity' AS conflict_type, round(sim, 4) AS similarity, stronger, evidence_confidence FROM named
  WHERE r <= 5 AND round(sim, 4) >= {THRESHOLD} AND (contains(lower(po), lower(oo)) OR contains(lower(oo), lower(po))))"""


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f
    return add


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"])


def chunks(spark: SparkSession, sf_dir: str, vectors: bool = True) -> DataFrame:
    out = ingest.chunk_text(table(spark, sf_dir, "documents"))
    if not vectors:
        return out
    emb = table(spark, sf_dir, "embeddings")
    return out.withColumn("vec_id", k_mod(F.col("doc_id") * 7 + F.col("ordinal"), emb.count())).join(emb.select("vec_id", "embedding"), "vec_id").drop("vec_id")


@query(f"WITH {FACTS} SELECT fact_id, subject, predicate, object_value, round(salience_now * list_cosine_similarity(embedding, q), 6) AS score FROM active, query ORDER BY salience_now * list_cosine_similarity(embedding, q) DESC, fact_id LIMIT 20")
def active_facts_ranked(spark, sf_dir):
    top = facts_.rank_facts(facts(spark, sf_dir), query_vector(spark, sf_dir), AS_OF, 20)
    return top.select("fact_id", "subject", "predicate", "object_value", F.round("score", 6).alias("score"))


@query(f"WITH {FACTS} SELECT fact_id, round(salience_now, 6) AS salience_now FROM active WHERE subject ILIKE '%user:1%' OR predicate ILIKE '%user:1%' OR object_value ILIKE '%user:1%' OR provenance_text ILIKE '%user:1%' ORDER BY active.salience_now DESC, observed_at DESC, fact_id LIMIT 20")
def active_facts_lexical_fallback(spark, sf_dir):
    return facts_.rank_facts(facts(spark, sf_dir, False), None, AS_OF, 20, "user:1").select("fact_id", F.round("salience_now", 6).alias("salience_now"))


@query(f"WITH {FACTS} SELECT fact_id, subject, predicate FROM facts WHERE observed_at <= TIMESTAMP '{PAST}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{PAST}')")
def facts_as_of(spark, sf_dir):
    return facts_.facts_at(facts(spark, sf_dir, False), PAST).select("fact_id", "subject", "predicate")


@query(f"WITH {FACTS} SELECT fact_id, round(salience_now, 6) AS salience_now FROM active")
def salience_now(spark, sf_dir):
    return facts_.active_facts(facts(spark, sf_dir, False), AS_OF).select("fact_id", F.round("salience_now", 6).alias("salience_now"))


FEEDBACK_SQL = f"""WITH RECURSIVE {FACTS}, first AS (SELECT subject, min(fact_id) AS target FROM facts GROUP BY 1),
log AS (SELECT target AS fact_id, observed_at AS ts, CASE fact_id % 5 WHEN 0 THEN 'approval' WHEN 1 THEN 'neutral' WHEN 2 THEN 'unknown' ELSE 'rebuttal' END AS signal, row_number() OVER (PARTITION BY target ORDER BY observed_at, fact_id) AS k,
  count(*) OVER (PARTITION BY target) AS n FROM facts JOIN first USING (subject) WHERE fact_id > target),
f AS (SELECT fact_id, 0::BIGINT AS k, 1.0::DOUBLE AS salience, observed_at AS since, 0::BIGINT AS reinforced, CASE WHEN fact_id % 2 = 0 THEN decay_rate ELSE 0.01 END::DOUBLE AS rate FROM facts JOIN first ON fact_id = target
  UNION ALL SELECT f.fact_id, f.k + 1, CASE WHEN signal IN ('approval', 'rebuttal') THEN round(greatest(0, least(1, greatest(0, least(1, salience * exp(-rate * (epoch_us(ts) - epoch_us(since)) / 86400e6))) * CASE signal WHEN 'approval' THEN 1.3 ELSE 0.5 END)), 4) ELSE salience END::DOUBLE,
  CASE WHEN signal IN ('approval', 'rebuttal') THEN ts ELSE since END, reinforced + CASE WHEN signal = 'approval' THEN 1 ELSE 0 END, rate FROM f JOIN log ON log.fact_id = f.fact_id AND log.k = f.k + 1)
SELECT f.fact_id, round(salience, 3) AS salience, reinforced FROM f JOIN (SELECT DISTINCT fact_id, n FROM log) l ON l.fact_id = f.fact_id AND l.n = f.k"""


@query(FEEDBACK_SQL)
def feedback_fold(spark, sf_dir):
    """Signals of one fact per user: the later events are feedback on the user's first; some signals are unknown and odd facts have no rate."""
    f = facts(spark, sf_dir, False)
    first = f.groupBy("subject").agg(F.min("fact_id").alias("target"))
    log = f.join(first, "subject").where("fact_id > target")
    k = F.col("fact_id") % 5
    signal = F.when(k == 0, "approval").when(k == 1, "neutral").when(k == 2, "unknown").otherwise("rebuttal")
    rated = f.withColumn("decay_rate", F.when(F.col("fact_id") % 2 == 0, F.col("decay_rate")))
    folded = facts_.fold_feedback(rated, log.select(F.col("target").alias("fact_id"), F.col("observed_at").alias("ts"), signal.alias("signal")))
    return folded.withColumn("salience", F.round("salience", 3))


@query(f"WITH {FACTS} SELECT fact_id, round(confidence, 4) AS confidence FROM facts WHERE subject ILIKE '%user:2%' OR predicate ILIKE '%user:2%' OR object_value ILIKE '%user:2%' OR provenance_text ILIKE '%user:2%' ORDER BY facts.confidence DESC, observed_at DESC, fact_id LIMIT 50")
def facts_lexical(spark, sf_dir):
    hits = facts(spark, sf_dir, False).where(facts_.matches("user:2")).orderBy(F.desc("confidence"), F.desc("observed_at"), "fact_id").limit(50)
    return hits.select("fact_id", F.round("confidence", 4).alias("confidence"))


@query(f"WITH {CHUNKS} SELECT doc_id, ordinal, char_start, sha256(content) AS content_hash, length(content) AS content_chars, greatest(1, length(content) // 4) AS token_count FROM chunks")
def chunk_text(spark, sf_dir):
    c = chunks(spark, sf_dir, False)
    return c.select("doc_id", "ordinal", "char_start", F.sha2("content", 256).alias("content_hash"), F.length("content").cast("long").alias("content_chars"), X.token_estimate(F.col("content")).alias("token_count"))


PAGES_SQL = r"""WITH d AS (SELECT doc_id, substr(text, 1, length(text) // 2) AS a, substr(text, length(text) // 2 + 1) AS b FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, a || chr(10) || b AS text, length(a) AS la, length(b) AS lb FROM d),
c AS (SELECT *, unnest(range(0, CASE WHEN length(text) <= 1200 THEN 1 ELSE CAST(ceil((length(text) - 1200) / 1080) AS BIGINT) + 1 END)) AS k FROM t), x AS (SELECT doc_id, k * 1080 AS char_start, substr(text, k * 1080 + 1, 1200) AS raw, la, lb FROM c),
y AS (SELECT doc_id, char_start, char_start + length(raw) AS char_end, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS content, la, lb FROM x)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY char_start) - 1 AS ordinal, sha256(content) AS content_hash, char_start, char_end, CASE WHEN la >= char_start THEN 1 ELSE 2 END AS page_start,
CASE WHEN la + 1 < char_end THEN 2 ELSE 1 END AS page_end, greatest(1, length(content) // 4) AS token_count FROM y WHERE content <> ''"""


@query(PAGES_SQL)
def chunk_pages(spark, sf_dir):
    """Two-page documents: the text cut at its middle."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    half = (F.length("text") / 2).cast("int")
    cut = ingest.chunk_pages(docs.select("doc_id", F.array(F.substr("text", F.lit(1), half), F.substr("text", half + 1)).alias("pages")))
    return cut.withColumn("content", F.sha2("content", 256)).withColumnRenamed("content", "content_hash")


@query(f"WITH {CHUNKS} SELECT doc_id, ordinal FROM chunks WHERE content ILIKE '%{TEXT}%' ORDER BY doc_id DESC, ordinal LIMIT 20")
def chunks_lexical(spark, sf_dir):
    return retrieval.lexical(chunks(spark, sf_dir, False), TEXT, 20).select("doc_id", "ordinal")


@query(f"WITH {CHUNKS} SELECT doc_id, ordinal, round(list_cosine_similarity(embedding, q), 4) AS score FROM vectors, query ORDER BY list_cosine_similarity(embedding, q) DESC, doc_id, ordinal LIMIT 20")
def chunks_semantic(spark, sf_dir):
    return retrieval.semantic(chunks(spark, sf_dir), query_vector(spark, sf_dir), 20).select("doc_id", "ordinal", "score")


@query(f"""WITH {CHUNKS}, s AS (SELECT doc_id, ordinal, 0 AS mode, row_number() OVER (ORDER BY round(sim, 4) DESC, doc_id, ordinal) AS pos FROM (SELECT doc_id, ordinal, list_cosine_similarity(embedding, q) AS sim FROM vectors, query ORDER BY sim DESC, doc_id, ordinal LIMIT 8)),
x AS (SELECT doc_id, ordinal, 1 AS mode, row_number() OVER (ORDER BY doc_id DESC, ordinal) AS pos FROM (SELECT doc_id, ordinal FROM chunks WHERE content ILIKE '%{TEXT}%' ORDER BY doc_id DESC, ordinal LIMIT 8)),
u AS (SELECT doc_id, ordinal, min(mode * 1000 + pos) AS p FROM (SELECT * FROM s UNION ALL SELECT * FROM x) GROUP BY 1, 2)
SELECT doc_id, ordinal, CAST(p // 1000 AS INTEGER) AS mode FROM u ORDER BY p LIMIT 8""")
def chunks_hybrid(spark, sf_dir):
    return retrieval.hybrid(chunks(spark, sf_dir), TEXT, query_vector(spark, sf_dir), 8).select("doc_id", "ordinal", "mode")


@query("""SELECT query_id, vec_id, rank, round(sim, 4) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM
(SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)) WHERE rank <= 10""")
def semantic_batch_topk(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    return retrieval.top_k_of_each(emb, emb.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), 10)


@query("SELECT conv_id, turn FROM conversations WHERE text ILIKE '%the%' ORDER BY turn DESC, conv_id LIMIT 30")
def recall_memory(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where(F.col("text").ilike("%the%")).orderBy(F.desc("turn"), "conv_id").limit(30).select("conv_id", "turn")


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS clean_hash FROM documents WHERE NOT regexp_matches(text, '\S-\n\S')""")
def sanitize_text(spark, sf_dir):
    """All documents; the SQL leaves out those with a hyphen at a line end, which the given tables do not hold."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.sanitize_text(F.col("text")), 256).alias("clean_hash"))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def content_hash_dedup(spark, sf_dir):
    return ingest.content_dedup(table(spark, sf_dir, "documents"))


@query("SELECT page_id, CASE " + " ".join(f"WHEN contains(upper(url), '{k}') THEN '{d}'" for k, d in X.DOMAIN_KEYWORDS) + " ELSE 'bibliotheque' END AS domain FROM pages")
def resolve_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.domain_of(F.col("url")).alias("domain"))


@query("SELECT status, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM (SELECT n_chars, CASE WHEN text IS NULL OR trim(text) = '' THEN 'skipped_empty' WHEN length(text) > 50000 THEN 'skipped_oversize_pages' ELSE 'ingested' END AS status FROM documents) GROUP BY 1")
def file_guard_status(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    blank = F.col("text").isNull() | (F.trim("text") == "")
    status = F.when(blank, "skipped_empty").when(F.length("text") > 50000, "skipped_oversize_pages").otherwise("ingested")
    return d.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query(f"WITH {FACTS} SELECT fact_id, CASE WHEN valid_to < observed_at THEN 'bad_interval' WHEN confidence < 0.02 THEN 'low_confidence' ELSE 'ok' END AS verdict FROM facts")
def validate_provenance(spark, sf_dir):
    f = facts(spark, sf_dir, False)
    return f.select("fact_id", F.when(F.col("valid_to") < F.col("observed_at"), "bad_interval").when(F.col("confidence") < 0.02, "low_confidence").otherwise("ok").alias("verdict"))


@query(f"WITH {FACTS} SELECT fact_id, frequency, frequency >= 3 AS linked FROM (SELECT fact_id, row_number() OVER (PARTITION BY predicate ORDER BY observed_at, fact_id) AS frequency FROM facts)")
def schema_gate_events(spark, sf_dir):
    return facts_.schema_gate(facts(spark, sf_dir, False)).select("fact_id", "frequency", "linked")


@query("SELECT event_type AS predicate, count(*) AS frequency, CASE WHEN count(*) >= 3 THEN 'stable' ELSE 'candidate' END AS status FROM events GROUP BY 1")
def schema_status(spark, sf_dir):
    return facts_.schema_status(facts(spark, sf_dir, False))


@query("SELECT c_mktsegment AS name, c_nationkey AS entity_type, max(c_custkey) AS latest, arg_max(c_acctbal, c_custkey) AS balance, count(*) AS versions FROM customer GROUP BY 1, 2")
def entity_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.groupBy(F.col("c_mktsegment").alias("name"), F.col("c_nationkey").alias("entity_type")).agg(
        F.max("c_custkey").alias("latest"), F.max_by("c_acctbal", "c_custkey").alias("balance"), F.count(F.lit(1)).alias("versions"))


@query(f"{PAIRS} SELECT * FROM temporal")
def conflicts_temporal(spark, sf_dir):
    return conflicts.temporal(facts(spark, sf_dir), THRESHOLD)


@query(f"{PAIRS} SELECT * FROM granularity")
def conflicts_granularity(spark, sf_dir):
    return conflicts.granularity(facts(spark, sf_dir), THRESHOLD)


@query(f"""{PAIRS[:PAIRS.index("pairs AS (")].replace("json_extract_string(props, '$.k') AS object_value", "CASE WHEN event_id % 4 = 0 THEN 'not is ' ELSE 'is ' END || (event_id % 5) AS object_value")}
pairs AS (SELECT p.fact_id, o.fact_id AS conflicting_fact_id, p.object_value AS po, o.object_value AS oo, length(p.provenance_text) AS pp, length(o.provenance_text) AS op FROM facts p JOIN facts o ON lower(p.subject) = lower(o.subject) AND lower(p.predicate) = lower(o.predicate)
  WHERE p.fact_id <> o.fact_id AND p.object_value <> o.object_value AND o.superseded_by IS NULL),
low AS (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY conflicting_fact_id) AS l FROM pairs)
SELECT fact_id, conflicting_fact_id, 'mutually_exclusive' AS conflict_type, NULL::DOUBLE AS similarity, CASE WHEN pp = op THEN 'tie' WHEN pp > op THEN 'first' ELSE 'second' END AS stronger,
CASE WHEN pp = op THEN 0.5 ELSE round(least(0.95, 0.5 + 0.45 * greatest(pp, op) / (pp + op)), 4) END AS evidence_confidence FROM low WHERE l <= 10 AND (po LIKE 'not %') <> (oo LIKE 'not %') AND replace(po, 'not ', '') = replace(oo, 'not ', '')""")
def conflicts_exclusive(spark, sf_dir):
    """Objects negated by position, so that contradictions occur."""
    f = facts(spark, sf_dir, False).withColumn("embedding", F.lit(None).cast("array<float>"))
    base = F.concat(F.lit("is "), (F.col("fact_id") % 5).cast("string"))
    return conflicts.exclusive(f.withColumn("object_value", F.when(F.col("fact_id") % 4 == 0, F.concat(F.lit("not "), base)).otherwise(base)))


@query(f"{PAIRS} SELECT conflict_type, count(*) AS n FROM (SELECT * FROM temporal UNION ALL SELECT * FROM granularity) GROUP BY 1")
def conflicts_by_type(spark, sf_dir):
    return conflicts.detect(facts(spark, sf_dir), THRESHOLD).groupBy("conflict_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"{PAIRS} SELECT fact_id, conflicting_fact_id, conflict_type, CASE WHEN stronger = 'first' THEN 'supersede' ELSE 'log' END AS action FROM (SELECT * FROM temporal UNION ALL SELECT * FROM granularity)")
def resolve_conflicts(spark, sf_dir):
    return conflicts.resolve(conflicts.detect(facts(spark, sf_dir), THRESHOLD)).select("fact_id", "conflicting_fact_id", "conflict_type", "action")


@query(f"WITH {FACTS} SELECT * FROM (SELECT fact_id, lead(fact_id) OVER (PARTITION BY subject, predicate ORDER BY observed_at, fact_id) AS superseded_by FROM facts) WHERE superseded_by IS NOT NULL")
def supersession_set(spark, sf_dir):
    return conflicts.supersede(facts(spark, sf_dir, False))


LAYERS_SQL = f"WITH {FACTS}, l AS (SELECT 'd' || label AS d, predicate AS s, fact_id, provenance_text FROM facts)"


def labelled(spark, sf_dir) -> DataFrame:
    return facts(spark, sf_dir).withColumn("domain", F.concat(F.lit("d"), "label"))


@query(f"""{LAYERS_SQL} SELECT layer, label, sha256(layer || '|' || label) AS node_id FROM (SELECT 'domain' AS layer, d AS label FROM l UNION SELECT 'theme', d || '/' || s FROM l UNION SELECT 'subtheme', d || '/' || s || '/' || s FROM l
UNION SELECT 'fact', 'fact:' || fact_id FROM l UNION SELECT 'passage', 'passage:' || provenance_text FROM l)""")
def hierarchy_nodes(spark, sf_dir):
    return hierarchy.nodes(labelled(spark, sf_dir), "domain")


@query(f"""{LAYERS_SQL} SELECT 'domain:' || d AS source, 'theme:' || d || '/' || s AS target, 'routes_to' AS edge_type, 0.7::DOUBLE AS weight FROM l UNION SELECT 'theme:' || d || '/' || s, 'subtheme:' || d || '/' || s || '/' || s, 'routes_to', 0.8 FROM l
UNION SELECT 'subtheme:' || d || '/' || s || '/' || s, 'fact:fact:' || fact_id, 'routes_to', 0.9 FROM l UNION SELECT 'fact:fact:' || fact_id, 'passage:passage:' || provenance_text, 'evidences', 1.0 FROM l""")
def hierarchy_edges(spark, sf_dir):
    return hierarchy.edges(labelled(spark, sf_dir), "domain")


DOMAINS_SQL = "dom AS (SELECT 'd' || label AS domain, arg_min(embedding, vec_id)::DOUBLE[] AS e FROM embeddings GROUP BY 1), top AS (SELECT domain, list_cosine_similarity(e, q) AS s FROM dom, query ORDER BY s DESC, domain LIMIT 3)"


def domains(spark, sf_dir) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return emb.groupBy(F.concat(F.lit("d"), "label").alias("domain")).agg(F.min_by("embedding", "vec_id").alias("embedding"))


@query(f"WITH {FACTS}, {DOMAINS_SQL} SELECT domain, round(s, 4) AS similarity FROM top")
def route_top_domains(spark, sf_dir):
    return hierarchy.route_domains(domains(spark, sf_dir), query_vector(spark, sf_dir)).select("domain", F.round("similarity", 4).alias("similarity"))


@query(f"WITH {FACTS}, {DOMAINS_SQL} SELECT fact_id, round(greatest(0, least(1, 0.6 * sim + 0.3 + 0.1)), 4) AS score FROM (SELECT fact_id, list_cosine_similarity(embedding, q) AS sim FROM facts, query WHERE 'd' || label IN (SELECT domain FROM top) ORDER BY sim DESC, fact_id LIMIT 20)")
def hmem_retrieve(spark, sf_dir):
    q = query_vector(spark, sf_dir)
    return hierarchy.retrieve(labelled(spark, sf_dir), q, 20, hierarchy.route_domains(domains(spark, sf_dir), q)).select("fact_id", F.round("score", 4).alias("score"))


@query(f"WITH {FACTS} SELECT fact_id, round(greatest(0, least(1, 0.6 * sim + 0.3 + 0.1)), 4) AS score FROM (SELECT fact_id, list_cosine_similarity(embedding, q) AS sim FROM facts, query ORDER BY sim DESC, fact_id LIMIT 20)")
def hmem_retrieve_flat(spark, sf_dir):
    return hierarchy.retrieve(facts(spark, sf_dir), query_vector(spark, sf_dir), 20).select("fact_id", F.round("score", 4).alias("score"))


EDGES_SQL = "e AS (SELECT 'p:' || l_partkey AS source, 's:' || l_suppkey AS target, count(*)::DOUBLE AS weight FROM lineitem GROUP BY 1, 2)"


@query(f"WITH RECURSIVE {EDGES_SQL}, b AS (SELECT source, target FROM e UNION ALL SELECT target, source FROM e), r AS (SELECT 's:1' AS node UNION SELECT b.target FROM r JOIN b ON b.source = r.node) SELECT node FROM r")
def reachable_facts(spark, sf_dir):
    """All that a supplier reaches over the edges both ways."""
    return graph.reachable(graph.undirected(graph_edges(spark, sf_dir)), spark.createDataFrame([("s:1",)], "node string"))


@query("SELECT 'supplies' AS kind, l_partkey AS source_id, l_suppkey AS target_id, count(*) AS n FROM lineitem GROUP BY 1, 2, 3 UNION ALL SELECT 'orders', o_custkey, o_orderkey, 1 FROM orders")
def edge_union(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    a = li.groupBy(F.col("l_partkey").alias("source_id"), F.col("l_suppkey").alias("target_id")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("supplies"))
    return a.unionByName(o.select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("target_id"), F.lit(1).cast("long").alias("n"), F.lit("orders").alias("kind")))


STEP = "SELECT v.node, {keep} * (coalesce(g.got, 0) + (SELECT coalesce(sum(r.rank), 0) FROM {prev} r LEFT JOIN tot ON tot.source = r.node WHERE tot.source IS NULL) * v.start) + {restart} * v.start AS rank FROM v LEFT JOIN (SELECT target AS node, sum(rank * share) AS got FROM {prev} JOIN st ON st.source = {prev}.node GROUP BY 1) g ON g.node = v.node"


def rank_sql(edges: str, restart: float, k: int, tail: str) -> str:
    steps = ", ".join(f"r{i} AS MATERIALIZED (" + STEP.format(prev=f"r{i - 1}", keep=1 - restart, restart=restart) + ")" for i in range(1, k + 1))
    return f"""WITH {EDGES_SQL}, g AS ({edges}), tot AS MATERIALIZED (SELECT source, sum(weight) AS total FROM g GROUP BY 1), st AS MATERIALIZED (SELECT g.source, target, weight / total AS share FROM g JOIN tot ON tot.source = g.source),
v AS (SELECT node, CASE WHEN node = 's:1' THEN 1.0 ELSE 0.0 END::DOUBLE AS start FROM (SELECT source AS node FROM g UNION SELECT target FROM g)), r0 AS (SELECT node, start AS rank FROM v), {steps} {tail.format(last=f"r{k}")}"""


@query(rank_sql("SELECT source, target, weight FROM e UNION ALL SELECT target, source, weight FROM e", 0.5, 10, "SELECT node, round(rank, 6) AS rank FROM {last}"))
def ppr_fixed_k(spark, sf_dir):
    seeds = spark.createDataFrame([("s:1", 1.0)], "node string, rank double")
    return graph.pagerank(graph.undirected(graph_edges(spark, sf_dir)), seeds, 0.5, 10).select("node", F.round("rank", 6).alias("rank"))


@query(rank_sql("SELECT target AS source, source AS target, weight FROM e", 0.15, 10, "SELECT node, round(rank, 6) AS rank FROM {last} ORDER BY rank DESC, node LIMIT 20"))
def pagerank_directed(spark, sf_dir):
    e = graph_edges(spark, sf_dir).select(F.col("target").alias("source"), F.col("source").alias("target"), "weight")
    ranked = graph.pagerank(e, spark.createDataFrame([("s:1", 1.0)], "node string, rank double"), 0.15, 10)
    return ranked.select("node", F.round("rank", 6).alias("rank")).orderBy(F.desc("rank"), "node").limit(20)


@query("SELECT n_name AS entity, c_custkey AS fact_id FROM nation, customer WHERE length(n_name) >= 3 AND contains(lower(c_name || ' ' || c_mktsegment || ' ' || (SELECT any_value(m.n_name) FROM nation m WHERE m.n_nationkey = c_nationkey)), lower(n_name))")
def entity_fact_match(spark, sf_dir):
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    named = c.join(F.broadcast(n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("own"))), "c_nationkey")
    texts = named.select(F.col("c_custkey").alias("id"), F.concat_ws(" ", "c_name", "c_mktsegment", "own").alias("text"))
    found = trigrams.contained(n.select(F.col("n_name").alias("name")), texts)
    return n.join(found, F.trim(F.lower("n_name")) == F.col("name")).select(F.col("n_name").alias("entity"), F.col("id").alias("fact_id"))


@query(f"WITH {FACTS}, s AS (SELECT subject, greatest(0, avg(list_cosine_similarity(embedding, q))) / ln(count(*) + 1 + exp(1)) AS v FROM facts, query GROUP BY 1) SELECT subject, round(v / (SELECT sum(v) FROM s WHERE v > 0), 6) AS mass FROM s WHERE v > 0")
def ppr_personalization(spark, sf_dir):
    sim = X.cosine(F.col("embedding"), F.array(*map(F.lit, query_vector(spark, sf_dir))))
    s = facts(spark, sf_dir).groupBy("subject").agg(F.avg(sim).alias("m"), F.count(F.lit(1)).alias("n"))
    mass = s.select("subject", (F.greatest(F.lit(0.0), "m") / F.log(F.col("n") + 1 + F.e())).alias("mass"))
    return graph.normalised(mass, "mass").select("subject", F.round("mass", 6).alias("mass"))


@query("SELECT conv_id, turn FROM conversations WHERE length(trim(text)) >= 25 AND role <> 'system' EXCEPT SELECT conv_id, turn FROM conversations WHERE turn % 2 = 0")
def pending_memories(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return monitoring.pending(c.where("role <> 'system'"), c.where("turn % 2 = 0"), ["conv_id", "turn"]).select("conv_id", "turn").distinct()


@query(f"WITH {CHUNKS} SELECT doc_id, ordinal FROM chunks WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = chunks.doc_id)")
def chunks_without_passage(spark, sf_dir):
    return chunks(spark, sf_dir, False).join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id", "ordinal")


@query(f"WITH {CHUNKS} SELECT count(*) AS chunks, count(DISTINCT c.doc_id) AS documents, count(l.doc_id) AS labelled, round(100.0 * count(l.doc_id) / count(*), 2) AS coverage_pct FROM chunks c LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = c.doc_id")
def ingestion_coverage(spark, sf_dir):
    marked = chunks(spark, sf_dir, False).join(table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("l", F.lit(1)), "doc_id", "left")
    return marked.agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("doc_id").alias("documents"), F.count("l").alias("labelled"), F.round(100.0 * F.count("l") / F.count(F.lit(1)), 2).alias("coverage_pct"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC")
def ingestion_timeline(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("day"))


@query("SELECT source AS domain, lang, count(*) AS documents FROM documents GROUP BY 1, 2")
def docs_per_domain(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("domain"), "lang").agg(F.count(F.lit(1)).alias("documents"))


@query("SELECT count(embedding) AS n, CAST(min(len(embedding)) AS BIGINT) AS least, CAST(max(len(embedding)) AS BIGINT) AS most FROM embeddings")
def vector_dims_check(spark, sf_dir):
    size = F.size("embedding").cast("long")
    return table(spark, sf_dir, "embeddings").agg(F.count("embedding").alias("n"), F.min(size).alias("least"), F.max(size).alias("most"))


@query("SELECT user_id AS job, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (ts > TIMESTAMP '2024-01-29 00:00:00' AND ts <= TIMESTAMP '2024-01-30 00:00:00') AS events_24h, CASE WHEN arg_max(event_type, (ts, event_id)) = 'error' THEN 'error' ELSE 'success' END AS status FROM events GROUP BY 1")
def jobs_summary(spark, sf_dir):
    return monitoring.jobs_summary(table(spark, sf_dir, "events"), "2024-01-30 00:00:00")


@query("SELECT event_id, user_id AS job, event_type FROM events WHERE ts > TIMESTAMP '2024-01-28 00:00:00' AND ts <= TIMESTAMP '2024-01-30 00:00:00'")
def recent_events(spark, sf_dir):
    return monitoring.recent(table(spark, sf_dir, "events"), "2024-01-30 00:00:00", 48).select("event_id", F.col("user_id").alias("job"), "event_type")


@query("WITH j AS (SELECT arg_max(event_type, (ts, event_id)) AS t FROM events GROUP BY user_id) SELECT count(*) AS jobs, count(*) FILTER (t = 'error') AS failed, count(*) FILTER (t <> 'error') AS done, round(100.0 * count(*) / 2000, 2) AS progress_pct, greatest(0, 2000 - count(*)) AS remaining FROM j")
def dashboard_snapshot(spark, sf_dir):
    return monitoring.dashboard(monitoring.jobs_summary(table(spark, sf_dir, "events"), "2024-01-30 00:00:00"), 2000)


def signal_sql(words) -> str:
    return "CASE WHEN regexp_matches(lower(text), '" + "|".join(words) + "') THEN 2 ELSE 1 END"


@query("SELECT conv_id, turn, sr, CASE WHEN sr >= 11 THEN 'critique' WHEN sr >= 9 THEN 'renforce' WHEN sr >= 7 THEN 'standard' ELSE 'leger' END AS level FROM (SELECT conv_id, turn, CASE WHEN length(text) > 180 THEN 2 ELSE 1 END + 1 + " + " + ".join(map(signal_sql, X.ROUTER_WORDS.values())) + " AS sr FROM conversations)")
def router_score(spark, sf_dir):
    score, level = X.router_score(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", score.alias("sr"), level.alias("level"))


ROUTE_SQL = r"""WITH w AS (SELECT conv_id, turn, [regexp_replace(x, '^[.,;:!?()\[\]]+|[.,;:!?()\[\]]+$', '', 'g') for x in regexp_split_to_array(lower(text), '\s+') if x <> ''] AS t FROM conversations WHERE text IS NOT NULL),
s AS (SELECT conv_id, turn, unnest([{'level': 'domain', 'label': 'memory', 'score': 1.0}, {'level': 'theme', 'label': CASE """ + " ".join(
    f"WHEN list_has_any(t, [{', '.join(repr(x) for x in words)}]) THEN '{theme}'" for theme, words in X.ROUTE_THEMES) + r""" ELSE 'general' END, 'score': 0.9},
  {'level': 'subtheme', 'label': CASE WHEN len(t) > 0 THEN array_to_string(t[1:4], '_') ELSE 'unspecified' END, 'score': 0.6}, {'level': 'entity', 'label': t[1], 'score': 0.4}, {'level': 'fact', 'label': 'candidate_facts', 'score': 0.3}, {'level': 'passage', 'label': 'candidate_passages', 'score': 0.2}]) AS p, len(t) AS n FROM w)
SELECT conv_id, turn, p.level AS level, p.label AS label, p.score::DOUBLE AS score FROM s WHERE n > 0 OR p.level <> 'entity'"""


@query(ROUTE_SQL)
def route_query(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.explode(X.route_query(F.col("text"))).alias("step")).select("conv_id", "turn", "step.*")


@query("SELECT conv_id, turn, 'Retrieve context for: ' || substr(text, 1, 80) AS title FROM conversations")
def taskcard(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("Retrieve context for: "), F.substring("text", 1, 80)).alias("title"))


@query("SELECT doc_id, concat_ws(',', CASE WHEN length(lang) = 0 THEN 'missing_sources' END, CASE WHEN doc_id % 2 = 0 THEN 'missing_citations' END, CASE WHEN doc_id % 3 = 0 THEN 'missing_limits' END, CASE WHEN doc_id % 5 = 0 THEN 'missing_risks' END) AS findings FROM documents")
def audit_answer(spark, sf_dir):
    k = F.col("doc_id")
    parts = X.missing_parts(sources=F.length("lang"), citations=k % 2, limits=k % 3, risks=k % 5)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(parts, ",").alias("findings"))


@query(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, 'nvapi-[A-Za-z0-9_\-]+', '***', 'g'), 'sk-[A-Za-z0-9_\-]+', '***', 'g'), '(?i)(api[_-]?key|token|secret|password|pass)=([^&\s]+)', '\1=***', 'g')) AS redacted_hash FROM documents")
def redact_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.redact(F.col("text")), 256).alias("redacted_hash"))


@query("SELECT c_custkey, CASE WHEN length(c_name) <= 8 THEN '***' ELSE substr(c_name, 1, 4) || '...' || substr(c_name, -4) END AS masked FROM customer")
def mask_secret(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.mask_secret(F.col("c_name")).alias("masked"))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id")


@query("SELECT o_orderkey, CAST(coalesce(l.l_linenumber, 0) AS BIGINT) AS l_linenumber, coalesce(l.l_partkey, -1) AS l_partkey FROM orders LEFT JOIN (SELECT l_orderkey, min(l_linenumber) AS l_linenumber, arg_min(l_partkey, (l_linenumber, l_partkey)) AS l_partkey FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey")
def lateral_first_line(spark, sf_dir):
    first = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_linenumber").alias("l_linenumber"), F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("l_partkey"))
    joined = table(spark, sf_dir, "orders").select("o_orderkey").join(first, "o_orderkey", "left")
    return joined.select("o_orderkey", F.coalesce("l_linenumber", F.lit(0)).cast("long").alias("l_linenumber"), F.coalesce("l_partkey", F.lit(-1)).alias("l_partkey"))
