"""Registered queries of flows over several steps (replay, resolution) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemo.functions import metadata
from mnemo.operators import conflicts, hierarchy, neighbours, replay, trigrams
from mnemo.operators.indexing import StoredHierarchy
from mnemo.operators.pipeline import ExtractionStore
from mnemo.operators.store import StoredTable
from mnemo.plans.catalogue import AS_OF, CHUNKS, DOMAINS_SQL, FACTS, ORACLE_SQL, ROUTE_SQL, THRESHOLD, chunks, domains, query, query_vector
from mnemo.plans.services import LEGACY, contradicting, labelled, pairs_sql, replies
from mnemo.sources.derived import facts, table
from mnemo.sources.folders import read_folders
from mnemo.sources.keyset import KeysetLoad
from mnemo.sources.shared import cut_lineage, new_path

REPLAY_SQL = f"""WITH RECURSIVE {FACTS},
g AS MATERIALIZED (SELECT fact_id, lower(subject) AS s, lower(predicate) AS p, lower(object_value) AS o, observed_at AS t, valid_to, status, superseded_by, embedding, row_number() OVER (PARTITION BY lower(subject), lower(predicate) ORDER BY fact_id) AS k FROM facts),
pairs AS MATERIALIZED (SELECT a.fact_id AS new, a.k, a.t AS nt, b.fact_id AS old, b.t AS ot, list_cosine_similarity(a.embedding, b.embedding) AS sim FROM g a JOIN g b ON a.s = b.s AND a.p = b.p AND b.k < a.k AND a.o <> b.o WHERE round(list_cosine_similarity(a.embedding, b.embedding), 4) >= {THRESHOLD}),
state AS (SELECT fact_id, superseded_by AS by_id, valid_to, status, 0::BIGINT AS found, 0::BIGINT AS step FROM g
  UNION ALL
  SELECT w.fact_id, coalesce(u.by_id, w.by_id), coalesce(w.valid_to, u.ends), CASE WHEN u.by_id IS NULL THEN w.status ELSE 'inactive' END, w.found + coalesce(u.found, 0), w.step + 1
  FROM state w LEFT JOIN (
    SELECT fact_id, max(by_id) AS by_id, max(ends) AS ends, max(found) AS found FROM (
      SELECT CASE WHEN nt >= ot THEN old ELSE new END AS fact_id, arg_max(CASE WHEN nt >= ot THEN new ELSE old END, r) AS by_id, arg_min(CASE WHEN nt >= ot THEN nt ELSE ot END, r) AS ends, 0::BIGINT AS found FROM
        (SELECT pairs.*, row_number() OVER (PARTITION BY new ORDER BY sim DESC, old) AS r FROM pairs JOIN state x ON x.fact_id = pairs.old AND x.by_id IS NULL AND pairs.k = x.step + 1) WHERE r <= 10 GROUP BY 1
      UNION ALL
      SELECT new, NULL, NULL, count(*) FROM (SELECT pairs.*, row_number() OVER (PARTITION BY new ORDER BY sim DESC, old) AS r FROM pairs JOIN state x ON x.fact_id = pairs.old AND x.by_id IS NULL AND pairs.k = x.step + 1) WHERE r <= 10 GROUP BY 1)
    GROUP BY 1) u ON u.fact_id = w.fact_id
  WHERE w.step < (SELECT max(k) FROM g))
SELECT fact_id, coalesce(by_id, -1) AS superseded_by, coalesce(epoch_us(valid_to), -1) AS valid_to_us, status, found FROM state WHERE step = (SELECT max(k) FROM g)"""


@query(REPLAY_SQL)
def replay_vectors(spark, sf_dir):
    """Facts arriving one by one, each against the ten nearest in force above the threshold; ends are closed."""
    states = replay.replayed(facts(spark, sf_dir), THRESHOLD)
    return states.select("fact_id", F.coalesce("superseded_by", F.lit(-1)).alias("superseded_by"), F.coalesce(F.unix_micros("valid_to"), F.lit(-1)).alias("valid_to_us"), "status", F.size("conflicts").cast("long").alias("found"))


@query(REPLAY_SQL.replace("SELECT fact_id, coalesce(by_id, -1) AS superseded_by, coalesce(epoch_us(valid_to), -1) AS valid_to_us, status, found FROM state WHERE step = (SELECT max(k) FROM g)",
                          "SELECT f.status AS before, s.status AS after, s.by_id IS NOT NULL AS superseded, count(*) AS n, CAST(sum(found) AS BIGINT) AS logged FROM state s JOIN facts f ON f.fact_id = s.fact_id WHERE step = (SELECT max(k) FROM g) GROUP BY 1, 2, 3"))
def replay_summary(spark, sf_dir):
    """Facts by status before and after the replay, with the conflicts that were logged."""
    f = facts(spark, sf_dir)
    states = replay.replayed(f, THRESHOLD)
    after = states.select("fact_id", F.col("status").alias("after"), F.col("superseded_by").isNotNull().alias("superseded"), F.size("conflicts").alias("logged"))  # the states are read once: each reading is a replay
    joined = after.join(f.select("fact_id", F.col("status").alias("before")), "fact_id")
    return joined.groupBy("before", "after", "superseded").agg(F.count(F.lit(1)).alias("n"), F.sum("logged").alias("logged"))


@query(pairs_sql("""SELECT f.fact_id, coalesce(w.by_id, f.superseded_by, -1) AS superseded_by, coalesce(l.n, 0) AS resolved FROM facts f
LEFT JOIN (SELECT conflicting_fact_id, max(fact_id) AS by_id FROM every WHERE stronger = 'first' GROUP BY 1) w ON w.conflicting_fact_id = f.fact_id
LEFT JOIN (SELECT fact_id, count(*) AS n FROM every GROUP BY 1) l ON l.fact_id = f.fact_id"""))
def conflicts_resolved(spark, sf_dir):
    """All conflicts logged as resolved, and the facts after them."""
    f = contradicting(spark, sf_dir)
    log = cut_lineage(conflicts.resolutions(conflicts.detect(f, THRESHOLD)), "resolutions")  # read twice
    n = log.groupBy("fact_id").agg(F.count(F.lit(1)).alias("resolved"))
    after = conflicts.applied(f, log).select("fact_id", "superseded_by")
    return after.join(n, "fact_id", "left").select("fact_id", F.coalesce("superseded_by", F.lit(-1)).alias("superseded_by"), F.coalesce("resolved", F.lit(0)).alias("resolved"))


@query(f"WITH {CHUNKS} SELECT doc_id, ordinal, title FROM (SELECT c.doc_id, ordinal, content, source AS title FROM chunks c JOIN documents d ON d.doc_id = c.doc_id) WHERE content ILIKE '%the_t%ing%' OR title ILIKE '%the_t%ing%' OR content ILIKE '%src1%' OR title ILIKE '%src1%'")
def chunks_by_trigrams(spark, sf_dir):
    """Chunks whose content or title holds either of two patterns, through an index of trigrams; wildcards stay live."""
    rows = chunks(spark, sf_dir, False).join(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title")), "doc_id")
    index = trigrams.TrigramIndex(spark, new_path(spark, "trigrams"), ["doc_id", "ordinal"], ["content", "title"]).build(rows)
    return index.search(rows, "%the_t%ing%", "%src1%").select("doc_id", "ordinal", "title")


@query(ORACLE_SQL["facts_lexical"])
def facts_by_trigrams(spark, sf_dir):
    """The lexical search over four columns of the facts through an index of trigrams."""
    f = facts(spark, sf_dir, False)
    index = trigrams.TrigramIndex(spark, new_path(spark, "trigrams"), ["fact_id"], ["subject", "predicate", "object_value", "provenance_text"]).build(f)
    hits = index.search(f, "%user:2%").orderBy(F.desc("confidence"), F.desc("observed_at"), "fact_id").limit(50)
    return hits.select("fact_id", F.round("confidence", 4).alias("confidence"))


@query("SELECT d.doc_id AS legacy_id, lang, n_chars, (SELECT count(*) FROM documents) AS audited FROM documents d")
def legacy_load(spark, sf_dir):
    """All documents loaded by key ranges in two runs, of which the first stops after two pages; with the rows that the audit counts."""
    path = new_path(spark, "legacy")
    target = StoredTable(spark, f"{path}/rows", ["id"], "id string, doc_id long, lang string, n_chars long", buckets=4)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    for most in (2, None):
        load = KeysetLoad(docs, "doc_id", target, path, LEGACY, "rag:documents:", 4)
        load.run(most=most)
    audited = load.audit().agg(F.sum("source_rows").alias("audited"))
    return target.read().select(F.col("doc_id").alias("legacy_id"), "lang", "n_chars").crossJoin(audited)  # one row


@query("""SELECT doc_id, lang, source AS origin, n_chars + 1 AS size, n_chars % 2 = 0 AS has_note, 'checked' AS state, lang = 'fr' OR text ILIKE '%ment%' AS found
FROM documents""")
def metadata_variant(spark, sf_dir):
    """Nested metadata read, tested for keys, merged, set below a path and searched."""
    d = table(spark, sf_dir, "documents")
    note = F.when(F.col("n_chars") % 2 == 0, F.lit('{"note": null, "lang": "?"}')).otherwise(F.lit('{"lang": "?"}'))
    own = F.to_json(F.struct("lang", F.struct(F.col("source").alias("origin"), F.struct(F.col("n_chars").alias("size")).alias("file")).alias("from"), F.concat(F.lit("tongue="), "lang").alias("tag")))
    m = metadata.merged(metadata.parse(note), metadata.parse(own))
    m = metadata.with_value(metadata.with_value(m, ["from", "file", "size"], F.col("n_chars") + 1), ["state"], F.lit("checked"))
    rows = d.select("doc_id", "text", m.alias("m"))
    at = lambda p, kind="string": metadata.read(F.col("m"), p, kind)
    return rows.select("doc_id", at("lang").alias("lang"), at("from.origin").alias("origin"), at("from.file.size", "long").alias("size"), metadata.has_key(F.col("m"), "note").alias("has_note"), at("state").alias("state"),
                       (metadata.search(F.col("text"), F.col("m"), "%ment%") | metadata.search(F.lit(None).cast("string"), F.col("m"), "%tongue=fr%")).alias("found"))


@query("SELECT coalesce(source, 'none') AS folder, count(*) AS lines, CAST(sum(length('doc ' || doc_id) + 1) AS BIGINT) AS bytes FROM documents WHERE source IS NULL OR source <> 'src3' GROUP BY 1")
def folder_walk(spark, sf_dir):
    """A tree of text files, one folder a source of the documents, read without the folder of one source."""
    root = new_path(spark, "tree")
    docs = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("source"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("value"))
    docs.repartition("source").write.partitionBy("source").text(root)
    files = read_folders(spark, root, "part-*", ["source=src3"]).where("status = 'ok'")
    folder = F.regexp_extract("folder", "source=([^/]*)$", 1)
    lines = F.size(F.split(F.col("content").cast("string"), "\n")) - 1
    return files.groupBy(folder.alias("folder")).agg(F.sum(lines).alias("lines"), F.sum("length").alias("bytes"))


def entities_of(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "person").when(F.col("event_type") == "click", "org").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select(F.concat(F.lit("user:"), "user_id").alias("entity"), kind.alias("entity_type"), F.lit("web").alias("domain"), F.col("ts").cast("timestamp").alias("at"))


@query(f"SELECT * FROM ({ORACLE_SQL['hierarchy_edges']}) UNION SELECT * FROM ({ORACLE_SQL['hierarchy_entity_edges']})")
def hierarchy_incremental(spark, sf_dir):
    """The hierarchy of all facts and entities, indexed in two batches and once more as a whole."""
    f, e = labelled(spark, sf_dir), entities_of(spark, sf_dir)
    stored = StoredHierarchy(spark, new_path(spark, "hierarchy"), 8)
    early = lambda c: F.col(c) < "2024-01-16"
    stored.index(f.where(early("observed_at")), "a", e.where(early("at")))
    stored.index(f.where(~early("observed_at")), "b", e.where(~early("at")))
    stored.index(f, "c", e)
    return stored.edges()


QUESTION = "Which project stores the memory of an agent?"
ROUTED_SQL = ROUTE_SQL.replace("WITH w AS", ", w AS").replace("FROM conversations WHERE text IS NOT NULL", f"FROM (SELECT 0 AS conv_id, 0 AS turn, '{QUESTION}' AS text)")
ROUTED_WITH, ROUTED_TAIL = ROUTED_SQL.rsplit("SELECT conv_id, turn, p.level", 1)


@query(f"WITH {FACTS}, {DOMAINS_SQL} {ROUTED_WITH}, steps AS (SELECT conv_id, turn, p.level{ROUTED_TAIL}), f AS (SELECT fact_id, round(greatest(0, least(1, 0.6 * sim + 0.3 + 0.1)), 4) AS score FROM (SELECT fact_id, list_cosine_similarity(embedding, q) AS sim FROM facts, query WHERE 'd' || label IN (SELECT domain FROM top) ORDER BY sim DESC, fact_id LIMIT 20)) "
       "SELECT 'hierarchical_index_routing' AS mode, * FROM (SELECT 'path' AS kind, level || ':' || label AS id, round(score, 4) AS score FROM steps UNION ALL SELECT 'domain', domain, round(s, 4) FROM top UNION ALL SELECT 'fact', fact_id::VARCHAR, score FROM f UNION ALL SELECT 'passage', 'event ' || fact_id, -1 FROM f)")
def hmem_answer(spark, sf_dir):
    """A whole answer: routing path, chosen domains, facts and their passages."""
    f = labelled(spark, sf_dir)
    passages = f.select(F.col("provenance_text").alias("passage"), F.concat(F.lit("text of "), "provenance_text").alias("passage_text"))
    rows = hierarchy.answer(f, hierarchy.edges(f, "domain"), domains(spark, sf_dir), passages, QUESTION, query_vector(spark, sf_dir), 20)
    return rows.select("mode", "kind", "id", F.round(F.coalesce("score", F.lit(-1.0)), 4).alias("score"))


@query("""WITH u AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events WHERE event_id % 5 < 3)
SELECT event_type AS predicate, count(*) AS facts, count(*) FILTER (n >= 3) AS links, count(*) AS passages, 1::BIGINT AS entities, (SELECT count(*) FROM events WHERE event_id % 5 >= 3) AS open FROM u GROUP BY 1""")
def extract_to_end(spark, sf_dir):
    """Replies extracted in two batches and once more: facts, links and passages by predicate, its entity, and the chunks that stay open."""
    r = replies(spark, sf_dir)
    done = ExtractionStore(spark, new_path(spark, "extraction"), 8)
    early = F.col("observed_at") < "2024-01-16"
    for batch, rows in (("a", r.where(early)), ("b", r.where(~early)), ("c", r)):
        done.run(rows, batch, AS_OF)
    links = done.links_.read().select("fact_id", F.lit(1).alias("linked"))
    held = done.passages_.read().select(F.col("passage_id").alias("chunk_id"), F.lit(1).alias("held"))
    n = done.facts_.read().join(links, "fact_id", "left").join(held, "chunk_id", "left").groupBy("predicate").agg(F.count(F.lit(1)).alias("facts"), F.count("linked").alias("links"), F.count("held").alias("passages"))
    named = done.entities_.read().groupBy(F.col("name").alias("predicate")).agg(F.count(F.lit(1)).alias("entities"))
    left = done.pending(r).agg(F.count(F.lit(1)).alias("open"))
    return n.join(named, "predicate").crossJoin(left).select("predicate", "facts", "links", "passages", "entities", "open")  # one row


@query(ORACLE_SQL["semantic_batch_topk"])
def semantic_batch_cells(spark, sf_dir):
    """The nearest vectors of a batch of queries through cells with exact bounds."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(emb, emb.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), 10)[0]
