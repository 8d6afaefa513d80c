"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents_of
from .tokenizing import tokenizer_file


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rans import encode_documents, read_token_files

    docs = documents_of(spark, sf_dir, "doc_id", "text")
    path = encode_documents(docs, tokenizer_file("word_bpe_49k.json"), True, 1)
    ids = read_token_files(spark, path)
    return ids.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(documents_of(spark, sf_dir, "doc_id", "text"), tokenizer_file("byte_bpe_50k.json"))


def pii_digest(docs: DataFrame) -> DataFrame:
    """Counts per base kind, a hash of the base spans, and all spans as text."""
    from .pii import BASE, find_pii, span_text

    found = find_pii(docs.select("doc_id", "text"))
    base = F.filter("pii_spans", lambda s: s["kind"].isin(*BASE))
    of_kind = lambda k: F.filter("pii_spans", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("pii_spans")).alias("spans"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(documents_of(spark, sf_dir, "doc_id", "text"))


#: (action, host/path) of the url query.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op7_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge_urls

    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
     q AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host,
                  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM p),
     r(action, h, p, rule) AS (VALUES ('block', 'net', '/', 'net/'), ('allow', 'example.net', '/en/', 'example.net/en/'),
                                      ('block', 'example.com', '/de/', 'example.com/de/'), ('allow', 'org', '/fr/', 'org/fr/')),
     m AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(action, length(rule)) AS action
           FROM q JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p) GROUP BY page_id)
SELECT q.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM q LEFT JOIN m USING (page_id)
"""


def op1_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score_documents

    docs = documents_of(spark, sf_dir, "doc_id", "text")
    chain = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, chain).withColumn("toxic", F.col("p_toxic") >= 0.5)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(documents_of(spark, sf_dir, "doc_id", "text")).withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts by the best-scoring pieces; scores are ranks of the file's pieces, not trained unigram probabilities."""
    from .token_counts import count_tokens

    return count_tokens(documents_of(spark, sf_dir, "doc_id", "text"), tokenizer_file("piece_bpe_32k.model"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import link_vectors

    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), 0.95)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fit, identify

    docs = documents_of(spark, sf_dir, "doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = fit(docs.where(F.coalesce(~held_out, F.lit(False))))
    return identify(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the items found in it, and whether there are any."""
    from .decontamination import contaminations

    docs = documents_of(spark, sf_dir, "doc_id", "text")
    found = contaminations(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = found.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("covered").alias("covered"))
    out = docs.select("doc_id").join(items, "doc_id", "left")
    return out.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce(F.array_join(F.col("items").cast("array<string>"), ","), F.lit("")).alias("items"),
                      F.coalesce("covered", F.lit(0)).cast("long").alias("covered"))


def op11_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, 5, F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import damaged, structure

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return structure(rows, damaged(rows))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(documents_of(spark, sf_dir, "text", "lang"))


OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
     s AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
     p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM s),
     total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
     places AS (SELECT lang, w, size, unnest(range(1, (len(w) - size + 2)::BIGINT)) AS i FROM p, range(1, 6) r(size)),
     g AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS f FROM places GROUP BY ALL HAVING count(*) >= 100),
     c AS (SELECT lang, phrase, f AS a, size, string_split(phrase, ' ') AS w FROM g WHERE size > 1),
     k AS (SELECT *, unnest(range(1, size)) AS k FROM c),
     v AS (SELECT k.lang, k.phrase, a, k, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n // (x.f::HUGEINT * y.f))::BIGINT AS score
           FROM k JOIN g x ON x.lang = k.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN g y ON y.lang = k.lang AND y.phrase = array_to_string(w[k + 1:], ' ') JOIN total ON total.lang = k.lang),
     b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
     o AS (SELECT lang, size, w, a, unnest(range(2, size)) AS part FROM c),
     h AS (SELECT lang, array_to_string(w[i:i + part - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest(range(1, size - part + 2)) AS i FROM o) GROUP BY ALL),
     q AS (SELECT b.* FROM b LEFT JOIN h USING (lang, phrase) WHERE coalesce(100 * longer < 100 * a, true))
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM q) WHERE rank <= 2000
"""


QUERIES = {f.__name__: f for f in (
    op1_toxicity_chain, op2_minhash_near_dedup, op3_token_counts, op4_token_files, op5_personal_data, op6_best_fit_packing, op7_url_cascade,
    op8_embedding_near_dedup, op9_language_id, op10_template_decontamination, op11_pivot_topk, op12_conversation_repair, op13_phrase_collocations)}
ORACLE_SQL = {"op7_url_cascade": OP7_SQL, "op11_pivot_topk": OP11_SQL, "op13_phrase_collocations": OP13_SQL}
