import pytest
from mnemo.functions import expressions as X
from mnemo.operators import facts, graph, ingest
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "clean"), [("abc\x00def", "abcdef"), ("agri-\nculture", "agriculture"), ("a    b\t\tc", "a b c"), ("é-\né", "éé"), (" \n x\n\n\n\ny ", "x\n\ny")])
def test_sanitize(spark, text, clean):
    assert one(spark, X.sanitize_text(F.lit(text))) == clean


@pytest.mark.parametrize(("text", "negated"), [("not alive", True), ("is alive, no", True), ("n'a pas", True), ("knowledge", False)])
def test_negation(spark, text, negated):
    assert one(spark, X.has_negation(F.lit(text))) is negated


@pytest.mark.parametrize(("a", "b", "want"), [("is alive", "is not alive", True), ("yes", "not yes", True), ("is alive", "is happy", False)])
def test_contradiction_is_symmetric(spark, a, b, want):
    assert one(spark, X.contradicts(F.lit(a), F.lit(b))) is want
    assert one(spark, X.contradicts(F.lit(b), F.lit(a))) is want


def test_scores_are_clamped(spark):
    assert one(spark, X.candidate_score(F.lit(1.0), F.lit(1.0))) == pytest.approx(1)
    assert one(spark, X.candidate_score(F.lit(0.0), F.lit(0.0), 0.0)) == 0
    assert one(spark, X.candidate_score(F.lit(2.0), F.lit(2.0), 2.0)) == 1
    assert one(spark, X.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None


def test_chunks_of_pages(spark):
    docs = spark.createDataFrame([(1, ["a" * 1000, "b" * 1000]), (2, ["x" * 500]), (3, []), (4, ["", "   "])], "doc_id long, pages array<string>")
    out = ingest.chunk_pages(docs, 400, 40).orderBy("doc_id", "ordinal").collect()
    first = [r for r in out if r["doc_id"] == 1]
    assert [r["ordinal"] for r in first] == list(range(len(first)))
    assert first[0]["page_start"] == 1 and first[-1]["page_end"] == 2 and all(r["token_count"] >= 1 for r in out)
    assert {r["doc_id"] for r in out} == {1, 2}


def test_feedback_folds_like_a_loop(spark):
    import datetime as dt
    import math

    t0 = dt.datetime(2024, 1, 1)
    facts_df = spark.createDataFrame([(1, 1.0, 0.05, t0)], "fact_id long, salience double, decay_rate double, observed_at timestamp")
    signals = [(1, t0 + dt.timedelta(days=d), s) for d, s in [(3, "rebuttal"), (1, "approval"), (2, "neutral"), (9, "approval")]]
    got = facts.fold_feedback(facts_df, spark.createDataFrame(signals, "fact_id long, ts timestamp, signal string")).first()
    salience, at = 1.0, t0
    for _, ts, s in sorted(signals, key=lambda r: r[1]):
        if s != "neutral":
            salience = round(min(1, salience * math.exp(-0.05 * (ts - at).days) * {"approval": 1.3, "rebuttal": 0.5}[s]), 4)
            at = ts
    assert got["salience"] == pytest.approx(salience, abs=1e-4) and got["reinforced"] == 2


def test_ranks_keep_their_mass_and_cycles_end(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("c", "a", 1.0), ("c", "d", 1.0)], "source string, target string, weight double")
    ranks = graph.pagerank(edges, spark.createDataFrame([("a", 1.0)], "node string, rank double"), 0.5, 40, 1e-6)
    assert ranks.agg(F.sum("rank")).first()[0] == pytest.approx(1)
    assert graph.reachable(edges, spark.createDataFrame([("b",)], "node string")).count() == 4
