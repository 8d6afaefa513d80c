"""Groups that hold much of a table, against brute force with small blocks."""

import math
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mnemo.operators import conflicts, graph
from mnemo.plans import flows
from mnemo.sources import shared


@pytest.fixture(scope="module")
def hot(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        subject = "S" if i % 3 else "other"
        vector = None if i % 13 == 0 else [rng.choice([0.0, 0.5, 1.0]) for _ in range(3)] + [0.1]
        rows.append((i, subject, "p", None if i % 17 == 0 else f"v{i % 4}", f"text {i}", datetime(2024, 1, 1) + timedelta(hours=i), i + 1 if i % 7 == 0 else None, vector))
    rows.append((90, None, "p", "v1", "t", None, None, None))
    schema = "fact_id long, subject string, predicate string, object_value string, provenance_text string, observed_at timestamp, superseded_by long, embedding array<double>"
    return rows, spark.createDataFrame(rows, schema).withColumn("valid_from", F.lit(None).cast("timestamp")).cache()


def expected(rows):
    return {(a[0], b[0]) for a in rows for b in rows if a[1] and a[1] == b[1] and a[0] != b[0] and a[3] and b[3] and a[3] != b[3] and b[6] is None}


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_pairs_do_not_depend_on_blocks(hot, block):
    rows, df = hot
    got = [(r[0], r[1]) for r in conflicts.candidates(df, block).select("p.fact_id", "o.fact_id").toDF("a", "b").collect()]
    assert len(got) == len(set(got)) and set(got) == expected(rows)


@pytest.mark.parametrize("k", [1, 3, 10, 50])
def test_lowest_others_of_each_probe(hot, k):
    rows, df = hot
    want = {}
    for a, b in sorted(expected(rows)):
        want.setdefault(a, []).append(b)
    got = {}
    for a, b in sorted((r[0], r[1]) for r in conflicts.lowest(df, k).select("p.fact_id", "o.fact_id").toDF("a", "b").collect()):
        got.setdefault(a, []).append(b)
    assert got == {a: b[:k] for a, b in want.items()}


def test_pairs_are_not_shuffled_by_probe(hot):
    plan = conflicts.nearest(conflicts.candidates(hot[1]), 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def of_pairs(df):
    return sorted((r["p"]["fact_id"], r["o"]["fact_id"], r["similarity"]) for r in df.select("p", "o", "similarity").collect())


@pytest.mark.parametrize("block, k, least", [(1, 2, 0.25), (7, 5, 0.9), (1024, 3, 0.25), (1024, 50, 0.0)])
def test_similar_others_are_the_nearest_candidates(hot, block, k, least):
    want = conflicts.nearest(conflicts.candidates(hot[1]), k).where(F.round("similarity", 4) >= least)
    assert of_pairs(conflicts.similar(hot[1], k, least, block)) == of_pairs(want) != []


@pytest.mark.parametrize("tile, rows", [(1, 1), (5, 7), (64, 13), (1000, 1000)])
def test_groups_that_span_batches_and_tiles(hot, monkeypatch, tile, rows):
    monkeypatch.setattr(conflicts, "TILE", tile)
    df = hot[1].where("embedding is not null and object_value is not null and subject is not null").selectExpr(
        "lower(subject) ls", "'p' lp", "0 pb", "0 ob", "lower(object_value) lo", "fact_id", "object_value", "provenance_text", "0L t", "embedding", "true probe", "superseded_by is null other")
    batches = df.orderBy("ls").toArrow().combine_chunks().to_batches(rows)
    got = sorted((p["fact_id"], o["fact_id"], s) for b in conflicts._best_of_groups(batches, 4, 0.25) for p, o, s in zip(*(c.to_pylist() for c in b.columns), strict=True))
    assert got == of_pairs(conflicts.nearest(conflicts.candidates(hot[1]), 4).where(F.round("similarity", 4) >= 0.25))


def shuffles(df):
    return re.findall(r"\bExchange ", df._jdf.queryExecution().executedPlan().toString())


def test_conflicts_send_facts_once_and_no_pairs(spark, hot):
    few = hot[1].localCheckpoint()
    assert len(shuffles(conflicts.temporal(few))) == 1
    plan = conflicts.exclusive(few)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("Generate explode")[0] and plan.count("- Window [") == 2


def test_resolutions_are_detected_once(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(flows, "cut_lineage", lambda df, label: calls.append(label) or shared.cut_lineage(df, label))
    plan = flows.conflicts_resolved(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert calls == ["resolutions"] and "MapInArrow" not in plan


@pytest.mark.parametrize("split, cut", [(1, 1), (2, 3), (1_000_000, 1)])
def test_ranks_do_not_depend_on_how_hubs_are_split(spark, monkeypatch, split, cut):
    monkeypatch.setattr(graph, "SPLIT", split)
    edges = [("hub", f"n{i}", 1.0 + i % 3) for i in range(9)] + [(f"n{i}", "hub", 1.0) for i in range(0, 9, 2)] + [("n1", "n2", 1.0)]
    for some in (edges, [(b, a, w) for a, b, w in edges] + edges):  # with and without nodes that lead nowhere
        df = spark.createDataFrame(some, "source string, target string, weight double")
        got = dict(graph.pagerank(df, spark.createDataFrame([("n1", 0.75), ("hub", 0.25)], "node string, rank double"), 0.3, 6, cut_every=cut).collect())
        nodes = sorted({x for a, b, _ in some for x in (a, b)})
        start = {n: {"n1": 0.75, "hub": 0.25}.get(n, 0.0) for n in nodes}
        total = {n: sum(w for a, _, w in some if a == n) for n in nodes}
        v = dict(start)
        for _ in range(6):
            loose = sum(v[n] for n in nodes if not total[n])
            v = {n: 0.7 * (sum(v[a] * w / total[a] for a, b, w in some if b == n) + loose * start[n]) + 0.3 * start[n] for n in nodes}
        assert got.keys() == v.keys() and all(math.isclose(got[n], v[n], abs_tol=1e-12) for n in nodes)


def test_ranks_of_an_empty_graph(spark):
    none = spark.createDataFrame([], "source string, target string, weight double")
    assert graph.pagerank(none, spark.createDataFrame([("a", 1.0)], "node string, rank double"), 0.5, 3).collect() == [("a", 1.0)]


def test_clean_removes_the_session_folder(spark, tmp_path, monkeypatch):
    assert shared.session_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    folder = tmp_path / "session"
    monkeypatch.setattr(shared, "session_folder", lambda _: f"file://{folder}")
    assert shared.cut_lineage(spark.range(3)).count() == 3 and list(folder.iterdir())
    assert shared.clean(spark) and not folder.exists()
