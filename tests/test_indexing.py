import time

import pytest
from mnemo.operators import extraction, hierarchy, indexing
from mnemo.operators.indexing import StoredHierarchy, entity_nodes
from mnemo.sources.shared import new_path
from pyspark.sql import functions as F


def test_union_equals_a_rebuild_and_a_second_run_creates_nothing(spark, monkeypatch):
    rows = [(k, ["likes", "works at", "is"][k % 3], f"p{k % 7}", ["web", "lab"][k % 2]) for k in range(60)]
    facts = spark.createDataFrame(rows, "fact_id long, predicate string, provenance_text string, domain string")
    entities = spark.createDataFrame([(f"e{k}", ["person", "org", None][k % 3], "web") for k in range(9)], "entity string, entity_type string, domain string")
    stored = StoredHierarchy(spark, new_path(spark, "h"), 4)
    count = lambda df: {r["kind"]: r["created"] for r in df.collect()}
    first = count(stored.index(facts.where("fact_id < 30"), "a", entities.limit(5)))
    with monkeypatch.context() as m:
        m.setattr(stored.nodes_, "merge", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            stored.index(facts, "b", entities)
    assert stored.missing(facts).count() == 30
    second = count(stored.index(facts, "b", entities))
    assert count(stored.index(facts, "c", entities)) == {"nodes": 0, "edges": 0} and stored.missing(facts).count() == 0
    nodes = hierarchy.nodes(facts, "domain").unionByName(entity_nodes(entities)).distinct()
    edges = hierarchy.edges(facts, "domain").unionByName(hierarchy.entity_edges(entities)).distinct()
    same = lambda a, b: sorted(map(tuple, a.select(*b.columns).collect())) == sorted(map(tuple, b.collect()))
    assert same(stored.nodes(), nodes) and same(stored.edges(), edges)
    assert first["nodes"] + second["nodes"] == nodes.count() and first["edges"] + second["edges"] == edges.count()


def test_many_braces_take_time_in_proportion(spark):
    good = '{"entities": [{"name": "a", "type": "b"}], "facts": []}'
    rows = [(1, "{" * 40_000 + good + "{" * 40_000), (2, "{so} " * 40_000 + good), (3, "{" * 40_000), (4, "x {'entities': []} y"), (5, '{"other": {"facts": []}} {"facts": [1]}')]
    began = time.time()
    got = {r["k"]: r["n"] for r in spark.createDataFrame(rows, "k int, t string").select("k", F.size(extraction.coerce_json(F.col("t"))["entities"]).alias("n")).collect()}
    assert time.time() - began < 30
    assert got[1] == got[2] == 1 and got[4] == 0 and got[3] in (None, -1)


def test_facts_are_looked_up_once(spark, monkeypatch):
    """Nodes and edges are made of the narrow facts without a node, not of their join."""
    plans, keep = {}, indexing.cut_lineage
    monkeypatch.setattr(indexing, "cut_lineage", lambda df, label: plans.setdefault(label, df._jdf.queryExecution().optimizedPlan().toString()) and keep(df, label))
    facts = spark.createDataFrame([(1, "p", "t", "d", [1.0])], "fact_id long, predicate string, provenance_text string, domain string, embedding array<double>")
    indexing.StoredHierarchy(spark, new_path(spark, "h"), 2).index(facts, "a")
    assert set(plans) == {"unindexed", "nodes", "edges"} and "embedding" not in plans["nodes"] + plans["edges"] and "_known" not in plans["nodes"] + plans["edges"]
