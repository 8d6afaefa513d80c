"""Operators that SQL cannot express, against brute force, and rows with nulls."""

import datetime as dt
import json
import math
import uuid

import numpy as np
import pytest
from mnemo.functions import expressions as X
from mnemo.operators import conflicts, extraction, facts, graph, hierarchy
from mnemo.plans import services
from mnemo.plans.catalogue import QUERIES, query_vector
from mnemo.streaming import live
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
AT = dt.datetime(2024, 1, 1)
FACT = "fact_id long, subject string, predicate string, object_value string, observed_at timestamp, valid_from timestamp, valid_to timestamp, status string, superseded_by long"


def test_replay_matches_a_sequential_fold(spark):
    rows = [(k, f"S{k % 3}", "p", f"o{k * k % 5}", AT + dt.timedelta(days=k * 7 % 11), None, None if k % 4 else AT + dt.timedelta(days=50), "active", 99 if k % 13 == 5 else None) for k in range(80)] + [(90, None, "p", "x", AT, None, None, "active", None)]
    state = {}
    for k, s, p, o, t, _, end, status, by in rows:
        mine = state[k] = [by, end, status, (s and s.lower(), p), o.lower(), t]
        others = [i for i in sorted(state) if i != k and s and state[i][3] == mine[3] and state[i][4] != mine[4] and state[i][0] is None and i < k][:10]
        for i in others:
            old = state[i]
            newer, older, name = (mine, old, k) if t >= old[5] else (old, mine, i)
            older[0], older[1], older[2] = name, older[1] or newer[5], "inactive"
    got = {r["fact_id"]: r for r in conflicts.replay(spark.createDataFrame(rows, FACT)).collect()}
    assert len(got) == len(rows)
    for k, want in state.items():
        assert (got[k]["superseded_by"], got[k]["valid_to"], got[k]["status"]) == tuple(want[:3]), k


def test_feedback_with_nulls_and_unknown_signals(spark):
    base = spark.createDataFrame([(1, 0.4, 0.02, AT), (2, 0.4, None, AT), (3, None, None, AT), (4, 1.0, 0.1, AT)], "fact_id long, salience double, decay_rate double, observed_at timestamp")
    day = lambda n: AT + dt.timedelta(days=n)
    log = spark.createDataFrame([(1, day(1), "shrug"), (1, day(2), None), (2, day(10), "rebuttal"), (3, day(5), "neutral"), (3, day(6), "approval"), (3, day(7), "rebuttal")], "fact_id long, ts timestamp, signal string")
    got = {r["fact_id"]: (r["salience"], r["reinforced"]) for r in facts.fold_feedback(base, log).collect()}
    three = round(min(1, math.exp(-0.06) * 1.3), 4)
    assert got == {1: (0.4, 0), 2: (round(0.4 * math.exp(-0.1) * 0.5, 4), 0), 3: (round(three * math.exp(-0.01) * 0.5, 4), 1)}


def test_retrieval_leaves_out_facts_without_vectors(spark):
    rows = [(1, [1.0, 0.0], 0.5, "a"), (2, None, 1.0, "a"), (3, [0.6, 0.8], None, "b")]
    f = spark.createDataFrame(rows, "fact_id long, embedding array<double>, salience double, domain string")
    got = [(r["fact_id"], round(r["score"], 4)) for r in hierarchy.retrieve(f, [1.0, 0.0], 5).collect()]
    assert got == [(1, 0.85), (3, 0.76)]
    domains = spark.createDataFrame([("a", [0.0, 1.0]), ("b", None), ("c", [1.0, 0.0])], "domain string, embedding array<double>")
    assert [r["domain"] for r in hierarchy.route_domains(domains, [1.0, 0.0], 2).collect()] == ["c", "a"]
    assert spark.range(1).select(X.clamp01(F.lit(None).cast("double")).alias("x")).first()["x"] is None


def test_ranks_match_brute_force(spark):
    f, bridges, entities = (df.toPandas() for df in services.ppr_inputs(spark, SF))
    q = np.array(query_vector(spark, SF), float)
    f["sim"] = [float(np.dot(v, q) / np.linalg.norm(v) / np.linalg.norm(q)) for v in f["embedding"]]
    f = f.sort_values(["sim", "fact_id"], ascending=[False, True]).head(2000)
    sim = {k: max(0.0, s) for k, s in zip(f["fact_id"], f["sim"])}
    text = {k: f"{s} {o}".lower() for k, s, o in zip(f["fact_id"], f["subject"], f["object_value"])}
    edges, seeds, of = [], {f"f:{k}": s for k, s in sim.items()}, {}
    for k, p in zip(bridges["fact_id"], bridges["passage"]):
        if k in sim:
            edges.append((f"f:{k}", f"p:{p}", 1.0))
            of.setdefault(f"p:{p}", []).append(sim[k])
    for e, name in zip(entities["entity"], entities["name"]):
        hits = [k for k, t in text.items() if name.lower() in t]
        edges += [(f"e:{e}", f"f:{k}", 0.5) for k in hits]
        if hits:
            seeds[f"e:{e}"] = max(0.0, sum(sim[k] for k in hits) / len(hits)) / math.log(len(hits) + 1 + math.e)
    seeds |= {p: sum(s) / len(s) for p, s in of.items()}
    nodes = sorted({x for a, b, _ in edges for x in (a, b)} | set(seeds))
    at = {n: k for k, n in enumerate(nodes)}
    w = np.zeros((len(nodes), len(nodes)))
    for a, b, x in edges:
        w[at[a], at[b]] += x
        w[at[b], at[a]] += x
    v0 = np.array([max(0.0, seeds.get(n, 0.0)) for n in nodes])
    v0 /= v0.sum()
    total = w.sum(axis=1)
    share = np.divide(w, total[:, None], out=np.zeros_like(w), where=total[:, None] > 0)
    v = v0.copy()
    for _ in range(40):
        v = 0.5 * (v @ share + v[total == 0].sum() * v0) + 0.5 * v0
    got = graph.ppr_retrieve(*services.ppr_inputs(spark, SF), list(q)).collect()
    assert [r["kind"] for r in got] == ["fact"] * 8 + ["passage"] * 8
    for kind, letter in (("fact", "f"), ("passage", "p")):
        best = sorted((-v[at[n]] for n in nodes if n.startswith(f"{letter}:")))[:8]
        mine = [(r["id"], r["ppr_score"]) for r in got if r["kind"] == kind]
        assert all(abs(s - v[at[f"{letter}:{i}"]]) < 2e-6 for i, s in mine)
        assert np.allclose([s for _, s in mine], [-b for b in best], atol=2e-6)


@pytest.mark.parametrize("raw, want", [
    ('{"facts": []}', True), ('text {"facts": [{"subject": "a"}]} more', True), ('```json\n{"entities": [{"name": "x"}]}\n```', True), ('{"a": {"facts": []}}', True),
    ("", False), (None, False), ("{", False), ('{"other": 1}', False), ("[1, 2]", False), ('say {"x": 1} then {"entities": []}', True)])
def test_replies(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "reply string").select(extraction.coerce_json(F.col("reply")).isNotNull().alias("ok")).first()["ok"]
    assert got is want


def test_cleaned_records(spark):
    raw = json.dumps({"entities": [{"name": "a", "type": "t"}, {"name": ""}, {"type": "x"}], "facts": [{"subject": "s", "predicate": "p", "object": "o", "confidence": 7}, {"subject": "s", "predicate": "p", "object": "o"}, {"subject": "s", "object": "o"}]})
    r = extraction.extract(spark.createDataFrame([(1, raw), (2, "broken {")], "chunk_id long, reply string")).orderBy("chunk_id").collect()
    assert r[0]["ok"] and [e["name"] for e in r[0]["entities"]] == ["a"] and [f["confidence"] for f in r[0]["facts"]] == [1.0, 0.5]
    assert not r[1]["ok"] and r[1]["error"] and r[1]["facts"] is None


def test_stable_ids_match_the_uuid_module(spark):
    rows = QUERIES["legacy_id_map"](spark, SF).collect()
    assert rows and all(r["id"] == str(uuid.uuid5(uuid.UUID(services.LEGACY), f"rag:documents:{r['legacy_id']}")) for r in rows)


def test_running_frequencies_of_a_hot_predicate_and_null_times(spark):
    rows = [(k, "hot" if k % 3 else None, AT + dt.timedelta(minutes=k * 37 % 600) if k % 5 else None) for k in range(200)]
    got = {r["fact_id"]: r["frequency"] for r in facts.schema_gate(spark.createDataFrame(rows, "fact_id long, predicate string, observed_at timestamp")).collect()}
    for p in ("hot", None):
        order = sorted((r for r in rows if r[1] == p), key=lambda r: (r[2] or dt.datetime.min, r[0]))
        assert [got[r[0]] for r in order] == list(range(1, len(order) + 1))


def test_folder_watch_and_sync(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, text in (("a.txt", "one"), ("b.txt", "two"), ("c.txt", "one"), ("d.bin", "three")):
        (folder / name).write_text(text)
    for _ in range(2):  # the second run finds nothing new
        stream = live.watch_folder(spark, str(folder), "*.txt").select("content_hash", "length")
        live.sync(stream, str(tmp_path / "out"), ["content_hash"], str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_late_events_are_left_out_of_windows(spark, tmp_path):
    rows = [(1, "2024-01-10 00:10:00", "a"), (2, "2024-01-10 00:20:00", "a"), (3, "2024-01-10 01:00:00", "b")]
    spark.createDataFrame(rows, "event_id long, ts string, event_type string").select("event_id", F.to_timestamp("ts").alias("ts"), "event_type").write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("event_id long, ts timestamp, event_type string").parquet(str(tmp_path / "ev"))
    query = live.event_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r["event_type"], r["n"]) for r in spark.table("counts").collect()} == {("a", 2), ("b", 1)}
