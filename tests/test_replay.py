import datetime as dt
import math
import random

import numpy as np
from mnemo.operators import replay
from mnemo.operators.replay import ARRIVALS, Cells, Group, Lowest
from mnemo.plans import flows  # noqa: F401  (adds its queries)
from mnemo.plans.catalogue import QUERIES

AT = dt.datetime(2024, 1, 1)
FACT = "fact_id long, subject string, predicate string, object_value string, observed_at timestamp, valid_from timestamp, valid_to timestamp, status string, superseded_by long, embedding array<float>"


def sequential(rows, threshold, most=10):
    """The fold, fact by fact, with every candidate compared."""
    state, log = {}, []
    low = lambda x: None if x is None else x.lower()
    for k, s, p, o, at, start, end, status, by, v in rows:
        new = state[k] = {"id": k, "key": (low(s), low(p)), "o": low(o), "t": start or at, "end": end, "status": status, "by": by, "v": v}
        others = [x for i, x in state.items() if i < k and x["by"] is None and x["key"] == new["key"] and None not in new["key"] and new["o"] is not None and x["o"] is not None and x["o"] != new["o"]]
        if threshold is not None and v is not None:
            def sim(x):
                a, b = np.float64(v), np.float64(x["v"])
                return float((a / np.linalg.norm(a)) @ (b / np.linalg.norm(b)))
            usable = lambda v: v is not None and any(v) and all(x is not None and math.isfinite(x) for x in v)
            scored = sorted((-sim(x), x["id"]) for x in others if usable(v) and usable(x["v"]) and len(x["v"]) == len(v))[:most]
            chosen = [(state[i], replay.round_half_up(-s)) for s, i in scored if replay.round_half_up(-s) >= threshold]
        else:
            chosen = [(x, None) for x in sorted(others, key=lambda x: x["id"])[:most]]
        for old, similarity in chosen:
            newer, older = (new, old) if new["t"] is not None and old["t"] is not None and new["t"] >= old["t"] else (old, new)
            older.update(by=newer["id"], status="inactive", end=older["end"] or newer["t"])
            log.append((k, old["id"], similarity, older["id"], newer["id"]))
    return {k: (x["by"], x["end"], x["status"]) for k, x in state.items()}, sorted(log)


def clustered(n, seed, objects=4, groups=2, missing=0.1):
    rng, r = np.random.default_rng(seed), random.Random(seed)
    centres = rng.standard_normal((8, 6))
    rows = []
    for k in range(n):
        v = (centres[r.randrange(8)] + 0.3 * rng.standard_normal(6)).astype(np.float32).tolist()
        v = None if r.random() < missing else [0.0] * 6 if r.random() < 0.02 else [1.0, math.nan] if r.random() < 0.02 else v
        rows.append((k, r.choice(["S", "s", "T"][:groups + 1]), "p", r.choice([f"O{r.randrange(objects)}", f"o{r.randrange(objects)}", None]), None if r.random() < 0.02 else AT + dt.timedelta(hours=r.randrange(2 * n)), AT if r.random() < 0.05 else None,
                     AT + dt.timedelta(days=99) if r.random() < 0.2 else None, r.choice(["active", "pending"]), 10**6 if r.random() < 0.05 else None, v))
    return rows + [(n, None, "p", "x", AT, None, None, "active", None, [1.0] * 6), (n + 1, "S", "p", "x", AT, None, None, "active", None, [1.0])]


def check(spark, rows, threshold):
    states = replay.replayed(spark.createDataFrame(rows, FACT).repartition(3), threshold).cache()
    want, log = sequential(rows, threshold)
    assert {r["fact_id"]: (r["superseded_by"], r["valid_to"], r["status"]) for r in states.collect()} == want
    got = sorted(tuple(r[c] for c in ("fact_id", "conflicting_fact_id", "similarity", "superseded", "kept")) for r in replay.conflict_log(states).collect())
    assert got == log
    states.unpersist()


def test_equals_a_sequential_fold_with_vectors(spark):
    check(spark, clustered(500, 1), 0.8)
    check(spark, clustered(400, 2, objects=60, missing=0.4), 0.3)


def test_equals_a_sequential_fold_without_vectors(spark):
    check(spark, clustered(400, 3, objects=12), None)
    check(spark, [], 0.8)


def arrivals(vectors, objects, times):
    return [{"s": "s", "p": "p", "id": k, "o": o, "t": t, "valid_to": None, "status": "active", "by": None, "v": v.tolist(), "conflicts": []} for k, (v, o, t) in enumerate(zip(vectors, objects, times, strict=True))]


def test_cells_leave_most_vectors_out():
    rng = np.random.default_rng(5)
    n, centres = 6000, rng.standard_normal((60, 32))
    vectors = centres[rng.integers(0, 60, n)] + 0.15 * rng.standard_normal((n, 32))
    facts = arrivals(vectors, [f"o{k}" for k in rng.integers(0, 2, n)], [0] * n)
    for f, end in zip(facts, rng.random(n), strict=True):
        f["t"] = None if end < 0.5 else 0
    group = Group(10, 0.8, True)
    for k in range(0, n, ARRIVALS):
        group.arrive(facts[k:k + ARRIVALS])
    cells: Cells = group.cells[32]
    assert cells.held and cells.compared < 0.1 * cells.held


def test_hot_group_with_one_object_most_of_the_time():
    n = 60_000
    vectors = np.tile(np.array([1.0, 0.5]), (n, 1))
    group, ended = Group(10, None, True), 0
    facts = arrivals(vectors, ["b" if k % 5000 == 4999 else "a" for k in range(n)], range(n))
    for k in range(0, n, ARRIVALS):
        ended += len(group.arrive(facts[k:k + ARRIVALS]))
    assert ended + len(group.live) == n


def test_lowest_of_other_objects():
    rng, low, alive = random.Random(6), Lowest(), {}
    for k in range(3000):
        o = f"o{rng.randrange(30) if rng.random() < 0.5 else 0}"
        assert low.others(o, 5) == sorted(i for i, x in alive.items() if x != o)[:5]
        low.add(k, o)
        alive[k] = o
        for i in rng.sample(sorted(alive), min(len(alive), rng.randrange(3))):
            low.remove(i, alive.pop(i))


def test_summary_replays_once(spark):
    plan = QUERIES["replay_summary"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
