import math

import numpy as np
from mnemo.operators import neighbours, retrieval


def frames(spark, rows, queries):
    c = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int").repartition(3)
    return c, spark.createDataFrame(queries, "query_id long, embedding array<float>")


def brute(rows, queries, k):
    unit = lambda v: np.float64(np.float32(v)) / np.linalg.norm(np.float64(np.float32(v)))
    ok = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    out = []
    for q, v in queries:
        if ok(v):
            scored = sorted((-float(unit(x) @ unit(v)), i) for i, x in rows if i != q and ok(x) and len(x) == len(v))[:k]
            out += [(q, i, r + 1, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def check(spark, rows, queries, k=5):
    found, told = neighbours.nearest(*frames(spark, rows, queries), k)
    got, want = sorted((r["query_id"], r["vec_id"], r["rank"], r["similarity"]) for r in found.collect()), brute(rows, queries, k)
    assert [x[:3] for x in got] == [x[:3] for x in want] and all(abs(a[3] - b[3]) < 1e-4 for a, b in zip(got, want, strict=True))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    return told.first()


def test_clustered_vectors_compare_less_than_a_tenth(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 16))
    rows = [(k, (centres[k % 40] + 0.05 * rng.standard_normal(16)).tolist()) for k in range(8000)]
    told = check(spark, rows, [(k, rows[k][1]) for k in range(0, 8000, 400)])
    assert told["pairs"] == 20 * 8000 and told["compared"] < 0.1 * told["pairs"]


def test_untidy_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.standard_normal(4).tolist()) for k in range(700)]
    rows += [(800, None), (801, [0.0] * 4), (802, [math.nan] * 4), (803, []), (804, [1.0, 2.0]), (805, [2.0, 4.0]), (806, [1.0, None, 1.0, 1.0]), (807, [math.inf, 0.0, 0.0, 0.0]), (808, [1e30, 0.0, 0.0, 0.0])]
    check(spark, rows, [*rows[:10], *rows[700:], (5000, [1.0] * 3), (5001, rows[3][1])])


def test_few_and_no_vectors(spark):
    check(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])], [(1, [1.0, 0.0]), (9, [0.5, 0.5])], 5)
    check(spark, [], [(1, [1.0])], 3)
    check(spark, [(1, [1.0])], [], 3)


def test_blocks_and_copies(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    monkeypatch.setattr(neighbours, "ASKED", 7)
    rng = np.random.default_rng(3)
    rows = [(k, [1.0, 2.0, 3.0] if k % 3 == 0 else rng.standard_normal(3).tolist()) for k in range(1500)]
    queries = [(k, rows[k][1]) for k in range(0, 1500, 50)]
    check(spark, rows, queries)
    few = neighbours.nearest_of_few(*frames(spark, rows, queries), 5)
    assert [tuple(r)[:3] for r in few.orderBy("query_id", "rank").collect()] == [x[:3] for x in sorted(brute(rows, queries, 5), key=lambda x: (x[0], x[2]))]


def test_pairs_stay_inside_their_task(spark):
    """What leaves a task are the best of each query, not the pairs."""
    vectors = np.random.default_rng(4).standard_normal((900, 8))
    out = neighbours.best(np.arange(900), vectors, np.arange(0, 900, 9), vectors[::9], 4)
    assert out.num_rows == 400
    same = neighbours.best(np.arange(900), np.ones((900, 8)), np.arange(0, 900, 9), np.ones((100, 8)), 4)
    assert same.num_rows == 400 and same["vec_id"].to_pylist()[:8] == [1, 2, 3, 4, 0, 1, 2, 3]


def test_few_vectors_are_followed_by_those_without_similarity(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (4, None), (5, [1.0, 1.0])]
    got = [tuple(r) for r in retrieval.top_k_of_each(*frames(spark, rows, [rows[0], rows[1]]), 3).orderBy("query_id", "rank").collect()]
    assert got == [(1, 5, 1, 0.7071), (1, 3, 2, 0.0), (1, 2, 3, None), (2, 1, 1, None), (2, 3, 2, None), (2, 4, 3, None)]
