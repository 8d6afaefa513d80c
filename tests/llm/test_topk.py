import math
import random

import numpy as np
from mnemo.llm import topk
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<double>, score long, rank string"


def brute(rows, k):
    usable = [(n, i, [math.floor(256 * x) for x in v]) for n, (i, v) in enumerate(rows)
              if i is not None and v is not None and all(x is not None and math.isfinite(256 * x) for x in v)]
    out = []
    for n, i, q in usable:
        if i % 50 == 0:
            found = sorted((-max(topk.LEAST, min(topk.MOST, sum(a * b for a, b in zip(q, x)))), j) for m, j, x in usable if m != n and len(x) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


def answers(spark, rows, k=5):
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, topk.top_k(df, k, F.col("vec_id") % 50 == 0).collect()))


def test_clusters_copies_and_untidy_rows(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 8)) * 3
    rows = [(k, (centres[k % 6] + 0.1 * rng.standard_normal(8)).tolist()) for k in range(1200)]
    rows += [(5000 + k, rows[50][1]) for k in range(300)]  # copies, so ties
    rows += [(100, rows[100][1]), (100, rows[7][1]), (150, rows[150][1])]  # repeated ids and repeated rows
    rows += [(2000, [0.0] * 8), (2050, None), (2100, [1.0] * 7 + [None]), (2150, [math.nan] * 8), (2200, [math.inf] + [0.0] * 7), (None, [1.0] * 8)]
    rows += [(2250, [1.0, 2.0]), (2251, [3.0, -4.0]), (2300, []), (2301, []), (2350, [5.0])]  # other lengths
    random.Random(3).shuffle(rows)
    assert answers(spark, rows) == brute(rows, 5)


def test_large_components(spark):
    rows = [(50, [1e5 + 0.3, -2e9]), (1, [3e8, 7.7]), (2, [1e15, 1e15]), (3, [-1e15, 2e15]), (4, [1e300, 1.0]), (100, [1e306, 1.0]), (5, [2.5, 1e-9])]
    assert answers(spark, rows, 3) == brute(rows, 3)


def test_empty_and_alone(spark):
    assert answers(spark, []) == []
    assert answers(spark, [(50, [1.0, 2.0])]) == []


def test_bounds_hold_and_close_annuli(spark):
    rng = np.random.default_rng(8)
    rows = np.floor(256 * (rng.standard_normal((20, 4))[rng.integers(0, 20, 3000)] * 4 + 0.05 * rng.standard_normal((3000, 4))))
    df = spark.createDataFrame([(k, (v / 256).tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<double>")
    coded = topk.quantized(df, 256, F.col("vec_id") % 50 == 0)
    index = topk.fit_index(coded, len(rows) * 16)
    placed = topk.placed(coded, index).cache()
    directory = topk.directory_of(placed)
    assert sum(directory[4]["n"]) == len(rows) and len(directory[4]["n"]) <= topk.MAX_ANNULI
    everywhere = topk.requests(placed.where("asks").withColumn("score", F.lit(None).cast("double")), index, directory).toPandas()
    at = {r["uid"]: (r["vec_id"], r["annulus"]) for r in placed.collect()}
    ids = {u: i for u, (i, _) in at.items()}
    members = {}
    for _, (i, a) in at.items():
        members.setdefault(a, []).append(i)
    for r in everywhere.itertuples():
        assert (rows[members[r.annulus]] @ rows[ids[r.uid]]).max() <= r.bound
    fifth = {u: float(np.sort(rows @ rows[i])[-6]) for u, i in ids.items()}
    score = spark.createDataFrame(list(fifth.items()), "uid long, score double")
    still = topk.requests(placed.where("asks").join(score, "uid"), index, directory)
    sizes = dict(zip(directory[4]["annulus"].tolist(), directory[4]["n"].tolist(), strict=True))
    compared = sum(sizes[r["annulus"]] for r in still.collect())
    assert compared < 0.2 * 60 * len(rows)  # clustered vectors: most annuli are closed
    placed.unpersist()


def test_blocks_and_chunks_do_not_change_the_result(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(k * 10, v.tolist()) for k, v in enumerate(rng.standard_normal((400, 5)))], "vec_id long, embedding array<double>")
    coded = topk.quantized(df, 256, F.col("vec_id") % 50 == 0).cache()
    index = topk.fit_index(coded, 400)
    placed = topk.placed(coded, index).cache()
    directory = topk.directory_of(placed)
    asked = topk.requests(placed.where("asks").withColumn("score", F.lit(None).cast("double")), index, directory)
    one = topk.merged(topk.search(asked, placed, directory, 6), 6).orderBy("uid").collect()
    assert one == topk.merged(topk.search(asked, placed, directory, 6, block=7, chunk=5), 6).orderBy("uid").collect()
