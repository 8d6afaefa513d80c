import random

import numpy as np
import pyarrow as pa

from mnemo.operators import trigrams
from mnemo.operators.trigrams import TrigramIndex, contained, literals
from mnemo.sources.derived import facts
from mnemo.sources.shared import new_path
from pyspark.sql import functions as F


def test_literal_parts_of_patterns():
    assert literals("%the_t%ing%") == ["the", "t", "ing"] and literals("%_%") == [] and literals(r"a\%b%c\\") == ["a%b", "c\\"] and literals("") == []


def texts_of(spark):
    rng = random.Random(1)
    words = ["The Cat", "thé", "100%", "a_b", "x", "", "ΣΑΣ", "😀😀😀", "İstanbul", "  ", "back\\slash", "cat"]
    rows = [(k, k % 3, " ".join(rng.choice(words) for _ in range(rng.randrange(6))), rng.choice(words)) for k in range(300)] + [(900, None, None, None), (901, 1, None, "the cat"), (902, 1, "long " * 50_000 + "needle", None)]
    return spark.createDataFrame(rows, "a long, b long, t string, u string").where("b is not null")


def test_search_gives_the_rows_of_a_scan(spark):
    rows = texts_of(spark).cache()
    index = TrigramIndex(spark, new_path(spark, "i"), ["a", "b"], ["t", "u"], 4).build(rows)
    for pattern in ("%the cat%", "%THE C_t%", "%thé%", "%100\\%%", "%a\\_b%", "%a_b%", "%σας%", "%😀😀😀%", "%i̇st%", "x", "%", "", "%ab%", "%needle", "%zzz%", "%back\\\\sl%", "the cat%thé%"):
        want = sorted(r["a"] for r in rows.where(F.coalesce(F.col("t").ilike(pattern), F.lit(False)) | F.coalesce(F.col("u").ilike(pattern), F.lit(False))).collect())
        assert sorted(r["a"] for r in index.search(rows, pattern).collect()) == want, pattern
    few = index.candidates("%needle%")
    assert [r["a"] for r in few.collect()] == [902] and index.candidates("%ab%") is None
    rows.unpersist()


def test_names_in_texts_without_a_nested_loop(spark):
    rng = random.Random(2)
    names = ["Ann Lee", "ann", "lee ", "an", "the", "İzmir", None, "", "Theodora", "no such name", "x-y"]
    texts = [(k, " ".join(rng.choice(["ann", "LEE", "the", "theodora", "İZMİR", "x-y", "q"]) for _ in range(rng.randrange(8)))) for k in range(200)] + [(500, None), (501, "")]
    df, n = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(x,) for x in names], "name string")
    found = contained(n, df)
    low = df.select("id", F.lower("text").alias("t")).collect()
    clean = {r["n"] for r in n.select(F.trim(F.lower("name")).alias("n")).collect() if r["n"] and len(r["n"]) >= 3}
    assert sorted(map(tuple, found.collect())) == sorted((x, r["id"]) for x in clean for r in low if r["t"] and x in r["t"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_trigrams_of_short_texts(spark):
    rows = spark.createDataFrame([("",), (None,), ("ab",), ("aBc",), ("aaaa",)], "t string").select(trigrams.trigrams(F.col("t")).alias("g")).collect()
    assert [r["g"] for r in rows] == [[], [], [], ["abc"], ["aaa"]]


def test_index_holds_a_list_a_block_and_trigram(spark):
    rows = spark.range(5000).select("id", F.lit("the same words everywhere").alias("t"), F.concat(F.lit("n"), F.pmod("id", F.lit(7)), F.lit("xy")).alias("u")).coalesce(2)
    index = TrigramIndex(spark, new_path(spark, "i"), ["id"], ["t", "u"]).build(rows)
    assert spark.read.parquet(index.path).count() <= 2 * (1 + 23 + 15)  # in each of two tasks one block of keys and postings
    assert index.search(rows, "%n3X%", "%n5x%").count() == sum(k % 7 in (3, 5) for k in range(5000)) and index.search(rows, "%everywhere", "ab").count() == 5000
    again = TrigramIndex(spark, index.path, ["id"], ["t", "u"])  # an index that was built before
    assert again.search(rows, "%n3X%").count() == sum(k % 7 == 3 for k in range(5000))


def test_blocks_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(trigrams, "BYTES", 300)
    rows = texts_of(spark)
    index = TrigramIndex(spark, new_path(spark, "i"), ["a", "b"], ["t", "u"]).build(rows)
    assert index.search(rows, "%the cat%").count() == rows.where("t ilike '%the cat%' or u ilike '%the cat%'").count() > 0
    none = rows.where("a < 0")
    assert TrigramIndex(spark, new_path(spark, "i"), ["a", "b"], ["t", "u"]).build(none).search(none, "%the cat%").count() == 0


def test_index_of_facts_stores_few_rows(spark):
    f = facts(spark, "/root/testdata/sf0.001", False)
    columns = ["subject", "predicate", "object_value", "provenance_text"]
    index = TrigramIndex(spark, new_path(spark, "i"), ["fact_id"], columns).build(f)
    pairs = f.select(F.explode(F.flatten(F.array(*(trigrams.trigrams(F.col(c)) for c in columns))))).count()
    assert spark.read.parquet(index.path).count() < 0.1 * pairs


def test_runs_are_sorted_and_hold_no_more_than_their_size():
    batches = [trigrams.stored(b, "t", np.arange(30)[::-1], pa.array([b"xy"] * 30, pa.binary()), pa.nulls(30, pa.list_(pa.int64()))) for b in range(20)]
    runs = list(trigrams.in_runs(iter(batches), 3 * batches[0].nbytes))
    assert [r.num_rows for r in runs] == [90] * 6 + [60] and all(r.column("gram").to_pylist() == sorted(r.column("gram").to_pylist()) for r in runs)
    rows = lambda tables: sorted((r["block"], r["gram"]) for t in tables for r in t.to_pylist())
    assert rows(runs) == rows(batches) and list(trigrams.in_runs(iter([]), 1)) == []


def test_a_task_that_builds_an_index_sorts_no_rows_of_its_own(spark):
    rows = spark.range(40_000).select("id", F.concat(F.lit("event "), "id").alias("t")).coalesce(1)
    context = spark.sparkContext
    context.setJobGroup("index", "index")
    index = TrigramIndex(spark, new_path(spark, "i"), ["id"], ["t"]).build(rows)
    context.setLocalProperty("spark.jobGroup.id", None)
    context._jsc.sc().listenerBus().waitUntilEmpty()
    stages = [s for j in context.statusTracker().getJobIdsForGroup("index") for s in context.statusTracker().getJobInfo(j).stageIds]
    held = [context._jsc.sc().statusStore().lastStageAttempt(s).peakExecutionMemory() for s in stages]
    assert held and max(held) == 0  # memory of Spark's sorts grows with the rows of a task
    assert [r["id"] for r in index.search(rows, "%event 3999%").orderBy("id").collect()] == [399 * 10 + 9, *range(39_990, 40_000)]
