import json

import pytest
from mnemo.functions import metadata as M
from mnemo.operators.store import StoredTable
from mnemo.sources.keyset import KeysetLoad, key_ranges
from mnemo.sources.shared import new_path
from pyspark.sql import functions as F

SPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def load_of(spark, source, path):
    target = StoredTable(spark, f"{path}/rows", ["id"], "id string, k long, v string", buckets=2)
    return target, KeysetLoad(source, "k", target, path, SPACE, "t:", 5)


def test_an_interrupted_load_goes_on(spark, monkeypatch):
    source = spark.createDataFrame([(k * 7, f"v{k}", "more") for k in range(50)] + [(None, "lost", "x"), (21, "twice", "x")], "k long, v string, extra string")
    one, whole = load_of(spark, source, new_path(spark, "one"))
    assert whole.run() == len(whole.ranges()) and whole.last_key() == 343
    two, parts = load_of(spark, source, new_path(spark, "two"))
    assert parts.run(most=2) == 2 and parts.last_key() < 343
    merge, calls = two.merge, []
    with monkeypatch.context() as m:
        m.setattr(two, "merge", lambda *a: merge(*a) if calls.append(1) or len(calls) < 2 else (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            parts.run()
    _, again = load_of(spark, source, parts.path)
    assert again.run() > 0 and again.run() == 0
    rows = lambda t: sorted(map(tuple, t.read().collect()))
    assert rows(one) == rows(two) and len(rows(one)) == 50
    logs = [sorted(map(tuple, x.audit().collect()), key=str) for x in (whole, again)]
    assert logs[0] == logs[1] and sum(r[3] for r in logs[0]) == 52 and sum(r[4] for r in logs[0]) == 50


def test_ranges_of_empty_and_equal_keys(spark):
    assert key_ranges(spark.createDataFrame([], "k long"), "k", 4) == []
    assert key_ranges(spark.createDataFrame([(5,)] * 9, "k long"), "k", 4) == [(None, 5)]


def test_nested_metadata(spark):
    rows = [('{"a":{"b":1,"c":null},"k":null,"z":"q"}', '{"z":2,"n":[1,2]}'), ("[1]", None), (None, '{"x":1}'), ("bad{", '{"y":{}}'), ("{}", "3"), ('{"a":5}', '{"a":{"b":2}}')]
    m, n = M.parse(F.col("m")), M.parse(F.col("n"))
    df = spark.createDataFrame(rows, "m string, n string").select(
        M.has_key(m, "k").alias("k"), M.has_key(m, "a").alias("a"), M.read(m, "a.b", "int").alias("b"), M.text(M.merged(m, n)).alias("merged"), M.text(M.with_value(m, ["a", "d"], F.lit(5))).alias("nested"), M.text(M.with_value(m, ["w"], F.array(F.lit("x")))).alias("top"), M.search(F.lit(None).cast("string"), m, '%"B":1%').alias("found"))
    got = [(r["k"], r["a"], r["b"], *(None if r[c] is None else json.loads(r[c]) for c in ("merged", "nested", "top")), r["found"]) for r in df.collect()]
    first = json.loads(rows[0][0])
    assert got == [(True, True, 1, first | {"z": 2, "n": [1, 2]}, first | {"a": {"b": 1, "c": None, "d": 5}}, first | {"w": ["x"]}, True), (False, False, None, {}, [1], [1], False), (None, None, None, {"x": 1}, None, None, False),
                   (None, None, None, {"y": {}}, None, None, False), (False, False, None, {}, {}, {"w": ["x"]}, False), (False, True, None, {"a": {"b": 2}}, {"a": 5}, {"a": 5, "w": ["x"]}, False)]
