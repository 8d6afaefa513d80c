import glob

import pytest
from mnemo.operators import store
from mnemo.operators.store import MERGE, StoredTable
from mnemo.sources.shared import new_path


def files(path):
    return {f.rsplit("/", 2)[-2] + "/" + f.rsplit("/", 1)[-1] for f in glob.glob(path.removeprefix("file://") + "/rows/bucket=*/*.parquet")}


def test_only_touched_buckets_are_written_and_batches_count_once(spark):
    path = new_path(spark, "t")
    t = StoredTable(spark, path, ["k"], "k long, v string, w double", buckets=8)
    t.merge(spark.range(200).selectExpr("id k", "'a' v", "1.5D w"), "one")
    before = files(path)
    assert t.merge(spark.createDataFrame([(7, "b")], "k long, v string"), "two") and not t.merge(spark.createDataFrame([(7, "c")], "k long, v string"), "two")
    after = files(path)
    changed = {f.split("/")[0] for f in before ^ after}
    assert len(changed) == 1
    rows = {r["k"]: (r["v"], r["w"]) for r in t.read().collect()}
    assert len(rows) == 200 and rows[7] == ("b", 1.5) and rows[8] == ("a", 1.5)
    assert StoredTable(spark, path, ["k"], "k long, v string, w double", buckets=3).buckets == 8


def test_partial_updates_maps_ties_and_null_keys(spark):
    t = StoredTable(spark, new_path(spark, "t"), ["a", "b"], "a string, b int, m map<string,string>, x double, y string", {"m": MERGE, "y": store.KEEP_FIRST}, 4)
    rows = "a string, b int, m map<string,string>, x double, y string, o long, extra int"
    t.merge(spark.createDataFrame([("p", 1, {"s": "1", "t": "1"}, 2.0, "first", 1, 0), ("p", 1, {"t": "2"}, None, "second", 2, 0), (None, None, {"n": "0"}, 1.0, None, 1, 0)], rows), "1", "o")
    t.merge(spark.createDataFrame([("p", 1, {"u": None}, None, "third", 1, 0), (None, None, None, 3.0, "late", 1, 0)], rows), "2", "o")
    got = {(r["a"], r["b"]): (r["m"], r["x"], r["y"]) for r in t.read().collect()}
    assert got == {("p", 1): ({"s": "1", "t": "2", "u": None}, 2.0, "first"), (None, None): ({"n": "0"}, 3.0, None)}
    sets = spark.createDataFrame([("p", 1, None, ["x"])], "a string, b int, x double, sets array<string>")
    t.merge(sets, "3")
    assert t.read().where("a = 'p'").first()["x"] is None
    assert t.merge(spark.createDataFrame([], rows), "4", "o") and t.read().count() == 2


def docs_of(spark):
    long = "word " * 1000
    return spark.createDataFrame([("b", "2", long), ("a", "1", long), ("c", "3", "short"), (None, "4", None), ("e", "5", "  "), ("f", "6", "")], "title string, source_uri string, text string")


def test_documents_and_chunks_land_together(spark, monkeypatch):
    stored = store.DocumentStore(spark, new_path(spark, "d"), 4)
    fail = lambda *_: (_ for _ in ()).throw(RuntimeError("lost"))
    with monkeypatch.context() as m:
        m.setattr(stored.documents_, "merge", fail)
        with pytest.raises(RuntimeError):
            stored.ingest(docs_of(spark), "one")
    assert stored.documents().count() == 0 and stored.chunks().count() == 0 and stored.chunks_.read().count() > 0
    told = {r["status"]: r["n"] for r in stored.ingest(docs_of(spark), "one").groupBy("status").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert told == {"ingested": 3, "skipped_empty": 3}
    found = {r["title"]: r["n_chunks"] for r in stored.documents().collect()}
    assert found == {"a": 5, "c": 1} and stored.chunks().count() == 6
    again = {r["status"]: r["n"] for r in stored.ingest(docs_of(spark), "two").groupBy("status").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert again == {"skipped": 3, "skipped_empty": 3} and stored.chunks().count() == 6
    vectors = stored.chunks().selectExpr("document_id", "ordinal", "array(1f, 2f) embedding")
    assert stored.embed(vectors, "v") and stored.chunks().where("embedding is not null and content is not null").count() == 6
    stored.ingest(docs_of(spark), "three")
    assert stored.chunks().where("embedding is not null").count() == 6


def test_a_merge_sends_rows_once(spark, monkeypatch):
    plans, folded = [], StoredTable._folded
    monkeypatch.setattr(StoredTable, "_folded", lambda t, e: plans.append(folded(t, e)) or plans[-1])
    t = StoredTable(spark, new_path(spark, "t"), ["k"], "k long, v string", {"v": store.KEEP_FIRST}, 8, slices=3)
    t.merge(spark.range(500).selectExpr("id % 100 k", "string(id) v"), "one")
    assert t.read().count() == t.read().select("k").distinct().count() == 100
    assert plans[0]._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_texts_are_neither_grouped_nor_sent_to_a_batch_that_is_stored(spark, monkeypatch):
    stored, merged = store.DocumentStore(spark, new_path(spark, "d"), 4), []
    merge = StoredTable.merge
    monkeypatch.setattr(StoredTable, "merge", lambda t, rows, batch, order=None: merged.append((t.key, rows)) or merge(t, rows, batch, order))
    twice = docs_of(spark).unionByName(docs_of(spark))  # rows alike in all
    stored.ingest(twice, "one")
    assert {r["title"]: r["n_chunks"] for r in stored.documents().collect()} == {"a": 5, "c": 1} and stored.chunks("document_id").count() == 6
    (_, chunks), (_, documents) = merged
    assert "text" not in documents._jdf.queryExecution().optimizedPlan().toString() and "min_by" not in chunks._jdf.queryExecution().optimizedPlan().toString()
    stored.ingest(twice, "one")
    assert len(merged) == 2


def test_job_states_over_batches(spark):
    jobs = store.job_table(spark, new_path(spark, "j"), 4)

    def batch(name, *events):
        rows = spark.createDataFrame([(j, t, k, kind, items, None, message) for k, (j, t, kind, items, message) in enumerate(events)], "job string, at string, seq long, kind string, items long, failed long, message string")
        jobs.merge(store.job_changes(rows.selectExpr("job", "timestamp(at) at", "seq", "kind", "items", "failed", "message"), jobs), name, "place")

    batch("1", ("x", "2024-01-01 00:00:00", "registered", None, None), ("x", "2024-01-01 00:00:05", "started", None, None), ("y", "2024-01-01 00:00:05", "registered", None, None), (None, "2024-01-01 00:00:05", "started", None, None), ("z", "2024-01-01 00:00:05", "other", None, None))
    batch("2", ("x", "2024-01-01 00:00:06", "registered", None, None), ("x", "2024-01-01 00:00:07.500", "error", None, "e" * 900))
    row = {r["job"]: r for r in jobs.read().collect()}
    assert set(row) == {"x", "y"} and row["y"]["status"] == "idle"
    assert (row["x"]["status"], row["x"]["last_duration_s"], len(row["x"]["last_error"]), row["x"]["items_processed"]) == ("error", 2.5, 500, None)
    batch("3", ("x", "2024-01-01 00:01:00", "started", None, None), ("x", "2024-01-01 00:01:01", "completed", 4, None))
    row = {r["job"]: r for r in jobs.read().collect()}["x"]
    assert (row["status"], row["last_duration_s"], row["last_error"], row["items_processed"], row["items_failed"]) == ("success", 1.0, None, 4, 0)


def test_counters_change_only_where_named(spark):
    t = store.counter_table(spark, new_path(spark, "c"), 2)
    t.merge(spark.createDataFrame([("global", 5, 4)], "domain string, files_detected long, files_ingested long"), "1")
    t.merge(spark.createDataFrame([("global", 9), ("web", 1)], "domain string, chunks_created long"), "2")
    got = {r["domain"]: (r["files_detected"], r["files_ingested"], r["chunks_created"], r["db_records"]) for r in t.read().collect()}
    assert got == {"global": (5, 4, 9, None), "web": (None, None, 1, None)}
