import datetime as dt
import json

import pytest
from mnemo.operators import extraction
from mnemo.operators.pipeline import ExtractionStore
from mnemo.plans import services
from mnemo.sources.shared import new_path

AT = dt.datetime(2024, 1, 1)


def reply(n, value):
    return json.dumps({"entities": [{"name": f"n{n % 3}", "type": ""}, {"name": "", "type": "x"}], "facts": [{"subject": "s", "predicate": "p", "object": value, "confidence": "2"}, {"subject": "", "predicate": "p", "object": "o"}]})


def test_extraction_goes_on_after_a_loss(spark, monkeypatch):
    rows = [(k, f"text {k}", AT + dt.timedelta(hours=k), reply(k, "is 1" if k % 2 else "not is 1")) for k in range(6)] + [(90, "bad", AT, "no object {"), (91, None, AT, None)]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string, observed_at timestamp, reply string")
    done = ExtractionStore(spark, new_path(spark, "x"), 2)
    told = {r["chunk_id"]: r["ok"] for r in done.run(chunks.where("chunk_id < 2"), "a", "2024-02-01 00:00:00").collect()}
    assert told == {0: True, 1: True} and done.links_.read().count() == 0  # the predicate is not stable yet
    with monkeypatch.context() as m:
        m.setattr(done.passages_, "merge", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            done.run(chunks, "b", "2024-02-01 00:00:00")
    assert done.pending(chunks).count() == 6
    done.run(chunks, "b", "2024-02-01 00:00:00")
    assert done.facts_.read().count() == 6 and done.passages_.read().count() == 6 and {r["chunk_id"] for r in done.pending(chunks).collect()} == {90, 91}
    linked = {r["passage"] for r in done.links_.read().collect()}
    assert linked == {2, 3, 4, 5}
    assert {(r["name"], r["entity_type"]): r["metadata"] for r in done.entities_.read().collect()} == {(f"n{k}", "other"): {"origin": "extraction"} for k in range(3)}
    before = done.hierarchy.edges().count()
    done.run(chunks, "c", "2024-02-01 00:00:00")
    assert done.hierarchy.edges().count() == before and done.facts_.read().count() == 6
    found = done.conflicts().collect()
    assert found and {r["conflict_type"] for r in found} == {"mutually_exclusive"} and {r["fact_id"] for r in found} <= {r["fact_id"] for r in done.links_.read().collect()}


def test_links_do_not_parse_replies_again(spark):
    done = extraction.extract(services.replies(spark, "/root/testdata/sf0.001"))
    _, made, links = extraction.store(done, "2024-02-01 00:00:00")
    for df in (made, links):
        assert "from_json" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < links.count() < made.count()
