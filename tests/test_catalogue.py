import hashlib
import math
import os

import duckdb
import pytest
from mnemo.plans import flows, services, stores  # noqa: F401
from mnemo.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def rows(frame):
    def value(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    columns = sorted(frame.columns)
    return sorted((tuple(value(getattr(v, "item", lambda v=v: v)()) for v in r) for r in frame[columns].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, oracle, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(oracle.execute(ORACLE_SQL[name]).df())


def test_sanitize_text_covers_all_documents(spark, tmp_path):
    texts = ["a word bro-\nken  here ", "- \n x", "plain", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["clean_hash"] for r in QUERIES["sanitize_text"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate([hashlib.sha256(t.encode()).hexdigest() for t in ("a word broken here", "- \n x", "plain")] + [None]))
