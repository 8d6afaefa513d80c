import random
import re

from mnemo.llm import url_filter
from mnemo.llm.url_filter import build_cascade, in_cascade, judge_urls
from pyspark.sql import functions as F

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def brute(url, rules):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for action, rule in rules:
        h, p = url_filter.split_rule(rule)
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (action, h + p)
    return host, path, best and best[1], best[0] if best else "allow"


URLS = [None, "", "no scheme", "http://", "http://NET/", "http://net", "https://a.b.Example.NET/en/x?y=1", "http://example.net/en", "http://example.net/en#x",
        "http://anet/x", "http://www.example.com/de/1", "http://example.com/dex/", "ftp://x.org/fr/", "http://x.org/FR/", "://net/", "http://a://net/", "http://É.net/x",
        "http://" + "a." * 3000 + "net/" + "x" * 9000, "http://.net/", "http://net./", "http://x.example.net/en/\nline"]


def test_judges_like_brute_force(spark, monkeypatch):
    pages = spark.createDataFrame([(k, u, "t") for k, u in enumerate(URLS + URLS[:7])], "page_id long, url string, rules string")
    for shard in (url_filter.SHARD, 2, 1):  # one cascade an action, then two and four
        monkeypatch.setattr(url_filter, "SHARD", shard)
        rows = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(pages, RULES).collect()}
        assert rows == {k: brute(u, RULES) for k, u in enumerate(URLS + URLS[:7])}
    assert judge_urls(pages.limit(0), RULES).count() == 0
    assert judge_urls(pages, []).where("verdict = 'allow' and rule is null").count() == len(URLS) + 7


def test_names_of_the_result_replace_columns(spark):
    pages = spark.createDataFrame([(1, "http://net/x", "mine", 5)], "page_id long, url string, host string, verdict int")
    row = judge_urls(pages, RULES).first()
    assert (row["host"], row["rule"], row["verdict"]) == ("net", "net/", "block") and len(row) == 6


def test_cascade_is_exact_over_its_universe(spark):
    random.seed(5)
    keys = [f"h{k}.example/{random.random()}" for k in range(6000)]
    listed = set(random.sample(keys, 700))
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    levels = build_cascade(spark.createDataFrame([(k,) for k in listed], "key string"), universe)
    assert len(levels) > 2
    got = {r["key"] for r in universe.where(in_cascade(levels, F.col("key"))).collect()}
    assert got == listed
    assert build_cascade(spark.createDataFrame([], "key string"), universe) == []
