"""URL rules by Bloom filter cascades, with DataFrame functions only.

A rule is a host and the start of a path.  Every url gives candidate keys (host suffix + path start, no
longer than rules are); the distinct candidates of the corpus are the complete key universe.  For each
action a cascade is built: level 0 is a Bloom filter of the listed keys, level 1 one of the universe's
false positives there, level 2 one of the listed keys that level 1 takes in wrongly, and so on until
none is left.  Over that universe a key is then decided exactly, by hashing alone: no join, and the
filters' size follows the number of listed keys and the logarithm of the universe.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

#: Listed keys of one cascade, about; keys are dealt by hash to as many cascades as that takes.
SHARD = 500_000


def parts_of(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty if the url is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^[^/?#]*([^?#]*)", 1)
    capitals, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, capitals, small), path


def candidate_keys(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """Keys a rule of at most ``labels`` host labels and one of the path ``lengths`` could have, longest first."""
    names = F.split(host, r"\.", -1)
    n = F.size(names)
    hosts = F.transform(F.sequence(F.lit(1), F.least(F.lit(labels), n)), lambda k: F.array_join(F.slice(names, n - k + 1, k), "."))

    def keys_of(x: int) -> Column:
        return F.transform(hosts, lambda h: F.when(F.length(path) >= x, F.struct(
            (-F.length(h) - x).alias("order"), (-F.length(h)).alias("by_host"), F.concat(h, F.substring(path, 1, x)).alias("key"))))

    keys = [keys_of(x) for x in lengths]
    return F.transform(F.array_sort(F.filter(F.concat(*keys), lambda k: k.isNotNull())), lambda k: k["key"])


@dataclass
class Level:
    bits: bytes
    size: int
    hashes: int
    seed: int

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.seed), F.lit(i)), F.lit(self.size).cast("long")) for i in range(self.hashes)]

    def contains(self, key: Column) -> Column:
        if not self.bits:
            return F.lit(False)
        out = F.lit(True)
        for at in self.positions(key):
            byte = F.conv(F.hex(F.substring(F.lit(self.bits), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            out = out & (F.getbit(byte.cast("long"), F.pmod(at, F.lit(8)).cast("int")) == 1)
        return out


def bloom_level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A Bloom filter of ``n`` keys; its bits are combined before the shuffle, a byte per row."""
    if not n:
        return Level(b"", 0, 0, seed)
    hashes = max(1, round(-math.log2(rate)))
    size = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    level = Level(b"", size, hashes, seed)
    at = keys.select(F.explode(F.array(*level.positions(F.col("key")))).alias("at"))
    rows = at.groupBy(F.shiftright("at", 3).alias("byte")).agg(F.expr("bit_or(shiftleft(1, cast(at % 8 as int)))").alias("bits")).collect()
    data = bytearray((size + 7) // 8)
    for r in rows:
        data[r["byte"]] = r["bits"]
    level.bits = bytes(data)
    return level


def build_cascade(listed: DataFrame, universe: DataFrame, max_levels: int = 64) -> list[Level]:
    """Levels over ``listed`` (key) and ``universe`` (distinct key); exact for every key of the universe."""
    inside = listed.select("key").distinct()
    others = universe.join(inside, "key", "left_anti")
    r, s = inside.count(), others.count()
    if not r:
        return []
    levels = [bloom_level(inside, r, min(0.5, max(1e-9, r / (math.sqrt(2) * max(s, 1)))), 0)]
    source, against = inside, others
    while len(levels) < max_levels:
        wrong = materialize(against.where(levels[-1].contains(F.col("key"))), "cascade")
        n = wrong.count()
        if not n:
            return levels
        levels.append(bloom_level(wrong, n, 0.5, len(levels)))
        source, against = wrong, source
    raise RuntimeError("the cascade did not end")


def in_cascade(levels: list[Level], key: Column) -> Column:
    """Exact membership of a key of the universe."""
    out = F.lit(len(levels) % 2 == 1)
    for k in range(len(levels) - 1, -1, -1):
        out = F.when(~levels[k].contains(key), F.lit(k % 2 == 1)).otherwise(out)
    return out


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("shard")), F.lit(shards).cast("long"))


def build_shards(listed: DataFrame, universe: DataFrame, shards: int) -> list[list[Level]]:
    """One cascade for the keys of each shard."""
    return [build_cascade(*(d.where(shard_of(F.col("key"), shards) == k) for d in (listed, universe))) for k in range(shards)]


def in_shards(cascades: list[list[Level]], key: Column) -> Column:
    """Exact membership of a key of the universe, by the cascade of its shard."""
    out = in_cascade(cascades[0], key)
    for k in range(1, len(cascades)):
        out = F.when(shard_of(key, len(cascades)) == k, in_cascade(cascades[k], key)).otherwise(out)
    return out


def rule_keys(spark: SparkSession, keys: list[str], part: int = 50_000) -> DataFrame:
    """(key) of the listed keys, as constants of the plan."""
    table = None
    for k in range(0, max(1, len(keys)), part):
        some = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(keys[k:k + part])), "array<string>")).alias("key"))
        table = some if table is None else table.unionByName(some)
    return materialize(table, "rules")


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.lower(), slash + path


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow", url: str = "url") -> DataFrame:
    """Add host, path, rule and verdict to each row.

    ``rules`` are (action, ``host/path``) with actions ``block`` and ``allow``; the longest that fits wins
    (at equal length the one with the longer host).  A rule fits its host and all subdomains if the path
    starts with the rule's.  Urls that no rule fits get ``default``.  A null url has an empty host and path.
    Rows are neither dropped nor merged; an empty table gives no rows.  Columns named host, path, rule or verdict
    are replaced.  Long lists are dealt to several cascades; all of them go with the plan, so its size follows the list's.
    """
    spark = pages.sparkSession
    host, path = parts_of(F.col(url))
    named = pages.withColumn("host", host).withColumn("path", path)
    if not rules:
        return named.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    split = [(action, *split_rule(rule)) for action, rule in rules]
    labels = max(h.count(".") + 1 for _, h, _ in split)
    lengths = sorted({len(p) for _, _, p in split})
    keyed = named.withColumn("__keys", candidate_keys(F.col("host"), F.col("path"), labels, lengths))
    universe = materialize(named.select("host", "path").distinct().select(
        F.explode(candidate_keys(F.col("host"), F.col("path"), labels, lengths)).alias("key")).distinct(), "universe")
    member, shards = {}, -(-len(rules) // SHARD)
    for action in ("allow", "block"):
        member[action] = build_shards(rule_keys(spark, [h + p for a, h, p in split if a == action]), universe, shards)
    fitting = F.filter("__keys", lambda k: in_shards(member["allow"], k) | in_shards(member["block"], k))
    out = keyed.withColumn("rule", F.try_element_at(fitting, F.lit(1)))
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).when(in_shards(member["block"], F.col("rule")), F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumn("verdict", verdict).drop("__keys")
