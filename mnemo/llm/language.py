"""Language identification by word-first backoff.

A word known from training is scored by its log frequency in each language.  An unseen word falls back to
its character n-grams, longest first: the longest length at which any n-gram is known decides.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, materialize

WORD = re.compile(r"[^\W\d_]+")
LONGEST = 5
#: Training rows a language may give (lowest hashes of doc_id first), and entries it may choose for each table.
MAX_ROWS, MAX_WORDS, MAX_GRAMS = 2000, 60_000, 30_000


def grams(word: str, n: int) -> list[str]:
    padded = f"<{word}>"
    return [padded[k:k + n] for k in range(len(padded) - n + 1)]


class Model:
    """Per-language log frequencies of words (n = 0) and of n-grams of each length.

    ``places[n]`` maps an entry to its row of ``tables[n]``; row 0 is for entries never seen.
    """

    def __init__(self, langs: list[str], places: list[dict[str, int]], tables: list[np.ndarray]):
        self.langs, self.places, self.tables = langs, places, tables

    def score(self, word: str) -> np.ndarray:
        """Log score of a lower-case word in each language; zeros if nothing of it was ever seen."""
        at = self.places[0].get(word)
        if at is not None:
            return self.tables[0][at]
        for n in range(LONGEST, 0, -1):
            get = self.places[n].get
            known = [get(g, 0) for g in grams(word, n)]
            if any(known):
                return self.tables[n][known].mean(axis=0)
        return np.zeros(len(self.langs), np.float32)


def training_counts(docs: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(lang, n, item, count): words (n = 0) and n-grams of a bounded sample of labelled rows."""
    from pyspark.sql import Window as W

    known = docs.where("lang is not null and text is not null").select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    salted = known.withColumn("salt", F.pmod("h", F.lit(64)))
    some = salted.withColumn("r", F.row_number().over(W.partitionBy("lang", "salt").orderBy("h", "doc_id"))).where(F.col("r") <= max_rows)
    some = some.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("r") <= max_rows)
    sample = docs.select("doc_id", "lang", "text").join(F.broadcast(some.select("doc_id", "lang").distinct()), ["doc_id", "lang"], "left_semi")

    def run(batches):
        from collections import Counter

        tables: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tables.setdefault(lang, Counter()).update(WORD.findall((text or "").lower()))
        for lang, words in tables.items():
            for n in range(LONGEST + 1):
                counts = words if not n else Counter()
                if n:
                    for word, c in words.items():
                        for g in grams(word, n):
                            counts[g] += c
                items = list(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(items), pa.string()), pa.array([n] * len(items), pa.int32()), pa.array(items, pa.string()), pa.array([counts[k] for k in items], pa.int64())],
                    ["lang", "n", "item", "c"])

    parts = sample.select("lang", "text").mapInArrow(run, "lang string, n int, item string, c long")
    return parts.groupBy("lang", "n", "item").agg(F.sum("c").alias("c"))


def chosen(hist: list[tuple[int, int]], most: int) -> tuple[int, float]:
    """(count from which entries are kept, share of the entries with just this count) for ``most`` entries of (count, entries)."""
    room = most
    for c, entries in sorted(hist, reverse=True):
        if entries >= room:
            return c, room / entries
        room -= entries
    return 0, 1.0


def fit(docs: DataFrame, max_rows: int = MAX_ROWS, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    """Fit on labelled rows; the tables keep the most frequent entries of each language, the same number for every language.

    Where entries of one count do not all fit, the lowest hashes of the entries do.  An entry that one language
    chooses has the counts of all.
    """
    counts = materialize(training_counts(docs, max_rows), "lang")
    hist: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for r in counts.groupBy("lang", "n", "c").agg(F.count(F.lit(1)).alias("entries")).collect():  # few counts differ
        hist.setdefault((r["lang"], r["n"]), []).append((r["c"], r["entries"]))
    langs = sorted({lang for lang, _ in hist})
    places, tables = [], []
    by = F.create_map(*[x for k, lang in enumerate(langs) for x in (F.lit(lang), F.lit(k))]) if langs else None
    for n in range(LONGEST + 1):
        size = np.array([sum(c * entries for c, entries in hist.get((lang, n), [])) + 1 for lang in langs], float)
        floor = np.log(0.5 / size)
        place, rows = {}, [floor]
        if langs:
            cut = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.struct(*map(F.lit, chosen(hist.get((lang, n), []), max_grams if n else max_words))))])[F.col("lang")]
            low = F.pmod(F.xxhash64("item"), F.lit(1 << 30)) < cut["col2"] * (1 << 30)
            top = counts.where(F.col("n") == n).groupBy("item").agg(
                F.max((F.col("c") > cut["col1"]) | ((F.col("c") == cut["col1"]) & low)).alias("kept"), F.collect_list(F.struct(by[F.col("lang")].alias("k"), "c")).alias("by"))
            kept = top.where("kept").toArrow()  # a bound for each language on what is broadcast
            for item, pairs in zip(kept.column("item").to_pylist(), kept.column("by").to_pylist(), strict=True):
                row = floor.copy()
                for x in pairs:
                    row[x["k"]] = math.log(x["c"] / size[x["k"]])
                place[item] = len(rows)
                rows.append(row)
        places.append(place)
        tables.append(np.array(rows, np.float32).reshape(len(rows), len(langs)))
    return Model(langs, places, tables)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text; score is the posterior of the answer per word.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned; equal scores
    go to the alphabetically first language.  Only the text is read; repeated rows give repeated results, and a
    null doc_id stays null.
    """
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = spread.value
        words = WordHashes(model.score)
        matrix = np.zeros((0, len(model.langs)), np.float32)
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(1).to_pylist():
                words.trim()
                found = WORD.findall(text.lower()) if text else []
                if not model.langs or not any(c.isalpha() for w in found for c in w):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                ids = list(map(words.__getitem__, found))
                if len(words.rows) < len(matrix):
                    matrix = matrix[:0]
                if len(words.rows) > len(matrix):
                    matrix = np.concatenate([matrix, np.array(words.rows[len(matrix):], np.float32)])
                total = matrix[ids].sum(axis=0, dtype=float)
                best = int(total.argmax())
                share = np.exp((total - total[best]) / math.sqrt(len(ids)))
                langs.append(model.langs[best])
                scores.append(float(1 / share.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
