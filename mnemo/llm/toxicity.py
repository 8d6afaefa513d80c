"""Toxicity by a classifier chain of logistic regressions over word features.

Categories are predicted in a fixed order; the model of each category gets the earlier categories'
probabilities as further features.  In training those probabilities are out-of-fold predictions, so a
later model sees them as noisy as they are on new texts.

Each model chooses its own words by how far the share of its category among the documents that hold a word
deviates from the share among all (a chi-square score), on the rows it is fitted on and on no others; how
many words, and how strong the penalty, is chosen by cross-validated log loss.  Equal texts share a fold.

The models are fitted on a bounded sample of the labelled rows (``MAX_ROWS``, lowest hashes of doc_id
first); every document is then scored over its whole text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

WORD = re.compile(r"[^\W\d_]+")
#: Labelled rows fitted on, and documents of the sample a word must occur in.
MAX_ROWS, MIN_DOCS = 6000, 4
FOLDS, STEPS, RATE = 3, 120, 0.15
#: Numbers of words and penalties tried; the first penalty is the one numbers of words are compared at.
SIZES, PENALTIES = (100, 300, 1000), (1e-5, 1e-6, 1e-4)
#: category -> the value of its label column that counts as positive, in the order of the chain.
CATEGORIES = {"low_quality": ("quality", 0), "toxic": ("toxic", 1)}


class Sparse:
    """Rows of (column, value) pairs, with the two products that fitting needs."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], columns: int):
        sizes = [len(c) for c, _ in rows]
        self.owner = np.repeat(np.arange(len(rows)), sizes)
        self.at = np.concatenate([c for c, _ in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)
        self.value = np.concatenate([v for _, v in rows]).astype(float) if rows else np.zeros(0)
        self.n, self.columns = len(rows), columns

    def only(self, columns: np.ndarray) -> Sparse:
        """The same rows with some of the columns, renumbered in the order given."""
        new = np.full(self.columns, -1)
        new[columns] = np.arange(len(columns))
        out = Sparse([], len(columns))
        keep = new[self.at] >= 0
        out.owner, out.at, out.value, out.n = self.owner[keep], new[self.at[keep]], self.value[keep], self.n
        return out

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, self.value * w[self.at], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self.value * g[self.owner], self.columns)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: Sparse, dense: np.ndarray, y: np.ndarray, use: np.ndarray, penalty: float = PENALTIES[0]) -> np.ndarray:
    """Weights for words, then dense columns, then the intercept, fitted on the rows in ``use`` (Adam)."""
    w = np.zeros(x.columns + dense.shape[1] + 1)
    rate = y[use].mean() if len(use) else 0.0
    w[-1] = math.log((rate + 1e-3) / (1 - rate + 1e-3))
    if not len(use) or rate in (0.0, 1.0):
        return w
    mask = np.zeros(x.n)
    mask[use] = 1 / len(use)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        p = sigmoid(x.dot(w[:x.columns]) + dense @ w[x.columns:-1] + w[-1])
        g = (p - y) * mask
        grad = np.concatenate([x.back(g), g @ dense, [g.sum()]])
        grad[:-1] += penalty * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


class Chain:
    """One weight vector per category; ``words`` maps a lower-case word to its column."""

    def __init__(self, names: list[str], words: dict[str, int], weights: list[np.ndarray]):
        self.names, self.words, self.weights = names, words, weights
        #: Row k: the weights of word k in every model of the chain.
        self.table = np.stack([w[:len(words)] for w in weights], 1) if weights else np.zeros((len(words), 0))

    def probabilities(self, sums: np.ndarray) -> np.ndarray:
        """(documents, categories) from the summed word weights of each document."""
        out = np.zeros_like(sums)
        for k, w in enumerate(self.weights):
            out[:, k] = sigmoid(sums[:, k] + out[:, :k] @ w[len(self.words):len(self.words) + k] + w[-1])
        return out


def predicted(x: Sparse, dense: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(x.dot(w[:x.columns]) + dense @ w[x.columns:-1] + w[-1])


def log_loss(y: np.ndarray, p: np.ndarray) -> float:
    p = np.clip(p, 1e-12, 1 - 1e-12)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def fit_chain(names: list[str], words: dict[str, int], x: Sparse, labels: np.ndarray, folds: np.ndarray, ranking: list[list[np.ndarray]]) -> Chain:
    """``labels`` is (rows, categories) of 0/1 with NaN where unknown; ``folds`` numbers each row's fold.

    ``ranking[k][f]`` has the columns by falling association with category k on the rows outside fold f, and
    ``ranking[k][FOLDS]`` those on all rows.
    """
    weights, earlier = [], np.zeros((x.n, 0))
    for k in range(len(names)):
        y, known = np.nan_to_num(labels[:, k]), ~np.isnan(labels[:, k])

        def out_of_fold(size: int, penalty: float) -> np.ndarray:
            p = np.zeros(x.n)
            for fold in range(FOLDS):
                part = x.only(ranking[k][fold][:size])
                w = fit_logistic(part, earlier, y, np.flatnonzero(known & (folds != fold)), penalty)  # noqa: B023
                p[folds == fold] = predicted(part, earlier, w)[folds == fold]  # noqa: B023
            return p

        tried = {(size, PENALTIES[0]): out_of_fold(size, PENALTIES[0]) for size in SIZES}
        loss = lambda c: log_loss(y[known], tried[c][known]) if known.any() else 0.0  # noqa: B023, E731
        size, _ = min(tried, key=loss)
        tried |= {(size, c): out_of_fold(size, c) for c in PENALTIES[1:]}
        size, penalty = min(tried, key=loss)
        columns = ranking[k][FOLDS][:size]
        w = fit_logistic(x.only(columns), earlier, y, np.flatnonzero(known), penalty)
        weights.append(np.concatenate([np.zeros(x.columns), w[len(columns):]]))
        weights[-1][columns] = w[:len(columns)]
        earlier = np.column_stack([earlier, tried[size, penalty]])
    return Chain(names, words, weights)


def association(k: int, fold: int) -> F.Column:
    """The chi-square score of a word with category ``k`` on all rows outside ``fold``."""
    both = lambda f: sum((F.col(f"{f}{k}")[g] for g in range(FOLDS) if g != fold), F.lit(0))
    n, hits, rows, positive = both("n"), both("y"), both("rows"), both("positive")
    share = positive / F.greatest(rows, F.lit(1))
    spread = n * share * (1 - share) * (1 - n / F.greatest(rows + 1, F.lit(1)))
    return F.when(spread > 0, F.abs(hits - n * share) / F.sqrt(spread)).otherwise(0.0)


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, tuple[str, int]] = CATEGORIES, max_rows: int = MAX_ROWS) -> Chain:
    """Fit a chain on ``docs`` (doc_id, text) and ``labels`` (doc_id and the categories' label columns).

    A null label leaves its row out of that category.  Of labels that repeat a doc_id the first in order of their
    values is used, nulls first.  Without labelled rows every probability is 0.5.
    """
    values = [F.col(c).cast("int").alias(f"l{k}") for k, (c, _) in enumerate(categories.values())]
    order = [F.xxhash64("doc_id"), "doc_id", *(f"l{k}" for k in range(len(values)))]
    rows = labels.where("doc_id is not null").select(F.col("doc_id").cast("long"), *values).orderBy(*order).limit(max_rows).collect()  # at most max_rows small rows
    known: dict[int, list[float]] = {}
    for r in rows:
        known.setdefault(r["doc_id"], [float("nan") if r[f"l{k}"] is None else float(r[f"l{k}"] == positive) for k, (_, positive) in enumerate(categories.values())])
    spark = docs.sparkSession
    chosen = spark.createDataFrame(list(known.items()), "doc_id long, y array<double>")
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")

    def count(batches):
        for batch in batches:
            rows = []
            for doc, text, y in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                found = Counter(WORD.findall(text.lower()))
                rows.append((doc, zlib.crc32(text.encode("utf-8", "replace")) % FOLDS, y, list(found), list(found.values())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "fold", "y", "words", "n"])

    kinds = (pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.string()), pa.list_(pa.int64()))
    held = materialize(texts.mapInArrow(count, "doc_id long, fold int, y array<double>, words array<string>, n array<long>"), "words")
    flags = [F.col("fold"), *(c.cast("int").alias(f"{name}{k}") for k in range(len(values)) for name, c in (("n", ~F.isnan(F.col("y")[k])), ("y", F.col("y")[k] == 1)))]
    of = lambda name, test: F.array(*(F.sum(F.when(F.col("fold") == g, F.col(test)).otherwise(0)) for g in range(FOLDS))).alias(name)
    tally = lambda n, y: [c for k in range(len(values)) for c in (of(f"{n}{k}", f"n{k}"), of(f"{y}{k}", f"y{k}"))]
    per_word = held.select(F.explode("words").alias("word"), *flags).groupBy("word").agg(F.count(F.lit(1)).alias("docs"), *tally("n", "y")).where(F.col("docs") >= MIN_DOCS)
    totals = held.select(*flags).agg(*tally("rows", "positive"))
    scored = materialize(per_word.join(F.broadcast(totals)).select("word", *(association(k, f).alias(f"s{k}_{f}") for k in range(len(values)) for f in range(FOLDS + 1))), "scores")  # one row of totals
    tops = [[[r["word"] for r in scored.orderBy(F.desc(f"s{k}_{f}"), "word").limit(SIZES[-1]).select("word").collect()] for f in range(FOLDS + 1)] for k in range(len(values))]
    words = {w: k for k, w in enumerate(sorted({w for fs in tops for top in fs for w in top}))}
    ranking = [[np.array([words[w] for w in top], np.int64) for top in fs] for fs in tops]

    def keep(batches):
        for batch in batches:
            rows = []
            for doc, fold, found, n in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                seen = sorted((at, c) for at, c in zip(map(words.get, found), n, strict=True) if at is not None)
                rows.append((doc, fold, [at for at, _ in seen], [c for _, c in seen]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64())), strict=True)], ["doc_id", "fold", "at", "n"])

    per_doc = held.select("doc_id", "fold", "words", "n").mapInArrow(keep, "doc_id long, fold int, at array<int>, n array<long>").orderBy("doc_id").toArrow()  # at most max_rows documents, words that were ranked
    x = Sparse([(np.array(a.as_py(), np.int64), value_of(np.array(n.as_py(), float))) for a, n in zip(per_doc.column("at"), per_doc.column("n"), strict=True)], len(words))
    y = np.array([known[d] for d in per_doc.column("doc_id").to_pylist()], float).reshape(x.n, len(categories))
    return fit_chain(list(categories), words, x, y, np.array(per_doc.column("fold").to_pylist(), int), ranking)


def value_of(n: np.ndarray) -> np.ndarray:
    """A word that occurs n times counts as log2(1 + n)."""
    return np.log2(1.0 + n)


def _scorer(chain: Chain):
    """texts -> (documents, categories) probabilities; a null or empty text has the sums of no words."""
    get = chain.words.get

    def score(texts: list[str | None]) -> np.ndarray:
        sums = np.zeros((len(texts), len(chain.names)))
        for k, text in enumerate(texts):
            if text:
                at = [i for i in map(get, WORD.findall(text.lower())) if i is not None]
                n = np.bincount(np.array(at, np.int64))
                seen = np.flatnonzero(n)
                sums[k] = value_of(n[seen]) @ chain.table[seen]
        return chain.probabilities(sums)

    return score


def score_documents(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, p_<category> ...) for every row of ``docs``; other columns are ignored.

    Null and empty texts get the probabilities of a text without known words; repeated rows give
    repeated results; an empty table gives no rows.
    """
    spread = docs.sparkSession.sparkContext.broadcast(chain)  # the words that some model chose
    names = [f"p_{n}" for n in chain.names]

    def run(batches):
        score = _scorer(spread.value)
        for batch in batches:
            p = score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, k]) for k in range(p.shape[1]))], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ", ".join(["doc_id long", *(f"{n} double" for n in names)]))


def drop_toxic(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose probability of the chain's last category is below ``threshold``."""
    spread = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        score = _scorer(spread.value)
        for batch in batches:
            p = score(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield batch.filter(pa.array(p[:, -1] < threshold))

    return docs.mapInArrow(run, docs.schema)
