"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question asked again with other values keeps its
template.  Windows of the templates, and of the lower-cased tokens themselves, are hash-joined; the values that filled the placeholders must then map
consistently: on one alignment a value of the benchmark item always stands for one value of the document.
A document is contaminated by an item if consistent windows cover enough of its tokens.

Template windows need a few literal tokens, and whether a token is a name depends on what is before it.  The windows of
the tokens themselves need neither, so a verbatim copy is found whatever its numbers, names, case and line breaks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import runs
from .common import materialize
from .lexer import hash_word, lexed

UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t lb oz ml cl l s sec min h hr hrs second seconds minute minutes hour hours day days week weeks month "
    "months year years meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet yard yards gram grams "
    "kilogram kilograms pound pounds ounce ounces liter liters litre litres percent dollar dollars euro euros cent cents degree degrees mph kmh "
    "hz khz mhz v w kw kwh j kj".split())
#: Tokens of a window, tokens that consistent windows must cover, and literal tokens a template window needs.
WINDOW, COVER, LITERAL = 8, 13, 4
#: Benchmark windows that one pass over the documents looks up; longer lists go in blocks.
BLOCK = 2_000_000
WORD_, NUMBER, NAME, UNIT = range(4)
U = np.uint64
_P = U(0x9E3779B97F4A7C15)


_HOLES = np.array([0x1000000000000001 * k for k in range(4)], U)
_UNIT_HASHES = np.sort(np.array([hash_word(u) for u in UNITS], U))


def templates(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text: (canonical hashes, kinds, hashes of the tokens themselves)."""
    for _, x in lexed(texts, kinds=True):
        kind = np.where(x.digit, NUMBER, np.where(x.capital & ~x.opens, NAME, WORD_))
        after = np.flatnonzero(x.digit[:-1]) + 1  # tokens behind a number
        after = after[~x.digit[after] & ~x.opens[after]]
        low = np.minimum(np.searchsorted(_UNIT_HASHES, x.hash[after]), len(_UNIT_HASHES) - 1)
        kind[after[_UNIT_HASHES[low] == x.hash[after]]] = UNIT
        canon = np.where(kind == WORD_, x.hash, _HOLES[kind])
        for a, b in zip(x.first[:-1].tolist(), x.first[1:].tolist(), strict=True):
            yield canon[a:b], kind[a:b], x.hash[a:b]


def window_hashes(canon: np.ndarray, n: int) -> np.ndarray:
    total = np.zeros(max(0, len(canon) - n + 1), U)
    for k in range(n if len(total) else 0):
        total = total * _P + canon[k:len(canon) - n + 1 + k]
    return total ^ (total >> U(29))


def _windows(t: tuple, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each window: of the templates with ``least`` literal tokens, then of the tokens where they differ."""
    canon, kind, raw = t
    template, plain = window_hashes(canon, n), window_hashes(raw, n)
    literal = np.concatenate([[0], np.cumsum(kind == WORD_)])
    some = np.flatnonzero(literal[n:] - literal[:-n] >= least) if len(template) else np.zeros(0, np.int64)
    other = np.flatnonzero((template != plain) | (literal[n:] - literal[:-n] < least)) if len(template) else some
    return np.concatenate([some, other]), np.concatenate([template[some], plain[other]])


ITEM = "item_id long, size int, at int, n int, hash long, slots binary"
HIT = "doc_id long, pos int, n int, hash long, slots binary"


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The windows of every item; an item shorter than ``window`` is one window, from five tokens on."""

    def run(batches):
        for batch in batches:
            for item, t in zip(batch.column(0).to_pylist(), templates(batch.column(1).to_pylist()), strict=True):
                n = min(window, len(t[0]))
                if n < 5:
                    continue
                at, hashes = _windows(t, n, min(LITERAL, n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(at), pa.int64()), pa.array([len(t[0])] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array([n] * len(at), pa.int32()),
                     pa.array(hashes.view(np.int64)), pa.array([t[2][k:k + n].tobytes() for k in at.tolist()], pa.binary())],
                    ["item_id", "size", "at", "n", "hash", "slots"])

    return benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(run, ITEM)


def document_hits(docs: DataFrame, wanted: Broadcast) -> DataFrame:
    """Windows of the documents whose hash is among the broadcast ``wanted`` (sorted hashes by window length)."""

    def run(batches):
        for batch in batches:
            for doc, t in zip(batch.column(0).to_pylist(), templates(batch.column(1).to_pylist()), strict=True):
                for n, known in wanted.value.items():
                    at, hashes = _windows(t, n, 0)
                    if not len(hashes):
                        continue
                    low = np.searchsorted(known, hashes)
                    hit = np.flatnonzero(known[np.minimum(low, len(known) - 1)] == hashes)
                    at, hashes = at[hit], hashes[hit]
                    if len(at):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([doc] * len(at), pa.int64()), pa.array(at, pa.int32()), pa.array([n] * len(at), pa.int32()),
                             pa.array(hashes.view(np.int64)), pa.array([t[2][k:k + n].tobytes() for k in at.tolist()], pa.binary())],
                            ["doc_id", "pos", "n", "hash", "slots"])

    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, HIT)


def consistent_cover(rows: list[tuple]) -> tuple[int, int]:
    """(covered item tokens, reused values) from (at, pos, n, item tokens, document tokens) of one document and item.

    Windows of one alignment (pos - at) are taken in order; one that maps an item's value to a second value
    is left out.  Literal tokens map to themselves, so only placeholders can conflict.
    """
    covered: set[int] = set()
    changed = 0
    ways: dict[int, dict[int, int]] = {}
    for at, pos, n, mine, theirs in sorted(rows, key=lambda r: (r[1] - r[0], r[0])):
        known = ways.setdefault(pos - at, {})
        a, b = np.frombuffer(mine, "<u8").tolist(), np.frombuffer(theirs, "<u8").tolist()
        new: dict[int, int] = {}
        if all(known.get(x, new.setdefault(x, y)) == y for x, y in zip(a, b, strict=True)):
            known.update(new)
            changed += any(x != y for x, y in zip(a, b, strict=True))
            covered.update(range(at, at + n))
    return len(covered), changed


def contaminations(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cover: int = COVER) -> DataFrame:
    """(doc_id, item_id, covered, n_tokens, changed): the items found in each document.

    An item counts if consistent windows cover ``cover`` of its tokens, or all of a shorter item.  ``changed``
    counts windows with other values than the item's.  Null texts and doc_ids have no rows; rows that
    repeat a doc_id are judged together; items of under five tokens are never found.
    """
    items = materialize(item_windows(benchmark, window), "items")
    keys = items.select("n", "hash").distinct()
    total = keys.count()
    blocks = max(1, -(-total // BLOCK))
    hits = None
    for block in range(blocks):  # a stated query set against all rows, in blocks of bounded size
        some = keys.where(F.expr(f"pmod(hash, {blocks}) = {block}")).toArrow()
        size, hashes = some.column("n").to_numpy(), some.column("hash").to_numpy().view(U)
        wanted = docs.sparkSession.sparkContext.broadcast({n: np.sort(hashes[size == n]) for n in np.unique(size).tolist()})
        found = materialize(document_hits(docs, wanted), "hits")
        wanted.destroy()  # the hits are written: no more than one block is held at a time
        hits = found if hits is None else hits.unionByName(found)
    pairs = hits.join(items.withColumnRenamed("slots", "mine"), ["hash", "n"]).select("doc_id", "item_id", "size", "at", "pos", "n", "mine", "slots")

    def judge(batches):
        for table in runs(batches, 2):
            doc, item, size = (table.column(k)[0].as_py() for k in range(3))
            covered, changed = consistent_cover(list(zip(*(table.column(k).to_pylist() for k in range(3, 8)), strict=True)))
            if covered >= min(cover, size):
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (doc, item, covered, size, changed)], ["doc_id", "item_id", "covered", "n_tokens", "changed"])

    return pairs.repartition("doc_id", "item_id").sortWithinPartitions("doc_id", "item_id", "pos", "at").mapInArrow(
        judge, "doc_id long, item_id long, covered long, n_tokens long, changed long")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark item is found.

    Each row is judged by its own text, named by a hash of doc_id and text: rows that repeat a doc_id with other texts stand
    alone, equal rows go or stay together, and a row without doc_id is judged too.
    """
    row = F.xxhash64(F.col("doc_id").cast("string"), F.col("text"))
    found = contaminations(docs.select(row.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("__found")).distinct()
    return docs.join(materialize(found, "found"), row == F.col("__found"), "left_anti")
