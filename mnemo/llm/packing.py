"""Best-fit packing of documents into token sequences by linear grouping.

The plan is made on the histogram of piece lengths, which has at most ``capacity`` entries however
many documents there are: large lengths are sorted and split into groups of equal cardinality, each
rounded up to its largest member; a configuration program over the few rounded sizes (column
generation, priced by a knapsack) says how often each configuration is used; actual pieces take the
places of the rounded ones; the small pieces go best-fit, longest first, into what is left.  Every
plan is made for a few bounds between large and small, and the one of fewest sequences is kept.  Every
step of it says "ranks r..r+n of length L go to sequences s..s+n at offset o", so the rows are
placed by one join on bounded data.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .tokenizing import piece_cache, text_slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece; only the first may be shorter than ``capacity``."""
    first = total % capacity or capacity
    cuts = [(0, min(first, total))]
    while sum(cuts[-1]) < total:
        cuts.append((sum(cuts[-1]), capacity))
    return cuts


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int,
                 with_ids: bool = False) -> DataFrame:
    """The pieces of every document: its tokens and ``end_id``, cut at ``capacity`` (null: empty text)."""

    def run(batches):
        cache = piece_cache(tokenizer_path, False)
        end = np.array([end_id], "<u4").tobytes()
        kind = f"<u{cache.width}"
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in text_slices(texts):
                rows = []
                for doc, data in zip(ids[lo:hi], cache.encode(texts[lo:hi]), strict=True):
                    data = np.frombuffer(data, kind).astype("<u4").tobytes() + end
                    for k, (start, n) in enumerate(cut_pieces(len(data) // 4, capacity)):
                        part = data[4 * start:4 * (start + n)]
                        rows.append((doc, k, start, n, zlib.crc32(part), part))
                cols = list(zip(*rows, strict=True))
                arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(cols[5], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def linear_groups(counts: dict[int, int], large: list[int], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Equal-cardinality groups of the large pieces, longest first: (rounded size, [(length, number)])."""
    total = sum(counts[x] for x in large)
    each = max(1, -(-total // groups))
    out: list[tuple[int, list[tuple[int, int]]]] = []
    room = 0
    for length in sorted(large, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append((length, []))
                room = each
            n = min(left, room)
            out[-1][1].append((length, n))
            left, room = left - n, room - n
    return out


def configurations(sizes: list[int], demand: list[int], capacity: int, max_columns: int = 4000) -> list[tuple[np.ndarray, float]]:
    """The linear configuration program by column generation: (pieces of each size, times used)."""
    k, size = len(sizes), np.array(sizes)
    need = np.array(demand, float)
    basis = np.diag(np.maximum(1, capacity // size)).astype(float)
    inverse = np.linalg.inv(basis)
    for step in range(max_columns):
        if step % 200 == 199:
            inverse = np.linalg.inv(basis)
        price = np.maximum(inverse.sum(axis=0), 0)
        best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for room in range(int(size.min()), capacity + 1):
            fits = size <= room
            value = np.where(fits, best[np.where(fits, room - size, 0)] + price, 0)
            j = int(value.argmax())
            if value[j] > best[room - 1]:
                best[room], pick[room] = value[j], j
            else:
                best[room] = best[room - 1]
        if best[capacity] <= 1 + 1e-6:
            break
        column, room = np.zeros(k), capacity
        while room > 0:
            if pick[room] < 0:
                room -= 1
            else:
                column[pick[room]] += 1
                room -= sizes[pick[room]]
        use, change = inverse @ need, inverse @ column
        ratio = np.where(change > 1e-9, use / np.where(change > 1e-9, change, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        row = inverse[out] / change[out]
        inverse -= np.outer(change, row)
        inverse[out] = row
    use = np.maximum(np.linalg.solve(basis, need), 0)
    return [(basis[:, j].astype(int), float(use[j])) for j in range(k) if use[j] > 0]


def best_plan(counts: dict[int, int], capacity: int = 1024, groups: int = 96, fractions: tuple[float, ...] = (0.5, 0.4, 0.3)) -> list[tuple[int, int, int, int, int]]:
    """The plan of fewest sequences among those that call lengths above each fraction of the capacity large.

    At one half a configuration holds one large piece, and the plan equals best fit with the longest first, so none is worse than that; smaller fractions help
    where few lengths leave no small pieces for the gaps.
    """
    plans = [plan_packing(counts, capacity, groups, f) for f in fractions]
    return min(plans, key=lambda runs: max((first + n for _, _, n, first, _ in runs), default=0))


def plan_packing(counts: dict[int, int], capacity: int = 1024, groups: int = 96,
                 large_fraction: float = 0.3) -> list[tuple[int, int, int, int, int]]:
    """Place a histogram of lengths: rows (length, first rank, number, first sequence, offset).

    The number of rows depends on ``capacity`` and ``groups``, not on how many pieces there are.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    taken = dict.fromkeys(counts, 0)
    sequences = 0
    gaps: dict[int, list[list[int]]] = {}  # free tokens -> runs [first sequence, number]

    def place(length: int, n: int, first: int, offset: int) -> None:
        runs.append((length, taken[length], n, first, offset))
        taken[length] += n

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            gaps.setdefault(room, []).append([first, n])

    if counts.get(capacity):
        place(capacity, counts[capacity], 0, 0)
        sequences = counts[capacity]
    rest = {x: n for x, n in counts.items() if x < capacity and n}
    large = [x for x in rest if x > large_fraction * capacity]
    if large:
        grouped = linear_groups(rest, large, groups)
        stock = [list(map(list, members)) for _, members in grouped]
        sizes = [size for size, _ in grouped]
        for column, times in configurations(sizes, [sum(n for _, n in m) for m in stock], capacity):
            left = int(times + 1e-9)
            while left > 0:  # actual pieces take the rounded places, a run of equal ones at a time
                held: dict[tuple[int, int], int] = {}
                for g in np.repeat(np.arange(len(column)), column).tolist():
                    free = next((j for j, (_, n) in enumerate(stock[g]) if n > held.get((g, j), 0)), None)
                    if free is not None:
                        held[g, free] = held.get((g, free), 0) + 1
                if not held:
                    break
                n, offset = min(left, *(stock[g][j][1] // m for (g, j), m in held.items())), 0
                for (g, j), m in held.items():
                    for _ in range(m):
                        place(stock[g][j][0], n, sequences, offset)
                        offset += stock[g][j][0]
                    stock[g][j][1] -= n * m
                leave(capacity - offset, sequences, n)
                sequences += n
                left -= n
        rest = {x: n for x, n in rest.items() if x not in set(large)}
        for members in stock:
            for x, n in members:
                if n:
                    rest[x] = rest.get(x, 0) + n
    rooms = sorted(gaps)
    for length in sorted(rest, reverse=True):
        left = rest[length]
        while left:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):  # new sequences, filled with as many of this length as they hold
                per = max(1, min(capacity // length, left))
                bins = left // per
                for j in range(per):
                    place(length, bins, sequences, j * length)
                left -= bins * per
                room = capacity - per * length
                if room:
                    leave(room, sequences, bins)
                    if room not in rooms:
                        bisect.insort(rooms, room)
                sequences += bins
                continue
            room = rooms[k]
            first, n = gaps[room][-1]
            per = min(room // length, left)
            bins = min(n, left // per)
            for j in range(per):
                place(length, bins, first, capacity - room + j * length)
            left -= bins * per
            if bins == n:
                gaps[room].pop()
            else:
                gaps[room][-1] = [first + bins, n - bins]
            if not gaps[room]:
                del gaps[room]
                rooms.pop(k)
            less = room - per * length
            if less:
                if less not in gaps:
                    bisect.insort(rooms, less)
                leave(less, first, bins)
    return runs


def ranked(pieces: DataFrame, rows_per_salt: int = 5000) -> DataFrame:
    """Number the pieces of each length from 0, without one task ever holding a whole length.

    Rows are salted by their key; ranks inside (salt, length) are shifted by the pieces of that
    length in earlier salts, a running sum over one row per (salt, length).
    """
    from pyspark.sql import Window as W

    salts = max(1, -(-pieces.count() // rows_per_salt))
    salted = pieces.withColumn("salt", F.expr(f"pmod(xxhash64(doc_id, piece), {salts})"))
    own = W.partitionBy("salt", "length").orderBy("doc_id", "piece", "start", "ids_crc32")
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    shift = salted.groupBy("salt", "length").agg(F.count(F.lit(1)).alias("n"))
    shift = shift.select("salt", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    out = salted.withColumn("rank", F.row_number().over(own) - 1).join(shift, ["salt", "length"])
    return out.withColumn("rank", F.col("rank") + F.col("shift")).drop("salt", "shift")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2,
                   groups: int = 96, fractions: tuple[float, ...] = (0.5, 0.4, 0.3), with_ids: bool = False) -> DataFrame:
    """Place every piece of every document: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored.  A null or empty text is one piece
    that holds only ``end_id``.  Repeated rows are packed once each.  An empty table gives no rows.
    ``with_ids`` keeps the token ids (little-endian uint32) for ``packed_sequences``.
    """
    pieces = materialize(token_pieces(docs, tokenizer_path, capacity, end_id, with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    by_length: dict[int, list[tuple[int, int, int, int]]] = {}
    for length, rank, n, first, offset in best_plan(counts, capacity, groups, fractions):
        by_length.setdefault(length, []).append((rank, n, first, offset))
    table = {x: tuple(np.array(c) for c in zip(*sorted(runs), strict=True)) for x, runs in by_length.items()}

    def place(batches):  # the plan is bounded by capacity and groups: it travels with the task
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            sequence, offset = np.zeros(len(length), "i8"), np.zeros(len(length), "i8")
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                first_rank, _, first, off = table[int(x)]
                run = np.searchsorted(first_rank, rank[at], side="right") - 1
                sequence[at] = first[run] + rank[at] - first_rank[run]
                offset[at] = off[run]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(n)) for n in kept), pa.array(sequence), pa.array(offset)],
                [*kept, "sequence_id", "offset"])

    kept = ["doc_id", "piece", "start", "length", "ids_crc32"] + (["ids"] if with_ids else [])
    schema = PIECES + (", ids binary" if with_ids else "") + ", sequence_id long, offset long"
    return ranked(pieces).select(*kept, "rank").mapInArrow(place, schema)


def packed_sequences(placed: DataFrame) -> DataFrame:
    """The sequences themselves: (sequence_id, n_tokens, ids), pieces joined in order of offset.

    A sequence holds ``capacity`` tokens at most, so each group is small.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(F.transform(parts, lambda p: p["ids"]), F.unhex(F.lit("")), lambda a, b: F.concat(a, b))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
