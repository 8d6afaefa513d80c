"""Token-id files coded with a static range asymmetric numeral system (rANS).

One frequency table over the whole corpus is shared by every block.  A block holds whole documents,
is coded on its own, and interleaves ``LANES`` coder states, so numpy steps all lanes at once.  Every
``EVERY`` steps a checkpoint keeps the states and the place in the word stream: segments of a block can
be decoded side by side.  Each block carries a CRC of its ids.

On disk a file set is two Parquet tables that any Spark job reads in parallel: ``table`` (symbol,
frequency out of 2**SCALE) and ``blocks`` (part, block, first ids and lengths of its documents, payload).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path
from .tokenizing import id_width, piece_cache, text_slices

SCALE, LANES, EVERY, BLOCK_TOKENS = 20, 1024, 64, 1 << 18
LOW = np.uint64(1 << 31)
U = np.uint64


def normalise(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**SCALE, at least 1 for every symbol that occurs (table fits 2**SCALE symbols)."""
    total, present = int(counts.sum()), np.flatnonzero(counts)
    freq = np.zeros(len(counts), np.int64)
    if not total:
        return freq
    if len(present) > 1 << (SCALE - 1):
        raise ValueError("too many distinct symbols for this scale")
    spare = (1 << SCALE) - len(present)
    freq[present] = 1 + (counts[present].astype(object) * spare // total).astype(np.int64)
    freq[int(freq.argmax())] += (1 << SCALE) - int(freq.sum())
    return freq


class Table:
    """The shared frequency table: coding limits and the slot -> symbol map."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(U)
        self.start = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(U)
        self.limit = self.freq << U(43)
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    """Header, checkpoints (states and word offsets), words."""
    n = len(ids)
    steps = -(-n // LANES)
    state = np.full(LANES, LOW, U)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    written = 0
    for step in range(steps - 1, -1, -1):
        symbols = ids[step * LANES:(step + 1) * LANES]
        x = state[:len(symbols)]
        full = x >= table.limit[symbols]
        if full.any():
            out = x[full]
            words.append((out & U(0xFFFFFFFF)).astype("<u4"))
            written += len(out)
            x[full] = out >> U(32)
        f = table.freq[symbols]
        q = x // f
        state[:len(symbols)] = (q << U(SCALE)) + (x - q * f) + table.start[symbols]
        if step % EVERY == 0:
            marks.append((written, state.copy()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    head = struct.pack("<IIII", n, len(marks), len(stream), zlib.crc32(ids.astype("<u4").tobytes()))
    places = np.array([len(stream) - w for w, _ in marks[::-1]], "<u8").tobytes()
    return head + places + b"".join(s.astype("<u8").tobytes() for _, s in marks[::-1]) + stream.tobytes()


def decode_block(data: bytes, table: Table) -> np.ndarray:
    """The ids of a block; raises if its checksum fails."""
    n, marks, size, crc = struct.unpack_from("<IIII", data)
    ids = np.concatenate([decode_segment(data, k, table) for k in range(marks)]) if marks else np.zeros(0, np.uint32)
    if len(ids) != n or zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("a block of token ids is damaged")
    return ids


def decode_segment(data: bytes, k: int, table: Table) -> np.ndarray:
    """The ids from checkpoint ``k`` to the next: needs nothing that other segments decode."""
    n, marks, size, _ = struct.unpack_from("<IIII", data)
    at = int(np.frombuffer(data, "<u8", marks, 16)[k])
    state = np.frombuffer(data, "<u8", LANES, 16 + 8 * marks + 8 * LANES * k).astype(U)
    stream = np.frombuffer(data, "<u4", size, 16 + 8 * marks * (1 + LANES))
    first, last = k * EVERY * LANES, min(n, (k + 1) * EVERY * LANES)
    out = np.empty(last - first, np.uint32)
    mask, slots, freq, start = U((1 << SCALE) - 1), table.slots, table.freq, table.start
    for low in range(0, last - first, LANES):
        active = min(LANES, last - first - low)
        x = state[:active]
        slot = x & mask
        symbols = slots[slot.astype(np.int64)]
        out[low:low + active] = symbols
        x = freq[symbols] * (x >> U(SCALE)) + slot - start[symbols]
        short = np.flatnonzero(x < LOW)
        if len(short):
            x[short] = (x[short] << U(32)) | stream[at:at + len(short)].astype(U)
            at += len(short)
        state[:active] = x
    return out


TOKENS = "doc_id long, n_tokens long, ids binary"


def token_ids(docs: DataFrame, tokenizer_path: str, drops_white_space: bool, end_id: int) -> DataFrame:
    """(doc_id, n_tokens, ids): every whole text (null: empty) and ``end_id``, as little-endian ids of ``id_width`` bytes.

    Each task adds one row without n_tokens, whose ids are how often it met each symbol, as 64-bit numbers.
    """

    def run(batches):
        cache = piece_cache(tokenizer_path, drops_white_space)
        kind = f"<u{cache.width}"
        end = np.array([end_id], kind).tobytes()
        total = np.zeros(0, np.int64)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in text_slices(texts):
                data = [d + end for d in cache.encode(texts[lo:hi])]
                more = np.bincount(np.frombuffer(b"".join(data), kind), minlength=len(total))
                more[:len(total)] += total
                total = more
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo:hi], pa.int64()), pa.array([len(d) // cache.width for d in data], pa.int64()), pa.array(data, pa.binary())],
                    ["doc_id", "n_tokens", "ids"])
        if len(total):
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([total.astype("<i8").tobytes()], pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, TOKENS)


def symbol_counts(tokens: DataFrame) -> dict[int, int]:
    """How often each id occurs; at most one entry per symbol of the vocabulary reaches the driver."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                total = np.frombuffer(data.as_py(), "<i8")
                seen = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["symbol", "n"])

    parts = tokens.where("n_tokens is null").select("ids").mapInArrow(run, "symbol long, n long")
    return {r["symbol"]: r["n"] for r in parts.groupBy("symbol").agg(F.sum("n").alias("n")).collect()}


BLOCKS = "part int, block int, n_docs int, n_tokens long, local_start long, doc_ids array<long>, lengths binary, payload binary"


def write_token_files(tokens: DataFrame, path: str, width: int) -> None:
    """Write ``tokens``, the written result of ``token_ids``, to ``path`` in ascending doc_id order, rows without one first.

    Rows are range-partitioned by doc_id; ties (repeated doc_ids) are ordered by their ids, which have ``width`` bytes.
    """
    counts = symbol_counts(tokens)
    dense = np.zeros(max(counts, default=-1) + 1, np.int64)
    for k, n in counts.items():
        dense[k] = n
    freq = normalise(dense)
    rows = [(int(k), int(freq[k])) for k in np.flatnonzero(freq)]
    tokens.sparkSession.createDataFrame(rows, "symbol long, frequency long").coalesce(1).write.parquet(f"{path}/table")

    def run(batches):
        table, part, block, start = Table(freq), TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int, bytes]] = []
        size = 0

        def close():
            ids = np.frombuffer(b"".join(d for _, d in held), f"<u{width}")
            doc_ids = [d for d, _ in held]
            lengths = np.array([len(d) // width for _, d in held], "<i8").tobytes()
            cells = [[part], [block], [len(held)], [len(ids)], [start], [doc_ids], [lengths], [encode_block(ids, table)]]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            names = [c.split()[0] for c in BLOCKS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names)

        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append((doc, data.as_py()))
                size += len(held[-1][1]) // width
                if size >= BLOCK_TOKENS:
                    yield close()
                    block, start, size = block + 1, start + size, 0
                    held.clear()
        if held:
            yield close()

    ordered = tokens.where("n_tokens is not null").select("doc_id", "ids").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(run, BLOCKS).write.parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Decode a file set: (doc_id, start, n_tokens, ids), ``start`` counting all ids of earlier documents."""
    from pyspark.sql import Window as W

    rows = spark.read.parquet(f"{path}/table").collect()  # one row per symbol of the vocabulary
    freq = np.zeros(max((r["symbol"] for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        freq[r["symbol"]] = r["frequency"]
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row per written file
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))

    def run(batches):
        table = Table(freq)
        for batch in batches:
            for doc_ids, lengths, payload, start in zip(*(batch.column(k) for k in range(4)), strict=True):
                ids = decode_block(payload.as_py(), table).astype("<u4")
                docs, n = doc_ids.as_py(), np.frombuffer(lengths.as_py(), "<i8")
                ends = np.cumsum(n)
                data = ids.tobytes()
                texts = [data[4 * (e - m):4 * e] for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(start.as_py() + ends - n), pa.array(n), pa.array(texts, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"])

    placed = blocks.join(parts, "part").select("doc_ids", "lengths", "payload", (F.col("local_start") + F.col("shift")).alias("start"))
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def encode_documents(docs: DataFrame, tokenizer_path: str, drops_white_space: bool, end_id: int, path: str | None = None) -> str:
    """Tokenise whole texts and write them as token files; returns the path of the file set.

    Null texts count as empty and hold only ``end_id``; rows without doc_id come first; repeated rows are written once each; an empty
    table gives an empty file set; columns other than doc_id and text are ignored.
    """
    path = path or new_path(docs.sparkSession, "tokens")
    write_token_files(materialize(token_ids(docs, tokenizer_path, drops_white_space, end_id), "ids"), path, id_width(tokenizer_path))
    return path
