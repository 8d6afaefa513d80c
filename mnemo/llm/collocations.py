"""Phrase collocation mining: weighted n-gram counts of distinct pieces, counted per hash bucket in duckdb.

A phrase lies within a piece, so identical pieces are one row with a multiplicity and their n-grams count so many times.  Distinct pieces
form blocks; a block sums its own n-grams and deals the sums to buckets by hash, and each bucket is counted out of core by a
duckdb of its own.  A phrase can only be frequent where all its pairs of neighbouring words are, so the buckets of words and pairs reply to each block which
of its pairs are frequent, and only n-grams of three to five words that hold none but those are counted, in the same way.
The counts of a phrase's parts come by lookup requests that are shuffled to where those counts are.
"""

from __future__ import annotations

import re
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .blocks import runs
from .common import materialize
from .tokenizing import text_slices

#: Words of a phrase at most; words a long piece is cut to (with the words before the cut as context).
LONGEST, CUT = 5, 2_000
#: Distinct pieces and characters of a block, words a bucket is planned for, most buckets, memory of a bucket's duckdb before it goes to disk.
PIECES, CHARS, BUCKET_WORDS, MAX_BUCKETS, MEMORY = 100_000, 6_000_000, 2_000_000, 4_096, "200MB"
#: Parts of a language that are ranked by themselves before the whole is.
SLICES = 16
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_PIECES = re.compile("[.,;:!?\n-\r]")
_SPACES = re.compile(" {2,}")
#: Before a piece whose first words are context of a cut; no piece holds this sign, nor a line feed.
CONTEXT = "\r"


def pieces_of(text: str) -> Iterator[str]:
    """The pieces with words, as words with single spaces between; long ones are cut, and then repeat the words before the cut."""
    low = text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")
    for piece in _PIECES.split(low.replace("\t", " ")):
        piece = piece.strip(" ")
        if not piece:
            continue
        if "  " in piece:
            piece = _SPACES.sub(" ", piece)
        if len(piece) > 2 * CUT and piece.count(" ") >= CUT:
            words = piece.split(" ")
            yield " ".join(words[:CUT])
            for k in range(CUT, len(words), CUT):
                yield CONTEXT + " ".join(words[k - LONGEST + 1:k + CUT])
        else:
            yield piece


def distinct_pieces(docs: DataFrame) -> DataFrame:
    """(key, m): language, line feed and piece, and how often it occurs."""
    def run(batches):
        for batch in batches:
            texts, langs = (batch.column(k).to_pylist() for k in range(2))
            for lo, hi in text_slices(texts):
                found = Counter(f"{lang}\n{piece}" for t, lang in zip(texts[lo:hi], langs[lo:hi], strict=True) if t for piece in pieces_of(t))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["key", "m"])

    rows = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    return rows.mapInArrow(run, "key string, m long").groupBy("key").agg(F.sum("m").alias("m"))


def packed(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write(table)
    return sink.getvalue().to_pybytes()


def unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def blocks_of(pieces: DataFrame) -> DataFrame:
    """(block, pieces, words): blocks of at most ``PIECES`` distinct pieces with their multiplicities, packed."""
    def run(batches):
        base, n = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []
        size = count = 0

        def close():
            table = pa.Table.from_batches(held).combine_chunks()
            words = pc.sum(pc.count_substring(table.column("key"), " ")).as_py() + table.num_rows
            return pa.RecordBatch.from_arrays([pa.array([base + n], pa.int64()), pa.array([packed(table)], pa.binary()), pa.array([words], pa.int64())], ["block", "pieces", "words"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                held.append(part)
                count, size = count + part.num_rows, size + pc.sum(pc.binary_length(part.column(0))).as_py()
                if count >= PIECES or size >= CHARS:
                    yield close()
                    n, held, size, count = n + 1, [], 0, 0
        if held:
            yield close()

    return pieces.select("key", "m").mapInArrow(run, "block long, pieces binary, words long")


class Words:
    """The words of a block's pieces on end, as arrays; n-grams are numbered from those one word shorter."""

    def __init__(self, table: pa.Table):
        halves = pc.split_pattern(table.column("key").combine_chunks(), "\n", max_splits=1, reverse=True).flatten()  # a piece holds no line feed
        langs, pieces = (halves.take(pa.array(np.arange(k, len(halves), 2))) for k in (0, 1))
        context = pc.starts_with(pieces, CONTEXT)
        words = pc.split_pattern(pc.if_else(context, pc.utf8_slice_codeunits(pieces, 1), pieces) if pc.any(context).as_py() else pieces, " ")
        size = np.diff(words.offsets.to_numpy())
        first = np.repeat(np.cumsum(size) - size, size)
        coded, langs = words.values.dictionary_encode(), langs.dictionary_encode()
        self.word, self.words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        self.at = np.arange(len(first)) - first
        self.skip = np.repeat(np.where(context.to_numpy(zero_copy_only=False), LONGEST - 1, 0), size)  # an n-gram counts where its last word is no context
        self.m = np.repeat(table.column("m").to_numpy(), size)
        self.id, places = numbered(np.repeat(langs.indices.to_numpy().astype(np.int64), size) * len(self.words) + self.word)
        self.grams = pc.binary_join_element_wise(langs.dictionary.take(pa.array(places // len(self.words))), self.words.take(pa.array(places % len(self.words))), "\n")
        self.n, self.fits = 1, np.ones(len(first), bool)

    def longer(self, fits: np.ndarray) -> None:
        """Go on to n-grams of one word more, of those that end where ``fits``."""
        self.fits = fits & (self.at >= self.n)  # words before the last one
        self.n += 1
        ends = np.flatnonzero(self.fits)
        ids, places = numbered(self.id[ends - 1] * len(self.words) + self.word[ends])
        self.grams = pc.binary_join_element_wise(self.grams.take(pa.array(places // len(self.words))), self.words.take(pa.array(places % len(self.words))), " ")
        self.id = np.zeros(len(self.at), np.int64)
        self.id[ends] = ids

    def sums(self) -> pa.Table:
        """(gram, w): language, line feed and n-gram, and how often it occurs."""
        ends = np.flatnonzero(self.fits & (self.at >= self.skip))
        w = np.zeros(len(self.grams), np.int64)
        np.add.at(w, self.id[ends], self.m[ends])
        used = np.flatnonzero(w)
        return pa.table({"gram": self.grams if len(used) == len(w) else self.grams.take(pa.array(used)), "w": pa.array(w[used])})


def numbered(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the number of each code, the distinct codes in order)."""
    order = np.argsort(codes)
    ordered = codes[order]
    new = np.diff(ordered, prepend=-1) != 0
    ids = np.empty(len(codes), np.int64)
    ids[order] = np.cumsum(new) - 1
    return ids, ordered[new]


def short_grams(words: Words) -> pa.Table:
    """The words, and the pairs of neighbours."""
    one = words.sums()
    words.longer(words.fits)
    return pa.concat_tables([one, words.sums()])


def long_grams(words: Words, frequent: pa.Array) -> pa.Table:
    """The n-grams of three words and more whose pairs of neighbours are all ``frequent``."""
    words.longer(words.fits)
    known = pc.is_in(words.grams, value_set=frequent).to_numpy(zero_copy_only=False)
    pair = words.fits & (known[words.id] if len(known) else False)
    run, found = pair, []
    for _ in range(LONGEST - 2):
        run = pair & np.concatenate([[False], run[:-1]])  # all pairs of the n-gram that ends here
        words.longer(run)
        found.append(words.sums())
    return pa.concat_tables(found)


def dealt(table: pa.Table, block: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """A block's sums as one packed table for each bucket."""
    import duckdb

    if not table.num_rows:
        return
    with duckdb.connect(config={"threads": 1}) as con:
        con.register("grams", table)
        bucket = con.execute(f"SELECT (hash(gram) % {buckets})::INTEGER AS b FROM grams").fetchnumpy()["b"].astype(np.int16)
    order = np.argsort(bucket, kind="stable")
    table, ends = table.take(pa.array(order)).combine_chunks(), np.searchsorted(bucket[order], np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(ends)).tolist()
    blobs = [packed(table.slice(ends[b], ends[b + 1] - ends[b])) for b in full]
    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([block] * len(full), pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "block", "grams"])


def short_sums(blocks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, grams): words and pairs of each block with their sums, by bucket."""
    def run(batches):
        for batch in batches:
            for block, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from dealt(short_grams(Words(unpacked(blob))), block, buckets)

    return blocks.select("block", "pieces").mapInArrow(run, "bucket int, block long, grams binary")


def long_sums(blocks: DataFrame, replies: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, grams): the n-grams of each block that hold frequent pairs only, with their sums, by bucket."""
    rows = blocks.select("block", F.lit(1).alias("kind"), F.col("pieces").alias("data")).unionByName(replies.select("block", F.lit(0).alias("kind"), F.col("grams").alias("data")))

    def run(batches):
        frequent: list[pa.Array] = []
        now = None
        for batch in batches:
            for block, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != now:
                    now, frequent = block, []
                if kind == 0:
                    frequent += unpacked(data).column("gram").chunks
                elif frequent:
                    yield from dealt(long_grams(Words(unpacked(data)), pa.chunked_array(frequent).combine_chunks()), block, buckets)

    return rows.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(run, "bucket int, block long, grams binary")


def counted(sums: DataFrame, least: int, reply: bool) -> DataFrame:
    """(lang, gram, f, block, grams): the n-grams of at least ``least`` occurrences, counted bucket by bucket.

    With ``reply`` also rows (block, grams) with those pairs of each block, packed.  A bucket's duckdb keeps
    ``MEMORY`` in memory and the rest in a folder of the task, which goes with it.
    """
    def count_bucket(con, table: pa.Table) -> Iterator[pa.RecordBatch]:
        con.execute("CREATE TABLE r (block BIGINT, gram VARCHAR, w BIGINT)")
        for lo in range(0, table.num_rows, 64):
            parts = [unpacked(blob.as_buffer()) for blob in table.column("grams").slice(lo, 64)]
            blocks = np.repeat(table.column("block").slice(lo, 64).to_numpy(), [p.num_rows for p in parts])
            con.register("parts", pa.concat_tables(parts).append_column("block", pa.array(blocks)))
            con.execute("INSERT INTO r SELECT block, gram, w FROM parts")
            con.unregister("parts")
        con.execute("CREATE TABLE f AS SELECT gram, sum(w)::BIGINT AS f FROM r GROUP BY gram HAVING sum(w) >= ?", [least])
        for batch in con.sql("SELECT gram, f FROM f").to_arrow_reader(100_000):
            keys = [g.rpartition("\n") for g in batch.column(0).to_pylist()]
            n = len(keys)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.string()), batch.column(1), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], NAMES)
        if reply:
            pairs = con.sql("SELECT block, gram FROM r SEMI JOIN f ON r.gram = f.gram WHERE contains(r.gram, ' ') ORDER BY block").to_arrow_reader(100_000)
            for batch in pairs:
                blocks, starts = np.unique(batch.column(0).to_numpy(), return_index=True)
                blobs = [packed(batch.select(["gram"]).slice(lo, hi - lo)) for lo, hi in zip(starts, [*starts[1:], batch.num_rows], strict=True)]
                n = len(blocks)
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.array(blocks, pa.int64()), pa.array(blobs, pa.binary())], NAMES)

    def run(batches):
        import duckdb

        for table in runs(batches, 1):
            with tempfile.TemporaryDirectory(prefix="bucket-") as folder, duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": folder, "preserve_insertion_order": False}) as con:
                yield from count_bucket(con, table)

    return sums.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "lang string, gram string, f long, block long, grams binary")


NAMES = ["lang", "gram", "f", "block", "grams"]


def frequent_grams(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """((lang, gram, f) of all n-grams of one to five words with f >= least, (lang, n) of all word occurrences)."""
    blocks = materialize(blocks_of(distinct_pieces(docs)), "pieces")
    words = blocks.agg(F.sum("words")).first()[0] or 0
    buckets = int(min(MAX_BUCKETS, max(16, -(-words // BUCKET_WORDS))))
    short = materialize(counted(short_sums(blocks, buckets), least, True), "short")
    long = materialize(counted(long_sums(blocks, short.where("block is not null"), buckets), least, False), "long")
    grams = short.where("block is null").unionByName(long).select("lang", "gram", "f")
    return grams, totals(blocks)


def totals(blocks: DataFrame) -> DataFrame:
    """(lang, n): all word occurrences."""
    def run(batches):
        for batch in batches:
            found: Counter = Counter()
            for blob in batch.column(0):
                table = unpacked(blob.as_buffer())
                for key, m in zip(table.column("key").to_pylist(), table.column("m").to_pylist(), strict=True):
                    lang, _, piece = key.rpartition("\n")
                    found[lang] += m * (piece.count(" ") + 1 - (LONGEST - 1) * (piece[0] == CONTEXT))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "n"])

    return blocks.select("pieces").mapInArrow(run, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))


def scored(grams: DataFrame, total: DataFrame, factor: int = 1000) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every phrase of two words and more, at its lowest-scoring cut.

    Each cut sends a lookup request for its two parts; all parts are frequent, since the phrase is.
    """
    words = F.split("gram", " ")
    phrases = grams.withColumn("words", words).where(F.size("words") > 1)
    part = lambda a, n: F.array_join(F.slice("words", a, n), " ")
    cuts = phrases.select("lang", F.col("gram").alias("phrase"), F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.size("words")).alias("rest"))
    ask = cuts.select("lang", "phrase", "a", "k", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("first").alias("gram")), F.struct(F.lit(1).alias("side"), F.col("rest").alias("gram")))).alias("x")).select("lang", "phrase", "a", "k", "x.side", "x.gram")
    answers = ask.join(grams, ["lang", "gram"]).groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    score = F.expr(f"(cast({factor} as decimal(7,0)) * cast(a as decimal(15,0)) * cast(n as decimal(16,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    valued = answers.join(total, "lang").withColumn("score", score)
    best = F.min(F.struct("score", "k", "l", "r", "n")).alias("b")
    return valued.groupBy("lang", "phrase", "a").agg(best).select("lang", "phrase", "a", "b.l", "b.r", "b.n", "b.score")


def uncovered(phrases: DataFrame, grams: DataFrame, percent: int = 100) -> DataFrame:
    """Phrases whose words lie in no longer phrase that has at least ``percent`` of their occurrences."""
    words = grams.withColumn("words", F.split("gram", " ")).where(F.size("words") > 2)
    size = F.size("words")
    parts = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda at: F.array_join(F.slice("words", at, n), " "))))
    held = words.select("lang", "f", F.explode(F.array_distinct(parts)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    joined = phrases.join(held, ["lang", "phrase"], "left")
    covered = F.lit(100) * F.col("longer").cast("decimal(20,0)") >= F.lit(percent) * F.col("a").cast("decimal(20,0)")
    return joined.where(~F.coalesce(covered, F.lit(False))).drop("longer")


def collocations(docs: DataFrame, least: int = 100, most: int = 2000, percent: int = 100, factor: int = 1000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two to five words in ``docs`` (text, lang).

    Null texts count as empty, a null language as ``und``.  Pieces end at marks and line ends, words at spaces and tabs; only A-Z are
    lower-cased.  Copies of a text count each; other columns are ignored; an empty table, or one without frequent phrases, gives no rows.
    """
    grams, total = frequent_grams(docs, least)
    found = materialize(uncovered(scored(grams, total, factor), grams, percent), "phrases")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    first = F.row_number().over(W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SLICES))).orderBy(*order))  # so that one task gets at most SLICES * most rows
    ranked = found.withColumn("rank", first).where(F.col("rank") <= most)
    ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
