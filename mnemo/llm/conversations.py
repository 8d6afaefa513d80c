"""Repair of conversation structure by a min-plus matrix scan.

A conversation is sound if its role initials are ``(s?(ua)+)?``; four states accept that language.  A turn becomes a 4 x 4 matrix: entry (i, j)
is the cheapest way, as (cost, audit), to go from state i to state j over the turn when it may be kept, given another role or deleted and turns may be
inserted on both sides (the closure of the insertions).  Products take sums of costs and joined audits, sums take the least pair, so the matrix of
a run of turns is the product of its parts in any bracketing.  Equal costs of one run mean equal letters but for their order, so no audit that ties with another is its prefix, and the least pair of
a whole is made of the least pairs of its parts.

Turns are sorted over range partitions, so a conversation may lie in many of them; parts are multiplied within a partition and then in a tree over
neighbouring partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Fixed values of the repair: the costs of the edits, and of leaving a truncated turn.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: (from, initial, to): nothing yet or after an assistant, s; then u and a in turn.  States: 0 nothing, 1 system, 2 user, 3 assistant.
STEPS = ((0, "s", 1), (0, "u", 2), (1, "u", 2), (2, "a", 3), (3, "u", 2))
ENDS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
#: Turns of a segment, turns whose product is remembered, parts that meet in one step of the tree.
SEGMENT, SHORT, FAN = 512, 8, 16
#: White space of the table's texts.
SPACE = " \t\n\x0b\x0c\r"

Matrix = tuple  # 16 entries, row by row: (cost, audit) or None


def times(a: Matrix, b: Matrix) -> Matrix:
    out = []
    for i in range(0, 16, 4):
        for j in range(4):
            ways = [(x[0] + y[0], x[1], y[1]) for k in range(4) if (x := a[i + k]) is not None and (y := b[4 * k + j]) is not None]
            if not ways:
                out.append(None)
                continue
            least = min(w[0] for w in ways)
            out.append((least, min(x + y for c, x, y in ways if c == least)))
    return tuple(out)


def plus(a: Matrix, b: Matrix) -> Matrix:
    return tuple(y if x is None else x if y is None else min(x, y) for x, y in zip(a, b, strict=True))


def matrix(entries: dict) -> Matrix:
    return tuple(entries.get((i, j)) for i in range(4) for j in range(4))


ONE = matrix({(i, i): (0, "") for i in range(4)})


@lru_cache(None)
def closure() -> Matrix:
    """Any number of inserted turns; more than three lead nowhere new."""
    once = plus(ONE, matrix({(i, j): (INSERT, "I") for i, initial, j in STEPS if initial in ROLES}))
    return times(once, times(once, once))


@lru_cache(None)
def turn_matrix(code: str) -> Matrix:
    """Of a turn's code: its initial (``-`` if none fits) and its fault: ``x`` to be deleted, ``t`` truncated, ``.`` none."""
    initial, fault = code
    entries = {(i, i): (DELETE, "D") for i in range(4)}
    if fault != "x":
        extra = TRUNCATED * (fault == "t")
        for i, letter, j in STEPS:
            ways = [(extra, "K")] * (letter == initial) + [(REROLE + extra, "R")] * (letter in ROLES)
            if ways:
                entries[i, j] = min(ways)
    return times(closure(), times(matrix(entries), closure()))


@lru_cache(100_000)
def _short(codes: str) -> Matrix:
    return turn_matrix(codes) if len(codes) == 2 else times(_short(codes[:-2]), turn_matrix(codes[-2:]))


def run_matrix(codes: str) -> Matrix:
    """The product of a run of turns, as a balanced tree over short runs."""
    if not codes:
        return closure()
    if len(codes) <= 2 * SHORT:
        return _short(codes)
    half = len(codes) // (4 * SHORT) * (2 * SHORT) or 2 * SHORT
    return times(run_matrix(codes[:half]), run_matrix(codes[half:]))


def solution(m: Matrix) -> tuple[int, str]:
    return min(m[j] for j in ENDS if m[j] is not None)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that each row's ``conv_id:turn`` names; nulls count as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def ordered(turns: DataFrame) -> DataFrame:
    """``turns`` sorted by conversation, turn (nulls first), role and text over range partitions, with their place and faults.

    ``part`` is the partition and ``at`` the place in it; a ``segment`` holds up to ``SEGMENT`` turns of one conversation.  Ranges follow the turns as well as the conversations,
    so a long conversation is spread over partitions.
    """
    visible = F.rtrim("text", F.lit(SPACE))
    blank = visible == ""
    truncated = ~blank & ~F.right(visible, F.lit(1)).isin(".", "!", "?")
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    same = F.md5(F.concat_ws(":", F.length(conv).cast("string"), conv, F.length("role").cast("string"), "role", "text"))
    rows = turns.select("conv_id", "turn", "role", "text", blank.alias("blank"), truncated.alias("truncated"), same.alias("same"))
    keys = ["conv_id", "turn", "role"]
    rows = rows.repartitionByRange(*keys, F.substring("text", 1, 64)).sortWithinPartitions(*keys, "text")
    kind = turns.schema["conv_id"].dataType.simpleString()

    def number(batches):
        part, at, segment, held, last = TaskContext.get().partitionId(), 0, 0, 0, None
        for batch in batches:
            places = []
            for conv in batch.column(0).to_pylist():
                if held == SEGMENT or (conv,) != last:
                    segment, held, last = segment + 1, 0, (conv,)
                held += 1
                places.append(segment)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * n, pa.int32()), pa.array(places, pa.int64()), pa.array(range(at, at + n), pa.int64())], [*batch.schema.names, "part", "segment", "at"])
            at += n

    turn = turns.schema["turn"].dataType.simpleString()
    return rows.mapInArrow(number, f"conv_id {kind}, turn {turn}, role string, text string, blank boolean, truncated boolean, same string, part int, segment long, at long")


def coded(turns: DataFrame) -> DataFrame:
    """(conv_id, part, segment, at, blank, duplicate, truncated, code) of ordered turns; each turn's first fault counts."""
    place = F.struct("part", "at")
    first = turns.groupBy("same").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("same", "first")
    rows = turns.select("conv_id", "part", "segment", "at", "role", "blank", "truncated", "same").join(first, "same", "left")
    duplicate = ~F.col("blank") & F.coalesce(place > F.col("first"), F.lit(False))
    truncated = F.col("truncated") & ~duplicate
    initial = F.substring("role", 1, 1)
    fault = F.when(F.col("blank") | duplicate, "x").when(truncated, "t").otherwise(".")
    code = F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("-"), fault)
    return rows.select("conv_id", "part", "segment", "at", "blank", duplicate.alias("duplicate"), truncated.alias("truncated"), code.alias("code"))


def legal(left: str, right: str) -> bool:
    return left + right in ("su", "ua", "au")


ELEMENT = "part int, segment long, blank long, duplicate long, truncated long, illegal long, first string, last string, costs array<long>, audits array<string>"
COUNTS = ("blank", "duplicate", "truncated", "illegal")


def joined(left: dict, right: dict) -> dict:
    """The element of two neighbouring runs: counts, outer initials and the product."""
    out = {c: left[c] + right[c] for c in COUNTS}
    out["illegal"] += not legal(left["last"], right["first"])
    return left | out | {"last": right["last"], "matrix": times(left["matrix"], right["matrix"])}


def folded(elements: Iterator[dict]) -> dict:
    """All elements joined in order, runs of equal length first, so that a long audit is copied a few times only."""
    stack: list[tuple[int, dict]] = []
    for e in elements:
        size = 1
        while stack and stack[-1][0] == size:
            e, size = joined(stack.pop()[1], e), 2 * size
        stack.append((size, e))
    out = stack.pop()[1]
    while stack:
        out = joined(stack.pop()[1], out)
    return out


def _batches(kind, elements: Iterator[dict], size: int = 1000) -> Iterator[pa.RecordBatch]:
    """Elements as record batches."""
    names = ("part", "segment", *COUNTS, "first", "last")
    kinds = {"part": pa.int32(), "first": pa.string(), "last": pa.string()}
    held: list[dict] = []

    def batch():
        of = lambda k, t: pa.array([[x and x[k] for x in e["matrix"]] for e in held], pa.list_(t))
        arrays = [pa.array([e["conv_id"] for e in held], _arrow(kind)), *(pa.array([e[c] for e in held], kinds.get(c, pa.int64())) for c in names), of(0, pa.int64()), of(1, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, ["conv_id", *names, "costs", "audits"])

    chars = 0
    for e in elements:
        held.append(e)
        chars += sum(len(x[1]) for x in e["matrix"] if x)
        if len(held) == size or chars > 20_000_000:
            yield batch()
            held, chars = [], 0
    yield batch()


def of_segments(rows: DataFrame) -> DataFrame:
    """One element for the turns of a conversation in a partition, from the codes of its segments."""
    of = rows.schema["conv_id"].dataType
    count = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    codes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]), "").alias("codes")
    segments = rows.groupBy("conv_id", "part", "segment").agg(*(count(c) for c in COUNTS[:3]), codes)

    def element(conv, part, segment, blank, duplicate, truncated, codes):
        initials = codes[::2]
        illegal = sum(not legal(a, b) for a, b in zip(initials, initials[1:]))
        return {"conv_id": conv, "part": part, "segment": segment, "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal, "first": initials[0], "last": initials[-1], "matrix": run_matrix(codes)}

    def rows_of(batches):
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "segment", *COUNTS[:3], "codes")), strict=True)

    def run(batches):
        return _batches(of, (folded(element(*r) for r in group) for _, group in groupby(rows_of(batches), key=lambda r: r[:2])))

    keys = ["conv_id", "part"]
    return segments.repartition(*keys).sortWithinPartitions(*keys, "segment").mapInArrow(run, f"conv_id {of.simpleString()}, {ELEMENT}")


def tree(elements: DataFrame, last: int | None) -> DataFrame:
    """One element a conversation: parts of ``FAN`` neighbouring partitions are joined, then of FAN times as many, and so on up to partition ``last``."""
    of = elements.schema["conv_id"].dataType

    def rows_of(batches):
        for batch in batches:
            for r in batch.to_pylist():
                r["matrix"] = tuple(None if c is None else (c, a) for c, a in zip(r.pop("costs"), r.pop("audits"), strict=True))
                yield r

    def run(batches):
        return _batches(of, (folded(group) for _, group in groupby(rows_of(batches), key=lambda r: (r["conv_id"], r["near"]))))

    span = 1
    while last is not None and span <= last:
        span *= FAN
        near = elements.withColumn("near", F.floor(F.col("part") / span)).select("conv_id", "near", *[c for c in elements.columns if c != "conv_id"])
        elements = near.repartition("conv_id", "near").sortWithinPartitions("conv_id", "near", "part").mapInArrow(run, f"conv_id {of.simpleString()}, {ELEMENT}")
    return elements


def solved(elements: DataFrame) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, audit) of whole conversations."""
    end = lambda j: F.struct(F.col("costs")[j].alias("cost"), F.col("audits")[j].alias("audit"))
    ends = F.filter(F.array(*(end(j) for j in ENDS)), lambda x: x["cost"].isNotNull())
    return elements.select("conv_id", *COUNTS, F.array_min(ends).alias("best")).select("conv_id", *COUNTS, "best.cost", "best.audit")


def _edits(batches):
    """(conv_id, turn, role, text, edit) of each kept, changed or inserted turn, and an end mark (edit None) after each conversation.

    Rows come by conversation, the audit's first.  The language leaves one choice: after a system turn kept in front, user and assistant alternate.
    """
    conv, audit, at, made = None, None, 0, 0

    def role() -> str:
        return "user" if made % 2 == 0 else "assistant"

    def inserted():
        nonlocal at, made
        while at < len(audit) and audit[at] == "I":
            yield conv, None, role(), "", "I"
            at, made = at + 1, made + 1

    for batch in batches:
        for c, a, turn, own, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "audit", "turn", "role", "text")), strict=True):
            if a is not None:
                if audit is not None:
                    yield from inserted()
                    yield conv, None, None, None, None
                conv, audit, at, made = c, a, 0, 0
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            system = edit == "K" and own[:1] == "s"
            yield conv, turn, own if edit == "K" else role(), text, edit
            made += not system
    if audit is not None:
        yield from inserted()
        yield conv, None, None, None, None


def with_audits(turns: DataFrame, answers: DataFrame) -> DataFrame:
    """The turns of a conversation in order behind its audit; one task streams a conversation, whatever its length."""
    head = answers.select("conv_id", F.lit(-1).alias("part"), F.lit(-1).cast("long").alias("at"), "audit", F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"))
    rows = turns.select("conv_id", "part", "at", F.lit(None).cast("string").alias("audit"), "turn", "role", "text").unionByName(head)
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "at")


def repaired_turns(turns: DataFrame, answers: DataFrame) -> DataFrame:
    """(conv_id, place, turn, role, text, edit): the sound conversations; inserted turns have no turn number."""
    schema = turns.schema

    def run(batches):
        rows, place = [], 0
        for conv, turn, role, text, edit in _edits(batches):
            if edit is None:
                place = 0
                continue
            rows.append((conv, place, turn, role, text, edit))
            place += 1
            if len(rows) == 1000:
                yield _table(rows)
                rows = []
        yield _table(rows)

    def _table(rows):
        kinds = [_arrow(schema["conv_id"].dataType), pa.int64(), _arrow(schema["turn"].dataType), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["conv_id", "place", "turn", "role", "text", "edit"])

    return with_audits(turns, answers).mapInArrow(run, f"conv_id {schema['conv_id'].dataType.simpleString()}, place long, turn {schema['turn'].dataType.simpleString()}, role string, text string, edit string")


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def digests(turns: DataFrame, answers: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): of the repaired ``role:text``, joined by newlines."""
    kind = turns.schema["conv_id"].dataType

    def run(batches):
        state, first, out = hashlib.sha256(), True, []
        for conv, _, role, text, edit in _edits(batches):
            if edit is None:
                out.append((conv, state.hexdigest()))
                state, first = hashlib.sha256(), True
                if len(out) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], _arrow(kind)), pa.array([x[1] for x in out])], ["conv_id", "repaired_sha256"])
                    out = []
                continue
            state.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
            first = False
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], _arrow(kind)), pa.array([x[1] for x in out], pa.string())], ["conv_id", "repaired_sha256"])

    return with_audits(turns, answers).mapInArrow(run, f"conv_id {kind.simpleString()}, repaired_sha256 string")


def gaps(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps): turn numbers that are missing between the first and the last."""
    wide = lambda c: c.cast("decimal(38,0)")
    span = wide(F.max("turn")) - wide(F.min("turn")) + 1 - wide(F.count_distinct("turn"))
    return turns.groupBy("conv_id").agg(F.when(F.count("turn") == 0, 0).otherwise(F.least(span, wide(F.lit((1 << 63) - 1)))).cast("long").alias("gaps"))


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ordered turns, answers) of conversations (conv_id, turn, role, text).

    Turns follow their number, nulls first; turns of one number follow role and text.  Rows without conv_id form one conversation.  Roles whose first
    letter is none of s, u and a, and empty ones, must be changed or deleted.  Other columns are ignored; an empty table gives no rows.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = materialize(ordered(turns.select("conv_id", "turn", text("role"), text("text"))), "turns")
    last = rows.agg(F.max("part")).first()[0]
    return rows, materialize(solved(tree(of_segments(coded(rows)), last)), "audits")


def structure(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for each conversation of ``conversations``: faults and cheapest repair of its ``turns``; none left: zeros and empty texts."""
    rows, answers = repair(turns)
    numbers = ["gaps", *COUNTS, "cost"]
    kinds = dict.fromkeys(numbers, "long") | {"audit": "string", "repaired_sha256": "string"}
    wide = lambda df: df.select("conv_id", *(F.col(c) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()))
    every = wide(conversations.select("conv_id").distinct())
    for part in (answers, gaps(rows), digests(rows, answers)):
        every = every.unionByName(wide(part))
    nothing = hashlib.sha256().hexdigest()
    return every.groupBy("conv_id").agg(*(F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c) for c in numbers), F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(nothing)).alias("repaired_sha256"))
