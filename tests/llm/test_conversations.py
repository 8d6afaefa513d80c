import hashlib
import itertools
import random
import re
import zlib

from mnemo.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, code string, part int"
SOUND = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"


def cheapest(codes):
    """(cost, audit) by a scan over states that keeps whole audits, with insertions tried one by one."""
    def grow(ways):
        for _ in range(3):
            for i, letter, j in C.STEPS:
                if letter in "ua" and i in ways:
                    new = (ways[i][0] + 3, ways[i][1] + "I")
                    if j not in ways or new < ways[j]:
                        ways[j] = new
        return ways

    ways = grow({0: (0, "")})
    for initial, fault in codes:
        after = {}
        for i, (cost, audit) in ways.items():
            options = [(i, cost + 4, "D")]
            if fault != "x":
                extra = 3 * (fault == "t")
                options += [(j, cost + extra, "K") for a, letter, j in C.STEPS if a == i and letter == initial]
                options += [(j, cost + 3 + extra, "R") for a, letter, j in C.STEPS if a == i and letter in "ua"]
            for j, c, e in options:
                if j not in after or (c, audit + e) < after[j]:
                    after[j] = (c, audit + e)
        ways = grow(after)
    return min(ways[j] for j in (0, 3) if j in ways)


def exhaustive(codes):
    """(cost, audit) among all edits with up to two insertions anywhere."""
    inserts = [(3 * len(x), "I" * len(x), "".join(x)) for n in range(3) for x in itertools.product("ua", repeat=n)]
    ways = set(inserts)
    for initial, fault in codes:
        choice = [(4, "D", "")]
        if fault != "x":
            e = 3 * (fault == "t")
            choice += [(e, "K", initial), (3 + e, "R", "u"), (3 + e, "R", "a")]
        ways = {(c + d + f, a + b + g, r + s + h) for c, a, r in ways for d, b, s in choice for f, g, h in inserts}
    return min((c, a) for c, a, r in ways if SOUND.fullmatch(r))


def codes_of(rng, n):
    return [rng.choice("sua-") + rng.choice("x..t.") for _ in range(n)]


def test_matrices_against_all_edits():
    rng = random.Random(1)
    for n in (0, 1, 2, 2, 2, 2, 2, 3):
        codes = codes_of(rng, n)
        assert C.solution(C.run_matrix("".join(codes))) == exhaustive(codes)


def test_any_bracketing_gives_the_same():
    rng = random.Random(2)
    for n in (4, 9, 40, 333):
        codes = codes_of(rng, n)
        whole = C.run_matrix("".join(codes))
        assert C.solution(whole) == cheapest(codes)
        cut = rng.randrange(1, n)
        assert C.times(C.run_matrix("".join(codes[:cut])), C.run_matrix("".join(codes[cut:]))) == whole


def brute(rows):
    """The contract, row by row."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if kind:
                text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
                turns += [(turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        counts, codes, seen = dict(blank=0, duplicate=0, truncated=0), [], set()
        for _, role, text in turns:
            bare = text.rstrip(SPACE)
            fault = "blank" if not bare.strip(SPACE) else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            codes.append((role[:1] if role[:1] in "sua" and role else "-") + {None: ".", "truncated": "t"}.get(fault, "x"))
        numbers = [t[0] for t in turns if t[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(codes))
        cost, audit = cheapest(codes)
        lines, made, rest = [], 0, iter(turns)
        for e in audit:
            role = "user" if made % 2 == 0 else "assistant"
            if e == "I":
                lines.append(f"{role}:")
                made += 1
                continue
            _, own, text = next(rest)
            if e != "D":
                lines.append(f"{own if e == 'K' else role}:{text}")
                made += not (e == "K" and own[0] == "s")
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def messy(rng, conversations, longest):
    words = ["Yes.", "No!", "why", "", "  ", "\n\t", "Same.", "é?", "end. \n", None, "a:b."]
    rows = []
    for c in conversations:
        for t in range(rng.randrange(0, longest)):
            turn = None if rng.random() < 0.05 else t if rng.random() < 0.9 else rng.randrange(2 * longest)
            rows.append((c, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "sudo"]), rng.choice(words) if rng.random() < 0.5 else f"text {rng.randrange(999)}."))
    return rows


def check(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "q", 1) for r in rows], SCHEMA).repartition(parts)
    got = {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in C.structure(df, C.damaged(df)).collect()}
    assert got == brute(rows)


def test_query_against_brute_force(spark):
    check(spark, messy(random.Random(7), [*range(40), None, -5], 9))


def test_conversations_over_many_partitions(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"t{rng.randrange(2000)}.") for t in range(3000)] + [(2, None, "user", f"n{k}") for k in range(700)] + [(3, 4, "system", "hi.")] * 600
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(C, "FAN", 2)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        check(spark, rows + messy(rng, range(10, 20), 6), 4)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_very_long_text_and_empty_table(spark):
    check(spark, [(1, 0, "user", "word " * 200_000 + "."), (1, 1, "assistant", " " * 1_000_000), (1, 2, "assistant", "x" * 500_000)])
    check(spark, [])


def test_repaired_turns(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s."), (1, 1, "assistant", "a."), (1, 2, "user", "b."), (1, 3, "user", "")], "conv_id long, turn long, role string, text string")
    rows = C.repaired_turns(*C.repair(turns)).orderBy("place").collect()
    assert "".join(r["role"][0] for r in rows) == "suaua" and [r["place"] for r in rows] == list(range(5))
    assert [r["edit"] for r in rows] == list("KIKKI") and [r["turn"] for r in rows] == [0, None, 1, 2, None] and rows[1]["text"] == ""
