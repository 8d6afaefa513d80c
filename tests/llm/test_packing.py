import bisect
import random
from collections import Counter

import pytest
from mnemo.llm.packing import best_plan, pack_documents
from mnemo.llm.tokenizing import tokenizer_file


def opened(counts, capacity):
    """Sequences of plain best fit, longest first."""
    rooms: list[int] = []
    n = 0
    for length in sorted((x for x, k in counts.items() for _ in range(k)), reverse=True):
        at = bisect.bisect_left(rooms, length)
        if at == len(rooms):
            n += 1
            room = capacity
        else:
            room = rooms.pop(at)
        bisect.insort(rooms, room - length)
    return n


def lengths(kind):
    r = random.Random(kind)
    if kind == "middle":
        return [r.randrange(100, 601) for _ in range(3000)]
    if kind == "any":
        return [r.randrange(1, 1025) for _ in range(3000)]
    if kind == "thirds":
        return [r.choice([300, 320, 338, 341, 345]) for _ in range(3000)]
    return [min(1024, int(r.lognormvariate(4.5, 1.2)) + 1) for _ in range(4000)]


@pytest.mark.parametrize("kind", ["middle", "any", "thirds", "lognormal"])
def test_no_more_sequences_than_best_fit(kind):
    counts = dict(Counter(lengths(kind)))
    plan = best_plan(counts)
    placed, used = Counter(), {}
    for length, _, n, first, offset in plan:
        placed[length] += n
        for k in range(first, first + n):
            used.setdefault(k, []).append((offset, length))
    assert placed == counts
    for parts in used.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(used) == max(used) + 1 <= opened(counts, 1024)


def test_the_given_documents_come_near_the_lower_bound(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pack_documents(docs, tokenizer_file("byte_bpe_50k.json")).toPandas()
    least = -(-rows["length"].sum() // 1024)
    n = rows["sequence_id"].nunique()
    assert n <= opened(Counter(rows["length"].tolist()), 1024) and n <= least * 1.003
