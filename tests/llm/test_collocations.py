import random
import re
import sys
from collections import Counter

from mnemo.llm import collocations as M

SCHEMA = "text string, lang string, rank long, n string"


def brute(rows, least, most, percent=100):
    total, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for n in range(1, 6):
                for k in range(len(words) - n + 1):
                    f[lang, tuple(words[k:k + n])] += 1
    phrases = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in phrases.items():
        longer = [b for (x, q), b in phrases.items() if x == lang and len(q) > len(p) and any(q[k:k + len(p)] == p for k in range(len(q))) and 100 * b >= percent * a]
        if longer:
            continue
        score, k = min((1000 * a * total[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], total[lang]))
    return sorted((lang, r + 1, p.decode(), -a, x, y, n, -s) for lang, found in out.items() for r, (s, a, p, x, y, n) in enumerate(sorted(found)[:most]))


def answers(spark, rows, least=3, most=20, percent=100):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    got = M.collocations(df, least, most, percent).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    return sorted(map(tuple, got))


def messy(seed, docs=60):
    rng = random.Random(seed)
    words = ["The", "of", "été", "ÀB", "x y", "a\tb", "one", "one", "İ", "cat", "cat\x0bdog", " ", "é", "The of", "q" * 30]
    marks = [" ", " ", "  ", " \t ", ", ", ".", "\n", "\r\n", "!? "]
    texts = ["".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randrange(60))) for _ in range(docs)]
    return [(t, rng.choice(["en", "fr", None, "e n", "de\nx"])) for t in texts] + [(None, "en"), ("", None), (" \t ", "fr"), (texts[0], "en"), (texts[0], "en")]


def test_messy_texts_against_brute_force(spark):
    rows = messy(1)
    assert answers(spark, rows) == brute(rows, 3, 20)
    assert answers(spark, rows, 4, 5, 60) == brute(rows, 4, 5, 60)


def test_overlaps_and_long_pieces(spark, monkeypatch):
    monkeypatch.setattr(M, "CUT", 7)  # pieces of more than seven words are cut
    rng = random.Random(2)
    rows = [(" ".join(rng.choice("abc") for _ in range(n)), "en") for n in (1, 2, 6, 7, 8, 13, 14, 15, 40, 40)] + [("x x x x x x", "en")] * 3
    assert answers(spark, rows, 3, 1000) == brute(rows, 3, 1000)


def test_small_blocks_and_one_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(M, "PIECES", 5)
    monkeypatch.setattr(M, "MAX_BUCKETS", 1)
    rows = messy(3)
    assert answers(spark, rows) == brute(rows, 3, 20)


def test_out_of_core(spark, monkeypatch):
    monkeypatch.setattr(M, "MAX_BUCKETS", 1)
    monkeypatch.setattr(M, "MEMORY", "20MB")  # the sums of this text need more
    rng = random.Random(4)
    rows = [(" ".join(f"word{rng.randrange(40_000)}" for _ in range(40_000)), "en") for _ in range(10)] + [("a b c. " * 50, "en")]
    got = answers(spark, rows, 40)
    assert [r[2:4] for r in got] == [("a b c", 50)] and got[0][6] == 400_150


def test_very_long_text_and_empty_table(spark):
    got = answers(spark, [("so it goes " * 200_000, "en")], 100)
    assert {r[2]: r[3] for r in got} == {"so it goes so it": 199_999, "it goes so it goes": 199_999, "goes so it goes so": 199_998} | {"so it goes": 200_000}
    assert answers(spark, []) == [] and answers(spark, [(None, None)]) == []


def test_sums_of_a_block_take_no_step_in_python_for_each_word():
    rng = random.Random(5)
    words = [f"word{k}" for k in range(300)]
    keys = [f"en\n{' '.join(rng.choices(words, k=12))}" for _ in range(3000)]
    table = M.pa.table({"key": keys, "m": [1] * len(keys)})
    want = Counter(g for key in keys for w in [key[3:].split(" ")] for g in [*w, *map(" ".join, zip(w, w[1:]))])
    calls = []
    sys.setprofile(lambda frame, event, what: calls.append(event))
    try:
        got = M.short_grams(M.Words(table))
    finally:
        sys.setprofile(None)
    assert dict(zip(got["gram"].to_pylist(), got["w"].to_pylist(), strict=True)) == {f"en\n{g}": n for g, n in want.items()}
    assert len(calls) < 5000 < 36_000
