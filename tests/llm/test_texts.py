import math
import random
import zlib

import numpy as np
from mnemo.llm import decontamination
from mnemo.llm.decontamination import contaminations, drop_contaminated
from mnemo.llm.language import fit as fit_language
from mnemo.llm.language import identify
from mnemo.llm.packing import pack_documents, packed_sequences
from mnemo.llm.queries import QUERIES
from mnemo.llm.rans import encode_documents, read_token_files
from mnemo.llm.token_counts import SPACE, UnigramTrie, count_tokens
from mnemo.llm.tokenizing import tokenizer_file
from mnemo.llm.toxicity import drop_toxic, fit, score_documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
ITEM = "A train leaves Boston with 120 people and arrives after 3 hours, so it needs 3 hours more than the train from Denver with 80 people."
CASES = [None, "", " ", "Straße, ÉTÉ! İstanbul ŉa Ǆ ﬁn e\u0301te\u0301 Σίσυφος x2 l'été don't",  "plain words, and more words.", "Ünïcode «x» 日本語 12.5 km\n\n  two  spaces", "a" * 30000, "x " * 4000, "\ttab\r\nline"]


def test_decontamination_finds_new_values_and_checks_slots(spark):
    again = ITEM.replace("Boston", "Lyon").replace("120", "75").replace("3 hours", "9 hours").replace("Denver", "Madrid").replace("80", "11")
    broken = again.replace("9 hours more", "8 hours more")
    rows = [(1, "Before. " + ITEM + " After."), (2, again), (3, None), (4, ""), (5, "clean text of no item at all but some length to look at here"), (6, broken), (2, "other")]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(0, ITEM), (1, None), (2, "")], "item_id long, text string")
    found = {r["doc_id"]: r for r in contaminations(docs, bench).collect()}
    assert found[1]["changed"] == 0 and found[2]["changed"] > 0 and not {3, 4, 5} & set(found)
    assert 6 not in found or found[6]["covered"] < found[2]["covered"]
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {3, 4, 5} <= {r[0] for r in kept.select("doc_id").collect()}
    assert [r[1] for r in kept.where("doc_id = 2").collect()] == ["other"]
    assert contaminations(docs.limit(0), bench).count() == 0 and contaminations(docs, bench.limit(0)).count() == 0


def test_one_value_stands_for_one_value(spark, monkeypatch):
    """Every window of this item holds its value twice, so other values count only if they are all the same; blocks change nothing."""
    item = "sum the 3 parts then take 3 more parts and add 3 to them before 3 people count 3 times over 3 days"
    values = iter("24567891")
    rows = [(1, item.replace("3", "7")), (2, "".join(next(values) if c == "3" else c for c in item)), (3, "so: " + item), (None, item)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string")
    for block in (decontamination.BLOCK, 3):
        monkeypatch.setattr(decontamination, "BLOCK", block)
        found = {r["doc_id"]: r["changed"] for r in contaminations(docs, bench).collect()}
        assert set(found) == {1, 3} and found[1] > 0 == found[3]
        assert [r[0] for r in drop_contaminated(docs, bench).collect()] == [2]


def test_decontamination_finds_verbatim_copies_of_few_literals(spark):
    items = ["Compute 12 + 7 x 5 - 3 + 18 * 4 / 2 - 9 + 33 - 1 + 6", "Name the order: Mercury Venus Earth Mars Jupiter Saturn Uranus Neptune Pluto Ceres Eris Haumea",
             "Which planet is the closest one to the sun in our system?", "In which year did Ada Lovelace write to Charles Babbage about Bernoulli numbers in London", "1 2 3 4 5 6"]
    copies = [(0, f"So: {items[0]} = ?", 0), (1, f"See here. {items[1]}, and more.", 1), (2, f"Question: {items[2]} Answer: none", 2),
              (3, "and " + items[3].lower() + " again", 3), (4, items[3].replace("Ada", "\nAda").replace("Charles", "\nCharles").replace("Bernoulli", "\nBernoulli"), 3), (5, "a 1 2 3 4 5 6 b", 4)]
    clean = [(10, "Compute 11 + 8 x 6 - 2 + 17 * 5 / 3 - 8 + 32 - 2 + 7", -1), (11, "1 2 3 4 5 7", -1), (12, "Which planet is far", -1)]
    docs = spark.createDataFrame([r[:2] for r in copies + clean], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in contaminations(docs, bench).collect()}
    assert set(found) == {(d, i) for d, _, i in copies}
    assert all(r["covered"] == r["n_tokens"] and r["changed"] == 0 for r in found.values())


def test_toxicity_learns_and_filters(spark):
    random.seed(1)
    rows, labels = [], []
    for k in range(400):
        toxic = k % 4 == 0
        words = [random.choice("abcdefgh") * 3 for _ in range(30)] + (["scum"] if toxic else [])
        rows.append((k, " ".join(words), "t"))
        labels.append((k, 1, int(toxic)) if k < 300 else (k, None, None))
    docs = spark.createDataFrame(rows + [(900, None, "t"), (901, "", "t"), (0, rows[0][1], "t")], "doc_id long, text string, p_toxic string")
    chain = fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = [(r["doc_id"], r["p_toxic"]) for r in score_documents(docs, chain).collect()]
    assert len(got) == 403 and all((p >= 0.5) == (k < 400 and k % 4 == 0) for k, p in got)
    assert drop_toxic(docs, chain).columns == docs.columns and drop_toxic(docs, chain).count() == 302
    assert score_documents(docs.limit(0), chain).count() == 0


def test_chain_probabilities_by_hand_and_on_held_out_rows(spark):
    """Rare marks of a category among many words of single documents; the marks of the first category matter for the second."""
    rng = random.Random(8)
    marks = [f"mark{chr(97 + k)}" for k in range(12)]
    rows, labels = [], []
    for k in range(1200):
        low, toxic = rng.random() < 0.3, rng.random() < 0.15
        words = [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(80)]
        words += rng.sample(marks[:4], 2) * low + rng.sample(marks[4:], 3) * toxic
        rng.shuffle(words)
        rows.append((k, " ".join(words).title()))
        labels.append((k, None if k % 50 == 0 else int(not low), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chain = fit(docs, spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r for r in score_documents(docs, chain).collect()}
    for k, text in rows[::37]:
        counts, before = {}, []
        for w in text.lower().split():
            counts[w] = counts.get(w, 0) + 1
        for weights in chain.weights:
            z = weights[-1] + sum(math.log2(1 + n) * weights[chain.words[w]] for w, n in counts.items() if w in chain.words)
            z += sum(p * weights[len(chain.words) + j] for j, p in enumerate(before))
            before.append(1 / (1 + math.exp(-z)))
        assert abs(got[k]["p_low_quality"] - before[0]) < 1e-9 and abs(got[k]["p_toxic"] - before[1]) < 1e-9
    held = [(k, toxic) for k, _, toxic in labels if k % 3 == 0]
    found = [got[k]["p_toxic"] >= 0.5 for k, toxic in held if toxic]
    assert sum(found) > 0.85 * len(found) and not any(got[k]["p_toxic"] >= 0.5 for k, toxic in held if not toxic)


def test_language_held_out(spark):
    got = QUERIES["op9_language_id"](spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = got.collect()
    assert rows and sum(r["lang_pred"] == r["lang"] for r in rows) > 0.95 * len(rows)
    docs = spark.createDataFrame([(1, "the cat sat", "en"), (2, "le chat noir", "fr"), (3, None, None), (4, "123 !", "en"), (5, "cat", None), (6, "½ ² ①", "en"), (None, "le chat", None), (5, "cat", None)], "doc_id long, text string, lang string")
    rows = identify(docs, fit_language(docs)).collect()
    named = {r["doc_id"]: r for r in rows}
    assert len(rows) == 8 and named[6]["lang_pred"] == "und" and named[None]["lang_pred"] == "fr"
    assert named[5]["lang_pred"] == "en" and named[3]["lang_pred"] == named[4]["lang_pred"] == "und" and named[2]["lang_pred"] == "fr"
    assert identify(docs.limit(0), fit_language(docs.limit(0))).count() == 0


def test_language_model_does_not_depend_on_partitions_or_larger_languages(spark):
    rng = random.Random(4)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(7))
    rows = [(k, " ".join(word("abcdefgh") for _ in range(60)) + " the the", "big") for k in range(40)] + [(100 + k, f"{word('pqrstuvw')} {word('pqrstuvw')} zyx", "small") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    entries = []
    for parts in (1, 60):
        model = fit_language(docs.repartition(parts, "doc_id"))
        entries.append([{e: tuple(table[at].tolist()) for e, at in place.items()} for place, table in zip(model.places, model.tables, strict=True)])
    assert entries[0] == entries[1]
    seen = {g for _, t, _ in rows for w in t.split() for g in (f"<{w}>"[k:k + 5] for k in range(len(w) - 2))}
    assert set(entries[0][5]) == {g for g in seen if len(g) == 5}
    bounded = fit_language(docs, max_words=50, max_grams=200)
    for lang, words in (("big", {w for _, t, x in rows if x == "big" for w in t.split()}), ("small", {w for _, t, x in rows if x == "small" for w in t.split()})):
        assert 25 <= len(words & set(bounded.places[0])) <= 75, lang
    assert {"the", "zyx"} <= set(bounded.places[0])


def brute_tokens(word, pieces, floor):
    text = SPACE + word
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        size = len(text[end - 1].encode())
        options = [(best[end - 1][0] + size * floor, -(best[end - 1][1] + size))]
        options += [(best[s][0] + pieces[text[s:end]], -(best[s][1] + 1)) for s in range(end) if text[s:end] in pieces]
        top = max(options)
        best.append((top[0], -top[1]))
    return best[-1][1]


def test_trie_counts_match_brute_force(spark):
    random.seed(2)
    pieces = {SPACE: -4.0, **{"".join(random.choice("abé") for _ in range(random.randint(1, 4))): -random.randint(1, 9) / 2 for _ in range(40)}}
    trie = UnigramTrie(pieces)
    words = {"".join(random.choice("abcé日") for _ in range(random.randint(1, 12))) for _ in range(400)}
    trie.learn(words)
    for w in words:
        assert trie.tokens(w) == brute_tokens(w, pieces, trie.floor)
    docs = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in count_tokens(docs, tokenizer_file("piece_bpe_32k.model")).collect()}
    assert got[0]["n_tokens"] == got[1]["n_tokens"] == got[2]["n_pretokens"] == 0 and got[7]["n_pretokens"] == 4000


def ids_of(name, text, end):
    return np.array(Tokenizer.from_file(tokenizer_file(name)).encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_token_files_round_trip(spark):
    docs = spark.createDataFrame([(k * 3 if k else None, t, 1) for k, t in enumerate(CASES)], "doc_id long, text string, ids int")
    got = sorted(read_token_files(spark, encode_documents(docs, tokenizer_file("word_bpe_49k.json"), True, 1)).collect(), key=lambda r: r["doc_id"] or 0)
    assert got[0]["doc_id"] is None
    start = 0
    for r, text in zip(got, CASES, strict=True):
        want = ids_of("word_bpe_49k.json", text, 1)
        assert r["ids"] == want.tobytes() and r["start"] == start and r["n_tokens"] == len(want)
        start += len(want)
    assert read_token_files(spark, encode_documents(docs.limit(0), tokenizer_file("word_bpe_49k.json"), True, 1)).count() == 0


def test_packing_places_every_piece(spark):
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(CASES * 5)], "doc_id long, text string, length int")
    placed = pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), with_ids=True)
    rows = placed.collect()
    for k, text in enumerate(CASES * 5):
        want = ids_of("byte_bpe_50k.json", text, 2)
        mine = sorted((r for r in rows if r["doc_id"] == k), key=lambda r: r["piece"])
        assert b"".join(r["ids"] for r in mine) == want.tobytes() and all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in mine)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    assert packed_sequences(placed).agg(F.sum("n_tokens")).first()[0] == sum(r["length"] for r in rows)
    assert pack_documents(docs.limit(0), tokenizer_file("byte_bpe_50k.json")).count() == 0


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert 0.5 * docs.count() <= out.count() <= docs.count(), name
        docs = out
