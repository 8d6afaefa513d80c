import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa  # noqa: F401
import pytest
from mnemo.llm import common
from mnemo.llm.embeddings import link_vectors
from mnemo.llm.lexer import words_of
from mnemo.llm.minhash import drop_near_duplicates, near_duplicates
from mnemo.llm.shingles import Icws, similarity


def corpus():
    random.seed(3)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = [[random.choice(vocabulary) for _ in range(120)] for _ in range(40)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    for k in range(8):
        near = list(texts[k])
        near[60] = "changed"
        rows.append((100 + k, " ".join(near)))  # 5 of 116 shingles differ
        rows.append((200 + k, " ".join(texts[k]).upper()))
    rows += [(300, None), (301, ""), (302, "..."), (303, "two words"), (304, "Two words"), (300, None), (305, " ".join(texts[0]) + " x" * 400)]
    return rows


def test_classes_match_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, key string")
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    classes = {r["doc_id"]: r["class_id"] for r in got}
    for k in range(8):
        assert classes[100 + k] == classes[200 + k] == k
    assert classes[304] == 303 and all(classes[i] == i for i in (300, 301, 302, 305))
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 17
    assert near_duplicates(docs.limit(0)).count() == 0


def test_samples_estimate_the_weighted_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 32, 400, dtype=np.uint32))
    b = np.unique(np.concatenate([a[:300], rng.integers(0, 1 << 32, 80, dtype=np.uint32)]))
    wa, wb = (np.where(x % 3 == 0, 2.5, 1.0).astype(np.float32) for x in (a, b))
    sig = Icws(2000).samples(np.concatenate([a, b]), np.concatenate([wa, wb]), np.array([len(a), len(b)]))
    assert abs((sig[0] == sig[1]).mean() - similarity((a, wa), (b, wb))) < 0.05


def test_words_do_not_depend_on_their_neighbours():
    texts = ["Été l'hiver «oui» x_1 2.5", None, "", "İx ẞtraße été"]
    alone = [next(iter(words_of([t]))).tolist() for t in texts]
    assert [w.tolist() for w in words_of(texts)] == alone
    assert len(alone[0]) == 7 and alone[0][0] == alone[3][2] and alone[1] == alone[2] == []


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 16))
    rows = [base[k] for k in range(60)] + [base[k % 5] + 0.03 * rng.standard_normal(16) for k in range(700)] + [base[7]] * 3
    vectors = [[float(np.float32(x)) for x in v] for v in rows] + [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None], [2.0, 0.0], [1.0, 0.0]]
    df = spark.createDataFrame([(k, v, 1) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in link_vectors(df).collect()}
    unit = np.array(vectors[:len(rows)])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.95
    np.fill_diagonal(links, False)
    found = sum(got[k]["n_links"] for k in range(len(rows)))
    assert 0.99 * links.sum() <= found <= links.sum()
    assert all(got[k]["component_id"] == k % 5 for k in range(5)) and got[len(rows) - 1]["component_id"] == 7
    assert all(got[len(rows) + k]["n_links"] == 0 for k in range(5)) and got[len(rows) + 6]["n_links"] == 1
    assert link_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [1_000_000, 30])
def test_components_against_union_find(spark, monkeypatch, limit):
    """Chains, repeated edges, loops and nulls; the small limit takes the star steps."""
    monkeypatch.setattr(common, "LOCAL_EDGES", limit)
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)]
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    links = spark.createDataFrame([*edges, *edges[:9], (None, 3), (4, None)], "a long, b long").repartition(3)
    got = [tuple(r) for r in common.connected_components(links).collect()]
    assert sorted(got) == sorted((x, find(x)) for x in parent)
    assert common.connected_components(links.where("a < 0")).count() == 0


def test_group_of_edited_copies_against_all_pairs(spark):
    """Edits of one text that are far from each other, and chains between them: more than one block of a bucket."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(100)]
    rows = []
    for k in range(150):
        text = list(base)
        for at in rng.sample(range(100), 1 + k % 4):
            text[at] = f"x{rng.randrange(40)}"
        rows.append((k, " ".join(text)))
    label = brute_classes([t for _, t in rows])
    got = dict(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    apart = [k for k in range(len(rows)) if got[k] != got[label[k]]]
    assert len(apart) <= 1, apart  # candidates are probabilistic
    assert all(label[k] == label[got[k]] for k in range(len(rows)))


def brute_classes(texts, threshold=0.8):
    """Least row of each row's class by all pairs, from the definition of the weights."""
    tf = [Counter(tuple(t.split()[i:i + 5]) for i in range(max(1, len(t.split()) - 4))) for t in texts]
    df = Counter(s for c in tf for s in c)
    weight = {s: 1 + 0.25 * math.log(min(len(texts) / n, 128)) / math.log(128) for s, n in df.items()}
    label = list(range(len(texts)))
    for i, a in enumerate(tf):
        for j, b in enumerate(tf[:i]):
            both = sum(min(n, b[s]) * weight[s] for s, n in a.items() if s in b)
            total = sum(n * weight[s] for c in (a, b) for s, n in c.items())
            if both >= threshold * (total - both) and label[i] != label[j]:
                x, y = sorted((label[i], label[j]))
                label = [x if k == y else k for k in label]
    return label


def test_weighted_classes_against_all_pairs(spark):
    """Frequent passages in unrelated texts, texts that repeat a passage, and edits around the threshold."""
    rng = random.Random(21)
    passage = [f"p{k}" for k in range(60)]
    texts = []
    for k in range(60):
        text = [f"w{rng.randrange(9000)}" for _ in range(rng.choice([30, 80, 200]))]
        texts.append(text + passage * (k % 3))
        for edits in (1, 2, 3, 5)[:k % 5]:
            near = list(texts[-1])
            for at in rng.sample(range(len(text)), edits):
                near[at] = f"x{rng.randrange(9000)}"
            texts.append(near)
        if k % 4 == 0:
            texts.append(text + text)
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    label = brute_classes([t for _, t in rows])
    got = dict(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    assert len(set(label)) < len(rows) and [got[k] for k in range(len(rows))] == label


def test_rows_that_repeat_a_doc_id(spark):
    words = [" ".join(f"{x}{k}" for k in range(40)) for x in "abc"]
    rows = [(1, words[0]), (1, words[1]), (2, words[1]), (3, words[2]), (3, words[2]), (4, None), (4, None), (None, words[2]), (5, words[2] + " end")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, h string")
    kept = sorted(((r["doc_id"], r["text"]) for r in drop_near_duplicates(docs).collect()), key=str)
    assert kept == sorted([(1, words[0]), (1, words[1]), (3, words[2]), (4, None), (4, None), (None, words[2])], key=str)


def test_similarities_of_one_set_with_several():
    from mnemo.llm.shingles import similarities

    rng = np.random.default_rng(4)
    sets = [(np.unique(rng.integers(0, 60, 40)).astype(np.uint32), None) for _ in range(12)]
    sets = [(h, rng.random(len(h)).astype(np.float32) + 1) for h, _ in sets]
    assert np.allclose(similarities(sets[0], sets), [similarity(sets[0], s) for s in sets])
