import random
from collections import Counter

import numpy as np
import pytest

import tidewater.llm.exchange as E
import tidewater.llm.near_dedup as N
from tidewater.llm.exchange import sizes


def docs_of(seed=1, n=120):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    out = []
    for i in range(n):
        if i % 4 == 3:
            words = out[rng.randrange(len(out))][1].split()
            for _ in range(rng.choice([0, 1, 2, 12])):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocab)
        else:
            words = [rng.choice(vocab) for _ in range(rng.randint(60, 200))]
        out.append((i, " ".join(words)))
    return out


def brute(docs, total):
    """Classes by all pairs, with the documented weights."""
    feats = []
    for _, t in docs:
        w = "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)] or ([tuple(w)] if w else [])
        feats.append(Counter(grams))
    df = Counter(g for f in feats for g in f)
    weight = [{g: c * (1 + N.IDF_SHARE * np.log(total / df[g]) / np.log(total)) for g, c in f.items()} for f in feats]
    union = N.Union()
    for a in range(len(docs)):
        for b in range(a):
            x, y = weight[a], weight[b]
            low = sum(min(x[g], y[g]) for g in x.keys() & y.keys())
            if x and y and low / (sum(x.values()) + sum(y.values()) - low) >= N.THRESHOLD:
                union.join(docs[a][0], docs[b][0])
    return {i: union.find(i) for i, _ in docs}


def classes(spark, docs):
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, class_id int")
    return {r["doc_id"]: r["class_id"] for r in N.near_duplicates(df).collect()}


def test_classes_against_all_pairs(spark):
    docs = docs_of()
    assert classes(spark, docs) == brute(docs, len(docs))


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "!!! ..."), (4, "one two"), (5, "One, two!"), (6, "one two three"), (7, "x " * 3000), (8, "x " * 3000)]
    got = classes(spark, docs)
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7}
    assert classes(spark, [(1, "a b")] * 3) == {1: 1}
    assert classes(spark, [(None, "a b c")]) == {None: None}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(empty).count() == 0
    assert sizes(empty) == (1, 1)


def test_large_group_of_copies_is_one_class(spark):
    base = docs_of(3, 1)[0][1]
    got = classes(spark, [(i, base) for i in range(300)] + [(1000 + i, base + f" tail{i}") for i in range(40)])
    assert set(got.values()) == {0}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["id"]: r["class_id"] for r in N.components(links).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def test_samples_estimate_similarity():
    rng = np.random.default_rng(4)
    h = np.sort(rng.integers(0, 1 << 48, 1000, dtype=np.uint64) << np.uint64(16))
    w = np.ones(900, np.float32)
    agree = np.mean([(N.sample(np.sort(rng.permutation(h)[:900]), w) == N.sample(h[:900], w)).mean() for _ in range(20)])
    assert 0.6 < agree < 0.95


def test_powers_serve_any_length():
    data = np.frombuffer(("word" * 50 + " ").encode() * 7, np.uint8)
    d, h, c = N.shingles(data, np.array([0, len(data)]))
    assert len(h) == 1 and c.tolist() == [3]


def edited(rng, words, n):
    """With n words replaced, far enough from each other that each takes five features."""
    out = list(words)
    for k in rng.sample(range(len(out) // 10), n):
        out[10 * k + rng.randrange(5)] = "".join(rng.choice("klmnopqrst") for _ in range(8))
    return out


def small_chunks(monkeypatch, size):
    """As many chunks as on a large table."""
    for name in ("LEAST_CHUNK", "CHUNK_BYTES"):
        monkeypatch.setattr(E, name, size)


@pytest.mark.parametrize("most", [4096, 20])
def test_copies_like_their_original_alone(spark, monkeypatch, most):
    small_chunks(monkeypatch, 4000)
    monkeypatch.setattr(N, "GROUP_DOCS", most)
    monkeypatch.setattr(N, "BLOCK_DOCS", 8)
    rng = random.Random(11)
    docs = []
    for g in range(3):  # the original's id is neither among the least nor the largest
        base = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(200)]
        docs += [(1000 * g + i, " ".join(base if i == 37 else edited(rng, base, 3))) for i in range(60)]
    want = brute(docs, len(docs))
    assert len(set(want.values())) == 3
    assert classes(spark, docs) == want


def test_links_between_documents_that_are_not_hubs(spark, monkeypatch):
    small_chunks(monkeypatch, 60_000)
    rng = random.Random(12)
    texts = []
    for _ in range(60):
        a = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(200)]
        b = edited(rng, a, 4)
        c = edited(rng, b, 4)
        texts += [a, b, c, edited(rng, c, 4)]
    rng.shuffle(texts)
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert sizes(spark.createDataFrame(docs, "doc_id long, text string"))[0] > 3
    want = brute(docs, len(docs))
    got = classes(spark, docs)
    assert got == want


def test_repeated_and_null_ids_are_documents_of_their_own(spark):
    a, b = (" ".join(t) for t in docs_words(2))
    near_a = a + " tail"
    rows = [(None, a), (None, b), (3, near_a), (7, "x y z one two three"), (7, b), (8, b + " end"), (9, "lone words of one document here"), (7, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, (tuple(r) for r in N.near_duplicates(df).collect())))
    want = [(None, 3, False), (3, 3, True), (None, 7, False), (7, 7, True), (7, 7, False), (8, 7, False), (7, 7, True), (9, 9, True)]
    assert got == sorted(map(str, want))
    kept = sorted((str(r["doc_id"]), r["text"]) for r in N.without_near_duplicates(df).collect())
    assert kept == sorted([("3", near_a), ("7", b), ("7", rows[3][1]), ("9", rows[6][1])])
    plain = spark.createDataFrame([(1, a, 5), (2, near_a, 5), (3, b, 5)], "doc_id long, text string, _key int")
    assert sorted(tuple(r) for r in N.without_near_duplicates(plain).collect()) == [(1, a, 5), (3, b, 5)]


def docs_words(n):
    rng = random.Random(21)
    return [["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(80)] for _ in range(n)]
