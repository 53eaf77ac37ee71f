"""Operator 13 against a plain walk over all pairs, and its SQL."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidewater.llm import variants as m


def lower(w):
    return "".join(c.lower() if c.isascii() else c for c in w)


def counted(docs):
    n = Counter()
    for i, t in docs:
        for run in re.findall(m.RUN, t or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            if len(w) >= 5:
                n[w] += 1
    return {w: k for w, k in n.items() if k >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return sorted(out)


def texts(n=160, seed=4):
    """Texts over few stems with random edits: chains of forms, accents, capitals, long runs, repeated rows."""
    rng = random.Random(seed)
    stems = ["abcde", "straße", "ÉCOLES", "écoles", "aaaaaa", "banana", "letters", "ab×÷ba", "x" * 300] + ["".join(rng.choices("abcdeéñ", k=rng.randint(5, 8))) for _ in range(30)]
    docs = []
    for k in range(n):
        words = []
        for _ in range(40):
            w = rng.choice(stems[: rng.randint(3, len(stems))])
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abcé") + w[at:], w[:at] + rng.choice("abcé") + w[at + 1 :]])
            words.append(rng.choice([w, w, w.upper() if w.isascii() else w]))
        docs.append((rng.choice([k, k, k // 2]), rng.choice([" ", "-", "1", "\n"]).join(words)))
    return docs + [(None, "abcde abcde straße"), (None, "abcde abcde straße"), (3, None), (4, ""), (5, "1234 ??? \U0001d4b3")]


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "k", 7) for i, t in docs], "doc_id long, text string, word string, n int")


@pytest.mark.parametrize("letters", [40, 600, m.LETTERS])
def test_against_all_pairs(spark, letters):
    docs = texts()
    want = plain(counted(docs))
    assert sum(r[1] is not None for r in want) > 50 and any(r[1] != r[2] for r in want if r[1])
    got = sorted(tuple(r) for r in m.spelling_variants(frame(spark, docs), letters=letters).collect())
    assert got == want


def test_equals_sql(spark, tmp_path):
    docs = texts(60, 9)
    pd.DataFrame(docs, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}).to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    got = sorted((tuple(r) for r in m.op13_spelling_variants(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(con.sql(m.SQL).fetchall(), key=str) == sorted(plain(counted(docs)), key=str)


def test_no_words(spark):
    assert m.spelling_variants(frame(spark, [])).count() == 0
    assert m.spelling_variants(frame(spark, [(1, None), (2, "four abcde abcde")])).count() == 0


def test_one_edit_leaves_a_band_and_few_bits(spark):
    rng = random.Random(2)
    alphabet = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
    pairs = []
    for _ in range(500):
        w = "".join(rng.choices(alphabet, k=8))
        at = rng.randrange(8)
        pairs.append((w, rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice(alphabet) + w[at:], w[:at] + rng.choice(alphabet) + w[at + 1 :]])))
    df = spark.createDataFrame(pairs, "a string, b string")
    for a, b in df.select(m.parity(df.a), m.parity(df.b)).collect():
        assert bin(a ^ b).count("1") <= 2 and any((a ^ b) & m.band_bits(k) == 0 for k in range(3))


def test_cell_of_many_words_of_one_mask():
    words = ["".join(p) for p in {tuple(random.Random(k).sample("abcdefgh", 8)) for k in range(300)}] + ["abcdefgg", "abcdefghh"]
    mask = np.zeros(len(words), np.uint64)
    m.PAIRS, before = 1000, m.PAIRS
    try:
        i, j = m.near_in_cell(words, mask, np.zeros(len(words), np.int32), 0, 8, False)
    finally:
        m.PAIRS = before
    got = {frozenset((words[a], words[b])) for a, b in zip(i, j)}
    assert got == {frozenset((a, b)) for a in words for b in words if len(a) == len(b) == 8 and a < b and one_edit(a, b)}
