import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

import tidewater.llm.suffix_dedup as S
from tidewater.llm.run_index import RunIndex


def brute(docs):
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            g = b[k : k + 50]
            first[g] = min(first.get(g, i), i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        cov = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                cov[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, c in zip(b, cov) if not c)
        spans = sum(1 for k in range(len(b)) if cov[k] and (k == 0 or not cov[k - 1]))
        out.append((i, len(b), sum(cov), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def made(seed, n=90):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 7))) for _ in range(40)]
    shared = [" ".join(rng.choice(words) for _ in range(rng.randint(8, 40))) for _ in range(5)]
    docs = []
    for i in range(n):
        m = rng.random()
        if m < 0.15:
            t = rng.choice([None, "", "a" * rng.randint(0, 200), "ab" * rng.randint(0, 90), "\x00" * 80, "x" * 49, "y" * 50])
        elif m < 0.3 and docs:
            t = rng.choice(docs)[1]
        else:
            t = ""
            for _ in range(rng.randint(1, 4)):
                p = rng.choice(shared)
                a = rng.randint(0, len(p))
                t += p[a : rng.randint(a, len(p))] + "".join(rng.choice("abcdeé ") for _ in range(rng.randint(0, 60)))
                if rng.random() < 0.3:
                    t += p
        docs.append((i * 7 % 1000, t))
    return docs


def in_process(docs, chunks=4, buckets=2, deal=lambda k, i: i):
    """All rounds without Spark, so that limits can be patched."""
    own = [[d for k, d in enumerate(docs) if deal(k, d[0]) % chunks == c] for c in range(chunks)]
    tables = [pa.table({"doc_id": pa.array([i for i, _ in x], pa.int64()), "text": pa.array([t or "" for _, t in x], pa.string())}) for x in own]

    def route(sent):
        rows = defaultdict(list)
        for t in sent:
            for r in t.to_pylist():
                rows[r["target"]].append(r)
        return {k: pa.Table.from_pylist(v, schema=sent[0].schema) for k, v in rows.items()}

    def judge(f, sent):
        return route([f(b, t) for b, t in route(sent).items()])

    def merged(*answers):
        return [pa.concat_tables([a[c] for a in answers if c in a] or [S.sent([])]) for c in range(chunks)]

    one = judge(S.judge_anchors, [S.Chunk(c, t, buckets).anchors() for c, t in enumerate(tables)])
    got = merged(one)
    two = judge(S.judge_contexts, [S.Chunk(c, t, buckets, got[c]).contexts() for c, t in enumerate(tables)])
    got = merged(one, two)
    three = judge(S.judge_bytes, [S.Chunk(c, t, buckets, got[c]).asked_bytes() for c, t in enumerate(tables)])
    got = merged(one, two, three)
    rows = [r for c, t in enumerate(tables) for r in S.Chunk(c, t, buckets, got[c]).removed().to_pylist()]
    return sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in rows)


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_against_brute_force(seed):
    docs = made(seed)
    assert in_process(docs) == brute(docs)


@pytest.mark.parametrize("many, rows, piece", [(-1, 6000, 48 << 10), (3, 5, 64), (2048, 5, 100)])
def test_limits_change_nothing(monkeypatch, many, rows, piece):
    """Anchors dealt string by string, tiny indexes and texts scanned in pieces give the same result."""
    monkeypatch.setattr(S, "MANY", many)
    monkeypatch.setattr(S, "INDEX_ROWS", rows)
    monkeypatch.setattr(S, "PIECE", piece)
    docs = made(7)
    assert in_process(docs) == brute(docs)


@pytest.mark.parametrize("many", [2048, -1])
def test_repeated_ids_in_several_chunks(monkeypatch, many):
    monkeypatch.setattr(S, "MANY", many)
    docs = [(i % 7, t) for i, t in made(9, 70)]
    assert in_process(docs, deal=lambda k, i: k) == brute(docs)


def test_on_spark_with_clashing_columns(spark):
    docs = made(5, 60)
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in docs], "doc_id long, text string, chunk int, kept string")
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in S.without_repeats(df).collect())
    assert got == brute(docs)
    carried = S.without_repeats(df.withColumnRenamed("kept", "more"), carry=["more"])
    assert {r["more"] for r in carried.collect()} == {"c"}
    assert S.without_repeats(df.limit(0)).count() == 0


def test_repeated_ids_do_not_match_each_other(spark):
    t = "z" * 20 + "abcdefghij" * 9
    got = S.without_repeats(spark.createDataFrame([(5, t), (5, t)], "doc_id long, text string")).collect()
    assert [r["n_removed"] for r in got] == [0, 0]


def test_matching_statistics_against_plain_search():
    rng = np.random.default_rng(2)
    rows = rng.integers(97, 100, (40, 60), dtype=np.uint8)
    rows[5:12, 10:45] = rows[0, 10:45]
    index = RunIndex(rows, 20)
    texts = [bytes(r) for r in rows]
    patterns = rng.integers(97, 100, (15, 60), dtype=np.uint8)
    patterns[3, 5:40] = rows[0, 10:45]
    patterns[4, :] = 255
    lengths = np.zeros((15, 60), int)
    for t, n, row in index.matching_statistics(patterns):
        lengths[:, t] = n
    for i, p in enumerate(patterns):
        p = bytes(p)
        for t in range(60):
            n = 0
            while t + n < 60 and any(p[t : t + n + 1] in x for x in texts):
                n += 1
            assert lengths[i, t] == n
    assert index.runs < rows.size


def test_null_ids_come_last(spark):
    t = "q" * 10 + "0123456789" * 8
    got = {r["doc_id"]: r["n_removed"] for r in S.without_repeats(spark.createDataFrame([(None, t), (5, t)], "doc_id long, text string")).collect()}
    assert got == {None: len(t), 5: 0}
