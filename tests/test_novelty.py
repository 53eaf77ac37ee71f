"""Novelty over blocks against a walk of all articles in order."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewater.operators import novelty as blocks

SCHEMA = "source string, id long, tokens array<string>"


def walk(rows, threshold, across):
    kept, out = [], {}
    for source, i, tokens in sorted(rows, key=lambda r: r[1]):
        s = set(tokens or [])
        best = max((len(s & k) / len(s | k) for of, k in kept if (across or of == source) and s | k), default=0.0)
        if best <= threshold:
            kept.append((source, s))
        out[i] = (source, 1 - best, best <= threshold)
    return out


def articles():
    """Frequent and rare words, equal sets, chains of near-copies whose middle drops, empty and null sets."""
    r = random.Random(5)
    rows = []
    for i in range(400):
        kind = r.random()
        if rows and kind < 0.15:
            tokens = r.choice(rows)[2]
        elif rows and kind < 0.5:
            tokens = list(r.choice(rows)[2] or [])
            for _ in range(r.randint(1, 4)):
                tokens = tokens[1:] + [f"r{r.randrange(3000)}"]
        elif kind < 0.53:
            tokens = r.choice([None, []])
        else:
            tokens = [f"w{int(60 * r.random() ** 3)}" for _ in range(r.randint(1, 40))] + [f"r{r.randrange(3000)}" for _ in range(r.randint(0, 12))]
        rows.append((r.choice("abc"), 7 * i, tokens))
    r.shuffle(rows)
    return rows


def got(spark, rows, **options):
    return {r["id"]: (r["source"], r["novelty"], r["kept"]) for r in blocks.novelty(spark.createDataFrame(rows, SCHEMA), **options).collect()}


def test_novelty_in_many_blocks_is_that_of_a_walk(spark, monkeypatch):
    monkeypatch.setattr(blocks, "LEAST", 1000)
    rows = articles()
    for options in ({"across": True}, {"threshold": 0.5}):
        assert got(spark, rows, **options) == walk(rows, options.get("threshold", 0.7), options.get("across", False))


def test_blocks_are_bounded_and_in_order(spark, monkeypatch):
    monkeypatch.setattr(blocks, "LEAST", 1000)
    rows = spark.createDataFrame(articles(), SCHEMA).select(F.lit(0).cast("long").alias("of"), "id", "source", F.transform(F.array_distinct(F.coalesce("tokens", F.array().cast("array<string>"))), lambda t: F.xxhash64(t)).alias("hashes"))
    placed = blocks._blocked(blocks._encoded(rows, *blocks._ranked(rows, 400))).select("id", "pos", "block", "n").orderBy("pos").collect()
    assert [r["id"] for r in placed] == sorted(r["id"] for r in placed) and [r["block"] for r in placed] == sorted(r["block"] for r in placed)
    total = sum(r["n"] + blocks.EACH for r in placed)
    size = max(1000, -(-total // blocks.SPREAD))
    for b in {r["block"] for r in placed}:
        assert sum(r["n"] + blocks.EACH for r in placed if r["block"] == b) <= size + max(r["n"] + blocks.EACH for r in placed)
    assert len({r["block"] for r in placed}) == blocks.SPREAD


def test_tokens_are_read_in_parts(monkeypatch):
    monkeypatch.setattr(blocks, "PART", 3)
    r = random.Random(7)
    far = [sorted(r.sample(range(-40, 40), r.randint(0, 4)), reverse=True) for _ in range(10)]
    mid = [sorted(r.sample(range(50), r.randint(0, 5)), reverse=True) for _ in range(10)]
    packed = lambda rows, kind: pa.array([np.array(x, kind).tobytes() for x in rows], pa.binary())
    rows = pa.table({"far": packed(far, np.int64), "mid": packed(mid, np.uint16)})
    known = blocks._known(rows)
    assert known.tolist() == sorted({x for row in far for x in row})
    tokens, start = blocks._tokens(rows, known[::2])
    number = {x: blocks.KNOWN + i for i, x in enumerate(known[::2].tolist())}
    assert [tokens[a:b].tolist() for a, b in zip(start, start[1:])] == [[number.get(x, -1) for x in f] + m for f, m in zip(far, mid)]
    tokens, row = np.array([3, 0, 3, 1], np.int32), np.array([0, 1, 2, 2])
    first, found = blocks._index(tokens, row, 5)
    assert [found[a:b].tolist() for a, b in zip(first, first[1:])] == [[1], [2], [], [0, 2], []]
