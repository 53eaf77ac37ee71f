"""Pairs of vectors in blocks against plain Python, with what is missing or isn't a number."""

import math

import pytest

from tidewater.operators import similarity

ROWS = [(0, [1.0, 2.0, 2.0], 5), (100, [0.0, 0.0, 0.0], 1), (200, None, 6), (300, [3.0, None, 1.0], 7), (1, [2.0, 4.0, 4.0], 9), (2, [1.0, 2.0], 3), (3, [1.0, 2.0, 2.0, 9.0], 4), (4, None, 5), (5, [float("nan"), 1.0, 1.0], 5), (6, [-1.0, -2.0, -2.0], 0)]


@pytest.fixture()
def folder(spark, tmp_path):
    spark.createDataFrame(ROWS, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def dot(q, x):
    if q is None or x is None or any(k >= len(x) or x[k] is None or q[k] is None for k in range(len(q))):
        return None
    return sum(a * b for a, b in zip(q, x))


def cos(q, x):
    ab, aa, bb = dot(q, x), dot(q, q), dot(x, x)
    return None if None in (ab, aa, bb) or aa * bb == 0 else ab / math.sqrt(aa * bb)


def same(a, b):
    return a == b or (None not in (a, b) and (math.isnan(a) and math.isnan(b) or abs(a - b) < 2e-6))


@pytest.mark.parametrize("group, block", [(512, 8192), (2, 3)])
def test_every_pair_is_met_once(spark, folder, monkeypatch, group, block):
    monkeypatch.setattr(similarity, "GROUP", group)
    monkeypatch.setattr(similarity, "BLOCK", block)
    want = {(q, v): (a, b) for q, a, _ in ROWS if q % 100 == 0 for v, b, _ in ROWS if v != q}
    got = {(r["qid"], r["vec_id"]): r["cosine"] for r in similarity.QUERIES["n19_cosine"](spark, folder).select("cosine", "qid", "vec_id").collect()}
    clamp = lambda c: -1.0 if c is None else 1.0 if math.isnan(c) else max(-1.0, min(1.0, c))
    assert got.keys() == want.keys() and all(same(got[k], clamp(cos(*want[k]))) for k in want)
    far = {(r["qid"], r["vec_id"]): r["distance"] for r in similarity.QUERIES["n20_euclidean"](spark, folder).collect()}
    gap = lambda q, x: None if dot(q, x) is None else math.sqrt(sum((a - b) ** 2 for a, b in zip(q, x)))
    assert far.keys() == want.keys() and all(same(far[k], gap(*want[k])) for k in want)


def test_the_nearest_of_all_blocks_count(spark, folder, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 3)
    monkeypatch.setattr(similarity, "TOP", 4)
    got = {r["qid"]: r for r in similarity.QUERIES["n18_historical_analogs"](spark, folder).collect()}
    # of 0: what isn't a number is the largest, then 1, 3, 6; nulls come last
    assert got[0]["n"] == 4 and got[0]["win_rate"] == 0.5 and math.isnan(got[0]["best"])


def test_pairs_meet_in_bounded_groups_by_keys(spark, folder):
    plan = similarity.QUERIES["n19_cosine"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "FlatMapCoGroupsInArrow" in plan
