"""Ordered streams: what comes out equals a walk in order of time, whatever the order of arrival; silent keys lose their state."""

import random
from datetime import datetime, timedelta

import pytest

from tidewater.streaming import ordered

START = datetime(2024, 1, 1)
SCHEMA = "symbol string, ts timestamp, tie long, value double"


@pytest.fixture(scope="module")
def arrivals():
    """Batches of rows up to eight minutes out of order; a long silence of one symbol; a last row far ahead that flushes."""
    rng = random.Random(6)
    rows = []
    for s in "ab":
        t, cum = 0, 100.0
        for k in range(150):
            t += rng.choice([5, 20, 60, 240]) if not (s == "b" and k == 80) else 9000
            cum = 10.0 if k == 60 else cum + rng.randrange(50)
            rows.append((s, START + timedelta(seconds=t), k, None if rng.random() < 0.05 else cum))
    rows.sort(key=lambda r: r[1])
    shaken = sorted(rows, key=lambda r: r[1] + timedelta(seconds=rng.randrange(480)))
    batches = [shaken[k : k + 40] for k in range(0, len(shaken), 40)]
    return rows, [*batches, [("z", START + timedelta(days=3), 0, 1.0)], [("z", START + timedelta(days=4), 1, 1.0)]]


def run(spark, tmp_path, batches, query):
    path = str(tmp_path / "in")
    for k, b in enumerate(batches):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(path + f"/b{k:03d}")
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path + "/*")
    out, name = query(src), "out_" + tmp_path.name.replace("-", "_")
    q = out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    return [tuple(r) for r in spark.table(name).collect()], q.lastProgress


def test_counters_equal_a_walk(spark, tmp_path, arrivals):
    rows, batches = arrivals
    got, progress = run(spark, tmp_path, batches, lambda s: ordered.counter_volume(s, "10 minutes", 7200))
    want = []
    for s in "ab":
        before, seen = None, None
        for _, ts, _, cum in (r for r in rows if r[0] == s):
            if seen is not None and (ts - seen).total_seconds() > 7200:
                before = None
            seen = ts
            want.append((s, ts, 0 if cum is None or before is None else max(0, int(cum - before))))
            before = cum if cum is not None else before
    assert sorted(r for r in got if r[0] != "z") == sorted(want)
    assert progress["stateOperators"][0]["numRowsTotal"] <= 1  # a and b have given up their state


def test_streaks_equal_a_walk(spark, tmp_path, arrivals):
    rows, batches = arrivals
    side = lambda v: "long" if (v or 0) > 900 else "short"
    from pyspark.sql import functions as F

    got, _ = run(spark, tmp_path, batches, lambda s: ordered.signal_streaks(s.withColumn("value", F.when(F.coalesce("value", F.lit(0.0)) > 900, 1.0).otherwise(-1.0)), "10 minutes", 200))
    want = []
    for s in "ab":
        own = None
        for _, ts, _, v in (r for r in rows if r[0] == s):
            if own and own[2] == side(v) and (ts - own[1]).total_seconds() <= 200:
                own = (own[0], ts, own[2], own[3] + 1)
            else:
                want += [(s, *own)] if own else []
                own = (ts, ts, side(v), 1)
        want.append((s, *own))
    assert sorted(r for r in got if r[0] != "z") == sorted(want) and len({r[3] for r in want}) == 2
