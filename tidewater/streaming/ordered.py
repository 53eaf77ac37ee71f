"""Stateful streams in order of event time: rows wait until the watermark has passed them, state ends when a key falls silent.

A key's rows are held back in its state and folded in order of (ts, tie) once no earlier row can come any more, so what comes out
doesn't depend on how rows arrived (those later than the watermark are dropped, as everywhere). A key whose
newest row is older than ``idle`` seconds before the watermark gives up its state, after a last word of the fold; its next row starts
afresh. State so holds what came within the lateness and one fold for each live key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewater.streaming.candles import timed

#: fold(state, ts in microseconds, value) -> (state, output rows); last(state) -> output rows. States are tuples of doubles.
Fold = Callable[[tuple | None, int, float | None], tuple[tuple, list[tuple]]]


def in_order(rows: DataFrame, fold: Fold, last: Callable[[tuple], list[tuple]], out: str, late: str = "10 minutes", idle: int = 3600) -> DataFrame:
    """``rows``: symbol, ts, tie (long), value (double, may be null). Output: symbol and the columns of ``out``, appended."""
    names = ["symbol", *[c.split()[0] for c in out.split(", ")]]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ts, ties, values, own, newest = (list(v) if isinstance(v, (list, tuple)) or hasattr(v, "tolist") else v for v in state.get) if state.exists else ([], [], [], [], -1)
        for b in batches:
            ts += [int(t.value // 1000) for t in b["ts"]]
            ties += [int(x) for x in b["tie"]]
            values += [math.nan if x is None else float(x) for x in b["value"]]
        mark = state.getCurrentWatermarkMs() * 1000
        waiting, said = [], []
        folded = tuple(own) if own else None
        for t, tie, v in sorted(zip(ts, ties, values), key=lambda r: r[:2]):
            if t <= mark:
                if folded is not None and t - newest > idle * 1_000_000:  # the silence was over before this row
                    said += last(folded)
                    folded = None
                folded, more = fold(folded, t, None if math.isnan(v) else v)
                said += more
                newest = t
            else:
                waiting.append((t, tie, v))
        if folded is not None and not waiting and newest + idle * 1_000_000 < mark:
            said += last(folded)
            folded = None
        if folded is None and not waiting:
            state.remove()
        else:
            state.update(([r[0] for r in waiting], [r[1] for r in waiting], [r[2] for r in waiting], [float(x) for x in folded or ()], newest))
            ends = min([r[0] for r in waiting] + ([newest + idle * 1_000_000 + 1] if folded is not None else []))
            state.setTimeoutTimestamp(max(ends // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame([(key[0], *r) for r in said], columns=names)

    t = timed(rows).withWatermark("ts", late).select("symbol", "ts", F.col("tie").cast("long").alias("tie"), F.col("value").cast("double").alias("value")).groupBy("symbol")
    kept = "ts array<long>, tie array<long>, value array<double>, own array<double>, newest long"
    return t.applyInPandasWithState(step, f"symbol string, {out}", kept, "append", GroupStateTimeout.EventTimeTimeout)


def _moment(us: float) -> pd.Timestamp:
    return pd.Timestamp(int(us), unit="us")


def counter_volume(ticks: DataFrame, late: str = "10 minutes", idle: int = 3600) -> DataFrame:
    """ts, volume of a cumulative counter (value): the rise since the reading before in time, 0 at a fall, a gap or a first reading."""

    def fold(state, ts, value):
        if value is None:
            return state or (math.nan,), [(_moment(ts), 0)]
        before = state[0] if state else math.nan
        return (value,), [(_moment(ts), 0 if math.isnan(before) else max(0, int(value - before)))]

    return in_order(ticks, fold, lambda s: [], "ts timestamp, volume long", late, idle)


def signal_streaks(signals: DataFrame, late: str = "10 minutes", gap: int = 1200) -> DataFrame:
    """since, until, direction, n of each run of one direction (value above 0: long) without a gap of over ``gap`` seconds, as it ends."""
    word = lambda s: [(_moment(s[0]), _moment(s[1]), "long" if s[2] > 0 else "short", int(s[3]))]

    def fold(state, ts, value):
        side = 1.0 if (value or 0.0) > 0 else -1.0
        if state is None:
            return (float(ts), float(ts), side, 1.0), []
        if side == state[2]:
            return (state[0], float(ts), side, state[3] + 1), []
        return (float(ts), float(ts), side, 1.0), word(state)

    return in_order(signals, fold, word, "since timestamp, until timestamp, direction string, n long", late, gap)


def beliefs(evidence: DataFrame, weight: float = 0.3, late: str = "10 minutes", idle: int = 86_400) -> DataFrame:
    """ts, belief, updates after each piece of evidence (value), in order of time; silence forgets."""
    w = min(0.9, max(0.1, weight))

    def fold(state, ts, value):
        p, n = state or (0.5, 0.0)
        if value is None:
            return (p, n), []
        p, n = (1 - w) * p + w * value, n + 1
        return (p, n), [(_moment(ts), p, int(n))]

    return in_order(evidence, fold, lambda s: [], "ts timestamp, belief double, updates long", late, idle)
