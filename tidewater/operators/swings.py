"""Market structure of one series from a table of its swings: every column is an array over the bars, not a walk.

A swing is confirmed k bars after it. Between two swings of a side nothing of that side changes, so a bar only has to know
which swing was the last; what happens once between two swings (a break) is the first bar of its stretch.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bars on either side of a swing, levels a side, open gaps kept, bars over which a break fades.
FRACTAL, LEVELS_KEPT, GAPS_KEPT, BREAK_FADES = 2, 5, 100, 10
COLUMNS = (
    "symbol string, ts timestamp, last_high double, last_low double, hh_run double, ll_run double, trend double, bos double, choch double, "
    "zone_pct double, open_gaps double, bias double, breakout_prob double, sweep_prob double"
)


class Side:
    """The distinct swing levels of one side: where each is confirmed, and how many in a row went further."""

    def __init__(self, x: np.ndarray, k: int, sign: int):
        n = len(x)
        around = pd.Series(sign * x).rolling(2 * k + 1, center=True).max().to_numpy()
        at = np.flatnonzero(sign * x == around)
        kept: list[int] = []
        for j in at.tolist():  # equal neighbours are one level
            if not kept or not np.isclose(x[j], x[kept[-1]], rtol=1e-9, atol=0.0):
                kept.append(j)
        self.level = x[kept]
        further = np.r_[False, sign * np.diff(self.level) > 0] if kept else np.zeros(0, bool)
        order = np.arange(len(kept))
        self.run = (order - np.maximum.accumulate(np.where(further, 0, order))).astype(float) if kept else np.zeros(0)
        self.last = np.searchsorted(np.array(kept, int) + k, np.arange(n), "right") - 1  # by bar; -1 before the first

    def at(self, values: np.ndarray, back: int = 0) -> np.ndarray:
        """By bar, the value of the last swing, or of one before it; nan where there is none."""
        which = self.last - back
        out = np.full(len(which), np.nan)
        out[which >= 0] = values[which[which >= 0]]
        return out

    def first_where(self, hit: np.ndarray) -> np.ndarray:
        """The first bar of each stretch between swings where ``hit`` holds."""
        seen = pd.Series(hit & (self.last >= 0)).groupby(self.last).cumsum().to_numpy()
        return hit & (self.last >= 0) & (seen == 1)


def open_gaps(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Net three-bar gaps that no later bar's range has met in the middle, by bar; the newest ``GAPS_KEPT`` count."""
    n = len(high)
    up, down = np.flatnonzero(low[2:] > high[:-2]) + 2, np.flatnonzero(high[2:] < low[:-2]) + 2
    bars = np.r_[up, down]
    sides = np.r_[np.ones(len(up)), -np.ones(len(down))]
    middle = np.r_[(low[up] + high[up - 2]) / 2, (high[down] + low[down - 2]) / 2]
    order = np.argsort(bars, kind="stable")
    net = np.zeros(n + 1)
    ends: dict[int, list[int]] = {}
    open_now: OrderedDict[int, None] = OrderedDict()
    done = 0

    def close_until(bar: int) -> None:  # gaps met by a bar before this one
        nonlocal done
        for t in sorted(x for x in ends if x < bar):
            for g in ends.pop(t):
                if open_now.pop(g, 0) is None:
                    net[t] -= sides[g]

    for g in order.tolist():
        b = int(bars[g])
        close_until(b)
        open_now[g] = None
        net[b] += sides[g]
        if len(open_now) > GAPS_KEPT:
            old, _ = open_now.popitem(last=False)
            net[b] -= sides[old]
        at = b
        while at < n:  # the first bar whose range holds the middle
            met = np.flatnonzero((low[at : at + 256] <= middle[g]) & (middle[g] <= high[at : at + 256]))
            if len(met):
                ends.setdefault(at + int(met[0]), []).append(g)
                break
            at += 256
    close_until(n)
    return np.cumsum(net[:n])


def structure_of(bars: pd.DataFrame, k: int = FRACTAL) -> pd.DataFrame:
    """Swings, runs, trend, breaks, nearest levels, unfilled gaps, bias and probabilities of one series, bar by bar."""
    bars = bars.sort_values("ts").reset_index(drop=True)
    high, low, close = (bars[c].to_numpy(float) for c in ("high", "low", "close"))
    tops, bottoms = Side(high, k, 1), Side(low, k, -1)
    last_high, last_low = tops.at(tops.level), bottoms.at(bottoms.level)
    rise, fall = last_high - tops.at(tops.level, 1), last_low - bottoms.at(bottoms.level, 1)
    trend = np.where(np.isnan(rise) | np.isnan(fall), np.nan, np.where((rise > 0) & (fall > 0), 1.0, np.where((rise < 0) & (fall < 0), -1.0, 0.0)))
    above = tops.first_where(close > last_high)
    below = bottoms.first_where((close < last_low) & ~above)
    bos = above.astype(float) - below
    against = np.nan_to_num(trend) * bos < 0
    levels = np.stack([s.at(s.level, b) for s in (tops, bottoms) for b in range(LEVELS_KEPT)])
    away = np.where(np.isnan(levels), np.inf, np.abs(levels - close)).min(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        zone = np.where(np.isfinite(away) & (close > 0), away / close * 100, np.nan)
        near = 1 - np.minimum(np.abs(last_high - close) / close * 100, 2.0) / 2.0
    i = np.arange(len(close))
    broke = np.maximum.accumulate(np.where(bos != 0, i, -1))
    age = i - broke
    faded = np.where((broke >= 0) & (age <= BREAK_FADES), bos[np.maximum(broke, 0)] * (1 - age / BREAK_FADES), 0.0)
    hh, ll = tops.at(tops.run), bottoms.at(bottoms.run)
    bias = np.clip(0.5 * trend + 0.3 * faded + 0.2 * np.tanh((np.nan_to_num(hh) - np.nan_to_num(ll)) / 3), -1, 1)
    out = {
        "symbol": bars["symbol"], "ts": bars["ts"], "last_high": last_high, "last_low": last_low, "hh_run": hh, "ll_run": ll, "trend": trend,
        "bos": bos, "choch": np.where(against, bos, 0.0), "zone_pct": zone, "open_gaps": open_gaps(high, low) if len(high) > 2 else np.zeros(len(high)),
        "bias": bias, "breakout_prob": np.where(close > 0, np.clip(0.5 + 0.3 * bias + 0.2 * near, 0.05, 0.95), np.nan),
        "sweep_prob": np.clip(0.15 + 0.7 * (1 - np.minimum(zone, 2.0) / 2.0), 0.05, 0.95),
    }
    return pd.DataFrame(out)


def structure(candles: DataFrame) -> DataFrame:
    got = candles.select("symbol", "ts", "high", "low", "close").groupBy("symbol").applyInPandas(lambda bars: structure_of(bars), COLUMNS)
    numbers = [c for c in got.columns if c not in ("symbol", "ts")]
    return got.select("symbol", "ts", *(F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in numbers))


def value_area(profile: np.ndarray, share: float = 0.7) -> tuple[int, int, int]:
    """(point of control, low bin, high bin): the first largest bin, widened by its fuller neighbour, the upper one of equals,
    until the range holds ``share`` of all. What a range holds is a difference of the profile's running sums."""
    sums = np.r_[0.0, np.cumsum(profile)]
    edge = np.r_[-np.inf, np.asarray(profile, float), -np.inf]  # bins by place + 1, walls on both sides
    poc = lo = hi = int(np.argmax(profile))
    for _ in range(len(profile) - 1):
        if sums[hi + 1] - sums[lo] >= share * sums[-1]:
            break
        lo, hi = (lo, hi + 1) if edge[hi + 2] >= edge[lo] else (lo - 1, hi)
    return poc, lo, hi
