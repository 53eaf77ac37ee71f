"""A run-length index: run-compressed Burrows-Wheeler transform of many short texts, with sampled run ends.

Built over the rows of a byte matrix, each a text of its own with an end mark. ``matching_statistics`` streams patterns
from right to left, all of them a step at a time: where the transform's run holds the next byte the match grows,
else it moves to the nearer run of that byte, above or below, by the longer common extension of the sampled end.
"""

from __future__ import annotations

import numpy as np

PACK = 6  # bytes ordered by the first sort


class RunIndex:
    def __init__(self, rows: np.ndarray, classes: int):
        """``rows``: uint8 matrix. Suffixes that share their first ``classes`` bytes are one class."""
        m, w = rows.shape
        self.width, self.pad = w, w + 1
        sym = np.zeros((m, w + 1), np.int64)
        sym[:, :w] = rows.astype(np.int64) + 1  # 0 is the end mark
        self.sym = sym
        # ranks of suffixes by their first PACK symbols, then doubled; what lies past the row's end compares as nothing
        key = np.zeros((m, w + 1), np.int64)
        for k in range(PACK):
            key <<= 9
            key[:, : w + 1 - k] |= sym[:, k:]
        self.key = key
        rank, span = self._ranks(key), PACK
        by_span = {}
        while span < w + 1:
            by_span[span] = rank
            later = np.zeros_like(rank)
            if span <= w:
                later[:, : w + 1 - span] = rank[:, span:]
            rank = self._ranks(rank * (int(rank.max()) + 2) + later)
            span *= 2
        sa = np.argsort(rank.ravel(), kind="stable")  # ties in row order: the end marks' order
        r, j = np.divmod(sa, w + 1)
        bwt = np.where(j > 0, sym[r, j - 1], 0)
        starts = np.flatnonzero(np.r_[True, bwt[1:] != bwt[:-1]])
        ends = np.r_[starts[1:], len(bwt)] - 1
        head = bwt[starts]
        count = np.bincount(sym.ravel(), minlength=258)
        first = np.r_[0, np.cumsum(count)[:-1]]
        # rows that each run maps to: symbols before it, plus equal symbols in runs before it
        order = np.argsort(head, kind="stable")
        size = (ends - starts + 1)[order]
        before = np.cumsum(size) - size
        group_first = np.r_[True, head[order][1:] != head[order][:-1]]
        base = before - np.maximum.accumulate(np.where(group_first, before, 0))
        self.step = np.empty(len(starts), np.int64)
        self.step[order] = first[head[order]] + base
        self.starts, self.ends, self.head = starts, ends, head
        self.start_sample, self.end_sample = sa[starts], sa[ends]
        self.first_sample = int(sa[0])
        self.runs = len(starts)
        self.by_head = head[order] * self.runs + order  # sorted: runs of a symbol in order of place
        self.by_head_run = order
        # classes of suffixes
        small = max(s for s in by_span if s <= classes)
        a = by_span[small].ravel()[sa]
        at = j + (classes - small)
        b = np.where(at <= w, by_span[small][r, np.minimum(at, w)], -1)
        whole = j + classes <= w
        same = np.r_[False, (a[1:] == a[:-1]) & (b[1:] == b[:-1]) & whole[1:] & whole[:-1]]
        self.class_of = np.cumsum(~same) - 1
        self.class_starts = np.flatnonzero(~same)
        self.sa_row = r

    @staticmethod
    def _ranks(key: np.ndarray) -> np.ndarray:
        _, inverse = np.unique(key.ravel(), return_inverse=True)
        return inverse.reshape(key.shape).astype(np.int64)

    def class_minimum(self, value_of_row: np.ndarray) -> np.ndarray:
        """The smallest value of the rows in each class."""
        return np.minimum.reduceat(value_of_row[self.sa_row], self.class_starts)

    def _common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common extension of text places a and b, up to ``most``."""
        w = self.width
        ra, ja = np.divmod(a, w + 1)
        rb, jb = np.divmod(b, w + 1)
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero(most > 0)
        while len(live):  # PACK symbols at a time; where they differ, the place of the first that does
            n = out[live]
            x = self.key[ra[live], np.minimum(ja[live] + n, w)] ^ self.key[rb[live], np.minimum(jb[live] + n, w)]
            same = x == 0
            lead = PACK - 1 - (np.frexp(x.astype(np.float64))[1] - 1) // 9
            out[live] = n + np.where(same, PACK, np.clip(lead, 0, PACK))
            live = live[same & (out[live] < most[live])]
        return np.minimum(out, most)

    def matching_statistics(self, patterns: np.ndarray):
        """Yields (place, match lengths, rows of the transform) from the last place of the patterns to the first."""
        n, w = patterns.shape
        row = np.zeros(n, np.int64)
        held = np.full(n, self.first_sample)
        length = np.zeros(n, np.int64)
        for t in range(w - 1, -1, -1):
            c = patterns[:, t].astype(np.int64) + 1
            run = np.searchsorted(self.starts, row, "right") - 1
            off = np.flatnonzero(self.head[run] != c)
            if len(off):
                key = c[off] * self.runs + run[off]
                at = np.searchsorted(self.by_head, key)
                has_down = (at < self.runs) & (self.by_head[np.minimum(at, self.runs - 1)] // self.runs == c[off])
                has_up = (at > 0) & (self.by_head[np.maximum(at - 1, 0)] // self.runs == c[off])
                up = self.by_head_run[np.maximum(at - 1, 0)]
                down = self.by_head_run[np.minimum(at, self.runs - 1)]
                l_up = np.where(has_up, self._common(held[off], self.end_sample[up], length[off]), -1)
                l_down = np.where(has_down, self._common(held[off], self.start_sample[down], length[off]), -1)
                go_up = l_up >= l_down
                to = np.where(go_up, up, down)
                found = has_up | has_down
                row[off] = np.where(go_up, self.ends[to], self.starts[to])
                held[off] = np.where(go_up, self.end_sample[to], self.start_sample[to])
                run[off] = to
                length[off] = np.where(found, np.maximum(l_up, l_down), -1)
                lost = off[~found]
            else:
                lost = off
            row = self.step[run] + row - self.starts[run]
            held = held - 1
            length = length + 1
            if len(lost):
                row[lost], held[lost], length[lost] = 0, self.first_sample, 0
            yield t, length, row
