"""Operator 5: near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A document's features are its runs of five words (ASCII letters without case, digits and all other non-ASCII characters
make words), weighted by term count times a normalised inverse document frequency. Consistent weighted samples,
banded, propose pairs; weighted Jaccard similarity of the features decides them.

1. Chunks send their distinct features to buckets, which answer with document frequencies over all documents.
2. Chunks weigh and sample. Documents with equal features collapse to the one with the least id; documents of a chunk that
   share a band are compared there. Each chunk sends one entry for each band key and local class.
3. On a band key with up to ``PAIRED`` documents, all pairs from different chunks are compared. A larger key first gets up to
   ``LEADERS`` leaders: the best supported local class and the classes with the least ids. Features go once to each chunk
   that has something to compare with them.
4. Chunks compare their documents, or every member of the class with the leader until one is similar. Verified links give
   classes (connected components, by rounds of label propagation over a checkpointed table of links).
5. Larger keys whose documents are still in several classes are grouped with those that share classes with them. A group's
   documents are dealt to blocks of about ``BLOCK_DOCS``, a large class to blocks of its own, and every pair of blocks is
   compared, except two blocks of one class. Features of documents on large keys are kept from round 4 for this.

So each pair of documents that share a band key is compared unless links have already put both in one class. Where leaders
link a group of copies, however large, its work stays linear; what they leave apart costs the square of its size.

Defined results
- null text is empty; documents without a word have no features and are classes of their own; with fewer than five
  words the whole text is one feature. The class id is the least id in the class, and that document stays.
- rows without an id, or with one that other rows have too, are documents of their own (told apart by their texts); a null
  id is larger than any other. Rows that share both stay together: one of them is kept at most. Where a class's least id
  is repeated, the text with the least hash stays. Other columns are ignored or passed on; empty tables give no rows.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.exchange import BLOCKS, NO_ID, at_buckets, chunked, cuts, distinct, mix, received, released, sent, sizes, texts_of
from tidewater.session import cut, sized_join

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 4
SAMPLES = BANDS * ROWS
IDF_SHARE = 0.5  # weight = count * (1 + IDF_SHARE * ln(N / df) / ln N)
LEADERS = 4
PAIRED = 6
BLOCK_DOCS = 512
GROUP_DOCS = 4096
SLOTS = 1 << 14
AT_A_TIME = 256 << 10  # bytes of text split into words at a time
BLOCK = 512  # features sampled at a time: the draws stay in a core's cache

FREQ, LOCAL, KEYS, TASKS, FEATURES, LARGE = 1, 2, 3, 4, 5, 6  # kinds of blocks
MEMBER, HUB, HUB_ONLY = 0, 1, 2  # an entry of a band key: another member, its class's hub, a hub that lacks the key itself
LINK, ON_KEY, WITH_FEATURES = 0, 1, 2  # rows of round 4
_M = np.uint64(0x9E3779B97F4A7C15)

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[48:58] = _WORD_BYTE[65:91] = _WORD_BYTE[97:123] = _WORD_BYTE[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


_BASE = 0x100000001B3
_power_cache: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2 to the 64th."""
    if not _power_cache or len(_power_cache[0]) < n:
        size = max(n, 1 << 19)
        _power_cache[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _power_cache[0][:n], _power_cache[1][:n]


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature hash, count), ordered by document and hash; a hash has 48 bits, the upper ones.

    A few documents at a time, so that what is held beyond the result is bounded by the longest of them.
    """
    docs, hashes, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    d, n = 0, len(offsets) - 1
    while d < n:
        to = min(n, max(d + 1, int(np.searchsorted(offsets, offsets[d] + AT_A_TIME, "right")) - 1))
        doc, h, c = _shingles(data[offsets[d] : offsets[to]], offsets[d : to + 1] - offsets[d])
        docs.append(doc + d)
        hashes.append(h)
        counts.append(c)
        d = to
    return np.concatenate(docs), np.concatenate(hashes), np.concatenate(counts)


def _shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(offsets) - 1
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not len(data):
        return none
    raw = _LOWER[data]
    word = _WORD_BYTE[raw]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    finish = word.copy()
    finish[:-1] &= ~word[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begin[edge] = word[edge]
    finish[edge - 1] = word[edge - 1]
    s, e = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    if not len(s):
        return none
    # polynomial hashes of words from prefix sums; the power of the start is divided out by its inverse
    hash_of = np.empty(len(s), np.uint64)
    step = 1 << 20
    at = 0
    while at < len(s):
        lo = s[at]
        to = max(at + 1, int(np.searchsorted(e, lo + step, "right")))
        hi = e[to - 1]
        power, back = _powers(int(hi - lo))
        sums = np.r_[np.uint64(0), np.cumsum((raw[lo:hi].astype(np.uint64) + np.uint64(1)) * power)]
        hash_of[at:to] = mix((sums[e[at:to] - lo] - sums[s[at:to] - lo]) * back[s[at:to] - lo] + (e[at:to] - s[at:to]).astype(np.uint64) * _M)
        at = to
    doc = np.searchsorted(offsets, s, "right") - 1
    count = np.bincount(doc, minlength=n)
    h = hash_of.copy()
    for k in range(1, WORDS):
        h = mix(h * _M)
        h[:-k] += hash_of[k:]
    h = mix(h * _M)
    first = np.r_[0, np.cumsum(count)[:-1]]
    place = np.arange(len(s)) - first[doc]
    whole = place + WORDS <= count[doc]
    few = np.flatnonzero((count > 0) & (count < WORDS))
    fh = np.zeros(len(few), np.uint64)
    for k in range(WORDS - 1):  # four words at most
        has = count[few] > k
        fh[has] = mix((fh[has] ^ hash_of[first[few[has]] + k]) * _M + count[few[has]].astype(np.uint64))
    d_all = np.r_[doc[whole], few]
    h_all = np.r_[h[whole], fh] >> np.uint64(16)
    # one sort of (document, 48 bits of hash), in segments of as many documents as 16 bits can tell apart
    at = d_all >> 16
    docs_, hashes, counts = [], [], []
    for seg in distinct(at)[0]:
        own = slice(None) if at[0] == at[-1] == seg and (at == seg).all() else at == seg
        key = (d_all[own] & 0xFFFF).astype(np.uint64) << np.uint64(48)
        key |= h_all[own]
        key.sort()
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        counts.append(np.diff(np.r_[new, len(key)]))
        key = key[new]
        docs_.append((key >> np.uint64(48)).astype(np.int64) + (int(seg) << 16))
        hashes.append(key << np.uint64(16))
    return np.concatenate(docs_), np.concatenate(hashes), np.concatenate(counts)


def _pack(counts: np.ndarray) -> bytes:
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.uint32).tobytes()


def _unpack(block, n: int) -> np.ndarray:
    out = np.frombuffer(block[:n], np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(block[n:], np.uint32)
    return out


def _pack_slots(slots: np.ndarray) -> bytes:
    """Rising hashes (48 bits, the upper ones) by their differences, of four bytes each where all fit."""
    x = slots >> np.uint64(16)
    steps = np.diff(x, prepend=x[:1])
    wide = bool(len(steps)) and int(steps.max()) >= 1 << 32
    return np.array([len(x), wide, x[0] if len(x) else 0], np.uint64).tobytes() + steps.astype(np.uint64 if wide else np.uint32).tobytes()


def _unpack_slots(block) -> tuple[np.ndarray, memoryview]:
    """(the upper 48 bits of the hashes, what follows them)."""
    n, wide, first = np.frombuffer(block[:24], np.uint64)
    end = 24 + int(n) * (8 if wide else 4)
    return np.cumsum(np.frombuffer(block[24:end], np.uint64 if wide else np.uint32), dtype=np.uint64) + first, block[end:]


_tables: list[np.ndarray] = []


def _random_tables() -> list[np.ndarray]:
    """Gamma(2, 1) and uniform draws by slot and sample; a feature's draws come from two slots of its hash."""
    if not _tables:
        rng = np.random.default_rng(5)
        shape = (SLOTS, SAMPLES)
        r = rng.gamma(2, 1, shape).astype(np.float32)
        beta = rng.uniform(0, 1, shape).astype(np.float32)
        _tables.extend([r, np.float32(1) / r, beta, np.log(rng.gamma(2, 1, shape)).astype(np.float32)])
        _tables.extend(np.empty((BLOCK, SAMPLES), np.float32) for _ in range(4))
    return _tables


def sample(h: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The consistent weighted samples of one document, one hash for each."""
    r_table, i_table, b_table, c_table, r_buf, t_buf, b_buf, c_buf = _random_tables()
    best = np.full(SAMPLES, np.inf, np.float32)
    out = np.zeros(SAMPLES, np.uint64)
    log_w = np.log(weight).astype(np.float32)
    cols = np.arange(SAMPLES)
    for s in range(0, len(h), BLOCK):
        g = h[s : s + BLOCK]
        n = len(g)
        one, two = ((g >> np.uint64(18)) & np.uint64(SLOTS - 1)).astype(np.intp), ((g >> np.uint64(40)) & np.uint64(SLOTS - 1)).astype(np.intp)
        r, t, beta, a = r_buf[:n], t_buf[:n], b_buf[:n], c_buf[:n]
        r_table.take(one, 0, r, "clip")
        i_table.take(one, 0, t, "clip")
        b_table.take(one, 0, beta, "clip")
        c_table.take(two, 0, a, "clip")
        # t = floor(ln w / r + beta); ln a = ln c - r (t - beta + 1)
        t *= log_w[s : s + BLOCK, None]
        t += beta
        np.floor(t, t)
        np.subtract(t, beta, beta)
        beta += 1
        beta *= r
        a -= beta
        k = a.argmin(0)
        low = a[k, cols]
        won = low < best
        best[won] = low[won]
        out[won] = mix((g[k] + (t[k, cols].astype(np.int64).astype(np.uint64)) * _M) * np.uint64(0xD6E8FEB86659FD93))[won]
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    m = samples.reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * _M
    for k in range(ROWS):
        h = mix((h ^ m[:, k]) * _M)
    return h


def similarity(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted feature lists."""
    if not len(ha) or not len(hb):
        return 0.0
    at = np.searchsorted(hb, ha)
    at[at == len(hb)] = 0
    both = np.flatnonzero(hb[at] == ha)
    low = float(np.minimum(wa[both], wb[at[both]]).sum())
    return low / (float(wa.sum()) + float(wb.sum()) - low)


class Union:
    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while self.up.get(x, x) != x:
            self.up[x] = self.up.get(self.up[x], self.up[x])
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


class Chunk:
    def __init__(self, chunk: int, table: pa.Table, buckets: int, total: int = 0, answers: pa.Table | None = None):
        self.chunk, self.buckets = chunk, buckets
        self.ids, data, offsets, _ = texts_of(table)
        self.doc, self.hash, self.count = shingles(data, offsets)
        self.slots, self.having = distinct(self.hash)  # features here, and in how many documents
        self.slot_cuts = cuts(self.slots, buckets)
        self.starts = np.searchsorted(self.doc, np.arange(len(self.ids) + 1))
        self.got: dict[int, dict[int, memoryview]] = defaultdict(dict)
        if answers is not None:
            for o, k, v in received(answers):
                self.got[k][o] = v
            df = np.ones(len(self.slots), np.int64)
            for b, s, e in self.slot_cuts:
                df[s:e] = _unpack(self.got[FREQ][b], e - s)
            self.idf = 1 + IDF_SHARE * np.log(max(total, 2) / np.minimum(df, max(total, 2))) / np.log(max(total, 2))

    def features(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        s, e = self.starts[d], self.starts[d + 1]
        h = self.hash[s:e]
        return h, (self.count[s:e] * self.idf[np.searchsorted(self.slots, h)]).astype(np.float32)

    def frequencies(self) -> pa.Table:
        """Round 1: slots with the number of documents here that have them."""
        n = self.having
        return sent([(b, self.chunk, FREQ, _pack_slots(self.slots[s:e]) + _pack(n[s:e])) for b, s, e in self.slot_cuts])

    def bands(self) -> pa.Table:
        """Round 2: band keys of the chunk's classes to buckets; the classes themselves to the chunk's own later rounds."""
        same: dict[bytes, int] = {}
        copy_of = np.arange(len(self.ids))
        by_key: dict[int, list[int]] = defaultdict(list)
        contents = self._contents()
        for d, own in enumerate(contents):
            if self.starts[d] == self.starts[d + 1]:
                continue
            if own in same:
                copy_of[d] = same[own]
                continue
            same[own] = d
            h, w = self.features(d)
            for k in band_keys(sample(h, w)).tolist():
                by_key[k].append(d)
        union, support = Union(), defaultdict(int)
        for members in by_key.values():
            if len(members) > 1:
                self._compare(members, union, support)
        home = np.array([union.find(int(d)) for d in copy_of], np.int64)
        hub: dict[int, int] = {}
        for d in range(len(self.ids)):
            c = int(home[d])
            if copy_of[d] == d and (c not in hub or (support[d], -d) > (support[hub[c]], -hub[c])):
                hub[c] = d
        hubs = np.array([hub[int(c)] for c in home], np.int64) if len(home) else home
        rows = [(self.chunk % self.buckets, self.chunk, LOCAL, self.ids.tobytes() + self.ids[hubs].tobytes())] if len(hubs) else []
        if by_key:
            # the members of each key by class, each class behind its hub
            keys = np.repeat(np.array(list(by_key), np.uint64), [len(m) for m in by_key.values()])
            who = np.concatenate([np.array(m, np.int64) for m in by_key.values()])
            hub_of = hubs[who]
            order = np.lexsort((who, who != hub_of, self.ids[hub_of], keys))
            keys, who, hub_of = keys[order], who[order], hub_of[order]
            first = np.r_[True, (keys[1:] != keys[:-1]) | (hub_of[1:] != hub_of[:-1])]
            role = np.where(first & (who == hub_of), HUB, MEMBER).astype(np.uint8)
            lacks = np.flatnonzero(first & (who != hub_of))
            keys, who, role = np.insert(keys, lacks, keys[lacks]), np.insert(who, lacks, hub_of[lacks]), np.insert(role, lacks, np.uint8(HUB_ONLY))
            who = self.ids[who]
            rows += [(b, self.chunk, KEYS, keys[s:e].tobytes() + who[s:e].tobytes() + role[s:e].tobytes()) for b, s, e in cuts(keys, self.buckets)]
        return sent(rows)

    def _contents(self) -> list[bytes]:
        """A digest of each document's features and counts; equal features, equal digests."""
        n = len(self.ids)
        out = np.zeros((n, 3), np.uint64)
        some = np.flatnonzero(self.starts[1:] > self.starts[:-1])
        if len(some):
            c = self.count.astype(np.uint64)
            at = self.starts[:-1][some]
            out[some, 0] = np.add.reduceat(mix(self.hash + c * _M), at)
            out[some, 1] = np.add.reduceat(mix(self.hash * np.uint64(0xC2B2AE3D27D4EB4F) ^ c), at)
            out[some, 2] = np.diff(self.starts)[some]
        return [row.tobytes() for row in out]

    def _compare(self, members: list[int], union: Union, support: dict[int, int]) -> None:
        """Link the members of one band key: each is compared with every class until a member of it is similar."""
        classes: dict[int, list[int]] = {}
        for d in members:
            classes.setdefault(union.find(d), []).append(d)
        groups = list(classes.values())
        done = [groups[0]]
        for g in groups[1:]:
            linked = []
            for at, other in enumerate(done):
                other.sort(key=lambda x: -support[x])
                pair = next(((x, y) for x in g for y in other if similarity(*self.features(x), *self.features(y)) >= THRESHOLD), None)
                if pair:
                    union.join(*pair)
                    support[pair[0]] += 1
                    support[pair[1]] += 1
                    linked.append(at)
            if linked:
                joined = g + [x for at in linked for x in done[at]]
                done = [o for at, o in enumerate(done) if at not in linked] + [joined]
            else:
                done.append(g)

    def leaders(self) -> pa.Table:
        """Round 3: features of leaders, once to each chunk that compares with them."""
        wanted: set[tuple[int, int]] = set()
        for v in self.got[TASKS].values():
            m = np.frombuffer(v, np.int64).reshape(-1, 3)
            wanted |= {(int(a), int(b)) for kind, a, b in m.tolist() if kind == 1}
        place = {int(x): d for d, x in reversed(list(enumerate(self.ids.tolist())))}
        by_target: dict[int, list[bytes]] = defaultdict(list)
        for who, target in sorted(wanted):
            h, w = self.features(place[who])
            by_target[target].append(np.array([who, len(h)], np.int64).tobytes() + _fold(h, w))
        return sent([(t, self.chunk, FEATURES, b"".join(parts)) for t, parts in by_target.items()])

    def links(self) -> pa.Table:
        """Round 4: (LINK, a, b) with a the document and b its class's hub here, or a hub and another chunk's document that is
        similar to one of its class; (ON_KEY, a, b) with a a document on the large key b; (WITH_FEATURES, a, b, features)
        with b the size of a's features."""
        ids = hubs = self.ids
        for v in self.got[LOCAL].values():
            ids, hubs = np.frombuffer(v, np.int64).reshape(2, -1)
        place = {int(x): d for d, x in reversed(list(enumerate(self.ids.tolist())))}
        members: dict[int, list[int]] = defaultdict(list)
        for i, u in zip(ids.tolist(), hubs.tolist()):
            members[u].append(place[i])
        leader: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for v in self.got[FEATURES].values():
            at = 0
            while at < len(v):
                who, n = np.frombuffer(v[at : at + 16], np.int64).tolist()
                leader[who] = np.frombuffer(v[at + 16 : at + 16 + 4 * n], np.uint32), np.frombuffer(v[at + 16 + 4 * n : at + 16 + 8 * n], np.float32)
                at += 16 + 8 * n
        tasks: set[tuple[int, int, int]] = set()
        for v in self.got[TASKS].values():
            m = np.frombuffer(v, np.int64).reshape(-1, 3)
            tasks |= {(int(kind), int(a), int(b)) for kind, a, b in m.tolist() if kind != 1}
        a, b = list(ids), list(hubs)
        contents = self._contents() if tasks else []
        hub_of = dict(zip(ids.tolist(), hubs.tolist()))
        union = Union()
        for kind, own, other in sorted(tasks):
            home = hub_of[own]
            if union.find(home) == union.find(other):
                continue
            lh, lw = leader[other]
            seen: set[bytes] = set()
            for d in sorted(members[own], key=lambda d: self.ids[d] != own) if kind == 0 else [place[own]]:
                h, w = self.features(d)
                if contents[d] in seen:
                    continue
                seen.add(contents[d])
                f = _fold(h, w)
                if similarity(np.frombuffer(f[: 4 * len(h)], np.uint32), np.frombuffer(f[4 * len(h) :], np.float32), lh, lw) >= THRESHOLD:
                    a.append(home)
                    b.append(other)
                    union.join(home, other)
                    break
        kinds = [LINK] * len(a)
        on_large: set[int] = set()
        for v in self.got[LARGE].values():
            keys, who = np.frombuffer(v, np.int64).reshape(2, -1)
            kinds += [ON_KEY] * len(who)
            a += who.tolist()
            b += keys.tolist()
            on_large.update(who.tolist())
        large = sorted(on_large)
        blobs = [None] * len(a) + [pa.compress(_fold(*self.features(place[x])), "zstd", asbytes=True) for x in large]
        held = [8 * int(self.starts[place[x] + 1] - self.starts[place[x]]) for x in large]
        kinds += [WITH_FEATURES] * len(large)
        return pa.table(
            [pa.array(kinds, pa.int32()), pa.array([*a, *large], pa.int64()), pa.array([*b, *held], pa.int64()), pa.array(blobs, pa.binary())],
            names=["kind", "a", "b", "features"],
        )


def _fold(h: np.ndarray, w: np.ndarray) -> bytes:
    """Features for comparing with another chunk's: 32 bits of the hash, in order, and weights."""
    small = (h >> np.uint64(16)).astype(np.uint32)
    order = np.argsort(small, kind="stable")
    return small[order].tobytes() + w[order].tobytes()


def judge_frequencies(bucket: int, table: pa.Table) -> pa.Table:
    heads, slots, counts = [], [], []
    for origin, _, v in received(table):
        x, rest = _unpack_slots(v)
        heads.append((origin, len(x)))
        slots.append(x)
        counts.append(_unpack(rest, len(x)))
    all_slots, all_counts = np.concatenate(slots), np.concatenate(counts)
    order = np.argsort(all_slots, kind="stable")
    sorted_slots = all_slots[order]
    new = np.r_[True, sorted_slots[1:] != sorted_slots[:-1]]
    sums = np.add.reduceat(all_counts[order], np.flatnonzero(new))
    df = np.empty(len(order), np.int64)
    df[order] = sums[np.cumsum(new) - 1]
    rows, at = [], 0
    for origin, n in heads:
        rows.append((origin, bucket, FREQ, _pack(df[at : at + n])))
        at += n
    return sent(rows)


def judge_keys(bucket: int, table: pa.Table) -> pa.Table:
    """Who is compared with whom: to each chunk (0, its hub, leader), (2, its document, document) and (1, its hub or document,
    chunk that needs the features); and its documents on large keys."""
    keys, who, role, home = [], [], [], []
    local = [(origin, bucket, LOCAL, v.tobytes()) for origin, kind, v in received(table) if kind == LOCAL]  # back to their chunks
    for origin, kind, v in received(table):
        if kind == KEYS:
            k = len(v) // 17
            keys.append(np.frombuffer(v[: 8 * k], np.uint64))
            who.append(np.frombuffer(v[8 * k : 16 * k], np.int64))
            role.append(np.frombuffer(v[16 * k :], np.uint8))
            home.append(np.full(k, origin, np.int32))
    out: dict[int, set[tuple[int, int, int]]] = defaultdict(set)
    large: dict[int, list[np.ndarray]] = defaultdict(list)
    if keys:
        keys, who, role, home = map(np.concatenate, (keys, who, role, home))
        order = np.argsort(keys, kind="stable")  # classes stay behind their hubs
        keys, who, role, home = keys[order], who[order], role[order], home[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        ends = np.r_[starts[1:], len(keys)]
        several = home[starts] != home[ends - 1]  # entries are in the order of their chunks
        for s, e in zip(starts[several].tolist(), ends[several].tolist()):
            on_key = s + np.flatnonzero(role[s:e] != HUB_ONLY)
            if len(on_key) <= PAIRED:
                pairs = on_key[np.argsort(who[on_key], kind="stable")]
                for i, x in enumerate(pairs.tolist()):
                    for y in pairs[:i].tolist():  # in the chunk of the larger id
                        if home[x] != home[y]:
                            out[int(home[x])].add((2, int(who[x]), int(who[y])))
                            out[int(home[y])].add((1, int(who[y]), int(home[x])))
                continue
            head = s + np.flatnonzero(role[s:e] != MEMBER)
            n = np.add.reduceat((role[s:e] != HUB_ONLY).astype(np.int64), head - s)
            order = np.argsort(who[head], kind="stable")
            head, n = head[order], n[order]
            led = {int(np.argmax(n)), *range(min(len(head), LEADERS - 1))}
            for x in range(len(head)):
                for y in led:
                    # a pair of leaders is compared once, in the chunk of the larger id
                    hx, hy = int(home[head[x]]), int(home[head[y]])
                    if hx != hy and not (x in led and x < y):
                        out[hx].add((0, int(who[head[x]]), int(who[head[y]])))
                        out[hy].add((1, int(who[head[y]]), hx))
            at = home[on_key]
            for c, b, t in zip(*_runs(at)):
                large[c].append(np.stack([keys[on_key[b:t]].view(np.int64), who[on_key[b:t]]]))
    rows = [(c, bucket, TASKS, np.array(sorted(t), np.int64).tobytes()) for c, t in out.items()]
    return sent(rows + [(c, bucket, LARGE, np.concatenate(m, 1).tobytes()) for c, m in large.items()] + local)


def _runs(x: np.ndarray) -> tuple[list, list, list]:
    """(value, start, end) of the runs of equal values."""
    new = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    return x[new].tolist(), new.tolist(), [*new[1:].tolist(), len(x)]


def compare_blocks(table: pa.Table) -> pa.Table:
    """Links (a, b) between classes that have similar documents in the two blocks, or in the one block, of a pair."""
    order = np.lexsort((table.column("id").to_numpy(), table.column("side").to_numpy()))
    side, home = (table.column(c).to_numpy()[order] for c in ("side", "class_id"))
    size = table.column("size").to_numpy()[order].tolist()
    packed = table.column("features").combine_chunks().take(pa.array(order))
    raw = [pa.decompress(v.as_buffer(), n, "zstd", asbytes=True) for v, n in zip(packed, size)]
    hashes = [np.frombuffer(v, np.uint32, len(v) // 8) for v in raw]
    weights = [np.frombuffer(v, np.float32, len(v) // 8, len(v) // 2) for v in raw]
    total = np.array([w.sum(dtype=np.float64) for w in weights])
    two = side[0] != side[-1]
    right = np.flatnonzero(side == side[-1])
    at = np.repeat(np.arange(len(right)), [len(hashes[d]) for d in right])
    h, w = np.concatenate([hashes[d] for d in right]), np.concatenate([weights[d] for d in right])
    order = np.argsort(h, kind="stable")
    h, w, at = h[order], w[order], at[order]
    union, a, b = Union(), [], []
    for x in np.flatnonzero(side == side[0]).tolist():
        lo, hi = np.searchsorted(h, hashes[x], "left"), np.searchsorted(h, hashes[x], "right")
        n = hi - lo
        place = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        low = np.bincount(at[place], np.minimum(w[place], np.repeat(weights[x], n)), len(right))
        for k in np.flatnonzero(low >= THRESHOLD * (total[x] + total[right] - low)).tolist():
            c, d = int(home[x]), int(home[right[k]])
            if (two or right[k] < x) and union.find(c) != union.find(d):
                union.join(c, d)
                a.append(c)
                b.append(d)
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def block_pairs(rows: DataFrame) -> DataFrame:
    """(pair, side, id, class_id): the documents of every two blocks of a key. ``rows``: key, id, class_id."""
    classes = cut(rows.groupBy("key", "class_id").agg(F.count("*").alias("n")))
    loose = cut(classes.where(F.col("n") <= BLOCK_DOCS).groupBy("key").agg(F.sum("n").alias("loose")))
    rows = sized_join(sized_join(rows, classes, ["key", "class_id"], "inner"), loose, ["key"], "left")
    own = F.col("n") > BLOCK_DOCS
    parts = F.ceil(F.when(own, F.col("n")).otherwise(F.col("loose")) / BLOCK_DOCS)
    number = F.pmod(F.xxhash64(F.when(own, F.col("id")).otherwise(F.col("class_id"))), parts)
    rows = cut(rows.select("key", "id", "class_id", F.when(own, F.col("class_id")).alias("whole"), number.alias("number")))
    rows = rows.withColumn("block", F.xxhash64("key", "whole", "number", F.col("whole").isNull()))
    blocks = cut(rows.select("key", "block", "whole").distinct())
    x, y = blocks.alias("x"), blocks.alias("y")
    met = (F.col("x.block") < F.col("y.block")) & ~F.coalesce(F.col("x.whole") == F.col("y.whole"), F.lit(False))
    alone = (F.col("x.block") == F.col("y.block")) & F.col("x.whole").isNull()
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (met | alone)).select(F.col("x.key").alias("key"), F.col("x.block").alias("one"), F.col("y.block").alias("two"))
    pairs = pairs.withColumn("pair", F.xxhash64("key", "one", "two"))
    sides = pairs.select("pair", F.col("one").alias("block"), F.lit(0).alias("side")).unionByName(pairs.where("one <> two").select("pair", F.col("two").alias("block"), F.lit(1).alias("side")))
    return sized_join(rows, cut(sides), ["block"], "inner").select("pair", "side", "id", "class_id")


def key_groups(on_key: DataFrame) -> DataFrame | None:
    """key, id, class_id of the keys whose documents are in several classes; None without any. Keys whose classes have the
    same least name, seen through a key and a class more, are joined under it, so that a document on many alike keys is
    compared once, unless that would gather over ``GROUP_DOCS`` documents: then they stay apart. ``on_key``: key, id, class_id."""
    keys = on_key.groupBy("key").agg(F.min("class_id").alias("low"), F.max("class_id").alias("_high")).where("low <> _high")
    rows = cut(on_key.join(keys.select("key", "low"), "key"))
    if rows.limit(1).count() == 0:
        return None
    edges = rows.select("key", "class_id", "low").distinct()
    through = edges.groupBy("class_id").agg(F.min("low").alias("_via"))
    named = edges.join(through, "class_id").groupBy("key").agg(F.min("_via").alias("group"))
    joined = cut(rows.select("key", "id", "class_id").join(named, "key"))
    merged = joined.select("group", "id", "class_id").distinct()
    large = merged.groupBy("group").agg(F.count("*").alias("_n")).where(F.col("_n") > GROUP_DOCS).select("group")
    apart = joined.join(large, "group", "left_semi").select("key", "id", "class_id")
    return merged.join(large, "group", "left_anti").select(F.col("group").alias("key"), "id", "class_id").unionByName(apart)


def components(links: DataFrame) -> DataFrame:
    """(id, class_id) of every id in ``links`` (a, b): the least id that links reach.

    Labels go along links and are then followed to their own label, so rounds grow with the logarithm of a chain's
    length; each round is checkpointed.
    """
    edges = links.where("a <> b").select("a", "b")
    edges = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct().withColumn("class_id", F.col("id")))
    while True:
        seen = edges.join(labels.select(F.col("id").alias("b"), "class_id"), "b").groupBy(F.col("a").alias("id")).agg(F.min("class_id").alias("low"))
        step = labels.join(seen, "id", "left").select("id", F.col("class_id").alias("old"), F.least("class_id", F.coalesce("low", "class_id")).alias("class_id"))
        jump = step.alias("s").join(step.select(F.col("id").alias("via"), F.col("class_id").alias("there")), F.col("s.class_id") == F.col("via"), "left")
        new = cut(jump.select("s.id", "s.old", F.least("s.class_id", F.coalesce("there", "s.class_id")).alias("class_id")))
        if new.where("old <> class_id").limit(1).count() == 0:
            return new.select("id", "class_id")
        labels = new.select("id", "class_id")


_OWN = 1 << 62  # keys below minus this stand for rows that their id doesn't tell apart


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bool]:
    """``docs`` with ``_key`` (the id, where no other row has it, else from id and text); and whether all keys are ids."""
    own = F.col(id_col).cast("long")
    again = cut(docs.groupBy(own.alias("_id")).count().where(f"count > 1 OR _id IS NULL OR _id < -{_OWN}").select("_id", F.lit(True).alias("_again")))
    if again.limit(1).count() == 0:
        return docs.withColumn("_key", own), True
    rows = sized_join(docs.withColumn("_id", F.coalesce(own, F.lit(NO_ID))), again.select(F.coalesce("_id", F.lit(NO_ID)).alias("_id"), "_again"), ["_id"], "left")
    digest = F.xxhash64("_id", F.coalesce(F.col(text_col), F.lit(""))).bitwiseAND(F.lit(_OWN - 1))
    return rows.withColumn("_key", F.when(F.col("_again"), F.lit(-_OWN - 1) - digest).otherwise(F.col("_id"))).drop("_id", "_again"), False


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, kept: one row for each row of ``docs``; a class is named by its least id."""
    rows, plain = keyed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    classes = key_classes(rows)
    if plain:
        return classes.select(F.col("key").alias("doc_id"), "class_id", (F.col("key") == F.col("class_id")).alias("kept"))
    low = _keepers(rows, classes)
    known = rows.groupBy("_key", "doc_id").agg(F.count("*").alias("_n")).join(low, "_key")
    copies = known.select("*", F.posexplode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_at", "_k"))
    return copies.select("doc_id", "class_id", (F.col("_stays") & (F.col("_at") == 0)).alias("kept"))


def _keepers(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """_key, class_id (the least id, null if none has one), _stays: one key of each class."""
    rank = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.negative("_key").alias("k"))
    ranked = cut(rows.select("_key", rank.alias("_rank")).distinct().join(classes.select(F.col("key").alias("_key"), F.col("class_id").alias("_class")), "_key"))
    least = cut(ranked.groupBy("_class").agg(F.min("_rank").alias("_least")))
    met = sized_join(ranked, least, ["_class"], "inner")
    return met.select("_key", F.nullif("_least.id", F.lit(NO_ID)).alias("class_id"), (F.col("_rank") == F.col("_least")).alias("_stays"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each class."""
    names = docs.columns
    at = {c: f"c{k}" for k, c in enumerate(names)}
    rows, plain = keyed(docs.toDF(*at.values()), at[id_col], at[text_col])
    base = rows.select(F.col(at[id_col]).cast("long").alias("doc_id"), F.col(at[text_col]).alias("text"), "_key")
    classes = key_classes(base)
    gone = classes.where("key <> class_id").select(F.col("key").alias("_key")) if plain else _keepers(base, classes).where("not _stays").select("_key")
    out = sized_join(rows, cut(gone), ["_key"], "left_anti")
    if not plain:  # one of rows alike in id and text
        single = out.where(f"_key >= -{_OWN}").select(*at.values())
        several = out.where(f"_key < -{_OWN}").groupBy("_key").agg(F.min_by(F.struct(*at.values()), F.xxhash64(*at.values())).alias("_row")).select("_row.*")
        out = single.unionByName(several)
    return out.select(*at.values()).toDF(*names)


def key_classes(docs: DataFrame, id_col: str = "_key", text_col: str = "text") -> DataFrame:
    """key, class_id (the least key) of each distinct key. ``docs``: keys that tell texts apart."""
    chunks, buckets = sizes(docs, text_col)
    total = docs.count()
    base = chunked(docs, chunks, id_col, text_col)

    def at_chunks(answers: DataFrame, f, schema: str) -> DataFrame:
        mine = answers.withColumnRenamed("target", "chunk")
        return base.groupBy("chunk").cogroup(mine.groupBy("chunk")).applyInArrow(lambda key, t, got: released(lambda: f(Chunk(key[0].as_py(), t, buckets, total, got))), schema)

    counts = base.groupBy("chunk").applyInArrow(lambda key, t: released(lambda: Chunk(key[0].as_py(), t, buckets).frequencies()), BLOCKS)
    freq = at_buckets(counts, buckets, judge_frequencies)
    bands = at_chunks(freq, Chunk.bands, BLOCKS)
    tasks = at_buckets(bands, buckets, judge_keys)
    known = freq.unionByName(tasks)
    features = at_chunks(known.where(F.col("kind") != LARGE), Chunk.leaders, BLOCKS)
    found = cut(at_chunks(known.unionByName(features), Chunk.links, "kind int, a long, b long, features binary"))
    links = found.where(F.col("kind") == LINK).select("a", "b")
    # hubs are few; documents follow their hub
    hubs = components(links.where("a <> b"))
    home = links.select(F.col("a").alias("doc_id"), F.col("b").alias("_hub"))
    low = home.groupBy("doc_id").agg(F.min("_hub").alias("_hub"))
    out = low.join(hubs.select(F.col("id").alias("doc_id"), "class_id"), "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    on_key = found.where(F.col("kind") == ON_KEY).select(F.col("a").alias("doc_id"), F.col("b").alias("key"))
    if on_key.limit(1).count():
        out = cut(out)
        groups = key_groups(on_key.join(out, "doc_id").select("key", F.col("doc_id").alias("id"), "class_id"))
        if groups is not None:
            features = found.where(F.col("kind") == WITH_FEATURES).select(F.col("a").alias("id"), F.col("b").alias("size"), "features")
            met = block_pairs(cut(groups)).join(features, "id")
            more = cut(met.groupBy("pair").applyInArrow(lambda t: released(compare_blocks, t), "a long, b long"))
            joined = components(more).select(F.col("id").alias("class_id"), F.col("class_id").alias("_class"))
            out = sized_join(out, cut(joined), ["class_id"], "left").select("doc_id", F.coalesce("_class", "class_id").alias("class_id"))
    return out.select(F.col("doc_id").alias("key"), "class_id")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = cut(near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    known = F.coalesce("class_id", F.lit(NO_ID)).alias("_class")
    sizes_ = cut(classes.groupBy(known).agg(F.count("*").alias("class_size")).where("class_size > 1"))
    out = sized_join(classes.select("*", known), sizes_, ["_class"], "left")
    return out.select("doc_id", "class_id", F.coalesce(F.when(F.col("class_id").isNotNull(), F.col("class_size")), F.lit(1).cast("long")).alias("class_size"), "kept")
