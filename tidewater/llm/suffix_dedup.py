"""Operator 1: removal of repeated passages by a run-length index.

Every byte covered by a string of ``MATCH`` bytes that also starts in a document with a smaller id is removed; matches are
judged on the input and never cross documents.

How. A string of 50 bytes holds at least one *anchor*: the 20-byte place with the least hash among its 31. Equal
strings have equal anchors at equal offsets, so only documents that share an anchor can share a string.
1. Chunks send their distinct anchors to buckets, which answer: lone, shared, or shared with many contexts.
2. For shared anchors chunks send the hash of the anchor's context (80 bytes: all strings that hold it) and the least
   id. A context that an earlier document also has is wholly repeated. Anchors with one context are settled thus.
3. The first holders of the other contexts send the bytes. The bucket builds a run-length index of them
   (:class:`RunIndex`), streams matching statistics of the later contexts through it, and marks every place
   whose match is 50 or longer if the class of the matched row has a smaller id.
4. Chunks turn the answers into spans and cut them out.
Anchors with very many contexts (at the edge of a passage in a third of all documents, say) are dealt by the hash of
each 50-byte string instead, combined per chunk, so that no bucket gathers them.

Defined results
- null text is empty; documents under 50 bytes keep everything; documents with equal ids never match each other; a
  null id counts as larger than any other;
  other columns are ignored; an empty table gives no rows; repeated rows give repeated results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.exchange import BLOCKS, NO_ID, at_buckets, chunked, cuts, mix, received, released, sent, sizes, texts_of
from tidewater.llm.run_index import RunIndex

MATCH = 50
SEED = 20
REACH = MATCH - SEED  # bytes of context on either side of an anchor
CONTEXT = MATCH + REACH
MANY = 2048  # more contexts than this beyond one per chunk: dealt string by string
PIECE = 48 << 10  # bytes scanned at a time: the arrays stay in a core's cache
INDEX_ROWS = 4_000  # contexts to an index: bounds a worker's memory
ALL, ASK = np.uint32(0xFFFFFFFF), np.uint32(0xFFFFFFFE)
SHARED, STRINGS, ASKED = 1, 2, 3  # kinds of blocks

_PAD = np.full(REACH + MATCH, 255, np.uint8)  # no byte of UTF-8 text


def _kmer_hash(a: np.ndarray) -> np.ndarray:
    """Hash of the SEED bytes from each place (SEED = 16 + 4)."""
    part, n, four = a.astype(np.uint64) + np.uint64(1), 1, None
    while n < 16:
        joined = part[:-n] * np.uint64(0x9E3779B97F4A7C15 + 2 * n)
        joined += part[n:]
        part = joined >> np.uint64(29)
        part ^= joined
        n *= 2
        if n == 4:
            four = part
    tail = four[16:]
    return mix(part[: len(tail)] * np.uint64(0x94D049BB133111EB) + tail)


def _sliding(a: np.ndarray, w: int, op) -> np.ndarray:
    n = 1
    while 2 * n <= w:
        a = op(a[:-n], a[n:])
        n *= 2
    return op(a[: -(w - n)], a[w - n :]) if w > n else a


def _words_hash(rows: np.ndarray, seed: int) -> np.ndarray:
    """Hash of each row of a uint8 matrix."""
    fill = -rows.shape[1] % 8
    if fill:
        rows = np.hstack([rows, np.zeros((len(rows), fill), np.uint8)])
    words = np.ascontiguousarray(rows).view("<u8")
    h = np.full(len(rows), np.uint64(seed))
    for k in range(words.shape[1]):
        h = mix((h ^ words[:, k]) * np.uint64(0x9E3779B97F4A7C15))
    return h


class Anchors:
    """The anchors of a chunk's documents: hash, place in the chunk's bytes, document, context bytes on demand."""

    def __init__(self, table: pa.Table):
        self.ids, self.data, self.offsets, order = texts_of(table)
        self.carried = table.select([c for c in table.column_names if c.startswith("_c")]).take(pa.array(order))
        hashes, places, contexts = [], [], []
        batch: list[tuple[int, int, int]] = []
        size = 0
        for d in range(len(self.ids)):
            s, e = int(self.offsets[d]), int(self.offsets[d + 1])
            for x in range(s, e if e - s >= MATCH else s, PIECE):
                y = min(x + PIECE, e)
                batch.append((d, x, y))
                size += y - x
                if size >= PIECE:
                    self._scan(batch, hashes, places, contexts)
                    batch, size = [], 0
        if batch:
            self._scan(batch, hashes, places, contexts)
        cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
        self.hash, self.place, self.context = cat(hashes, np.uint64), cat(places, np.int64), cat(contexts, np.uint64)
        self.doc = np.searchsorted(self.offsets, self.place, "right") - 1
        self.doc_id = self.ids[self.doc] if len(self.ids) else np.zeros(0, np.int64)

    def _scan(self, batch, hashes, places, contexts) -> None:
        parts, starts, origin, lead, at = [], [], [], [], 0
        for d, x, y in batch:
            s, e = int(self.offsets[d]), int(self.offsets[d + 1])
            lo, hi = max(s, x - REACH), min(e, y + MATCH - 1)
            before, after = _PAD[: REACH - (x - lo)], _PAD[: MATCH - 1 - (hi - y) + 1]
            parts += [before, self.data[lo:hi], after]
            starts.append(at + REACH)  # where place x lies
            origin.append(x)
            lead.append(y - x)
            at += len(before) + hi - lo + len(after)
        a = np.concatenate(parts)
        h = _kmer_hash(a)
        wins = REACH + 1
        least = _sliding(h, wins, np.minimum)  # for the string from each place
        bad = np.zeros(len(a) + 1, np.int32)
        np.cumsum(a == 255, out=bad[1:])
        n = len(a) - MATCH + 1
        least = np.where(bad[MATCH : MATCH + n] == bad[:n], least[:n], np.uint64(0))
        # an anchor is the least place of some whole string that holds it
        top = _sliding(np.r_[np.zeros(REACH, np.uint64), least, np.zeros(REACH, np.uint64)], wins, np.maximum)[: len(h)]
        found = np.flatnonzero((top == h[: len(top)]) & (top > 0))
        starts, origin, lead = np.array(starts), np.array(origin), np.array(lead)
        p = np.searchsorted(starts, found, "right") - 1
        rel = found - starts[np.maximum(p, 0)]
        own = (p >= 0) & (rel >= 0) & (rel < lead[np.maximum(p, 0)])
        found, p, rel = found[own], p[own], rel[own]
        if len(found):
            ctx = np.lib.stride_tricks.sliding_window_view(a, CONTEXT)[found - REACH]
            hashes.append(mix(h[found] * np.uint64(0xD6E8FEB86659FD93)))  # the least hashes are small: spread them over the buckets
            places.append(origin[p] + rel)
            contexts.append(_words_hash(ctx, 80))

    def context_bytes(self, which: np.ndarray) -> np.ndarray:
        """CONTEXT bytes around the anchors, padded where the document ends."""
        out = np.full((len(which), CONTEXT), 255, np.uint8)
        if len(which):
            place, doc = self.place[which], self.doc[which]
            cols = place[:, None] - REACH + np.arange(CONTEXT)
            inside = (cols >= self.offsets[doc][:, None]) & (cols < self.offsets[doc + 1][:, None])
            out[inside] = self.data[cols[inside]]
        return out

    def string_hashes(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, index into ``which``, start) of every whole string that holds one of the anchors."""
        ctx = self.context_bytes(which)
        hs, ix, st = [], [], []
        for j in range(REACH + 1):
            win = ctx[:, j : j + MATCH]
            ok = np.flatnonzero((win != 255).all(1))
            hs.append(_words_hash(win[ok], 50))
            ix.append(ok)
            st.append(self.place[which[ok]] - REACH + j)
        return np.concatenate(hs), np.concatenate(ix), np.concatenate(st)


def _first_ids(keys: tuple[np.ndarray, ...], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order: (index of one row of each with the least id, start of each, index of the key by row)."""
    order = np.lexsort((ids, *reversed(keys)))
    new = np.r_[True, np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)] if len(order) else np.zeros(0, bool)
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(new) - 1
    return order[new], np.flatnonzero(new), entry


class Chunk:
    """What a chunk derives from its documents and the answers so far; the same in every round."""

    def __init__(self, chunk: int, table: pa.Table, buckets: int, answers: pa.Table | None = None):
        self.chunk, self.buckets = chunk, buckets
        self.a = a = Anchors(table)
        self.keys, self.of = np.unique(a.hash, return_inverse=True)
        self.got: dict[int, dict[int, memoryview]] = {}
        if answers is not None:
            for o, k, v in received(answers):
                self.got.setdefault(k, {})[o] = v
        if answers is not None:
            status = self._answer(SHARED, cuts(self.keys, buckets), np.uint8)
            st = status[self.of] if len(self.of) else np.zeros(0, np.uint8)
            self.shared, self.many = np.flatnonzero(st == 1), np.flatnonzero(st == 2)
            # contexts of shared anchors, in order of (anchor, context)
            self.first, _, self.entry = _first_ids((a.hash[self.shared], a.context[self.shared]), a.doc_id[self.shared])
            self.first = self.shared[self.first]
            self.entry_cuts = cuts(a.hash[self.first], buckets)
            # strings at anchors with many contexts
            self.s_hash, self.s_ix, self.s_start = a.string_hashes(self.many) if len(self.many) else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            self.s_doc = a.doc_id[self.many[self.s_ix]] if len(self.many) else np.zeros(0, np.int64)
            self.s_first, _, self.s_entry = _first_ids((self.s_hash,), self.s_doc)
            self.s_cuts = cuts(self.s_hash[self.s_first], buckets)

    def _answer(self, kind: int, runs: list[tuple[int, int, int]], dtype) -> np.ndarray:
        n = runs[-1][2] if runs else 0
        out = np.zeros(n, dtype)
        got = self.got.get(kind, {})
        for b, s, e in runs:
            out[s:e] = np.frombuffer(got[b], dtype)
        return out

    def anchors(self) -> pa.Table:
        """Round 1: anchor, and one byte: distinct contexts here (up to 127), 128 if in two documents or more."""
        a = self.a
        contexts = np.ones(len(self.keys), np.int64)
        low, high = np.zeros(len(self.keys), np.int64), np.zeros(len(self.keys), np.int64)
        more = np.flatnonzero((np.bincount(self.of, minlength=len(self.keys)) > 1)[self.of]) if len(self.keys) else np.zeros(0, np.int64)
        if len(more):  # only anchors that occur again here
            of = self.of[more]
            first, _, _ = _first_ids((a.hash[more], a.context[more]), a.doc_id[more])
            n = np.bincount(of[first], minlength=len(self.keys))
            contexts = np.maximum(n, 1)
            low[of], high[of] = np.iinfo(np.int64).max, np.iinfo(np.int64).min
            np.minimum.at(low, of, a.doc_id[more])
            np.maximum.at(high, of, a.doc_id[more])
        note = np.minimum(contexts, 127).astype(np.uint8) | np.where(high > low, 128, 0).astype(np.uint8)
        return sent([(b, self.chunk, SHARED, self.keys[s:e].tobytes() + note[s:e].tobytes()) for b, s, e in cuts(self.keys, self.buckets)])

    def contexts(self) -> pa.Table:
        """Round 2: (anchor, context hash, least id) of shared anchors; (string hash, least id) of the others."""
        f, a = self.first, self.a
        rows = [(b, self.chunk, SHARED, a.hash[f[s:e]].tobytes() + a.context[f[s:e]].tobytes() + a.doc_id[f[s:e]].tobytes()) for b, s, e in self.entry_cuts]
        g = self.s_first
        rows += [(b, self.chunk, STRINGS, self.s_hash[g[s:e]].tobytes() + self.s_doc[g[s:e]].tobytes()) for b, s, e in self.s_cuts]
        return sent(rows)

    def codes(self) -> np.ndarray:
        return self._answer(SHARED + 10, self.entry_cuts, np.uint32)

    def asked(self) -> np.ndarray:
        return np.flatnonzero(self.codes() == ASK)

    def asked_bytes(self) -> pa.Table:
        """Round 3: (anchor, id, context bytes) where they were asked for."""
        rows = self.first[self.asked()]
        a, ctx = self.a, self.a.context_bytes(rows)
        return sent([(b, self.chunk, ASKED, a.hash[rows[s:e]].tobytes() + a.doc_id[rows[s:e]].tobytes() + ctx[s:e].tobytes()) for b, s, e in cuts(a.hash[rows], self.buckets)])

    def removed(self) -> pa.Table:
        """Round 4: the documents without their repeated bytes."""
        a = self.a
        diff = np.zeros(len(a.data) + 1, np.int32)

        def mark(first: np.ndarray, last: np.ndarray) -> None:  # strings that start at first .. last
            np.add.at(diff, first, 1)
            np.add.at(diff, last + MATCH, -1)

        codes = self.codes()
        if len(self.shared):
            code = codes[self.entry]
            later = a.doc_id[self.shared] > a.doc_id[self.first[self.entry]]
            whole = self.shared[(code == ALL) | later]
            low = np.maximum(a.place[whole] - REACH, a.offsets[a.doc[whole]])
            high = np.minimum(a.place[whole], a.offsets[a.doc[whole] + 1] - MATCH)
            mark(low, high)
            asked = self.asked()
            if len(asked):
                masks = np.zeros(len(codes), np.uint32)
                masks[asked] = self._answer(ASKED + 10, cuts(a.hash[self.first[asked]], self.buckets), np.uint32)
                some = np.flatnonzero(~((code == ALL) | later) & (masks[self.entry] > 0))
                m, rows = masks[self.entry[some]], self.shared[some]
                for j in range(REACH + 1):
                    r = rows[(m >> np.uint32(j)) & np.uint32(1) > 0]
                    s = a.place[r] - REACH + j
                    s = s[(s >= a.offsets[a.doc[r]]) & (s + MATCH <= a.offsets[a.doc[r] + 1])]
                    mark(s, s)
        if len(self.s_hash):
            elsewhere = self._answer(STRINGS + 10, self.s_cuts, np.uint8)
            hit = (elsewhere[self.s_entry] > 0) | (self.s_doc > self.s_doc[self.s_first[self.s_entry]])
            mark(self.s_start[hit], self.s_start[hit])
        covered = np.cumsum(diff[:-1], dtype=np.int32) > 0
        n = len(a.ids)
        before = np.r_[0, np.cumsum(covered)][a.offsets]
        rise = covered.copy()
        rise[1:] &= ~covered[:-1]
        inner = a.offsets[:-1][(a.offsets[:-1] < len(covered))]
        rise[inner] = covered[inner]
        spans = np.diff(np.r_[0, np.cumsum(rise)][a.offsets])
        removed = np.diff(before)
        lengths = np.diff(a.offsets)
        kept_offsets = np.r_[0, np.cumsum(lengths - removed)].astype(np.int32)
        kept = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(kept_offsets.tobytes()), pa.py_buffer(a.data[~covered].tobytes())])
        own = [pa.array(a.ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), kept]
        return pa.table([*own, *a.carried.columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *a.carried.column_names])


def _gathered(table: pa.Table, kind: int, *fields) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
    """Blocks of one kind, field by field (dtype, or an int: bytes a row): ((origin, rows) of each, joined fields)."""
    per = sum(f if isinstance(f, int) else np.dtype(f).itemsize for f in fields)
    heads, parts = [], [[] for _ in fields]
    for origin, k, v in received(table):
        if k != kind:
            continue
        n = len(v) // per
        heads.append((origin, n))
        at = 0
        for f, out in zip(fields, parts):
            size = n * (f if isinstance(f, int) else np.dtype(f).itemsize)
            x = np.frombuffer(v[at : at + size], np.uint8 if isinstance(f, int) else f)
            out.append(x.reshape(n, f) if isinstance(f, int) else x)
            at += size
    joined = [np.concatenate(p) if p else np.zeros((0, f) if isinstance(f, int) else 0, np.uint8 if isinstance(f, int) else f) for p, f in zip(parts, fields)]
    return heads, joined


def _answers(bucket: int, kind: int, heads: list[tuple[int, int]], values: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    rows, at = [], 0
    for origin, n in heads:
        rows.append((origin, bucket, kind, values[at : at + n].tobytes()))
        at += n
    return rows


def judge_anchors(bucket: int, table: pa.Table) -> pa.Table:
    """0: lone; 1: shared; 2: shared, with many contexts."""
    heads, (keys, notes) = _gathered(table, SHARED, np.uint64, np.uint8)
    u, of = np.unique(keys, return_inverse=True)
    holders = np.bincount(of, minlength=len(u))
    inside = np.zeros(len(u), bool)
    inside[of[notes >= 128]] = True
    more = np.bincount(of, weights=np.maximum((notes & 127).astype(np.int64), 1) - 1, minlength=len(u))
    status = np.where((holders > 1) | inside, np.where(more > MANY, 2, 1), 0).astype(np.uint8)
    return sent(_answers(bucket, SHARED, heads, status[of]))


def judge_contexts(bucket: int, table: pa.Table) -> pa.Table:
    heads, (keys, ctx, ids) = _gathered(table, SHARED, np.uint64, np.uint64, np.int64)
    first, _, entry = _first_ids((keys, ctx), ids)
    code = np.where(ids > ids[first[entry]], ALL, np.uint32(0)).astype(np.uint32)
    # the first holders of the other contexts are asked for bytes; several chunks may hold one first, under one id
    if len(first):
        k, i = keys[first], ids[first]
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        differ = np.minimum.reduceat(i, starts) < np.maximum.reduceat(i, starts)
        several = np.repeat(differ, np.diff(np.r_[starts, len(k)]))
        code[(code == 0) & several[entry]] = ASK
    rows = _answers(bucket, SHARED + 10, heads, code)
    heads, (keys, ids) = _gathered(table, STRINGS, np.uint64, np.int64)
    first, _, entry = _first_ids((keys,), ids)
    return sent(rows + _answers(bucket, STRINGS + 10, heads, (ids > ids[first[entry]]).astype(np.uint8) if len(ids) else np.zeros(0, np.uint8)))


def long_matches(anchor: np.ndarray, ids: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """For each context a mask: bit j is set if an earlier document's context has the string from j."""
    mask = np.zeros(len(ids), np.uint32)
    order = np.lexsort((ids, anchor))
    a, d = anchor[order], ids[order]
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[starts, len(a)])
    low = np.repeat(d[starts], counts) if len(a) else d
    high = np.repeat(d[starts + counts - 1], counts) if len(a) else d
    # whole groups together, up to INDEX_ROWS to an index
    batch = np.cumsum(counts) // INDEX_ROWS
    for b in np.unique(batch):
        g = np.flatnonzero(batch == b)
        rows = np.arange(starts[g[0]], starts[g[-1]] + counts[g[-1]])
        held = order[rows[d[rows] < high[rows]]]
        asks = order[rows[d[rows] > low[rows]]]
        if not len(held) or not len(asks):
            continue
        index = RunIndex(ctx[held], MATCH)
        earliest = index.class_minimum(ids[held])
        own = ids[asks]
        m = np.zeros(len(asks), np.uint32)
        for t, length, row in index.matching_statistics(ctx[asks]):
            if t <= REACH:
                hit = (length >= MATCH) & (earliest[index.class_of[row]] < own)
                m[hit] |= np.uint32(1 << t)
        mask[asks] = m
    return mask


def judge_bytes(bucket: int, table: pa.Table) -> pa.Table:
    heads, (keys, ids, ctx) = _gathered(table, ASKED, np.uint64, np.int64, CONTEXT)
    return sent(_answers(bucket, ASKED + 10, heads, long_matches(keys, ids, ctx)))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: the bytes that stay), and the columns named in ``carry``."""
    chunks, buckets = sizes(docs, text_col)
    base = chunked(docs, chunks, id_col, text_col, carry, by_text=True)

    def at_chunks(answers: DataFrame, f, schema: str) -> DataFrame:
        mine = answers.withColumnRenamed("target", "chunk")
        return base.groupBy("chunk").cogroup(mine.groupBy("chunk")).applyInArrow(lambda key, t, got: released(lambda: f(Chunk(key[0].as_py(), t, buckets, got))), schema)

    one = base.groupBy("chunk").applyInArrow(lambda key, t: released(lambda: Chunk(key[0].as_py(), t, buckets).anchors()), BLOCKS)
    status = at_buckets(one, buckets, judge_anchors)
    codes = status.unionByName(at_buckets(at_chunks(status, Chunk.contexts, BLOCKS), buckets, judge_contexts))
    masks = codes.unionByName(at_buckets(at_chunks(codes, Chunk.asked_bytes, BLOCKS), buckets, judge_bytes))
    more = "".join(f", _c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(carry or []))
    out = at_chunks(masks, Chunk.removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary" + more)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID))).withColumnsRenamed({f"_c{k}": c for k, c in enumerate(carry or [])})


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (
  SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 100) AS g
  FROM (SELECT doc_id, h, unnest(range(greatest(0, length(h) // 2 - 49))) AS i FROM d)),
m AS (SELECT g, min(doc_id) AS least FROM s GROUP BY g HAVING count(DISTINCT doc_id) > 1),
hit AS (SELECT s.doc_id, s.i FROM s JOIN m USING (g) WHERE s.doc_id > m.least),
edge AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM (SELECT DISTINCT doc_id, i FROM hit)),
span AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b
  FROM (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i - before > 50 THEN 1 ELSE 0 END)
               OVER (PARTITION BY doc_id ORDER BY i) AS k FROM edge)
  GROUP BY doc_id, k),
gap AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM span
  UNION ALL SELECT d.doc_id, coalesce(max(b), 0), length(any_value(h)) // 2 FROM d LEFT JOIN span USING (doc_id) GROUP BY d.doc_id),
kept AS (
  SELECT doc_id, string_agg(substr(h, CAST(2 * x + 1 AS BIGINT), CAST(2 * (y - x) AS BIGINT)), '' ORDER BY x) AS k
  FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(r.c, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id)
LEFT JOIN (SELECT doc_id, sum(b - a) AS n, count(*) AS c FROM span GROUP BY doc_id) r USING (doc_id)
"""
