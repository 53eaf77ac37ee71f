"""Greedy suppression of near-copies in order, and each article's distance to the nearest one kept before it.

Articles are put in order and dealt into blocks of bounded size; every two blocks meet in one task, the earlier one's
articles as candidates of the later one's. Three passes of this kind: which articles have an earlier one too close to them
(prefix filter: two sets that are alike share one of their rarest tokens); all such pairs of the few that this leaves open; the
largest similarity to a kept one, which is low for most articles, so that every pair counts: frequent tokens by columns of bytes, the
others by an index of the block. The last pass is quadratic in work, whatever the method; memory is bounded by the block.

Tokens are told apart by 64-bit hashes. A bounded sample says which are frequent: it decides how fast a pair is met, not what
comes out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.session import cut, shuffle_partitions, sized_join

# Tokens known by rank (two bytes each), articles they are counted in, tokens of a block (each article as EACH
# more), blocks that even few articles are dealt into, least tokens of a block, a column of their own for tokens that one in
# OFTEN candidates has (at most COLUMNS), rare tokens that are met on, rows unpacked at once
KNOWN, SAMPLE, BLOCK, EACH, SPREAD, LEAST, OFTEN, COLUMNS, SHARED, PART = 65536, 4096, 9_000_000, 64, 8, 500_000, 200, 2048, 4, 4096
SETS = "of long, id long, source string, n int, mid binary, far binary"


def _ranked(sets: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of tokens seen twice or more in a sample, ascending, and their ranks by frequency (0: most frequent)."""
    part = sets.where(F.pmod(F.xxhash64("id", "source"), F.lit(max(1, n // SAMPLE))) == 0)
    counts = part.select(F.explode("hashes").alias("h")).groupBy("h").count().where("count > 1")
    known = np.array([r["h"] for r in counts.orderBy(F.desc("count"), "h").limit(KNOWN).collect()], np.int64)
    rank = np.argsort(known)
    return known[rank], rank


def _packed(values: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    """Each row's values, descending, as bytes."""
    values = values[np.lexsort((-values.astype(np.int64), row))]
    ends = np.r_[0, np.cumsum(np.bincount(row, minlength=n))] * values.itemsize
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def _encoded(sets: DataFrame, known: np.ndarray, rank: np.ndarray) -> DataFrame:
    """Columns of, id, source, n and the tokens, rarest first: far (the unknown ones' keys), mid (the others' ranks)."""

    def run(batches):
        for b in batches:
            hashes = b["hashes"]
            values, lengths = hashes.flatten().to_numpy(zero_copy_only=False), hashes.value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), lengths)
            at = np.minimum(np.searchsorted(known, values), max(0, len(known) - 1))
            hit = known[at] == values if len(known) else np.zeros(len(values), bool)
            mid = _packed(rank[at[hit]].astype(np.uint16), row[hit], b.num_rows)
            far = _packed(values[~hit], row[~hit], b.num_rows)
            yield pa.RecordBatch.from_arrays([b["of"], b["id"], b["source"], pa.array(lengths.astype(np.int32)), mid, far], names=["of", "id", "source", "n", "mid", "far"])

    return sets.mapInArrow(run, SETS)


def _blocked(rows: DataFrame) -> DataFrame:
    """Adds pos, which ascends in order, and block, a number for neighbours of bounded size in all."""
    names = [c.split()[0] for c in SETS.split(", ")]

    def run(batches):
        total = 0
        for b in batches:
            w = b["n"].to_numpy().astype(np.int64) + EACH
            before = total + np.cumsum(w) - w
            total += int(w.sum())
            yield pa.RecordBatch.from_arrays([*[b[c] for c in names], pa.array(before)], names=[*names, "before"])

    order = [F.col("of"), F.col("id").asc_nulls_last(), F.col("source"), F.xxhash64("mid", "far")]
    ordered = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    placed = cut(ordered.mapInArrow(run, f"{SETS}, before long").withColumn("pos", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()))
    sums = sorted((r["part"], r["w"]) for r in placed.groupBy("part").agg(F.sum(F.col("n") + EACH).alias("w")).collect())
    total = sum(w for _, w in sums)
    size = min(BLOCK, max(LEAST, -(-total // SPREAD)))
    starts = np.cumsum([0, *[w for _, w in sums]]).tolist()
    start = rows.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(sums, starts)], "part int, start long")
    block = F.floor((F.col("start") + F.col("before")) / size).cast("int")
    return placed.join(F.broadcast(start), "part").withColumn("block", block).drop("part", "start", "before")


def _met(queries: DataFrame, candidates: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run`` of every block of queries and every block of candidates that isn't later."""
    last = queries.agg(F.max("block")).first()[0] or 0
    names = ["pos", "of", "n", "mid", "far"]
    q = queries.select(*names, F.col("block").alias("b"), F.explode(F.sequence(F.lit(0), "block")).alias("a"))
    # columns of their own: the planner tells the two sides of a cogroup apart by them
    c = candidates.where(F.col("block") <= last).select(*[F.col(x).alias(f"to_{x}") for x in names], F.col("block").alias("to_a"), F.explode(F.sequence("block", F.lit(last))).alias("to_b"))

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return run(None, None)
        return run(left.sort_by("pos"), right.rename_columns([x.removeprefix("to_") for x in right.column_names]).sort_by("pos"))

    return q.groupBy("a", "b").cogroup(c.groupBy("to_a", "to_b")).applyInArrow(both, schema)


def _numbers(rows: pa.Table, name: str) -> np.ndarray:
    return rows[name].to_numpy().astype(np.int64)


def _unpacked(rows: pa.Table, name: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(values of all rows, values a row)."""
    parts = rows[name].to_pylist()
    values = np.frombuffer(b"".join(parts), kind)
    return values, np.array([len(p) for p in parts], np.int64) // values.itemsize


def _known(rows: pa.Table) -> np.ndarray:
    """Keys of all rows, ascending, each once."""
    far = np.sort(_unpacked(rows, "far", np.int64)[0])
    return far[np.r_[True, far[1:] != far[:-1]]] if len(far) else far


def _tokens(rows: pa.Table, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of all rows, rarest first; where each row starts): ranks, then numbers of ``known`` keys, -1 for other keys."""
    parts, lengths = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for at in range(0, rows.num_rows, PART):
        far, n_far = _unpacked(rows.slice(at, PART), "far", np.int64)
        mid, n_mid = _unpacked(rows.slice(at, PART), "mid", np.uint16)
        is_far = np.repeat(np.tile([True, False], len(n_far)), np.c_[n_far, n_mid].ravel())
        out = np.empty(len(is_far), np.int32)
        found = np.minimum(np.searchsorted(known, far), max(0, len(known) - 1))
        out[is_far] = np.where(known[found] == far, KNOWN + found, -1) if len(known) else -1
        out[~is_far] = mid
        parts.append(out)
        lengths.append(n_far + n_mid)
    return np.concatenate(parts), np.r_[0, np.cumsum(np.concatenate(lengths))]


def _index(tokens: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(where the rows of each of n tokens start, rows)."""
    both = (tokens.astype(np.int64) << 32) + row
    both.sort()
    return np.r_[0, np.cumsum(np.bincount(tokens, minlength=n))], both & ((1 << 32) - 1)


def _counted(tokens: np.ndarray, first: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """How many of the tokens each of the n rows has."""
    if not len(tokens):
        return np.zeros(n, np.int64)
    return np.bincount(np.concatenate([rows[a:b] for a, b in zip(first[tokens].tolist(), first[tokens + 1].tolist())]), minlength=n)


def _nearest(q: pa.Table | None, c: pa.Table | None) -> pa.Table:
    """Each query's largest similarity to an earlier candidate of its kind."""
    kinds = pa.schema([("pos", pa.int64()), ("best", pa.float64())])
    if q is None:
        return kinds.empty_table()
    pos, of, n = (_numbers(q, x) for x in ("pos", "of", "n"))
    to_pos, to_of, to_n = (_numbers(c, x) for x in ("pos", "of", "n"))
    several = len(np.unique(np.r_[of, to_of])) > 1
    known = _known(c)
    tokens, start = _tokens(c, known)
    row = np.repeat(np.arange(c.num_rows), np.diff(start))
    first, rows = _index(tokens, row, KNOWN + len(known))
    having = np.diff(first)
    often = np.argsort(-having, kind="stable")[:COLUMNS]
    often = often[having[often] * OFTEN > c.num_rows]
    column = np.full(len(having), -1)
    column[often] = np.arange(len(often))
    at = column[tokens]
    columns = np.zeros((len(often), -(-c.num_rows // 8) * 8), np.uint8)
    columns[at[at >= 0], row[at >= 0]] = 1
    eights = columns.view(np.uint64)  # adds eight bytes at once
    own, start = _tokens(q, known)
    sizes = to_n.astype(np.float32)
    upto = np.searchsorted(to_pos, pos)  # candidates are in order
    best = np.zeros(q.num_rows)
    for r, k in enumerate(upto.tolist()):
        mine = own[start[r] : start[r + 1]]
        mine = mine[mine >= 0]
        mine = mine[having[mine] > 0]
        if not k or not len(mine):
            continue
        at = column[mine]
        both = _counted(mine[at < 0], first, rows, c.num_rows)[:k].astype(np.float32)
        at = at[at >= 0].tolist()
        for some in range(0, len(at), 255):  # what a byte can hold
            part = np.zeros(eights.shape[1], np.uint64)
            for j in at[some : some + 255]:
                np.add(part, eights[j], out=part)
            both += part.view(np.uint8)[:k]
        ratio = both / (sizes[:k] + np.float32(n[r]))  # ascends with the similarity
        if several:
            ratio[to_of[:k] != of[r]] = 0
        most = ratio.max()
        if most > 0:
            near = np.flatnonzero(ratio >= most * np.float32(1 - 1e-5))
            common = both[near].astype(float)
            best[r] = (common / (n[r] + to_n[near] - common)).max()
    return pa.Table.from_arrays([pa.array(pos), pa.array(best)], schema=kinds)


def _close(threshold: float, all_of: bool) -> Callable:
    """Pairs of a query and an earlier candidate of its kind that is too close: the first candidate, or ``all_of`` them."""
    kinds = pa.schema([("pos", pa.int64()), ("t", pa.int64())])

    def prefixes(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens that must be shared, of how many of the rarest)."""
        least = np.maximum(1, np.ceil(threshold * n * (1 - 1e-12) - 1e-9).astype(np.int64))
        shared = np.minimum(SHARED, least)
        return shared, np.minimum(n, n - least + SHARED)

    def run(q: pa.Table | None, c: pa.Table | None) -> pa.Table:
        if q is None:
            return kinds.empty_table()
        pos, of, n = (_numbers(x, y) for x, y in ((q, "pos"), (q, "of"), (q, "n")))
        to_pos, to_of, to_n = (_numbers(c, x) for x in ("pos", "of", "n"))
        known = _known(c)
        tokens, start = _tokens(c, known)
        row = np.repeat(np.arange(c.num_rows), np.diff(start))
        within = np.arange(len(tokens)) - start[row] < prefixes(to_n)[1][row]
        first, rows = _index(tokens[within], row[within], KNOWN + len(known))
        having = np.diff(first)
        own, begin = _tokens(q, known)
        need, rare = prefixes(n)
        marked = np.zeros(KNOWN + len(known), bool)
        upto = np.searchsorted(to_pos, pos)
        out_s, out_t = [], []
        for r in range(q.num_rows):
            mine = own[begin[r] : begin[r + 1]]
            head = mine[: rare[r]]
            head = head[head >= 0]
            counts = _counted(head[having[head] > 0], first, rows, c.num_rows)[: upto[r]]
            maybe = np.flatnonzero(counts >= need[r])
            maybe = maybe[(to_of[maybe] == of[r]) & (to_n[maybe] > threshold * n[r] - 1e-6) & (n[r] > threshold * to_n[maybe] - 1e-6)]
            if not len(maybe):
                continue
            mine = mine[mine >= 0]
            marked[mine] = True
            done, step = 0, 16
            while done < len(maybe):
                some = maybe[done : done + step]
                ends = np.cumsum(to_n[some])
                has = marked[tokens[np.arange(ends[-1]) + np.repeat(start[some] - ends + to_n[some], to_n[some])]]
                common = np.add.reduceat(has, ends - to_n[some], dtype=np.int64)
                hits = some[common / (n[r] + to_n[some] - common) > threshold]
                if len(hits) and not all_of:
                    hits = hits[:1]
                out_s.append(np.full(len(hits), pos[r]))
                out_t.append(to_pos[hits])
                if len(hits) and not all_of:
                    break
                done, step = done + step, min(2 * step, 1024)
            marked[mine] = False
        if not out_s:
            return kinds.empty_table()
        return pa.Table.from_arrays([pa.array(np.concatenate(out_s)), pa.array(np.concatenate(out_t))], schema=kinds)

    return run


def _dropped(leads: DataFrame, threshold: float) -> DataFrame:
    """pos of the leads that have a kept one before them too close: one is kept if all that are close and before it dropped."""
    pairs = "pos long, t long"
    as_t = lambda rows: rows.select(F.col("pos").alias("t"))
    earliest = cut(_met(leads, leads, _close(threshold, False), pairs).groupBy("pos").agg(F.min("t").alias("t")))
    # whose earliest has none before itself
    out = [cut(earliest.join(as_t(earliest), "t", "left_anti").select("pos"))]
    unsure = earliest.join(out[0], "pos", "left_anti").select("pos")
    if unsure.isEmpty():
        return out[0]
    links = cut(_met(leads.join(unsure, "pos", "left_semi"), leads.join(out[0], "pos", "left_anti"), _close(threshold, True), pairs))
    while not links.isEmpty():
        out.append(cut(links.join(as_t(links).distinct(), "t", "left_anti").select("pos").distinct()))
        links = cut(links.join(out[-1], "pos", "left_anti").join(as_t(out[-1]), "t", "left_anti"))
    return reduce(DataFrame.union, out)


def novelty(articles: DataFrame, threshold: float = 0.7, across: bool = False) -> DataFrame:
    """Greedy suppression: an article too close to any earlier kept one of its source, or ``across`` all sources, drops.

    ``articles``: source, id, tokens array<string> (null: none). Adds novelty = 1 - largest Jaccard similarity to those, and
    kept. Earlier is by id, a null last, then by source and tokens. ``threshold``: 0 or more.
    """
    of = F.lit(0).cast("long") if across else F.xxhash64("source")
    hashes = F.array_distinct(F.transform(F.coalesce("tokens", F.array().cast("array<string>")), lambda t: F.xxhash64(t)))
    sets = articles.select(of.alias("of"), F.col("id").cast("long").alias("id"), "source", hashes.alias("hashes"))
    rows = _blocked(cut(_encoded(sets, *_ranked(sets, articles.count()))))
    full = rows.where("n > 0")
    if threshold < 1:
        # of equal sets only the first can be kept
        key = F.sha2(F.concat_ws("|", F.col("of").cast("string"), F.hex("mid"), F.hex("far")), 256)
        keyed = full.select("pos", key.alias("key"))
        several = cut(keyed.groupBy("key").agg(F.min("pos").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies"))
        copies = cut(sized_join(keyed, several, ["key"], "inner").where("pos <> first").select("pos", "first"))
        leads = full.join(copies, "pos", "left_anti")
        dropped = cut(_dropped(leads, threshold))
        settled = cut(copies.join(dropped.select(F.col("pos").alias("first")), "first", "left_anti").select("pos"))
        kept = leads.join(dropped, "pos", "left_anti")
        best = _met(full.join(settled, "pos", "left_anti"), kept, _nearest, "pos long, best double").unionByName(settled.withColumn("best", F.lit(1.0)))
    else:
        best = _met(full, full, _nearest, "pos long, best double")
    best = best.groupBy("pos").agg(F.max("best").alias("best"))
    value = F.coalesce("best", F.lit(0.0))
    return rows.select("pos", "source", "id").join(best, "pos", "left").select("source", "id", (1 - value).alias("novelty"), (value <= threshold).alias("kept"))
