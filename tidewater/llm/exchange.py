"""Chunks and buckets: how operators that compare all documents trade compact blocks instead of rows.

Documents are dealt by a hash into chunks of bounded size. A chunk sends each bucket one block of packed, locally
combined keys; a bucket sees a key's blocks from all chunks and answers each chunk with a block in the order that
the chunk sent. A key held by a third of all documents is one entry per chunk, never one per document. All rounds
read the same exchange of documents, which Spark runs once.
"""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.session import shuffle_partitions

CHUNK_BYTES = 12 << 20
BUCKET_BYTES = 128 << 20
PER_PARTITION = 4  # chunks to a partition, so that a hash deals them evenly
LEAST_CHUNK, LEAST_BUCKET = 1 << 20, 4 << 20  # but no smaller than this: blocks grow with chunks x buckets

NO_ID = (1 << 63) - 1  # stands for a null id inside: it sorts after every other

BLOCKS = "target int, origin int, kind int, block binary"
_SCHEMA = pa.schema([("target", pa.int32()), ("origin", pa.int32()), ("kind", pa.int32()), ("block", pa.binary())])


def sizes(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(chunks, buckets) for these documents: bounded bytes of text to each."""
    total = docs.select(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    least = shuffle_partitions(docs.sparkSession)
    chunks = max(min(PER_PARTITION * least, -(-total // LEAST_CHUNK)), -(-total // CHUNK_BYTES), 1)
    return chunks, max(min(least, -(-total // LEAST_BUCKET)), -(-total // BUCKET_BYTES), 1)


def released(f, *args):
    """f's result; what it held besides goes back to the system, so that a worker that is used again stays small."""
    out = f(*args)
    gc.collect(0)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
    return out


def at_buckets(blocks: DataFrame, buckets: int, judge) -> DataFrame:
    """``judge(bucket, blocks)`` for each bucket, each in a partition of its own."""

    def run(batches):
        held = pa.Table.from_batches(batches, _SCHEMA)
        if held.num_rows:
            yield from released(judge, held.column("target")[0].as_py(), held).to_batches()

    return blocks.repartitionById(buckets, F.col("target")).mapInArrow(run, BLOCKS)


def chunked(docs: DataFrame, chunks: int, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, by_text: bool = False) -> DataFrame:
    """chunk, doc_id, text (null: empty) and the columns to carry along as _c0, _c1, ..., ready for groupBy("chunk").

    ``by_text``: rows without an id, or with one that others have too, are spread by their texts.
    """
    more = [F.col(c).alias(f"_c{k}") for k, c in enumerate(carry or [])]
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)
    return d.select(chunk_of(F.xxhash64("doc_id", "text") if by_text else F.col("doc_id"), chunks).alias("chunk"), "*")


def chunk_of(doc_id: Column, chunks: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(chunks)).cast("int")


def sent(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [(), (), (), ()]
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA)], schema=_SCHEMA)


def received(table: pa.Table, by: str = "origin") -> list[tuple[int, int, memoryview]]:
    """(origin, kind, block) rows in a fixed order."""
    rows = zip(table.column(by).to_pylist(), table.column("kind").to_pylist(), table.column("block"))
    return sorted(((o, k, memoryview(v.as_buffer())) for o, k, v in rows), key=lambda r: r[:2])


def texts_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, bytes of all texts, offsets, the rows' places in the table) of a chunk, in an order that depends on the rows alone."""
    ids = table.column("doc_id").to_numpy(zero_copy_only=False)
    col = table.column("text").combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    digest = col.cast(pa.large_string())
    if len(np.unique(ids)) == len(ids):
        order = np.argsort(ids, kind="stable")
    else:  # repeated ids: their texts decide
        plain = digest.to_pylist()
        order = np.array(sorted(range(len(ids)), key=lambda k: (ids[k], plain[k])), np.int64)
    taken = digest.take(pa.array(order))
    if not len(taken):
        return ids, np.zeros(0, np.uint8), np.zeros(1, np.int64), order
    offsets = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
    data = np.frombuffer(taken.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if taken.buffers()[2] is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return ids[order], data, offsets - offsets[0], order


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """By the high bits, so that keys in order are also buckets in order."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def cuts(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of the runs of sorted keys; buckets without keys are left out."""
    b = bucket_of(keys, buckets)
    starts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(b)] if len(b) else starts
    return [(int(b[s]), int(s), int(e)) for s, e in zip(starts, ends)]


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values, how often each occurs)."""
    x = np.sort(x)
    new = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    return x[new], np.diff(np.r_[new, len(x)])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits; in place where it can, as these arrays are many."""
    if not isinstance(h, np.ndarray):
        return mix(np.array([h], np.uint64))[0]
    t = h >> np.uint64(31)
    t ^= h
    t *= np.uint64(0xBF58476D1CE4E5B9)
    u = t >> np.uint64(29)
    u ^= t
    return u
