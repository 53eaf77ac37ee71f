"""Operator 9: bounded-space online best-fit packing of token sequences.

A fixed number of bins is open at a time. The free space of open bins is kept in a bitset: bit f is set if some
open bin has f places free, so the tightest bin for an item of n tokens is the lowest set bit at n or above. When
a new bin is needed and all are open, the fullest closes first (the lowest set bit).

Defined results
- null text is empty: one piece, the end id alone; a document longer than a sequence is cut so that only its first
  piece may be short; every other piece fills a sequence.
- ties go to the bin opened first; repeated ids give repeated pieces; an empty table gives no rows.
- other columns of the input are ignored.

Plan: tokens never leave the worker that made them: a piece's row holds its length and checksum. Those small rows
are dealt by a hash and arrive in runs of about as many pieces as there are open bins, longest first within a run, in an
order that depends on the pieces alone, so a lost task gives the same bins again. Each partition's bins that are still
loosely filled at its end are packed once more, over far fewer partitions; both rounds read a checkpointed table of pieces.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import cut, shuffle_partitions

SEQ_LEN = 2048
OPEN_BINS = 2048
END_ID = 0
LOOSE = 32  # a bin with more free places than this at a partition's end is packed again


class BestFit:
    """``add`` gives (bin, offset); ``closed`` gathers (bin, free) of closed bins."""

    def __init__(self, size: int = SEQ_LEN, open_bins: int = OPEN_BINS):
        self.size, self.most = size, open_bins
        self.bits, self.by_free, self.n_open, self.made = 0, defaultdict(deque), 0, 0

    def _pop(self, free: int) -> int:
        own = self.by_free[free]
        b = own.popleft()
        if not own:
            self.bits &= ~(1 << free)
        return b

    def _push(self, free: int, b: int) -> None:
        self.by_free[free].append(b)
        self.bits |= 1 << free

    def add(self, n: int) -> tuple[int, int]:
        if n > self.size:
            raise ValueError(f"an item of {n} is longer than a bin")
        fit = self.bits >> n
        if fit:
            free = n + (fit & -fit).bit_length() - 1
            b = self._pop(free)
            self.n_open -= 1
        else:
            free, b = self.size, self.made
            self.made += 1
            if self.n_open >= self.most:
                self._pop((self.bits & -self.bits).bit_length() - 1)
                self.n_open -= 1
        if free > n:
            self._push(free - n, b)
            self.n_open += 1
        return b, self.size - free

    def open_free(self) -> dict[int, int]:
        return {b: f for f, own in self.by_free.items() for b in own}


def cut_points(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: only the first may be shorter than ``size`` where n is over it."""
    if n <= size:
        return [(0, n)]
    first = n % size
    starts = ([0] if first else []) + list(range(first, n, size))
    return [(s, (first if s == 0 and first else size)) for s in starts]


PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)


def byte_bpe(path_name: str):
    """An encoder with the ids of the tokenizers library for a byte-level vocabulary, special strings included."""
    import base64
    import json

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(path_name), encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    with open(public_tokenizers.path(path_name.replace(".json", ".tiktoken")), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    names = list(special)

    def encode(text: str) -> list[int]:
        if any(s in text for s in names):
            return enc.encode(text, allowed_special="all")
        return enc.encode_ordinary(text)

    return encode


def piece_rows(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", seq_len: int = SEQ_LEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(vocabulary)
        for batch in batches:
            out: list[tuple] = []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array([*encode(text or ""), END_ID], dtype="<u4")
                for k, (s, n) in enumerate(cut_points(len(ids), seq_len)):
                    out.append((d, k, s, n, zlib.crc32(ids[s : s + n].tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), PIECES)] if out else [pa.array([], t.type) for t in PIECES], schema=PIECES)

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _packed(pieces: DataFrame, parts: int, seq_len: int, open_bins: int, level: int, last: bool) -> DataFrame:
    """Adds sequence_id, seq_offset and loose (its bin is to be packed again) to the pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        top = (level << 62) | (TaskContext.get().partitionId() << 38)
        bins, kept = BestFit(seq_len, open_bins), []
        for batch in batches:
            placed = [bins.add(n) for n in batch.column("length").to_pylist()]
            kept.append((batch, [b for b, _ in placed], [o for _, o in placed]))
        loose = set() if last else {b for b, f in bins.open_free().items() if f > LOOSE}
        for batch, b, o in kept:
            cols = [*batch.columns, pa.array([top + x for x in b], pa.int64()), pa.array(o, pa.int64()), pa.array([x in loose for x in b], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "sequence_id", "seq_offset", "loose"])

    runs = max(1, -(-pieces.count() // (parts * open_bins)))
    place = F.xxhash64("doc_id", "piece", "length", "ids_crc32")
    dealt = pieces.repartition(parts, place).sortWithinPartitions(F.pmod(F.xxhash64(place), F.lit(runs)), F.desc("length"), "doc_id", "piece", "ids_crc32", "start")
    return dealt.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, seq_offset long, loose boolean")


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", seq_len: int = SEQ_LEN, open_bins: int = OPEN_BINS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    parts = shuffle_partitions(docs.sparkSession)
    pieces = cut(piece_rows(docs, vocabulary, seq_len, id_col, text_col))
    first = cut(_packed(pieces, parts, seq_len, open_bins, 0, last=False))
    own = ["doc_id", "piece", "start", "length", "ids_crc32"]
    again = _packed(first.where("loose").select(*own), max(1, parts // 32), seq_len, open_bins, 1, last=True)
    return first.where("not loose").unionByName(again).select(*own, "sequence_id", F.col("seq_offset").alias("offset"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
