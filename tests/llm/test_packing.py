import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidewater.llm.packing import BestFit, _packed, cut_points, pack

TEXTS = [(1, "hello world"), (2, None), (3, ""), (4, "word " * 5000), (5, "naïve <|endoftext|> café 日本語\n\n  x"), (6, "hello world"), (6, "hello world"), (None, "no id")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 5) for i, t in rows], "doc_id long, text string, sequence_id string, offset int")


def check(rows, texts, size=2048):
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in texts:
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut_points(len(ids), size))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= size
    return bins


def test_pieces_and_places(spark):
    check(pack(frame(spark, TEXTS)).collect(), TEXTS)


def test_empty_table(spark):
    assert pack(frame(spark, [])).count() == 0


def test_whole_table_is_tight(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = pack(docs).collect()
    bins = check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    total = sum(r["length"] for r in rows)
    assert len(bins) <= -(-total // 2048) * 1.01 + 4  # four partitions, each with a last bin


def test_fill_of_many_pieces(spark):
    lengths = [1 + (k * 7919) % 2047 if k % 3 else 1 + (k * 31) % 300 for k in range(20_000)]
    pieces = spark.createDataFrame([(k, 0, 0, n, k) for k, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    for parts, open_bins in ((1, 512), (4, 2048), (40, 2048)):
        made = _packed(pieces, parts, 2048, open_bins, 0, last=True).select("sequence_id").distinct().count()
        assert made <= -(-sum(lengths) // 2048) * 1.01 + parts


def test_only_first_piece_is_short():
    assert cut_points(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)]
    assert cut_points(4096, 2048) == [(0, 2048), (2048, 2048)]
    assert cut_points(1, 2048) == [(0, 1)]


def test_best_fit_matches_plain_search():
    rng = np.random.default_rng(3)
    fit, free, closed = BestFit(100, 5), {}, set()
    for n in rng.integers(1, 101, 400).tolist():
        b, o = fit.add(n)
        fits = [f for x, f in free.items() if f >= n and x not in closed]
        if b in free:
            assert free[b] == min(fits) and o == 100 - free[b]
        else:
            assert not fits and o == 0
            live = [x for x in free if x not in closed and free[x] > 0]
            if len(live) >= 5:
                low = min(free[x] for x in live)
                closed.add(next(x for x in live if free[x] == low and x not in fit.open_free()))
            free[b] = 100
        free[b] -= n
