"""Operator 13: spelling variants, by letter-parity masks in three bands.

A word's mask has a bit for each letter, set if the letter occurs an odd number of times. One inserted or deleted code point
flips one bit, a replaced one two or none, so of three bands of bits one at least is equal. Words meet in a cell of one band's
value and one length (with those of the next length); a cell beyond `LETTERS` is dealt into parts by the words' hashes, and the parts
meet two by two. In a cell distinct masks are compared first (bits that differ: none or two at equal length, one otherwise, and
no earlier band equal, so that a pair is found once), then words of the masks that fit: one half of the letters must be
equal, and the letters are then compared exactly.

A word's form has at least twice its count, so chains of forms end; roots come by doubling the steps.

Defined results
- null text has no words; letters beyond a-z and U+00C0 to U+00FF end a run; a null id counts as an empty string before the colon.
- repeated rows count again; other columns are ignored; an empty table, or no word often enough, gives no rows.
- a word of any length is compared whole; ties among near words go to the first in code-point order.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import cut, sized_join

RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LETTERS = 5
LEAST_SEEN = 3
EVERY = 97
BANDS = 3
BITS = 63  # a-z have a bit each, the accented letters share the others
LETTERS = 1 << 19  # letters in a part of a cell
PAIRS = 1 << 20  # word pairs looked at at once


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """word: one row an occurrence, with the stated deletions."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(RUN), 0)).alias("w"))
    runs = runs.where(F.length("w") >= LEAST_LETTERS).withColumn("w", F.translate("w", string.ascii_uppercase, string.ascii_lowercase))
    runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "w")))
    at = (F.col("h") % F.length("w")).cast("int")
    word = F.when(F.col("h") % EVERY == 0, F.concat(F.substr("w", F.lit(1), at), F.substr("w", at + 2))).otherwise(F.col("w"))
    return runs.select(word.alias("word")).where(F.length("word") >= LEAST_LETTERS)


def parity(word: Column) -> Column:
    """The mask: bit of a letter a-z by its place, of others by code point, folded into what is left."""
    code = lambda c: F.ascii(c)
    bit = lambda c: F.when(code(c) < 128, code(c) - ord("a")).otherwise(26 + (code(c) - 0xC0) % (BITS - 26))
    one = F.lit(1).cast("long")
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda m, c: F.when(c == "", m).otherwise(m.bitwiseXOR(F.call_function("shiftleft", one, bit(c)))))


def band_bits(band: int) -> int:
    return sum(1 << b for b in range(BITS) if b % BANDS == band)


def _cells(words: DataFrame, letters: int) -> DataFrame:
    """band, key, len, i, j (the cell) and word, n, mask, part: every word in the cells of its own length and the one before."""
    size = F.length("word")
    rows = words.select("word", "n", parity(F.col("word")).alias("mask"), size.alias("size"))
    keys = F.array(*[F.struct(F.lit(b).alias("band"), F.col("mask").bitwiseAND(F.lit(band_bits(b))).alias("key")) for b in range(BANDS)])
    rows = rows.select("*", F.explode(keys).alias("b"))
    rows = rows.select("word", "n", "mask", "b.band", "b.key", F.explode(F.array("size", F.col("size") - 1)).alias("len"))
    many = rows.groupBy("band", "key", "len").agg(F.ceil(F.count("*") * (F.col("len") + 1) / letters).cast("int").alias("parts")).where("parts > 1")
    rows = sized_join(rows, cut(many), ["band", "key", "len"], "left").fillna(1, ["parts"])
    part = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    rows = rows.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select("band", "key", "len", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "word", "n", "mask", "part")


def _hashes(letters: np.ndarray) -> np.ndarray:
    out = np.full(len(letters), 0xCBF29CE484222325, np.uint64)
    for c in letters.T:
        out = (out ^ c) * np.uint64(0x100000001B3)
    return out


class _Side:
    """Words of one length in a cell, ordered by mask."""

    def __init__(self, words: list[str], mask: np.ndarray, part: np.ndarray, length: int, of: int):
        order = np.argsort(mask, kind="stable")
        self.order, self.part = order, part[order]
        text = np.array([words[k] for k in order.tolist()], f"U{length}")
        self.letters = text.view(np.uint32).reshape(len(text), length) if len(text) else np.zeros((0, length), np.uint32)
        half = of // 2
        self.first, self.last = _hashes(self.letters[:, :half]), _hashes(self.letters[:, length - (of - half) :])
        self.masks, self.start, self.count = np.unique(mask[order], return_index=True, return_counts=True)


def _mask_pairs(a: np.ndarray, b: np.ndarray, band: int, fits: tuple[int, ...], upper: bool):
    """Index pairs of masks whose differing bits are as many as ``fits`` names, found first in this band."""
    step = max(1, (1 << 21) // max(1, len(b)))
    for s in range(0, len(a), step):
        diff = a[s : s + step, None] ^ b[None, :]
        good = np.isin(np.bitwise_count(diff), fits)
        for earlier in range(band):
            good &= (diff & np.uint64(band_bits(earlier))) != 0
        x, y = np.nonzero(good)
        x = x + s
        if upper:
            x, y = x[x <= y], y[x <= y]
        if len(x):
            yield x, y


def _word_pairs(left: _Side, right: _Side, band: int, fits: tuple[int, ...]):
    """Rows of words (left, right) of masks that fit, some at a time."""
    same = left is right
    for x, y in _mask_pairs(left.masks, right.masks, band, fits, same):
        each = left.count[x] * right.count[y]
        ends = np.cumsum(each)
        done = 0
        while done < ends[-1]:  # by place in the list of all word pairs, so that one large pair of masks is cut too
            k = np.arange(done, min(done + PAIRS, ends[-1]))
            at = np.searchsorted(ends, k, "right")
            inside = k - (ends[at] - each[at])
            i, j = left.start[x[at]] + inside // right.count[y[at]], right.start[y[at]] + inside % right.count[y[at]]
            done = int(k[-1]) + 1
            good = (left.first[i] == right.first[j]) | (left.last[i] == right.last[j])
            if same:
                good &= i < j
            yield i[good], j[good]


def near_in_cell(words: list[str], mask: np.ndarray, part: np.ndarray, band: int, length: int, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that differ by one code point: both of ``length``, or one of the next. ``across``: of different parts only."""
    sizes = np.array([len(w) for w in words])
    at = [np.flatnonzero(sizes == length), np.flatnonzero(sizes == length + 1)]
    own, more = (_Side([words[k] for k in r.tolist()], mask[r], part[r], n, length) for r, n in zip(at, (length, length + 1)))
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i, j in _word_pairs(own, own, band, (0, 2)):
        good = (own.letters[i] != own.letters[j]).sum(1) == 1
        if across:
            good &= own.part[i] != own.part[j]
        out.append((at[0][own.order[i[good]]], at[0][own.order[j[good]]]))
    for i, j in _word_pairs(own, more, band, (1,)):
        u, v = own.letters[i], more.letters[j]
        head = np.cumprod(u == v[:, :-1], 1).sum(1)
        tail = np.cumprod((u == v[:, 1:])[:, ::-1], 1).sum(1)
        good = head + tail >= length
        if across:
            good &= own.part[i] != more.part[j]
        out.append((at[0][own.order[i[good]]], at[1][more.order[j[good]]]))
    return tuple(np.concatenate(side) for side in zip(*out))


def near_pairs(words: DataFrame, letters: int = LETTERS) -> DataFrame:
    """word, other, n (of the other): both directions of every near pair. ``words``: distinct words with their counts."""

    def run(key: tuple, cell: pa.Table) -> pa.Table:
        band, _, length, i, j = (k.as_py() for k in key)
        own, n = cell.column("word").to_pylist(), cell.column("n").to_numpy()
        a, b = near_in_cell(own, cell.column("mask").to_numpy().astype(np.uint64), cell.column("part").to_numpy(), band, length, i != j)
        to = pa.array(np.r_[a, b])
        return pa.table({"word": cell.column("word").take(to), "other": cell.column("word").take(pa.array(np.r_[b, a])), "n": pa.array(n[np.r_[b, a]], pa.int64())})

    return _cells(words, letters).groupBy("band", "key", "len", "i", "j").applyInArrow(run, "word string, other string, n long")


def with_roots(forms: DataFrame) -> DataFrame:
    """word, root of every word with a form: each round doubles the steps taken, so chains of n forms take log2(n) rounds."""
    steps = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = cut(steps.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        steps = joined.select("word", "root")
        if joined.where("moved").limit(1).count() == 0:
            return steps


def variants(words: DataFrame, letters: int = LETTERS) -> DataFrame:
    """word, form, root, n, n_near, form_n of a table of distinct words and counts."""
    best = F.min(F.struct((-F.col("n")).alias("less"), "other"))
    near = near_pairs(words, letters).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    chosen = -F.col("best.less") >= 2 * F.col("n")
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(chosen, F.col("best.other")).alias("form"), F.when(chosen, -F.col("best.less")).alias("form_n"))
    rows = cut(rows)
    roots = with_roots(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = LETTERS) -> DataFrame:
    words = occurrences(docs, id_col, text_col).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_SEEN)
    return variants(cut(words), letters)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


_HIGH = "".join(map(chr, range(0xC0, 0x100)))
_SPARE = "".join(c for c in map(chr, range(33, 127)) if not c.islower() and c != "'")[:64]
#: crc32 by its table (a rule makes it), edit distance on single bytes (the accented letters get codes that words lack), roots by recursion.
SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
         unnest(list_filter(regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{RUN}'), lambda w: length(w) >= {LEAST_LETTERS})) AS w
  FROM documents),
seen AS (SELECT id, w, count(*) AS n FROM runs GROUP BY id, w),
hashed AS (
  SELECT w, n, xor(4294967295, list_reduce(
           flatten(list_transform(string_split(id || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, CAST(unicode(c) AS BIGINT) - 64] END)),
           lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8), CAST(4294967295 AS BIGINT))) AS h
  FROM seen, crc),
spelt AS (
  SELECT CASE WHEN h % {EVERY} = 0 THEN left(w, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, n FROM hashed),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n, translate(word, '{_HIGH}', '{_SPARE}') AS code, length(word) AS len
  FROM spelt WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {LEAST_SEEN}),
half AS (
  SELECT word, n, code, len, l, left(code, l // 2) AS a, right(code, l - l // 2) AS z
  FROM (SELECT *, unnest([len, len - 1]) AS l FROM words)),
found AS (
  SELECT u.word AS a, v.word AS b FROM half u JOIN half v ON u.l = v.l AND u.a = v.a WHERE u.len = u.l AND (v.len > u.len OR u.word < v.word) AND levenshtein(u.code, v.code) = 1
  UNION
  SELECT u.word, v.word FROM half u JOIN half v ON u.l = v.l AND u.z = v.z WHERE u.len = u.l AND (v.len > u.len OR u.word < v.word) AND levenshtein(u.code, v.code) = 1),
near AS (SELECT a AS word, b AS other FROM found UNION ALL SELECT b, a FROM found),
best AS (
  SELECT near.word, count(*) AS n_near, arg_min(words.word, (-words.n, words.word)) AS other, max(words.n) AS most
  FROM near JOIN words ON words.word = near.other GROUP BY near.word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * w.n THEN other END AS form, CASE WHEN most >= 2 * w.n THEN most END AS form_n
  FROM words w LEFT JOIN best USING (word)),
walk AS (
  SELECT word, form AS at FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.at WHERE forms.form IS NOT NULL),
ends AS (SELECT walk.word, walk.at AS root FROM walk JOIN forms ON forms.word = walk.at WHERE forms.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM forms LEFT JOIN ends USING (word)
"""
