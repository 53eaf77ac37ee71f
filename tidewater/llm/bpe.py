"""Operator 4: BPE encoding by backtracking over Aho-Corasick longest matches, decoding by an offset table.

A word's characters are scanned once. At each place the automaton gives the longest vocabulary token that starts
there; a token may follow another only if the pair is compatible, that is, if merging the two texts by rank order
would leave the cut between them. If the pair isn't, the next shorter token that is a prefix is tried; if none is left,
the last token is taken back. The result is the merge result, in time linear in the word for a fixed vocabulary.

Defined results
- null text is empty: no ids, empty decoded text; other columns are ignored; repeated rows give repeated results.
- a symbol without a token becomes the vocabulary's unknown token; where it names none, the symbol goes.
- special strings of the vocabulary found in a text become their ids, as the library does by default.
- decoding joins the tokens' strings by one space when the vocabulary names no decoder (the library's rule).
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "word_bpe_49k.json"
CACHE_WORDS = 1_000_000  # words remembered by a worker before it starts anew: bounds memory, not results
MAX_CACHED = 64  # longer words aren't remembered


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars, n = {}, 0
    for b in range(256):
        if b in kept:
            chars[b] = chr(b)
        else:
            chars[b] = chr(256 + n)
            n += 1
    return [chars[b] for b in range(256)]


def ranges(codes: list[int]) -> str:
    """The inside of a character class of a regular expression; of an empty list, one that no text holds."""
    out: list[list[int]] = []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out) or "\\U0010ffff"


def newer_characters() -> tuple[str, str]:
    """Classes of characters newer than Python's Unicode tables; letters and numbers newer than the library's."""
    import sys

    import regex
    from tokenizers import Regex, pre_tokenizers

    assigned, known = regex.compile(r"\P{Cn}"), regex.compile(r"[\p{L}\p{N}]")
    library = pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]"), "removed").pre_tokenize_str
    new = [ord(c) for c in assigned.findall("".join(map(chr, range(0x370, sys.maxunicode + 1)))) if unicodedata.category(c) == "Cn"]
    return ranges(new), ranges([c for c in new if known.match(chr(c)) and library(chr(c))])


class Backtracker:
    """Exact merges of a rank-ordered vocabulary; symbols are the characters of a word, the last with ``suffix``."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        import ahocorasick

        self.vocab, self.suffix = vocab, suffix
        self.rank: dict[tuple[int, int], int] = {}
        self.split: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges):
            pair = (vocab[a], vocab[b])
            if pair not in self.rank:
                self.rank[pair] = r
                self.merged[pair] = vocab[a + b]
                self.split.setdefault(vocab[a + b], pair)
        self.text = {i: t for t, i in vocab.items()}
        reachable = [t for t, i in vocab.items() if i in self.split or len(t.removesuffix(suffix) if suffix else t) == 1]
        # the suffix is one end symbol to the automaton
        self.end = "\U0010fffe"
        self.seen: dict[tuple[int, int], bool] = {}
        self.key_of = {}
        for t in reachable:
            k = t[: -len(suffix)] + self.end if suffix and t.endswith(suffix) and len(t) > len(suffix) else t
            self.key_of[k] = vocab[t]
        # every token's next shorter prefix that is a token too
        self.length = {i: len(k) for k, i in self.key_of.items()}
        self.shorter: dict[int, int] = {}
        for k, i in self.key_of.items():
            for n in range(len(k) - 1, 0, -1):
                j = self.key_of.get(k[:n])
                if j is not None:
                    self.shorter[i] = j
                    break
        # reversed keys: a match that ends at place p of the reversed word starts at its mirror in the word
        self.automaton = ahocorasick.Automaton()
        for k, i in self.key_of.items():
            self.automaton.add_word(k[::-1], i)
        self.automaton.make_automaton()

    def compatible(self, left: int, right: int) -> bool:
        """Does the cut between two tokens survive the merging of their joined text? (memoised)"""
        known = self.seen.get((left, right))
        if known is None:
            if len(self.seen) > 4 * CACHE_WORDS:
                self.seen.clear()
            known = self.seen[left, right] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        # walk the two merge trees back from the last merge; a pair across the cut that merges earlier breaks it
        limit, big = float("inf"), float("inf")
        while True:
            r = self.rank.get((left, right), big)
            if r < limit:
                return False
            rl = self.rank[self.split[left]] if left in self.split else -1
            rr = self.rank[self.split[right]] if right in self.split else -1
            if rl < 0 and rr < 0:
                return True
            if rl > rr or (rl == rr and rl >= 0):
                # at equal ranks the merge further left comes first, so the right one is undone first
                if rl == rr:
                    limit, right = rr + 0.5, self.split[right][0]
                    continue
                limit, left = rl, self.split[left][1]
            else:
                limit, right = rr + 0.5, self.split[right][0]

    def encode(self, word: str) -> list[int] | None:
        """ids, or None where some character has no token of its own."""
        if not word:
            return []
        s = word[:-1] + word[-1] + self.end if self.suffix else word
        n = len(s)
        longest: list[int] = [-1] * n
        for at, i in self.automaton.iter(s[::-1]):  # at one place the longest match comes first
            start = n - 1 - at  # the reversed match ends at this place of the word
            if longest[start] < 0:
                longest[start] = i
        length, shorter, seen = self.length, self.shorter, self.seen
        forbidden = n - 1 if self.suffix else -1  # the end symbol is no token of its own
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token, last = 0, longest[0], -1
        while True:
            while token >= 0:
                to = at + length[token]
                if to != forbidden and not dead[to]:
                    if last < 0:
                        break
                    fits = seen.get((last, token))
                    if fits or (fits is None and self.compatible(last, token)):
                        break
                token = shorter.get(token, -1)
            if token >= 0:
                out.append(token)
                if to == n:
                    return out
                at, last, token = to, token, longest[to]
                continue
            dead[at] = 1
            if not out:
                return None
            token = out.pop()
            at -= length[token]
            token, last = shorter.get(token, -1), out[-1] if out else -1


    def encode_known(self, word: str, unknown: int | None) -> list[int]:
        """Merges of a word in which some symbol has no token: that symbol becomes ``unknown``, or goes if there is none."""
        symbols = [*word[:-1], word[-1] + self.suffix] if word else []
        ids = [self.vocab.get(x, unknown) for x in symbols]
        ids = [i for i in ids if i is not None]
        while len(ids) > 1:
            rank, at = min((self.rank.get(pair, float("inf")), k) for k, pair in enumerate(zip(ids, ids[1:])))
            if rank == float("inf"):
                break
            ids[at : at + 2] = [self.merged[ids[at], ids[at + 1]]]
        return ids


class Codec:
    """Encodes and decodes texts as the vocabulary file's pipeline says (normalising, splitting, byte symbols, merges)."""

    def __init__(self, path: str):
        import regex
        from tokenizers import normalizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.core = Backtracker(model["vocab"], merges, self.suffix)
        self.vocab = model["vocab"]
        self.unknown = self.vocab.get(model.get("unk_token") or "")
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"unknown normaliser {kinds}")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(pattern).findall
        # characters newer than the library's Unicode tables are neither letters nor numbers to it
        new, newer = newer_characters()
        self.new = regex.compile(f"[{new}]").search
        self.library_normalise = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str
        self.find_newer = regex.compile(
            pattern.replace("[^\\s\\p{L}\\p{N}]", f"(?:[^\\s\\p{{L}}\\p{{N}}]|[{newer}])").replace("[\\p{L}]", f"[\\p{{L}}--[{newer}]]").replace("[\\p{N}]", f"[\\p{{N}}--[{newer}]]"),
            regex.V1,
        ).findall
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.chars = byte_chars()
        self.table = str.maketrans({b: c for b, c in enumerate(self.chars)})
        # decoding: all tokens' strings in one text, and where each starts
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        names = [""] * size
        for t, i in [*self.vocab.items(), *self.special.items()]:
            names[i] = t
        self.all_text = "".join(names)
        self.starts = [0]
        for t in names:
            self.starts.append(self.starts[-1] + len(t))
        self.words: dict[str, tuple[int, str, str]] = {}

    def word_ids(self, word: str) -> list[int]:
        symbols = word.encode().decode("latin-1").translate(self.table)
        ids = self.core.encode(symbols)
        return self.core.encode_known(symbols, self.unknown) if ids is None else ids

    def token(self, i: int) -> str:
        return self.all_text[self.starts[i] : self.starts[i + 1]]

    def _entry(self, word: str) -> tuple[int, str, str]:
        ids = self.word_ids(word)
        return len(ids), " ".join(map(str, ids)), " ".join(map(self.token, ids))

    def _pieces(self, text: str) -> Iterator[tuple[int, str, str]]:
        words, find = self.words, self.find
        if text.isascii():
            text = text.lower()
        elif self.new(text):
            text, find = self.library_normalise(text), self.find_newer
        else:  # lower-casing is by character: no final sigma
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        for w in find(text):
            e = words.get(w)
            if e is None:
                e = self._entry(w)
                if len(w) <= MAX_CACHED:
                    if len(words) >= CACHE_WORDS:
                        words.clear()
                    words[w] = e
            yield e

    def run(self, text: str) -> tuple[int, str, str]:
        """(number of ids, decimal ids joined by a space, decoded text)."""
        parts: list[tuple[int, str, str]] = []
        if self.split_special and any(s in text for s in self.special):
            for p in self.split_special(text):
                if p in self.special:
                    parts.append((1, str(self.special[p]), self.token(self.special[p])))
                elif p:
                    parts.extend(self._pieces(p))
        else:
            parts.extend(self._pieces(text))
        if not parts:
            return 0, "", ""
        n, ids, texts = zip(*parts)
        return sum(n), " ".join(ids), " ".join(texts)

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.run(text)[1].split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.token, ids))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_decode(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by a space), decoded; with ``digests`` their sha256 in place of the texts."""
    names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        c = codec(public_tokenizers.path(vocabulary))
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column(1).to_pylist():
                k, ids, decoded = c.run(text or "")
                n.append(k)
                a.append(sha(ids) if digests else ids)
                b.append(sha(decoded) if digests else decoded)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", *names])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, f"doc_id long, n_tokens long, {names[0]} string, {names[1]} string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)
