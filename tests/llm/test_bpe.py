import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewater.llm.bpe import Codec, encode_decode

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    return Tokenizer.from_file(PATH), Codec(PATH)


def same(both, text):
    tk, codec = both
    e = tk.encode(text, add_special_tokens=False)
    n, ids, decoded = codec.run(text)
    assert (n, ids) == (len(e.ids), " ".join(map(str, e.ids))), repr(text)
    assert decoded == tk.decode(e.ids, skip_special_tokens=False), repr(text)


def test_edges(both):
    for t in ["", " ", "a", "A", "it's", "THE  the\n", "Σίσυφος ΟΔΟΣ", "İstanbul", "日本語 한국어", "<|startoftext|>x<|endoftext|>", "\x00\x1f\u0085", "é", "1234", "a" * 5000, "🙂👍🏽"]:
        same(both, t)


def test_random_texts(both):
    rng = random.Random(11)
    chars = "abcdefghijklmnopqrstuvwxyzABCDE 0123456789'.,!-_éèüßñÀΣςσǅ中あカ한🙂\n\t"
    for _ in range(3000):
        same(both, "".join(rng.choice(chars) for _ in range(rng.randint(1, 40))))
    for _ in range(3000):
        same(both, "".join(chr(rng.choice([rng.randint(1, 0x250), rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(rng.randint(1, 8))))


def test_symbols_without_a_token():
    from tidewater.llm.bpe import Backtracker

    core = Backtracker({"a": 0, "b</w>": 1, "ab</w>": 2, "c": 3, "?": 4}, [("a", "b</w>")], "</w>")
    assert core.encode("axb") is None
    assert core.encode_known("axb", None) == [2] and core.encode_known("axb", 4) == [0, 4, 1]
    assert core.encode_known("xx", None) == [] and core.encode_known("cab", None) == [3, 2]


def test_round_trip_of_ids(both):
    _, codec = both
    ids = codec.encode("the quick brown fox isn't 42")
    assert codec.decode(ids) == codec.run("the quick brown fox isn't 42")[2]


def test_frame(spark):
    rows = spark.createDataFrame([(1, "the cat", 3), (2, None, 4), (2, None, 4)], "doc_id long, text string, n_tokens int")
    got = {(r["doc_id"], r["n_tokens"], r["ids"], r["decoded"]) for r in encode_decode(rows).collect()}
    assert (2, 0, "", "") in got and len(got) == 2
    assert encode_decode(rows.limit(0)).count() == 0
