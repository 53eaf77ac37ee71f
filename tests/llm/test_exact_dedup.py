import hashlib
from collections import defaultdict

from tidewater.llm.exact_dedup import digests, exact_dedup

ROWS = [(1, "Abc"), (2, "aBC"), (3, None), (4, ""), (5, "é"), (6, "É"), (7, "abc "), (8, "x" * 300 + "A"), (9, "x" * 300 + "a"), (10, "x" * 300 + "b"), (11, "abc")]


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups["".join(c.lower() if c.isascii() else c for c in (t or ""))].append(i)
    return {i: (max(g), len(g)) for g in groups.values() for i in g if len(g) > 1}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, keep_id string, _full int")


def test_groups_against_brute_force(spark):
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in digests(frame(spark, ROWS)).where("group_size > 1").collect()}
    assert got == brute(ROWS)


def test_largest_id_stays_and_columns_pass(spark):
    kept = exact_dedup(frame(spark, ROWS))
    assert kept.columns == ["doc_id", "text", "keep_id", "_full"]
    assert {r["doc_id"] for r in kept.collect()} == {4, 5, 6, 7, 9, 10, 11}


def test_empty_and_repeated(spark):
    assert digests(frame(spark, [])).count() == 0 and exact_dedup(frame(spark, [])).count() == 0
    same = [(k, "same") for k in range(50)]
    assert {(r["keep_id"], r["group_size"]) for r in digests(frame(spark, same)).collect()} == {(49, 50)}
    assert [r["doc_id"] for r in exact_dedup(frame(spark, same)).collect()] == [49]


def test_repeated_and_null_ids(spark):
    rows = [(5, "dup"), (5, "dup"), (7, "x"), (7, "y"), (8, "y"), (None, "same"), (None, "same"), (None, "y"), (3, "dup"), (5, "other")]
    got = sorted((r["text_sha256"][:8], -1 if r["doc_id"] is None else r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in digests(frame(spark, rows)).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()[:8]
    want = [(sha("dup"), 3, 5, 3, False), (sha("dup"), 5, 5, 3, False), (sha("dup"), 5, 5, 3, True), (sha("x"), 7, 7, 1, True), (sha("y"), 7, 8, 3, False)]
    want += [(sha("y"), 8, 8, 3, True), (sha("y"), -1, 8, 3, False), (sha("same"), -1, None, 2, False), (sha("same"), -1, None, 2, True), (sha("other"), 5, 5, 1, True)]
    assert got == sorted(want)
    kept = sorted((str(r["doc_id"]), r["text"]) for r in exact_dedup(frame(spark, rows)).collect())
    assert kept == sorted([("5", "dup"), ("7", "x"), ("8", "y"), ("None", "same"), ("5", "other")])


def test_one_of_rows_that_differ_elsewhere(spark):
    rows = spark.createDataFrame([(1, "t", "a"), (1, "t", "b"), (0, "t", "c")], "doc_id long, text string, lang string")
    one, two = (exact_dedup(rows.repartition(n)).collect() for n in (1, 3))
    assert one == two and len(one) == 1 and one[0]["doc_id"] == 1 and one[0]["lang"] in "ab"


def test_query_digests(spark, sf):
    from tidewater.llm.exact_dedup import op8_exact_dedup

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op8_exact_dedup(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows[:50]:
        t = "".join(c.lower() if c.isascii() else c for c in (texts[r["doc_id"]] or ""))
        assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
