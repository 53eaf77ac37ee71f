import hashlib
from collections import defaultdict

import corpus_pipeline as P
from tidewater.llm import near_dedup


def test_stages_chain_on_whole_table(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(900001, None, None, "s", None), (900002, "12 34 !!", "en", "s", 8), (900003, "", None, "s", 0)], docs.schema)
    docs = docs.unionByName(extra)
    kept = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf)
        path = str(tmp_path / name)
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        kept[name] = docs
        if name != P.STAGES[-1][0]:
            assert docs.columns == P.COLUMNS and set(docs.columns) == set(before.columns)
    ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
    first = ids(kept["language_id"])
    assert not first & {900001, 900002, 900003} and len(first) == docs_count(spark, sf)
    # exact dedup against plain Python
    groups = defaultdict(list)
    for r in kept["language_id"].collect():
        groups["".join(c.lower() if c.isascii() else c for c in r["text"])].append(r["doc_id"])
    assert ids(kept["exact_dedup"]) == {max(g) for g in groups.values()}
    # one document of each near class, the least id
    classes = defaultdict(list)
    for r in near_dedup.near_duplicates(kept["exact_dedup"]).collect():
        classes[r["class_id"]].append(r["doc_id"])
    assert ids(kept["near_dedup"]) == {min(c) for c in classes.values()}
    # every document stays through passage removal, and no text grows
    a = {r["doc_id"]: r["text"] for r in kept["near_dedup"].collect()}
    b = {r["doc_id"]: r for r in kept["suffix_dedup"].collect()}
    assert a.keys() == b.keys()
    assert all(len(b[i]["text"]) <= len(t) and b[i]["n_chars"] == len(b[i]["text"]) for i, t in a.items() if b[i]["text"] != t)
    assert ids(kept["best_fit_packing"]) == b.keys()


def docs_count(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL AND text RLIKE '\\\\p{L}'").count()


def test_run_is_the_stages(spark, sf):
    a = P.run(spark, sf)
    assert set(a.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    h = hashlib.sha256(repr(sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in a.collect())).encode()).hexdigest()
    b = P.run(spark, sf)
    assert h == hashlib.sha256(repr(sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in b.collect())).encode()).hexdigest()


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, sf).count() == 0
