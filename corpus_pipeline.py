"""The corpus pipeline: language ID, exact dedup, near-dedup, repeated-passage removal, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of ``documents``. Decisions
- language ID: documents that it rejects (no letter, or a null text: ``und``) go; all others stay. Documents without a
  language get the predicted one. It learns from the documents that have one.
- exact dedup: of equal texts the row with the largest id stays.
- near-dedup: the least id of each class stays; rows with a repeated id and different texts are documents of their own.
- suffix-array dedup: bytes of repeated passages are cut from the text. Where a cut falls inside a character, its
  remaining bytes go too. A document that loses all of its text stays, with an empty text; a null text becomes empty.
- packing: one row per piece.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import exact_dedup, langid, near_dedup, packing, suffix_dedup
from tidewater.session import shared_folder, ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = langid.fit_documents(docs)

    def run(batches):
        for b in batches:
            got = [model.predict(t) for t in b.column("text").to_pylist()]
            keep = pa.array([g[0] != "und" or not model.families and bool(t) for g, t in zip(got, b.column("text").to_pylist())], pa.bool_())
            lang = pa.array([x if x is not None else g[0] for x, g in zip(b.column("lang").to_pylist(), got)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(c) if c != "lang" else lang for c in COLUMNS], names=COLUMNS).filter(keep)

    return docs.select(*COLUMNS).mapInArrow(run, docs.select(*COLUMNS).schema)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return exact_dedup.exact_dedup(docs.select(*COLUMNS))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_dedup.without_near_duplicates(docs.select(*COLUMNS)).select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    kept = suffix_dedup.without_repeats(docs.select(*COLUMNS), carry=["lang", "source", "n_chars"])

    def run(batches):
        for b in batches:
            rows = zip(b.column("kept").to_pylist(), b.column("n_removed").to_pylist(), b.column("n_chars").to_pylist())
            texts, n_chars = [], []
            for raw, removed, n in rows:
                texts.append(bytes(raw).decode("utf-8", "ignore"))
                n_chars.append(len(texts[-1]) if removed else n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), b.column("lang"), b.column("source"), pa.array(n_chars, pa.int64())], names=COLUMNS)

    return kept.mapInArrow(run, "doc_id long, text string, lang string, source string, n_chars long")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("suffix_dedup", repeats),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again as the next one's documents."""
    home = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{k}-{name}")
        docs = spark.read.parquet(f"{home}/{k}-{name}")
    return docs


#: The language model, similarity classes and tokens are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None
