"""Operator 8: exact dedup by progressive refinement (length, prefix hash, full hash).

Defined results
- null text counts as empty; equality ignores the case of A-Z only.
- of equal texts one row stays, one with the largest id (a null id is less than any other). Where several rows of a group
  have that id, the query keeps any one of them (they are alike in all it reads), and :func:`exact_dedup` the one whose
  columns have the least hash. Groups are judged by text: rows that share an id but not a text don't touch each other.
- an empty table gives an empty result; other columns of the input are ignored or passed on, whatever their names.

Each level looks only at rows whose group at the level before has two rows or more, so the whole text is hashed
for those alone. Groups are counted by partial aggregation, and their keys come back to the rows through a broadcast whose
rows have been counted, or a join between two exchanges that adaptive execution can split; rows without a group
carry a key of their own there, so that they spread.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import cut, sized_join

PREFIX_CHARS = 128


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def _refined(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``_full``: the digest of the texts that may have an equal, 8 bytes of a row's own for all others."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumn("_len", F.octet_length(text))
    # 1: byte length (unchanged by the case of A-Z)
    lengths = cut(rows.groupBy("_len").count().where("count > 1").select("_len", F.lit(True).alias("_more")))
    rows = sized_join(rows, lengths, ["_len"], "left")
    # 2: hash of a short prefix
    rows = rows.withColumn("_prefix", F.when(F.col("_more"), F.xxhash64("_len", normalised(F.substring(text, 1, PREFIX_CHARS)))).otherwise(F.xxhash64("_len")))
    prefixes = cut(rows.where("_more").groupBy("_prefix").count().where("count > 1").select("_prefix", F.lit(True).alias("_again")))
    rows = sized_join(rows.drop("_more"), prefixes, ["_prefix"], "left")
    # 3: full content, for what is left
    full = F.when(F.col("_again"), F.unhex(F.sha2(normalised(text), 256))).otherwise(F.unhex(F.lpad(F.hex("_prefix"), 16, "0")))
    return rows.withColumn("_full", full).drop("_len", "_prefix", "_again")


def _groups(keyed: DataFrame, key: str, id_col: Column) -> DataFrame:
    """key, keep_id, group_size and _tops (rows with keep_id) of every group of two rows or more."""
    per_id = keyed.groupBy(key, id_col.alias("_id")).agg(F.count("*").alias("_n"))
    top = F.max(F.struct("_id", "_n"))
    groups = per_id.groupBy(key).agg(top.alias("_top"), F.sum("_n").alias("group_size")).where("group_size > 1")
    return cut(groups.select(key, F.col("_top._id").alias("keep_id"), "group_size", F.col("_top._n").alias("_tops")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that stay: of equal texts, one with the largest id."""
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    names = dict(zip(docs.columns, plain.columns))
    keyed = _refined(plain, names[text_col])
    groups = _groups(keyed.where(F.octet_length("_full") > 8), "_full", F.col(names[id_col]))
    met = sized_join(keyed, groups, ["_full"], "left")
    top = F.col(names[id_col]).eqNullSafe(F.col("keep_id"))
    one = met.where(F.col("group_size").isNull() | (top & (F.col("_tops") == 1)))
    # one of several rows with the largest id: the least hash of all columns, combined before the shuffle
    cols = plain.columns
    several = met.where(top & (F.col("_tops") > 1)).groupBy("_full").agg(F.min_by(F.struct(*cols), F.xxhash64(*cols)).alias("_row")).select("_row.*")
    few = groups.where("_tops > 1").limit(1).count() == 0
    return (one.select(*cols) if few else one.select(*cols).unionByName(several)).toDF(*docs.columns)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of ``docs``.

    The refinement finds the groups; the digest that the result needs of every text is their key on the way back.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    groups = _groups(_refined(docs, "text").where(F.octet_length("_full") > 8), "_full", F.col("doc_id"))
    rows = docs.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("_full"))
    met = sized_join(rows, groups, ["_full"], "left")
    top = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    several = top & F.coalesce(F.col("_tops") > 1, F.lit(False))
    shape = lambda df, kept: df.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        kept.alias("kept"),
        F.lower(F.hex("_full")).alias("text_sha256"),
    )
    if groups.where("_tops > 1").limit(1).count() == 0:
        return shape(met, F.col("group_size").isNull() | top)
    alike = met.where(several).groupBy("_full", "doc_id", "keep_id", "group_size").agg(F.count("*").alias("_n"))
    alike = alike.select("*", F.posexplode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_at", "_k"))
    return shape(met.where(~several), F.col("group_size").isNull() | top).unionByName(shape(alike, F.col("_at") == 0))


SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(t) AS text_sha256
FROM n
"""
