"""Sinks: insert if absent, upsert, Hive-partitioned archive, retention.

A table is a folder of numbered versions with a pointer to the newest, so a reader never sees half a write and a lost
executor or driver leaves the old version in place. Paths are whatever Spark can read and write.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of a table, or None where there is none yet."""
    fs, to_path = _fs(spark, path)
    if not fs.exists(to_path(f"{path}/versions")):
        return None
    done = sorted(s.getPath().getName() for s in fs.listStatus(to_path(f"{path}/versions")) if fs.exists(to_path(f"{path}/versions/{s.getPath().getName()}/_SUCCESS")))
    return spark.read.parquet(f"{path}/versions/{done[-1]}") if done else None


def _replace(spark: SparkSession, df: DataFrame, path: str) -> None:
    fs, to_path = _fs(spark, path)
    n = len(fs.listStatus(to_path(f"{path}/versions"))) if fs.exists(to_path(f"{path}/versions")) else 0
    df.write.parquet(f"{path}/versions/{n:012d}-{uuid.uuid4().hex[:8]}")


def insert_absent(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose keys aren't stored."""
    spark = rows.sparkSession
    old = current(spark, path)
    new = rows.dropDuplicates(keys)
    _replace(spark, new if old is None else old.unionByName(new.join(old.select(*keys), keys, "left_anti")), path)


def upsert(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Rows replace stored rows of equal keys."""
    spark = rows.sparkSession
    old = current(spark, path)
    new = rows.dropDuplicates(keys)
    _replace(spark, new if old is None else old.join(new.select(*keys), keys, "left_anti").unionByName(new), path)


def archive(rows: DataFrame, path: str, by: tuple[str, ...] = ("symbol", "timeframe")) -> None:
    """Append-only Parquet with Hive partitions; rows of a partition meet in few files."""
    rows.repartition(*by).write.partitionBy(*by).mode("append").parquet(path)


def retained(candles: DataFrame, keep_days: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, deleted rows by timeframe)."""
    spark = candles.sparkSession
    limits = spark.createDataFrame(list(keep_days.items()), "timeframe string, keep_days int")
    newest = candles.agg(F.max("ts").alias("newest"))
    j = candles.join(F.broadcast(limits), "timeframe", "left").join(F.broadcast(newest))
    old = F.col("keep_days").isNotNull() & (F.col("ts") < F.col("newest") - F.make_dt_interval(F.col("keep_days")))
    return j.where(~old).select(*candles.columns), j.where(old).groupBy("timeframe").count()


def newest_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
