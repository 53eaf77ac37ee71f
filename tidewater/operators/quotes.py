"""Windows over a symbol's quotes, whose history grows with the table: dealt into blocks of bounded size.

A quote's number in its symbol's history is its place in a range of moments and the quotes of the ranges before (a small
table). Blocks are ranges of numbers; each begins with the last quotes of the one before, as many as the frames reach back, which
are no rows of its own. Frames count rows, so every frame is whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.operators import rolling  # noqa: F401  its definitions come first
from tidewater.plans.dialect import CATALOG, Operator

# Fixed values
RANGE, BLOCK = 10**6 << 17, 16384
REACH = 99 + 19  # the slope's frame, and the depths' frame of its first row


def dealt(quotes: DataFrame, span: int = RANGE, block: int = BLOCK, reach: int = REACH) -> DataFrame:
    """``quotes`` (symbol, ts: long) with rn, block and own: every quote once with own, its block's first ones again without."""
    q = quotes.withColumn("_range", F.floor(F.col("ts") / span))
    counts = q.groupBy("symbol", "_range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("symbol").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("symbol", "_range", F.coalesce(before, F.lit(0)).alias("_start"))
    placed = q.withColumn("rn", F.row_number().over(Window.partitionBy("symbol", "_range").orderBy("ts"))).join(starts, ["symbol", "_range"])
    rn = F.col("_start") + F.col("rn")
    numbered = placed.withColumn("rn", rn).withColumn("_b", F.floor((F.col("rn") - 1) / block)).drop("_start", "_range")
    last = -(-reach // block)  # blocks that a quote's number reaches into
    blocks = F.filter(F.sequence(F.col("_b"), F.col("_b") + last), lambda b: F.col("rn") + reach > b * block)
    return numbered.withColumn("block", F.explode(blocks)).withColumn("own", F.col("block") == F.col("_b")).drop("_b")


def in_blocks(name: str, quotes: DataFrame) -> DataFrame:
    """The operator of that name over quotes that are ``dealt``."""
    text = CATALOG[name].text.replace("PARTITION BY symbol ORDER BY ts", "PARTITION BY symbol, block ORDER BY ts").replace(" FROM {quotes})", ", rn, block, own FROM {dealt})")
    head, _, tail = text.replace(", row_number() OVER (PARTITION BY symbol, block ORDER BY ts) AS rn", "").rpartition("SELECT symbol, ts, ")
    # frames first, then the rows of each block's own
    return Operator(name, "", f"{head}SELECT own, symbol, ts, {tail}").apply(quotes.sparkSession, dealt=quotes).where("own").drop("own")


def _run(name: str):
    return lambda spark, sf_dir: in_blocks(name, dealt(Operator("", "", "SELECT * FROM {quotes}").run(spark, sf_dir)))


QUERIES = {name: _run(name) for name in ("l02_liquidity_score", "l03_spread_trend")}
