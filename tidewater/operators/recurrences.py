"""Recurrences x' = f * x + s along time, composed over blocks: exponential averages and beliefs without collecting a series.

A row is an affine map, and so is a block of rows: blocks are folded apart from each other, each to the one map from the state
before it to the state after it. A series is then a short table of maps, one a block, which gives the state that each block
really starts in; a second fold within the block gives the state after every row. One long series spreads over tasks, and
what meets in one place is a map for every ``block`` seconds.

Every series starts from zeros. The moments of a series are distinct (bars); rows without one, and bars without a close, are left
out. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.operators.assessments import transition
from tidewater.plans.dialect import Operator
from tidewater.session import cut

BLOCK = 14 * 86400  # seconds of a block
#: Windows of the averages, bounds of a belief's weight.
SPANS = (20, 50, 200)
LEAST, MOST = 0.1, 0.9
STATES = ["up", "down", "flat"]


def _step(f: Column, s: Column, x: Column) -> Column:
    return F.zip_with(F.zip_with(f, x, lambda a, b: a * b), s, lambda a, b: a + b)


def composed(rows: DataFrame, width: int, block: int = BLOCK) -> DataFrame:
    """symbol, ts, state (array of ``width``): the state after every row. ``rows``: symbol, ts, factor and shift (arrays of ``width``)."""
    kind = rows.schema["symbol"].dataType.simpleString()
    at = F.floor(F.unix_timestamp("ts") / block)
    blocks = cut(rows.groupBy("symbol", at.alias("block")).agg(F.array_sort(F.collect_list(F.struct("ts", "factor", "shift"))).alias("rows")))
    ones, zeros = (F.array(*[F.lit(v)] * width) for v in (1.0, 0.0))
    whole = F.aggregate("rows", F.struct(ones.alias("f"), zeros.alias("s")), lambda m, r: F.struct(F.zip_with(r["factor"], m["f"], lambda a, b: a * b).alias("f"), _step(r["factor"], r["shift"], m["s"]).alias("s")))

    def run(own: pd.DataFrame) -> pd.DataFrame:  # one small row a block
        own = own.sort_values("block")
        x, starts = np.zeros(width), []
        for f, s in zip(own["f"], own["s"]):
            starts.append(x.tolist())
            x = np.asarray(f) * x + np.asarray(s)
        return pd.DataFrame({"symbol": own["symbol"], "block": own["block"], "start": starts})

    maps = blocks.select("symbol", "block", whole.alias("m")).select("symbol", "block", "m.f", "m.s")
    starts = maps.groupBy("symbol").applyInPandas(run, f"symbol {kind}, block long, start array<double>")
    first = F.struct(F.col("start").alias("x"), F.array().cast("array<array<double>>").alias("met"))

    def one(state: Column, r: Column) -> Column:
        x = _step(r["factor"], r["shift"], state["x"])
        return F.struct(x.alias("x"), F.concat(state["met"], F.array(x)).alias("met"))

    walked = blocks.join(starts, ["symbol", "block"]).select("symbol", "rows", F.aggregate("rows", first, one)["met"].alias("met"))
    return walked.select("symbol", F.explode(F.arrays_zip(F.col("rows.ts").alias("ts"), "met")).alias("z")).select("symbol", F.col("z.ts").alias("ts"), F.col("z.met").alias("state"))


def numbered(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``rows`` with n, their number in their series by ``ts`` from 1: counted by blocks, the blocks' counts added up."""
    placed = rows.withColumn("_block", F.floor(F.unix_timestamp("ts") / block))
    counts = placed.groupBy("symbol", "_block").agg(F.count("*").alias("_k"))
    before = counts.withColumn("_before", F.sum("_k").over(Window.partitionBy("symbol").orderBy("_block")) - F.col("_k")).drop("_k")
    own = F.row_number().over(Window.partitionBy("symbol", "_block").orderBy("ts"))
    return placed.withColumn("_own", own).join(before, ["symbol", "_block"]).withColumn("n", F.col("_own") + F.col("_before")).drop("_own", "_before", "_block")


def averages(bars: DataFrame, spans: tuple[int, ...] = SPANS, block: int = BLOCK) -> DataFrame:
    """symbol, ts, n, ema_<w>: seeded with the plain average of the first w closes, null before it. ``bars``: symbol, ts, close."""
    rows = numbered(bars.where("ts IS NOT NULL AND close IS NOT NULL").select("symbol", "ts", F.col("close").cast("double").alias("close")), block)
    late = lambda w: F.col("n") > w
    factor = F.array(*[F.when(late(w), 1 - 2 / (w + 1)).otherwise(1.0) for w in spans])
    shift = F.array(*[F.when(late(w), F.col("close") * (2 / (w + 1))).otherwise(F.col("close") / w) for w in spans])
    states = numbered(composed(rows.select("symbol", "ts", factor.alias("factor"), shift.alias("shift")), len(spans), block), block)
    return states.select("symbol", "ts", "n", *(F.when(F.col("n") >= w, F.round(F.get("state", F.lit(k)) + 1e-9, 6) + 0.0).alias(f"ema_{w}") for k, w in enumerate(spans)))


def beliefs(evidence: DataFrame, states: list[str], block: int = BLOCK) -> DataFrame:
    """symbol, ts and a share for each state after every row. ``evidence``: symbol, ts, confidence and each state's evidence.

    Evidence counts as shares (uniform where nothing speaks), with a weight of ``LEAST`` to ``MOST``; the first row of a series is its first
    belief. Shares stay shares, as both sides of the mean add up to one."""
    parts = [F.greatest(F.lit(0.0), F.coalesce(F.col(s).cast("double"), F.lit(0.0))) for s in states]
    total = sum(parts, F.lit(0.0))
    rows = numbered(evidence.where("ts IS NOT NULL").select("symbol", "ts", "confidence", F.array(*[F.when(total > 0, p / total).otherwise(1.0 / len(states)) for p in parts]).alias("likely")), block)
    weight = F.when(F.col("n") == 1, 1.0).otherwise(F.least(F.lit(MOST), F.greatest(F.lit(LEAST), F.coalesce(F.col("confidence").cast("double"), F.lit(LEAST)))))
    rows = rows.withColumn("weight", weight)
    got = composed(rows.select("symbol", "ts", F.array(*[1 - F.col("weight")] * len(states)).alias("factor"), F.transform("likely", lambda x: x * F.col("weight")).alias("shift")), len(states), block)
    return got.select("symbol", "ts", *(F.get("state", F.lit(k)).alias(s) for k, s in enumerate(states)))


#: A bar's evidence: how far it rose, fell and came back, trusted by how many ticks it holds.
EVIDENCE = """SELECT symbol, ts, greatest(close - open, 0.0) AS up, greatest(open - close, 0.0) AS down, high - low - abs(close - open) AS flat, CAST(volume AS DOUBLE) / 20 AS confidence FROM {candles}"""


def _beliefs(spark: SparkSession, d: str) -> DataFrame:
    return beliefs(Operator("", "", EVIDENCE).run(spark, d), STATES)


def _rounded(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select("symbol", "ts", *((F.round(F.col(s) + 1e-9, 6) + 0.0).alias(s) for s in names))


QUERIES = {
    "k13_ema_blocks": lambda spark, d: averages(Operator("", "", "SELECT symbol, ts, close FROM {candles} WHERE close IS NOT NULL").run(spark, d)),
    "n23_belief_blocks": lambda spark, d: _rounded(_beliefs(spark, d), STATES),
    "n25_regime_assessment": lambda spark, d: transition(_beliefs(spark, d), STATES),
}

# SQL in closed form: every earlier row with what is left of its weight.
_AVERAGES = "WITH b AS (SELECT symbol, ts, CAST(close AS DOUBLE) AS close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM {candles} WHERE close IS NOT NULL) SELECT t.symbol, t.ts, t.n, " + ", ".join(
    f"CASE WHEN t.n >= {w} THEN @r6(sum(CASE WHEN i.n <= {w} THEN i.close / {w} * power({w - 1}.0 / {w + 1}, t.n - {w}) ELSE i.close * 2.0 / {w + 1} * power({w - 1}.0 / {w + 1}, t.n - i.n) END)) END AS ema_{w}" for w in SPANS
) + " FROM b t JOIN b i ON t.symbol = i.symbol AND i.n <= t.n GROUP BY t.symbol, t.ts, t.n"
_BELIEFS = """WITH e AS (SELECT *, up + down + flat AS total, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM {evidence}),
w AS (SELECT *, CASE WHEN n = 1 THEN 1 WHEN confidence < 0.1 THEN 0.1 WHEN confidence > 0.9 THEN 0.9 ELSE confidence END AS w FROM e),
k AS (SELECT *, sum(CASE WHEN n = 1 THEN 0 ELSE ln(1 - w) END) OVER (PARTITION BY symbol ORDER BY n) AS kept FROM w)
SELECT t.symbol, t.ts, """ + ", ".join(f"sum(i.w * exp(t.kept - i.kept) * CASE WHEN i.total > 0 THEN i.{s} / i.total ELSE 1.0 / 3 END) AS {s}" for s in STATES) + " FROM k t JOIN k i ON t.symbol = i.symbol AND i.n <= t.n GROUP BY t.symbol, t.ts"
_REGIME = """WITH h AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS x FROM {beliefs}),
o AS (SELECT * FROM h WHERE back <= 20),
l AS (SELECT symbol, ts, unnest(['up', 'down', 'flat']) AS s, unnest([1, 2, 3]) AS k, unnest([up, down, flat]) AS p, back, x FROM o),
r AS (SELECT symbol, s, max(CASE WHEN back = 1 THEN p END) AS p, coalesce(regr_slope(p, CAST(x AS DOUBLE)), 0) AS slope, row_number() OVER (PARTITION BY symbol ORDER BY max(CASE WHEN back = 1 THEN p END) DESC, any_value(k)) AS place FROM l GROUP BY symbol, s),
g AS (SELECT symbol, max(ts) AS ts, count(*) AS n, max_by(greatest(up, down, flat), back) - min_by(greatest(up, down, flat), back) AS loss FROM o GROUP BY symbol),
j AS (SELECT g.symbol, g.ts, n, greatest(0, loss) AS loss, a.s AS state, b.s AS runner_up, a.slope AS speed, 0.6 * (1 - a.p + b.p) + 0.4 * least(1, greatest(0, b.slope) / 0.05) AS chance
      FROM g JOIN r a ON a.symbol = g.symbol AND a.place = 1 JOIN r b ON b.symbol = g.symbol AND b.place = 2 WHERE n > 1),
v AS (SELECT *, 0.4 * chance + 0.3 * least(1, abs(speed) / 0.1) + 0.3 * loss AS level FROM j),
s AS (SELECT *, list_transform([0, 0.5, 1], lambda a: greatest(0, 1 - abs(level - a) / 0.4)) AS near FROM v)
SELECT symbol, ts, state, runner_up, @r6(100 * level) AS score, @r6(least(1, n / 10)) AS confidence, @r6(chance) AS probability, @r6(speed) AS speed, @r6(loss) AS confidence_loss, @r6(CASE WHEN chance >= 0.6 THEN 1 ELSE 0 END) AS alert,
  @r6(near[1] / list_sum(near)) AS s_stable, @r6(near[2] / list_sum(near)) AS s_transitioning, @r6(near[3] / list_sum(near)) AS s_unstable FROM s"""


def oracle_sql() -> dict[str, str]:
    views = {"evidence": EVIDENCE, "beliefs": _BELIEFS}
    return {
        "k13_ema_blocks": Operator("", "", _AVERAGES).oracle(),
        "n23_belief_blocks": Operator("", "", "SELECT symbol, ts, @r6(up) AS up, @r6(down) AS down, @r6(flat) AS flat FROM {beliefs}", views).oracle(),
        "n25_regime_assessment": Operator("", "", _REGIME, views).oracle(),
    }
