"""Historical analogs: states of the past that are like a symbol's newest one, and what followed them.

A state is seven z-scores. Every past state with a complete outcome is scored against its symbol's newest state by cosine
and by Euclidean distance; the best of both (limits that each task applies before the shuffle) are a bounded set, for which
alone the paths that led there are fetched and aligned by dynamic time warping. A lower bound, the sum of each point's
cheapest partner, orders and ends the alignments. Nothing pairs one past state with another.

Ties go to the earlier moment. A state of zero length has no cosine. A symbol without a past state of known outcome gives
one row with score 50 and confidence 0.1.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.operators.rolling import BARS, P, over, zscore
from tidewater.plans.dialect import Operator, operator
from tidewater.session import cut

# Fixed values
TOP, FORWARD, PATH, PREFILTER = 20, 20, 10, 100
SATURATION, TILT, POOL = 0.05, 2.5, 100
STATE = ["mom_20_z", "mom_50_z", "acc_20_z", "hist_20_z", "regime_20_z", "far_high_z", "far_low_z"]

STATES = f"""WITH {BARS.strip()},
m AS (SELECT symbol, ts, close, sr, @div(close - lag(close, 20) OVER ({P}), lag(close, 20) OVER ({P})) * 100 AS mom_20, @div(close - lag(close, 50) OVER ({P}), lag(close, 50) OVER ({P})) * 100 AS mom_50,
  CASE WHEN count(lr) {over(20)} = 20 THEN round(stddev_pop(lr) {over(20)} * sqrt(252) * 100, 9) END AS hist_20,
  @div(close - max(high) {over(50)}, max(high) {over(50)}) * 100 AS far_high, @div(close - min(low) {over(50)}, min(low) {over(50)}) * 100 AS far_low FROM rets),
h AS (SELECT *, mom_20 - lag(mom_20) OVER ({P}) AS acc_20, @list_agg(hist_20) {over(100)} AS held, count(hist_20) {over(100)} AS n FROM m),
r AS (SELECT *, CASE WHEN hist_20 IS NOT NULL AND n >= 10 THEN CAST(least(2.0, floor(3 * @div(@size(@filter(held, @L(x) x < hist_20)), n))) AS DOUBLE) END AS regime_20 FROM h)
SELECT symbol, ts, sr, """ + ", ".join(f"@r6({zscore(k)}) AS {k}_z" for k in ("mom_20", "mom_50", "acc_20", "hist_20", "regime_20", "far_high", "far_low")) + " FROM r"
operator("n18_states", "State vectors of every bar, with its simple return.", "SELECT * FROM {states}", states=STATES)


def path_outcome(returns: Column) -> Column:
    """total, volatility, drawdown, runup of a path of returns that starts at one."""
    start = F.struct(*[F.lit(x).alias(k) for k, x in (("at", 1.0), ("high", 1.0), ("low", 1.0), ("drawdown", 0.0), ("runup", 0.0))])

    def step(s: Column, r: Column) -> Column:
        at = s["at"] * (1 + r)
        high, low = F.greatest(s["high"], at), F.least(s["low"], at)
        return F.struct(at.alias("at"), high.alias("high"), low.alias("low"), F.least(s["drawdown"], at / high - 1).alias("drawdown"), F.greatest(s["runup"], at / low - 1).alias("runup"))

    done = F.aggregate(returns, start, step)
    mean = F.aggregate(returns, F.lit(0.0), lambda a, x: a + x) / F.size(returns)
    spread = F.sqrt(F.aggregate(returns, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(returns))
    return F.struct((done["at"] - 1).alias("total"), spread.alias("volatility"), done["drawdown"].alias("drawdown"), done["runup"].alias("runup"))


def known_states(states: DataFrame) -> DataFrame:
    """symbol, ts, i (number among the symbol's complete states), the state, outcome (null until all of it has happened)."""
    by = Window.partitionBy("symbol").orderBy("ts")
    ahead = by.rowsBetween(1, FORWARD)
    returned = states.where("sr IS NOT NULL").withColumn("_r", F.collect_list("sr").over(ahead))
    full = F.when(F.size("_r") == FORWARD, path_outcome(F.col("_r")))
    later = returned.withColumn("outcome", full).where(" AND ".join(f"{k} IS NOT NULL" for k in STATE))
    return later.select("symbol", "ts", F.row_number().over(by).alias("i"), *STATE, "outcome")


def prefiltered(known: DataFrame, keep: int = PREFILTER) -> DataFrame:
    """symbol, i, ts, cosine, distance, outcome and both ranks of the ``keep`` best by either; n: how many were compared."""
    newest = known.groupBy("symbol").agg(F.max_by(F.struct("i", *STATE), "i").alias("now"))
    past = known.where("outcome IS NOT NULL").join(newest, "symbol").where(F.col("i") < F.col("now.i"))
    dot = sum(F.col(k) * F.col(f"now.{k}") for k in STATE)
    own, other = sum(F.col(k) * F.col(k) for k in STATE), sum(F.col(f"now.{k}") * F.col(f"now.{k}") for k in STATE)
    cosine = F.when((own > 0) & (other > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / (F.sqrt(own) * F.sqrt(other)))))
    away = F.sqrt(sum((F.col(k) - F.col(f"now.{k}")) * (F.col(k) - F.col(f"now.{k}")) for k in STATE))
    scored = cut(past.select("symbol", "i", "ts", cosine.alias("cosine"), away.alias("distance"), "outcome"))
    best = lambda order, name: scored.withColumn(name, F.row_number().over(Window.partitionBy("symbol").orderBy(order, "i"))).where(F.col(name) <= keep)
    by_cosine = best(F.desc_nulls_last("cosine"), "cosine_rank").where("cosine IS NOT NULL")
    by_distance = best(F.asc("distance"), "distance_rank").select("symbol", "i", "distance_rank")
    chosen = by_cosine.select("symbol", "i", "cosine_rank").join(by_distance, ["symbol", "i"], "full")
    counts = scored.groupBy("symbol").agg(F.count("*").alias("n"))
    return chosen.join(scored, ["symbol", "i"]).join(counts, "symbol")


def align(now: np.ndarray, paths: np.ndarray, top: int, batch: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, distances) of the ``top`` nearest of ``paths`` (k x n x d) to ``now`` (m x d) by dynamic time warping."""
    cost = np.sqrt(((now[None, :, None, :] - paths[:, None, :, :]) ** 2).sum(-1))
    bound = np.maximum(cost.min(2).sum(1), cost.min(1).sum(1))  # every point meets one at least
    order = np.argsort(bound, kind="stable")
    found_k, found_d = np.zeros(0, int), np.zeros(0)
    for s in range(0, len(order), batch):
        own = order[s : s + batch]
        if len(found_d) == top and bound[own[0]] > found_d[-1] + 1e-9:
            break
        c = cost[own]
        m, n = c.shape[1:]
        d = np.full((m + 1, n + 1, len(own)), np.inf)
        d[0, 0] = 0.0
        for i in range(1, m + 1):
            for j in range(1, n + 1):
                d[i, j] = c[:, i - 1, j - 1] + np.minimum(np.minimum(d[i - 1, j], d[i, j - 1]), d[i - 1, j - 1])
        found_k, found_d = np.r_[found_k, own], np.r_[found_d, d[m, n]]
        best = np.lexsort((found_k, found_d))[:top]
        found_k, found_d = found_k[best], found_d[best]
    return found_k, found_d


def aligned(known: DataFrame, chosen: DataFrame, top: int = TOP, path: int = PATH) -> DataFrame:
    """symbol, i, dtw_rank, dtw: the nearest of the chosen states by the path of ``path`` states that led to each."""
    last = known.groupBy("symbol").agg(F.max("i").alias("i"))
    ends = chosen.select("symbol", F.col("i").alias("end")).unionByName(last.select("symbol", F.col("i").alias("end")).join(chosen.select("symbol").distinct(), "symbol"))
    steps = ends.where(F.col("end") >= path).select("symbol", "end", F.explode(F.sequence(F.col("end") - path + 1, F.col("end"))).alias("i"))
    points = steps.join(known.select("symbol", "i", F.array(*STATE).alias("v")), ["symbol", "i"])
    paths = points.groupBy("symbol", "end").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]).alias("path"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:  # the chosen of one symbol: two prefilters at most
        rows = rows.sort_values("end")
        x = np.array([[list(v) for v in p] for p in rows["path"]])
        k, d = align(x[-1], x[:-1], top) if len(x) > 1 else (np.zeros(0, int), np.zeros(0))
        return pd.DataFrame({"symbol": rows["symbol"].iloc[0], "i": rows["end"].to_numpy()[k], "dtw_rank": np.arange(1, len(k) + 1), "dtw": d})

    return paths.groupBy("symbol").applyInPandas(run, "symbol string, i int, dtw_rank int, dtw double")


def analogs(states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the chosen states with all ranks, each symbol's newest moment)."""
    known = cut(known_states(states))
    chosen = cut(prefiltered(known))
    ranked = chosen.join(aligned(known, chosen), ["symbol", "i"], "left")
    return cut(ranked), known.groupBy("symbol").agg(F.max("ts").alias("ts"))


def listed(ranked: DataFrame) -> DataFrame:
    """The analogs by cosine, nearest first, with what followed."""
    top = ranked.where(F.col("cosine_rank") <= TOP)
    four = lambda c: F.round(c, 4)
    return top.select(
        "symbol", F.col("cosine_rank").alias("rank"), "ts", four("cosine").alias("similarity"), four("outcome.total").alias("subsequent_return"),
        four("outcome.volatility").alias("subsequent_volatility"), four("outcome.drawdown").alias("max_drawdown"), four("outcome.runup").alias("max_runup"),
    )


def assessed(ranked: DataFrame, newest: DataFrame) -> DataFrame:
    """One row a symbol: score, confidence, states, rates and how far the three rankings agree."""
    inside = lambda k: F.avg((F.coalesce(F.col(k), F.lit(TOP + 1)) <= TOP).cast("double"))
    aligned_any = ranked.groupBy("symbol").agg(F.max(F.col("dtw").isNotNull()).alias("dtw_used"), F.max("n").alias("n"))
    rows = listed(ranked).join(ranked.where(F.col("cosine_rank") <= TOP).select("symbol", "ts", "distance_rank", "dtw_rank"), ["symbol", "ts"])
    a = rows.groupBy("symbol").agg(
        F.count("*").alias("analogs"), F.avg((F.col("subsequent_return") > 0).cast("double")).alias("win"), F.avg("subsequent_return").alias("gain"), F.avg("subsequent_volatility").alias("noise"),
        F.avg("max_drawdown").alias("drop"), F.avg("max_runup").alias("rise"), F.avg("similarity").alias("like"), inside("distance_rank").alias("by_distance"), inside("dtw_rank").alias("by_dtw"),
    ).join(aligned_any, "symbol")
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    agree = F.when(F.col("dtw_used"), (F.col("by_distance") + F.col("by_dtw")) / 2).otherwise(F.col("by_distance"))
    a = a.withColumn("agree", agree).withColumn("tilt", clamp(F.abs(F.col("win") - 0.5) * TILT))
    sure = clamp(0.15 + 0.35 * clamp((F.col("like") + 1) / 2) + 0.25 * F.col("agree") + 0.25 * clamp(F.col("n") / POOL))
    out = newest.join(a, "symbol", "left")
    some = F.col("analogs").isNotNull()
    state = lambda c, none: F.when(some, c).otherwise(F.lit(none))
    four = lambda c: F.round(c, 4)
    return out.select(
        "symbol", "ts", state(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 + 50 * F.tanh(F.col("gain") / SATURATION))), 50.0).alias("score"), state(sure, 0.1).alias("confidence"),
        state(F.when(F.col("win") > 0.5, F.col("tilt")).otherwise(0.0), 0.0).alias("bullish"), state(F.when(F.col("win") < 0.5, F.col("tilt")).otherwise(0.0), 0.0).alias("bearish"), state(1 - F.col("tilt"), 1.0).alias("mixed"),
        F.coalesce("analogs", F.lit(0)).alias("analogs"), four("win").alias("win_rate"), four("gain").alias("mean_return"), four("noise").alias("mean_volatility"), four("drop").alias("mean_drawdown"),
        four("rise").alias("mean_runup"), four("like").alias("mean_similarity"), four("agree").alias("method_agreement"), F.coalesce("dtw_used", F.lit(False)).alias("dtw_used"),
    )


def similarity(analog_list: DataFrame, directions: DataFrame) -> DataFrame:
    """What the analogs of a symbol say of a candidate; a short one mirrors returns and swaps excursions. ``directions``: symbol, direction."""
    sign = F.when(F.col("direction") == "short", -1.0).otherwise(1.0)
    r = sign * F.col("subsequent_return")
    worst = F.when(sign > 0, F.col("max_drawdown")).otherwise(-F.col("max_runup"))
    best = F.when(sign > 0, F.col("max_runup")).otherwise(-F.col("max_drawdown"))
    met = directions.join(analog_list, "symbol", "left")
    four = lambda c: F.round(c, 4)
    return met.groupBy("symbol", "direction").agg(
        F.count("rank").alias("analogs"), four(F.avg((r > 0).cast("double"))).alias("win_rate"), four(F.avg(r)).alias("average_return"), four(F.min(worst)).alias("worst_drawdown"), four(F.max(best)).alias("best_runup"),
        *[four(F.percentile(r, F.lit(q / 100))).alias(f"p{q}") for q in (10, 25, 50, 75, 90)],
    )


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Operator("", "", "SELECT * FROM {states}", {"states": STATES}).run(spark, sf_dir)


def _ranked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    kept = spark.sparkContext.__dict__.setdefault("_tidewater_analogs", {})
    if sf_dir not in kept:
        kept[sf_dir] = analogs(_states(spark, sf_dir))
    return kept[sf_dir]


def _similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, newest = _ranked(spark, sf_dir)
    sides = F.explode(F.array(F.lit("long"), F.lit("short")))
    return similarity(listed(ranked), newest.select("symbol", sides.alias("direction")))


QUERIES = {
    "n18_analog_list": lambda spark, d: listed(_ranked(spark, d)[0]),
    "n18_analog_assessment": lambda spark, d: assessed(*_ranked(spark, d)),
    "n21_aligned_paths": lambda spark, d: _ranked(spark, d)[0].where("dtw_rank IS NOT NULL").select("symbol", "ts", F.col("dtw_rank").alias("rank"), F.round("dtw", 6).alias("distance")),
    "y21_analog_similarity": _similarity,
}


def _oracle_list(then: str) -> str:
    """The list by lists: cosine from inner products, outcomes from compounded paths unnested and ranked again."""
    head = Operator("", "", "SELECT 1 AS z FROM {states}", {"states": STATES}).oracle()
    ctes = head[: head.rindex("SELECT 1 AS z")].rstrip()
    whole = " AND ".join(f"{k} IS NOT NULL" for k in STATE)
    return f"""{ctes},
ret AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM states WHERE sr IS NOT NULL),
ahead AS (SELECT a.symbol, a.ts, b.k - a.k AS j, exp(sum(ln(1 + b.sr)) OVER (PARTITION BY a.symbol, a.ts ORDER BY b.k)) AS worth, b.sr FROM ret a JOIN ret b ON a.symbol = b.symbol AND b.k > a.k AND b.k <= a.k + {FORWARD}),
path AS (SELECT symbol, ts, j, worth, sr FROM ahead UNION ALL SELECT symbol, ts, 0, 1.0, NULL FROM ret),
run AS (SELECT *, max(worth) OVER (PARTITION BY symbol, ts ORDER BY j) AS high, min(worth) OVER (PARTITION BY symbol, ts ORDER BY j) AS low FROM path),
outcome AS (SELECT symbol, ts, max(CASE WHEN j = {FORWARD} THEN worth END) - 1 AS total, stddev_pop(sr) AS volatility, min(worth / high - 1) AS drawdown, max(worth / low - 1) AS runup FROM run GROUP BY symbol, ts HAVING max(j) = {FORWARD}),
st AS (SELECT symbol, ts, [{", ".join(STATE)}] AS v FROM ret WHERE {whole}),
now AS (SELECT symbol, max_by(v, ts) AS v, max(ts) AS ts FROM st GROUP BY symbol),
sc AS (SELECT st.symbol, st.ts, list_cosine_similarity(st.v, now.v) AS cs, o.* EXCLUDE (symbol, ts) FROM st JOIN now USING (symbol) JOIN outcome o ON o.symbol = st.symbol AND o.ts = st.ts WHERE st.ts < now.ts),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY cs DESC, ts) AS INTEGER) AS rank FROM sc),
li AS (SELECT symbol, rank, ts, round(cs, 4) AS similarity, round(total, 4) AS subsequent_return, round(volatility, 4) AS subsequent_volatility, round(drawdown, 4) AS max_drawdown, round(runup, 4) AS max_runup FROM rk WHERE rank <= {TOP})
{then}"""


def oracle_sql() -> dict[str, str]:
    both = """SELECT symbol, direction, count(rank) AS analogs, round(avg(CASE WHEN g * subsequent_return > 0 THEN 1.0 ELSE 0.0 END), 4) AS win_rate, round(avg(g * subsequent_return), 4) AS average_return,
  round(min(CASE WHEN g > 0 THEN max_drawdown ELSE -max_runup END), 4) AS worst_drawdown, round(max(CASE WHEN g > 0 THEN max_runup ELSE -max_drawdown END), 4) AS best_runup, """ + ", ".join(f"round(quantile_cont(g * subsequent_return, {q / 100}), 4) AS p{q}" for q in (10, 25, 50, 75, 90))
    return {
        "n18_analog_list": _oracle_list("SELECT * FROM li"),
        "y21_analog_similarity": _oracle_list(both + " FROM li, (VALUES ('long', 1.0), ('short', -1.0)) d(direction, g) GROUP BY symbol, direction"),
    }
