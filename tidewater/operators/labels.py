"""Triple-barrier labels, long and short, with dates that force an exit: every entry's next bars are folded where they lie.

One window gives each bar the bars that follow it, up to the horizon; a fold over that short array walks the barriers, so there is no
join of bars with bars and one exchange. A gap through both barriers or a touch of both counts as the worse; the trailing
stop starts halfway to the target and never loosens; dates of events and of thin liquidity close at the bar's close, by local date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.operators import training
from tidewater.operators.rolling import P
from tidewater.plans.dialect import Operator
from tidewater.session import cut, sized_join

# Fixed values
WINDOW, FLOOR, PROFIT, STOP, HORIZON = 20, 0.002, 2.0, 1.0, 10
ACTIVE, TRAIL = 0.5, 0.4
LOCAL = "Asia/Kolkata"


def walked(bars: Column, entry: Column, profit: Column, stop: Column, sign: int) -> Column:
    """Exit of one entry: reason, price, ts, held, gap, ambiguous. ``bars``: structs ts, open, high, low, close, event, thin."""
    side = lambda a, b: a >= b if sign > 0 else a <= b
    best = (lambda a, b: F.greatest(a, b)) if sign > 0 else (lambda a, b: F.least(a, b))
    target, fixed = entry * (1 + sign * profit), entry * (1 - sign * stop)
    none = F.lit(None)
    exit_of = lambda reason, price, ts, held, gap, ambiguous: F.struct(
        reason.cast("string").alias("reason"), price.cast("double").alias("price"), ts.cast("timestamp").alias("ts"), held.cast("int").alias("held"), gap.cast("boolean").alias("gap"), ambiguous.cast("boolean").alias("ambiguous")
    )
    start = F.struct(entry.cast("double").alias("ext"), F.lit(0).alias("n"), exit_of(none, none, none, none, none, none).alias("out"))

    def step(s: Column, b: Column) -> Column:
        trailing = sign * (s["ext"] - entry) / entry >= ACTIVE * profit
        at = F.when(trailing, best(fixed, s["ext"] * (1 - sign * TRAIL * profit))).otherwise(fixed)
        n = s["n"] + 1
        stopped = F.when(trailing, "trailing_stop").otherwise("stop")
        gap_up, gap_down = side(b["open"], target), side(at, b["open"])
        far, near = (b["high"], b["low"]) if sign > 0 else (b["low"], b["high"])
        up, down = side(far, target), side(at, near)
        yes, no = F.lit(True), F.lit(False)
        made = lambda reason, price, gap, both: exit_of(reason, price, b["ts"], n, gap, both)
        out = (
            F.when(s["out"]["reason"].isNotNull(), s["out"])
            .when(gap_up & gap_down, made(F.lit("stop"), b["open"], yes, yes)).when(gap_up, made(F.lit("profit_target"), target, yes, no)).when(gap_down, made(stopped, at, yes, no))
            .when(up & down, made(F.lit("stop"), at, no, yes)).when(up, made(F.lit("profit_target"), target, no, no)).when(down, made(stopped, at, no, no))
            .when(b["event"], made(F.lit("event_barrier"), b["close"], no, no)).when(b["thin"], made(F.lit("liquidity_barrier"), b["close"], no, no))
            .otherwise(s["out"])
        )
        return F.struct(best(s["ext"], far).cast("double").alias("ext"), n.alias("n"), out.alias("out"))

    end = F.aggregate(bars, start, step)["out"]
    last = F.element_at(bars, -1)
    late = F.when(F.size(bars) == 0, exit_of(F.lit("insufficient_data"), entry, none, F.lit(0), F.lit(False), F.lit(False))).otherwise(
        exit_of(F.when(F.size(bars) < HORIZON, "insufficient_data").otherwise("max_holding_time"), last["close"], last["ts"], F.size(bars), F.lit(False), F.lit(False))
    )
    return F.when(end["reason"].isNotNull(), end).otherwise(late)


def labelled(candles: DataFrame, event_days: DataFrame, thin_days: DataFrame) -> DataFrame:
    """One row an entry and direction. ``event_days``: day; ``thin_days``: symbol, day (local dates; repeats count once)."""
    day = F.to_date(F.from_utc_timestamp("ts", LOCAL))
    bars = candles.select("symbol", "ts", "open", "high", "low", "close", day.alias("day"))
    bars = sized_join(bars, cut(event_days.select("day").distinct().withColumn("event", F.lit(True))), ["day"], "left")
    bars = sized_join(bars, cut(thin_days.select("symbol", "day").distinct().withColumn("thin", F.lit(True))), ["symbol", "day"], "left")
    by = Window.partitionBy("symbol").orderBy("ts")
    one = F.struct("ts", *[F.col(k).cast("double").alias(k) for k in ("open", "high", "low", "close")], F.coalesce("event", F.lit(False)).alias("event"), F.coalesce("thin", F.lit(False)).alias("thin"))
    before = F.lag("close").over(by)
    rows = bars.select("symbol", "ts", "close", F.when((before > 0) & (F.col("close") > 0), F.log(F.col("close") / before)).alias("lr"), one.alias("bar"))
    recent, ahead = by.rowsBetween(-(WINDOW - 2), 0), by.rowsBetween(1, HORIZON)
    vol = F.when(F.count("lr").over(recent) >= 2, F.greatest(F.stddev_pop("lr").over(recent), F.lit(FLOOR))).otherwise(F.lit(FLOOR))
    rows = rows.select("symbol", "ts", F.col("close").cast("double").alias("entry"), vol.alias("vol"), F.collect_list("bar").over(ahead).alias("bars")).where("entry > 0")
    rows = rows.select("symbol", "ts", "entry", "bars", F.round(PROFIT * F.col("vol"), 6).alias("profit"), F.round(STOP * F.col("vol"), 6).alias("stop"))
    sides = F.array(*[F.struct(F.lit(name).alias("direction"), F.lit(float(sign)).alias("sign"), walked(F.col("bars"), F.col("entry"), F.col("profit"), F.col("stop"), sign).alias("x")) for name, sign in (("long", 1), ("short", -1))])
    out = rows.select("symbol", "ts", "entry", "profit", "stop", F.explode(sides).alias("s")).select("symbol", "ts", "entry", "profit", "stop", "s.direction", "s.sign", "s.x")
    gain = F.round(F.col("sign") * (F.col("x.price") - F.col("entry")) / F.col("entry") * 100, 4) + F.lit(0.0)  # no minus zero
    reason = F.col("x.reason")
    out = out.withColumn("exit_return_pct", gain)
    label = F.when(reason == "profit_target", "win").when(reason == "stop", "loss").when(reason.isin("trailing_stop", "event_barrier", "liquidity_barrier"), F.when(F.col("exit_return_pct") > 0, "partial_success").otherwise("loss")).otherwise("timeout")
    quality = F.when(reason == "insufficient_data", 0.1).otherwise(1.0 - F.when(F.col("x.gap"), 0.3).otherwise(0.0) - F.when(F.col("x.ambiguous"), 0.4).otherwise(0.0) - F.when(reason == "max_holding_time", 0.2).otherwise(0.0))
    return out.select("symbol", "ts", "direction", F.col("profit").alias("profit_target_pct"), F.col("stop").alias("stop_pct"), F.coalesce("x.ts", "ts").alias("exit_ts"), F.round("x.price", 4).alias("exit_price"), reason.alias("exit_reason"), "exit_return_pct", label.alias("label"), F.round(quality, 4).alias("label_quality"), F.col("x.held").alias("bars_held"), F.col("x.gap").alias("gap"), F.col("x.ambiguous").alias("ambiguous"))


#: Days of the provided tables that force exits: those with more errors than usual, and those whose quotes score low on average.
EVENT_DAYS = "SELECT day FROM (SELECT @date(@ist(ts)) AS day, count(*) AS n, avg(count(*)) OVER () AS usual FROM {ticks} WHERE symbol = 'error' GROUP BY @date(@ist(ts))) q WHERE n > 1.15 * usual"
THIN_DAYS = "SELECT symbol, @date(@ist(ts)) AS day FROM {liquidity} GROUP BY symbol, @date(@ist(ts)) HAVING avg(liquidity_score) < 25"
FEEDS = {"quotes": training.QUOTES, "liquidity": training.FEEDS["liquidity"], "event_days": EVENT_DAYS, "thin_days": THIN_DAYS}
DAYS = "SELECT 'event' AS kind, 'MARKET' AS symbol, day FROM {event_days} UNION ALL SELECT 'liquidity', symbol, day FROM {thin_days}"


def _view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return Operator("", "", text, FEEDS).run(spark, sf_dir)


QUERIES = {
    "y03_barrier_labels": lambda spark, d: labelled(_view(spark, d, "SELECT * FROM {candles}"), _view(spark, d, "SELECT * FROM {event_days}"), _view(spark, d, "SELECT * FROM {thin_days}")),
    "y06_barrier_dates": lambda spark, d: _view(spark, d, DAYS),
}


def _oracle() -> str:
    """In closed form: the extreme of the bars before decides the stop of each bar, and the first bar that ends the walk counts."""
    head = Operator("", "", "SELECT 1 AS z FROM {candles} c, {event_days} e, {thin_days} t", FEEDS).oracle()
    ctes = head[: head.rindex("SELECT 1 AS z")].rstrip()
    return f"""{ctes},
nb AS (SELECT *, row_number() OVER ({P}) AS rn, CASE WHEN lag(close) OVER ({P}) > 0 AND close > 0 THEN ln(close / lag(close) OVER ({P})) END AS lr, CAST(ts + INTERVAL 330 MINUTES AS DATE) AS day FROM candles),
vb AS (SELECT *, CASE WHEN count(lr) OVER r >= 2 THEN greatest(stddev_pop(lr) OVER r, {FLOOR}) ELSE {FLOOR} END AS vol, day IN (SELECT day FROM event_days) AS event, (symbol, day) IN (SELECT (symbol, day) FROM thin_days) AS thin
  FROM nb WINDOW r AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {WINDOW - 2} PRECEDING AND CURRENT ROW)),
en AS (SELECT symbol, rn, ts, close AS entry, round({PROFIT} * vol, 6) AS profit, round({STOP} * vol, 6) AS stop, g, CASE WHEN g > 0 THEN 'long' ELSE 'short' END AS direction FROM vb, (VALUES (1), (-1)) s(g) WHERE close > 0),
fw AS (SELECT e.*, b.rn - e.rn AS k, b.ts AS bts, g * b.open AS o, CASE WHEN g > 0 THEN b.high ELSE -b.low END AS far, CASE WHEN g > 0 THEN b.low ELSE -b.high END AS near, b.close AS c, b.event, b.thin,
  max(CASE WHEN g > 0 THEN b.high ELSE -b.low END) OVER (PARTITION BY e.symbol, e.rn, g ORDER BY b.rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS peak
  FROM en e JOIN vb b ON b.symbol = e.symbol AND b.rn > e.rn AND b.rn <= e.rn + {HORIZON}),
ex AS (SELECT *, greatest(coalesce(peak, g * entry), g * entry) AS ext, g * entry * (1 + g * profit) AS target, g * entry * (1 - g * stop) AS fixed FROM fw),
tr AS (SELECT *, (ext - g * entry) / entry >= {ACTIVE} * profit AS trails FROM ex),
st AS (SELECT *, CASE WHEN trails THEN greatest(fixed, ext * (1 - g * {TRAIL} * profit)) ELSE fixed END AS at_ FROM tr),
hit AS (SELECT *, CASE WHEN o >= target AND o <= at_ THEN 1 WHEN o >= target THEN 2 WHEN o <= at_ THEN 3 WHEN far >= target AND near <= at_ THEN 4 WHEN far >= target THEN 5 WHEN near <= at_ THEN 6 WHEN event THEN 7 WHEN thin THEN 8 END AS h FROM st),
one AS (SELECT symbol, rn, g, min_by(h, k) FILTER (h IS NOT NULL) AS h, min(k) FILTER (h IS NOT NULL) AS k, min_by(bts, k) FILTER (h IS NOT NULL) AS ets, min_by(trails, k) FILTER (h IS NOT NULL) AS trails,
  min_by(CASE h WHEN 1 THEN g * o WHEN 2 THEN g * target WHEN 5 THEN g * target WHEN 7 THEN c WHEN 8 THEN c ELSE g * at_ END, k) FILTER (h IS NOT NULL) AS price, max_by(c, k) AS last, max_by(bts, k) AS lts, count(*) AS n FROM hit GROUP BY symbol, rn, g),
al AS (SELECT e.*, o.h, coalesce(o.ets, o.lts, e.ts) AS exit_ts, coalesce(o.price, o.last, e.entry) AS price, CAST(coalesce(o.k, o.n, 0) AS INTEGER) AS held,
  CASE WHEN h IN (1, 4) THEN 'stop' WHEN h IN (2, 5) THEN 'profit_target' WHEN h IN (3, 6) THEN CASE WHEN o.trails THEN 'trailing_stop' ELSE 'stop' END WHEN h = 7 THEN 'event_barrier' WHEN h = 8 THEN 'liquidity_barrier' WHEN coalesce(o.n, 0) < {HORIZON} THEN 'insufficient_data' ELSE 'max_holding_time' END AS reason
  FROM en e LEFT JOIN one o ON o.symbol = e.symbol AND o.rn = e.rn AND o.g = e.g)
SELECT symbol, ts, direction, profit AS profit_target_pct, stop AS stop_pct, exit_ts, round(price, 4) AS exit_price, reason AS exit_reason, round(g * (price - entry) / entry * 100, 4) + 0.0 AS exit_return_pct,
  CASE reason WHEN 'profit_target' THEN 'win' WHEN 'stop' THEN 'loss' WHEN 'max_holding_time' THEN 'timeout' WHEN 'insufficient_data' THEN 'timeout' ELSE CASE WHEN round(g * (price - entry) / entry * 100, 4) > 0 THEN 'partial_success' ELSE 'loss' END END AS label,
  CASE WHEN reason = 'insufficient_data' THEN 0.1 ELSE round(1.0 - CASE WHEN h IN (1, 2, 3) THEN 0.3 ELSE 0 END - CASE WHEN h IN (1, 4) THEN 0.4 ELSE 0 END - CASE WHEN reason = 'max_holding_time' THEN 0.2 ELSE 0 END, 4) END::DOUBLE AS label_quality,
  held AS bars_held, coalesce(h IN (1, 2, 3), false) AS gap, coalesce(h IN (1, 4), false) AS ambiguous FROM al"""


def oracle_sql() -> dict[str, str]:
    return {"y03_barrier_labels": _oracle(), "y06_barrier_dates": Operator("", "", DAYS, FEEDS).oracle()}
