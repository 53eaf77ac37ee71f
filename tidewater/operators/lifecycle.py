"""Lifecycles from an append-only log: what each row does is a table from stage to stage, and tables compose.

A lifecycle's log is dealt into blocks of its sequence numbers. A block folds its rows into one table (where it would end from
every stage it might start in), so blocks are read apart from each other; composing the tables in order gives the
stage that each block really starts in, and a second fold within the block judges every row. One hot lifecycle spreads over tasks.

A row repeats (the stage is the present one: ignored), applies, or is rejected, which leaves the stage as it was and names the
rule. Rows of one sequence number are taken in order of time, then stage. A null stage is an unknown one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.plans.dialect import Operator
from tidewater.session import cut

# The stages that follow each other, those that end, and what a lifecycle starts with
OPEN = ["detected", "confirmed", "qualified", "sent", "monitoring"]
CLOSED = ["expired", "succeeded", "failed"]
STAGES = ["none", *OPEN, *CLOSED]
#: What a row asks for: a stage, an expiry without a reason, or something unknown.
ASKS = [*OPEN, *CLOSED, "expired_unexplained", "unknown"]
BLOCK = 256


def step(stage: str, ask: str) -> tuple[str, str]:
    """(the stage afterwards, what became of the row)."""
    if stage == ask or (stage == "expired" and ask == "expired_unexplained"):
        return stage, "repeated"
    if stage == "none":
        return ("detected", "applied") if ask == "detected" else (stage, "starts_late")
    if stage in CLOSED:
        return stage, "already_closed"
    if ask in CLOSED:
        return ask, "applied"
    if ask == "expired_unexplained":
        return stage, "no_reason"
    if ask == "unknown":
        return stage, "unknown_stage"
    return (ask, "applied") if OPEN.index(ask) == OPEN.index(stage) + 1 else (stage, "out_of_order")


def _table(part: int) -> Column:
    """Flat table of stages by asks: numbers of the stages afterwards (part 0), or what became of the row (part 1)."""
    made = [step(s, a)[part] for s in STAGES for a in ASKS]
    return F.array(*[F.lit(STAGES.index(v)) if part == 0 else F.lit(v) for v in made])


def _after(stage: Column, ask: Column, part: int) -> Column:
    return F.get(_table(part), stage * len(ASKS) + ask)


def judged(log: DataFrame, block: int = BLOCK) -> DataFrame:
    """lifecycle_id, seq, at, stage, reason, outcome, before, verdict: every row with the stage that it met. ``log``: the first six."""
    known = F.coalesce("stage", F.lit(""))
    ask = F.when((known == "expired") & F.col("reason").isNull(), F.lit(ASKS.index("expired_unexplained"))).otherwise(
        F.coalesce(F.when(known.isin(*OPEN, *CLOSED), F.array_position(F.array(*[F.lit(a) for a in ASKS]), known).cast("int") - 1), F.lit(ASKS.index("unknown")))
    )
    rows = log.select("lifecycle_id", F.floor(F.col("seq") / block).alias("_block"), F.struct("seq", "at", known.alias("known"), "stage", "reason", "outcome", ask.alias("ask")).alias("_row"))
    blocks = cut(rows.groupBy("lifecycle_id", "_block").agg(F.array_sort(F.collect_list("_row")).alias("rows")))
    same = F.array(*[F.lit(k) for k in range(len(STAGES))])
    ends = blocks.select("lifecycle_id", "_block", F.aggregate("rows", same, lambda t, r: F.transform(t, lambda s: _after(s, r["ask"], 0))).alias("ends"))

    def run(own: pd.DataFrame) -> pd.DataFrame:  # one small table a block
        own = own.sort_values("_block")
        at, starts = 0, []
        for t in own["ends"]:
            starts.append(at)
            at = int(t[at])
        return pd.DataFrame({"lifecycle_id": own["lifecycle_id"], "_block": own["_block"], "start": starts})

    kind = log.schema["lifecycle_id"].dataType.simpleString()
    starts = ends.groupBy("lifecycle_id").applyInPandas(run, f"lifecycle_id {kind}, _block long, start int")
    grown = F.struct(F.col("start").alias("at"), F.array().cast("array<int>").alias("met"))
    met = F.aggregate("rows", grown, lambda s, r: F.struct(_after(s["at"], r["ask"], 0).alias("at"), F.concat(s["met"], F.array(s["at"])).alias("met")))["met"]
    walked = blocks.join(starts, ["lifecycle_id", "_block"]).select("lifecycle_id", "rows", met.alias("met"))
    each = walked.select("lifecycle_id", F.explode(F.arrays_zip("rows", "met")).alias("z"))
    stage = F.get(F.array(*[F.lit(s) for s in STAGES]), F.col("z.met"))
    return each.select("lifecycle_id", "z.rows.seq", "z.rows.at", "z.rows.stage", "z.rows.reason", "z.rows.outcome", stage.alias("before"), _after(F.col("z.met"), F.col("z.rows.ask"), 1).alias("verdict"))


def states(rows: DataFrame) -> DataFrame:
    """One row a lifecycle from judged rows: its stage, how rows fared, delay and lifetime in seconds, reason and outcome."""
    done = F.col("verdict") == "applied"
    closes = done & F.col("stage").isin(*CLOSED)
    when = lambda s: F.min(F.when(done & (F.col("stage") == s), F.unix_timestamp("at")))
    order = F.struct("seq", "at", "stage")
    a = rows.groupBy("lifecycle_id").agg(
        F.coalesce(F.max_by("stage", F.when(done, order)), F.lit("none")).alias("stage"), F.sum(done.cast("long")).alias("applied"), F.sum((F.col("verdict") == "repeated").cast("long")).alias("repeated"),
        F.sum((~F.col("verdict").isin("applied", "repeated")).cast("long")).alias("rejected"), when("detected").alias("_detected"), when("confirmed").alias("_confirmed"),
        F.min(F.when(closes, F.unix_timestamp("at"))).alias("_closed"), F.max(F.when(done & (F.col("stage") == "expired"), F.col("reason"))).alias("expiration_reason"),
        F.max(F.when(done & F.col("stage").isin("succeeded", "failed"), F.coalesce("outcome", "stage"))).alias("outcome"),
    )
    return a.select("lifecycle_id", "stage", "applied", "repeated", "rejected", (F.col("_confirmed") - F.col("_detected")).alias("detection_delay"), (F.col("_closed") - F.col("_detected")).alias("lifetime"), "expiration_reason", "outcome")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("verdict").isin("applied", "repeated")).select("lifecycle_id", "seq", "stage", "before", F.col("verdict").alias("rule"))


#: A log of the provided tables: each user's events as the transitions that were asked for.
LOG = """SELECT user_id AS lifecycle_id, event_id AS seq, ts AS at,
  CASE event_type WHEN 'view' THEN 'detected' WHEN 'click' THEN 'confirmed' WHEN 'signup' THEN 'qualified' WHEN 'purchase' THEN CASE WHEN value > 20 THEN 'monitoring' ELSE 'sent' END
    ELSE CASE WHEN value < 30 THEN 'lost' WHEN event_id % 3 = 0 THEN 'expired' WHEN event_id % 3 = 1 THEN 'succeeded' ELSE 'failed' END END AS stage,
  CASE WHEN event_id % 2 = 0 THEN 'timeout' END AS reason, CASE WHEN event_id % 4 = 1 THEN 'target' END AS outcome FROM {events}"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(Operator("", "", LOG).run(spark, sf_dir))


QUERIES = {
    "z15_lifecycle_states": lambda spark, d: states(_judged(spark, d)),
    "z15_rejected_rows": lambda spark, d: rejected(_judged(spark, d)),
}


def _oracle(then: str) -> str:
    """The log walked row by row."""
    log = Operator("", "", LOG).oracle()
    nxt = "CASE w.stage " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in zip(["none", *OPEN], OPEN)) + " END"
    closed = ", ".join(f"'{s}'" for s in CLOSED)
    return f"""WITH RECURSIVE lg AS ({log}),
nu AS (SELECT *, row_number() OVER (PARTITION BY lifecycle_id ORDER BY seq, "at", stage) AS k FROM lg),
w AS (
  SELECT lifecycle_id, CAST(0 AS BIGINT) AS k, 'none' AS stage, 'none' AS before, CAST(NULL AS VARCHAR) AS verdict FROM nu WHERE k = 1
  UNION ALL
  SELECT lifecycle_id, k, CASE WHEN verdict = 'applied' THEN asked ELSE before END, before, verdict FROM (
    SELECT n.lifecycle_id, n.k, n.stage AS asked, w.stage AS before,
      CASE WHEN n.stage = w.stage THEN 'repeated' WHEN w.stage = 'none' AND n.stage <> 'detected' THEN 'starts_late' WHEN w.stage IN ({closed}) THEN 'already_closed'
           WHEN n.stage = 'expired' AND n.reason IS NULL THEN 'no_reason' WHEN n.stage IN ({closed}) THEN 'applied' WHEN n.stage NOT IN ({", ".join(f"'{s}'" for s in OPEN)}) THEN 'unknown_stage'
           WHEN n.stage = {nxt} THEN 'applied' ELSE 'out_of_order' END AS verdict
    FROM w JOIN nu n ON n.lifecycle_id = w.lifecycle_id AND n.k = w.k + 1) q),
jd AS (SELECT n.*, w.before, w.verdict FROM w JOIN nu n USING (lifecycle_id, k) WHERE w.k > 0)
{then}"""


def oracle_sql() -> dict[str, str]:
    when = lambda s: f"min(CASE WHEN verdict = 'applied' AND stage {s} THEN CAST(floor(epoch(\"at\")) AS BIGINT) END)"
    ends = "IN (" + ", ".join(f"'{s}'" for s in CLOSED) + ")"
    return {
        "z15_rejected_rows": _oracle("SELECT lifecycle_id, seq, stage, before, verdict AS rule FROM jd WHERE verdict NOT IN ('applied', 'repeated')"),
        "z15_lifecycle_states": _oracle(f"""SELECT lifecycle_id, coalesce(arg_max(stage, k) FILTER (verdict = 'applied'), 'none') AS stage, count(*) FILTER (verdict = 'applied') AS applied, count(*) FILTER (verdict = 'repeated') AS repeated,
  count(*) FILTER (verdict NOT IN ('applied', 'repeated')) AS rejected, {when("= 'confirmed'")} - {when("= 'detected'")} AS detection_delay, {when(ends)} - {when("= 'detected'")} AS lifetime,
  max(reason) FILTER (verdict = 'applied' AND stage = 'expired') AS expiration_reason, max(coalesce(outcome, stage)) FILTER (verdict = 'applied' AND stage IN ('succeeded', 'failed')) AS outcome FROM jd GROUP BY lifecycle_id"""),
    }
