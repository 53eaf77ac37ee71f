"""Streaming forms: ticks to bars with a watermark, counter volumes and beliefs with state, upserts, bus dedup.

The batch functions of :mod:`tidewater.operators` define the results; here each gets a stream in and a stream out, and
late rows beyond the watermark drop. State is keyed by symbol and expires with the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SESSION_OFFSET = {1: 0, 3: 0, 5: 0, 15: 0, 30: 15, 60: 45}


def timed(df: DataFrame, col: str = "ts") -> DataFrame:
    """Event time as an instant: watermarks don't take times without a zone."""
    return df.withColumn(col, F.col(col).cast("timestamp")) if df.schema[col].dataType.typeName() == "timestamp_ntz" else df


def bars(ticks: DataFrame, minutes: int = 1, late: str = "10 minutes") -> DataFrame:
    """symbol, ts, open, high, low, close, volume from ticks (symbol, ts, ltp), one row per closed bar."""
    w = F.window("ts", f"{minutes} minutes", startTime=f"{SESSION_OFFSET.get(minutes, 0)} minutes")
    t = timed(ticks).where("ltp IS NOT NULL").withWatermark("ts", late).groupBy("symbol", w)
    agg = t.agg(F.min_by("ltp", "ts").alias("open"), F.max("ltp").alias("high"), F.min("ltp").alias("low"), F.max_by("ltp", "ts").alias("close"), F.count("*").alias("volume"))
    return agg.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def counter_volume(ticks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Volume between a cumulative counter's readings (symbol, ts, cum): max(0, rise since the last one seen)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for rows in batches:
            out = []
            for ts, cum in rows.sort_values("ts")[["ts", "cum"]].itertuples(index=False):
                if pd.isna(cum):
                    out.append((key[0], ts, 0))
                    continue
                out.append((key[0], ts, max(0, int(cum) - last) if last is not None else 0))
                last = int(cum)
            yield pd.DataFrame(out, columns=["symbol", "ts", "volume"])
        if last is not None:
            state.update((last,))

    t = timed(ticks).withWatermark("ts", late).groupBy("symbol")
    return t.applyInPandasWithState(step, "symbol string, ts timestamp, volume long", "last long", "append", GroupStateTimeout.NoTimeout)


def beliefs(evidence: DataFrame, weight: float = 0.3) -> DataFrame:
    """Running belief per symbol from evidence (symbol, ts, likelihood): (1 - w) prior + w likelihood."""
    w = min(0.9, max(0.1, weight))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        p, n = state.get if state.exists else (0.5, 0)
        for rows in batches:
            for x in rows.sort_values("ts")["likelihood"]:
                p, n = (1 - w) * p + w * float(x), n + 1
        state.update((p, n))
        yield pd.DataFrame([(key[0], p, n)], columns=["symbol", "belief", "updates"])

    return timed(evidence).groupBy("symbol").applyInPandasWithState(step, "symbol string, belief double, updates long", "p double, n long", "update", GroupStateTimeout.NoTimeout)


def lifecycle(log: DataFrame) -> DataFrame:
    """Current stage per lifecycle id from an append-only log (id, seq, stage); repeats of a stage change nothing."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stage, moves = state.get if state.exists else ("", 0)
        for rows in batches:
            for s in rows.sort_values("seq")["stage"]:
                if s != stage:
                    stage, moves = s, moves + 1
        state.update((stage, moves))
        yield pd.DataFrame([(key[0], stage, moves)], columns=["id", "stage", "moves"])

    return log.groupBy("id").applyInPandasWithState(step, "id long, stage string, moves long", "stage string, moves long", "update", GroupStateTimeout.NoTimeout)


def deduplicated(bus: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Bus messages once by id within the watermark (event_id, ts, ...)."""
    return timed(bus).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def upsert_into(path: str, keys: list[str]):
    """A ``foreachBatch`` writer: the newest batch's row replaces a stored row of equal keys."""

    def write(batch: DataFrame, batch_id: int) -> None:
        from tidewater.sources.sinks import upsert

        upsert(batch, path, keys)

    return write
