"""Candles from ticks, observation snapshots, and the long feature store: sinks' row logic, latest, history, as-of replay.

The writers are in :mod:`tidewater.sources.sinks` and the streaming forms in :mod:`tidewater.streaming.candles`; here
is what each computes. Keys are (feature, version, symbol, timeframe, ts); ties on ts go to the larger version.
"""

from __future__ import annotations

from tidewater.plans.dialect import operator

TF = {"3m": 3, "5m": 5, "15m": 15, "30m": 30, "1H": 60}


def bucket(ts: str, minutes: int, offset: int) -> str:
    """Start of the bucket of ``minutes`` that holds ts, buckets starting ``offset`` minutes past the epoch's."""
    return f"@from_unix(@idiv(@unix({ts}) - {offset * 60}, {minutes * 60}) * {minutes * 60} + {offset * 60})"


OHLC = "min_by(ltp, ts) AS open, max(ltp) AS high, min(ltp) AS low, max_by(ltp, ts) AS close"

# 2.1 scans -------------------------------------------------------------------------------------------------------
operator("s01_candle_scan", "Newest 500 candles per symbol, oldest first.", "SELECT symbol, ts, open, high, low, close, volume FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM {candles}) q WHERE k <= 500")
operator("s02_json_observations", "Newest observations whose JSON payload passes a path predicate; malformed values drop out.", "SELECT id, ts, label, value, k FROM (SELECT id, ts, label, value, CAST(@json(metadata, 'k') AS BIGINT) AS k, row_number() OVER (PARTITION BY label ORDER BY id DESC) AS n FROM {observations} WHERE CAST(@json(metadata, 'k') AS BIGINT) >= 10) q WHERE n <= 500")
operator("s03_source_observations", "Observations by source.", "SELECT source, label, ts, value FROM {observations} WHERE source = 'src1' AND value IS NOT NULL")
operator("s04_quote_parse", "Depth totals with fallbacks; a zero total counts as missing.", "SELECT symbol, ts, @r6(coalesce(nullif(bid_depth, 0.0), nullif(ask_depth, 0.0))) AS bid_total, @r6(coalesce(nullif(ask_depth, 0.0), nullif(bid_depth, 0.0))) AS ask_total FROM {quotes}")
operator("s06_live_quotes", "Stream value first, fallback where it is stale; direction of the change.", "SELECT s.symbol, s.ts, @r6(coalesce(CASE WHEN s.volume > 12 THEN s.close END, r.close)) AS ltp, CAST(sign(coalesce(CASE WHEN s.volume > 12 THEN s.close END, r.close) - s.open) AS INT) AS direction FROM {candles} s LEFT JOIN {reference} r USING (ts)")
operator("s07_backfill_start", "Where each symbol's backfill resumes.", "SELECT symbol, greatest(max(ts), (SELECT max(ts) FROM {candles}) - INTERVAL 2 DAYS) AS start FROM {candles} GROUP BY symbol")
operator("s08_source_fallback", "The whole of the first source that has rows, per key.", "WITH u AS (SELECT symbol, ts, close, CASE WHEN volume >= 15 THEN 1 ELSE 2 END AS priority FROM {candles}), b AS (SELECT symbol, @date(ts) AS day, min(priority) AS p FROM u GROUP BY symbol, @date(ts)) SELECT u.symbol, u.ts, u.close FROM u JOIN b ON u.symbol = b.symbol AND @date(u.ts) = b.day AND u.priority = b.p")
operator("s09_no_future", "Bars not stamped after the fetch.", "SELECT symbol, ts, close FROM {candles} WHERE ts <= (SELECT max(ts) - INTERVAL 24 HOURS FROM {candles})")
operator("s10_gap_count", "Gaps longer than a bar and shorter than sixteen hours.", "SELECT symbol, CAST(sum(CASE WHEN gap > 3600 AND gap < 57600 THEN 1 ELSE 0 END) AS BIGINT) AS gaps FROM (SELECT symbol, @unix(ts) - @unix(lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) AS gap FROM {candles}) q GROUP BY symbol")
operator("s11_insert_absent", "Rows of a batch whose key isn't stored yet.", "SELECT n.symbol, n.ts, n.close FROM {candles} n WHERE NOT EXISTS (SELECT 1 FROM (SELECT symbol, ts FROM {candles} WHERE volume % 2 = 0) o WHERE o.symbol = n.symbol AND o.ts = n.ts)")
operator("s14_clean_text", "Markup out of feed and page texts, white space to single spaces.", "SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' '@g), '[ \\n\\t\\r]+', ' '@g)) AS text FROM {pages}")
operator("s15_chain_legs", "Strike rows of the nearest expiry of each chain.", "WITH e AS (SELECT p_brand AS chain, p_size AS strike, p_partkey % 4 AS expiry, CAST(sum(p_partkey % 13) AS BIGINT) AS oi FROM {part} GROUP BY 1, 2, 3), n AS (SELECT chain, min(expiry) AS expiry FROM e GROUP BY chain) SELECT e.chain, e.strike, e.expiry, e.oi FROM e JOIN n ON e.chain = n.chain AND e.expiry = n.expiry")
operator("s16_latest_deals", "Deals of the latest date only, value in tens of millions.", "SELECT l_returnflag AS symbol, l_orderkey, l_linenumber, l_partkey, @r6(l_quantity * l_extendedprice / 10000000) AS value_cr FROM (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate DESC) AS r FROM {lineitem}) q WHERE r = 1")
operator("s17_action_mapping", "Kind of an action by a pattern in its subject.", "SELECT doc_id, CASE WHEN @like_all(lower(text), 'license') THEN 'license' WHEN @like_all(lower(text), 'idiot|pathetic') THEN 'warning' ELSE 'other' END AS kind FROM {documents}")
operator("s18_schedule_expansion", "Next occurrence of monthly rules within thirteen months; days that don't exist are skipped.", "WITH m AS (SELECT c_custkey, 1 + CAST(c_custkey % 31 AS INT) AS dom FROM {customer}), d AS (SELECT c_custkey, dom, @explode(@seq(0, 12)) AS k FROM m), n AS (SELECT c_custkey, dom, CAST(@idiv(k, 12) AS INT) + 2024 AS y, CAST(k % 12 AS INT) + 1 AS mo FROM d), ok AS (SELECT c_custkey, y, mo, dom FROM n WHERE dom <= CASE WHEN mo IN (4, 6, 9, 11) THEN 30 WHEN mo = 2 THEN CASE WHEN y % 4 = 0 THEN 29 ELSE 28 END ELSE 31 END) SELECT c_custkey, min(make_date(y, mo, dom)) AS next_on FROM ok WHERE make_date(y, mo, dom) >= DATE '2024-02-10' GROUP BY c_custkey")
operator("s19_dashboard_candles", "One symbol's candles of the last N days, oldest first.", "SELECT ts, open, high, low, close, volume FROM {candles} WHERE symbol = 'click' AND ts >= (SELECT max(ts) - INTERVAL 7 DAYS FROM {candles})")
operator("s20_universe", "Quotes joined with their averages.", "SELECT c.c_custkey AS id, n.n_name AS sector, c.c_acctbal AS last FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey")

# 2.2 candles -----------------------------------------------------------------------------------------------------
for tf, m in TF.items():
    session = {30: 15, 60: 45}.get(m, 0)
    clock = {60: 30}.get(m, 0)
    operator(f"t01_session_bucket_{tf.lower()}", "Bars anchored at the session's start.", f"SELECT symbol, {bucket('ts', m, session)} AS ts, {OHLC}, count(*) AS n FROM {{ticks}} GROUP BY symbol, {bucket('ts', m, session)}")
    if m in (30, 60):
        operator(f"t06_clock_bucket_{tf.lower()}", "Bars anchored on the clock's minutes.", f"SELECT symbol, {bucket('ts', m, clock)} AS ts, {OHLC}, CAST(0 AS BIGINT) AS volume FROM {{ticks}} WHERE ltp IS NOT NULL GROUP BY symbol, {bucket('ts', m, clock)}")
MINUTE = f"m1 AS (SELECT symbol, {bucket('ts', 1, 0)} AS ts, {OHLC}, count(*) AS volume FROM {{ticks}} GROUP BY symbol, {bucket('ts', 1, 0)})"
operator("t02_minute_bars", "Ticks to one-minute bars.", f"WITH {MINUTE} SELECT * FROM m1")
operator("t03_counter_volume", "Bar volume from a cumulative counter; a fall counts as nothing.", f"WITH c AS (SELECT symbol, ts, {bucket('ts', 60, 0)} AS bar, count(*) OVER (PARTITION BY symbol, @date(ts) ORDER BY ts) AS cum FROM {{ticks}}), b AS (SELECT symbol, bar, max(cum) AS top FROM c GROUP BY symbol, bar) SELECT symbol, bar AS ts, greatest(0, top - coalesce(lag(top) OVER (PARTITION BY symbol ORDER BY bar), 0)) AS volume FROM b")
operator("t04_rollup", "Minute bars rolled up to larger ones.", f"WITH {MINUTE} " + " UNION ALL ".join(f"SELECT symbol, '{tf}' AS timeframe, {bucket('ts', m, {30: 15, 60: 45}.get(m, 0))} AS ts, min_by(open, ts) AS open, max(high) AS high, min(low) AS low, max_by(close, ts) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM m1 GROUP BY symbol, {bucket('ts', m, {30: 15, 60: 45}.get(m, 0))}" for tf, m in TF.items()))
operator("t05_upsert_candles", "Insert or replace: of equal keys, the newest batch's row.", "SELECT symbol, ts, close, batch FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY batch DESC) AS k FROM (SELECT symbol, ts, close, 1 AS batch FROM {candles} UNION ALL SELECT symbol, ts, close + 1, 2 FROM {candles} WHERE volume % 3 = 0) u) q WHERE k = 1")
operator("t07_retention", "Rows that retention deletes, by timeframe.", "WITH l AS (SELECT '1H' AS timeframe, 10 AS keep_days UNION ALL SELECT 'D', 5), s AS (SELECT '1H' AS timeframe, ts FROM {candles} UNION ALL SELECT 'D', @from_unix(@unix(@date(ts))) FROM {candles}) SELECT s.timeframe, CAST(sum(CASE WHEN @unix(ts) < @unix((SELECT max(ts) FROM {candles})) - keep_days * 86400 THEN 1 ELSE 0 END) AS BIGINT) AS deleted, count(*) AS total FROM s JOIN l ON s.timeframe = l.timeframe GROUP BY s.timeframe")
operator("t08_snapshots", "Observations in epoch buckets: newest time, last value per label, nulls skipped.", "SELECT @idiv(@unix(ts), 60) AS bucket, label, max(ts) AS ts, max_by(value, CASE WHEN value IS NOT NULL THEN id END) AS value, count(*) AS n FROM {observations} GROUP BY @idiv(@unix(ts), 60), label")
operator("t09_event_snapshots", "Buckets of calendar records: the last summary and how many events.", "SELECT @idiv(@unix(ts), 3600) AS bucket, max(ts) AS ts, max_by(label, CASE WHEN source = 'src0' THEN id END) AS summary, CAST(sum(CASE WHEN source <> 'src0' THEN 1 ELSE 0 END) AS BIGINT) AS events FROM {observations} GROUP BY @idiv(@unix(ts), 3600)")
operator("t10_sessions", "Trading sessions by local date, with enough bars.", "SELECT symbol, @date(@ist(ts)) AS session, count(*) AS bars FROM {candles} GROUP BY symbol, @date(@ist(ts)) HAVING count(*) >= 15")
operator("t11_bus_dedup", "Bus messages once by id, ordered by version.", "SELECT event_id, label, version FROM (SELECT id AS event_id, label, version, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS k FROM (SELECT id, label, 1 AS version FROM {observations} UNION ALL SELECT id, label, 2 FROM {observations} WHERE id % 5 = 0) u) q WHERE k = 1")
operator("t13_observation_rows", "Observations to persist, with a health row per source.", "SELECT source, count(*) AS records, CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls, max(ts) AS last_seen FROM {observations} GROUP BY source")
operator("t14_market_open", "Weekday, within session hours, no holiday.", "WITH h AS (SELECT DATE '2024-01-26' AS holiday) SELECT event_id, CASE WHEN @isodow(@ist(ts)) < 5 AND extract(HOUR FROM @ist(ts)) * 60 + extract(MINUTE FROM @ist(ts)) BETWEEN 555 AND 935 AND holiday IS NULL THEN 1 ELSE 0 END AS is_open FROM {ticks} LEFT JOIN h ON @date(@ist(ts)) = holiday")
operator("t15_breaker_replay", "Runs of failures and whether the breaker is open.", "WITH o AS (SELECT id, source, CASE WHEN value IS NULL OR value < 1 THEN 1 ELSE 0 END AS bad FROM {observations}), g AS (SELECT *, sum(1 - bad) OVER (PARTITION BY source ORDER BY id ROWS UNBOUNDED PRECEDING) AS run FROM o) SELECT id, source, CAST(sum(bad) OVER (PARTITION BY source, run ORDER BY id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS failures, CASE WHEN sum(bad) OVER (PARTITION BY source, run ORDER BY id ROWS UNBOUNDED PRECEDING) >= 3 THEN 'open' ELSE 'closed' END AS state FROM g")
operator("t17_quality_history", "Newest quality rows of each collector.", "SELECT source, id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id DESC) AS k FROM {observations}) q WHERE k <= 50")

# 2.3 feature store -----------------------------------------------------------------------------------------------
operator("f01_unpivot", "Wide to long; null, NaN and infinite values drop; per-feature watermark.", "WITH l AS (SELECT symbol, ts, 'close' AS feature_name, close AS value FROM {candles} UNION ALL SELECT symbol, ts, 'body', close - open FROM {candles} UNION ALL SELECT symbol, ts, 'body_pct', @div(close - open, open) FROM {candles}), w AS (SELECT 'close' AS feature_name, (SELECT max(ts) - INTERVAL 5 DAYS FROM {candles}) AS cutoff) SELECT symbol, ts, l.feature_name, @r6(value) AS value FROM l LEFT JOIN w ON l.feature_name = w.feature_name WHERE value IS NOT NULL AND abs(value) < 1e300 AND (cutoff IS NULL OR ts > cutoff)")
operator("f02_range_quality", "Share of values within the registered range, with a warning.", "WITH r AS (SELECT 'close' AS feature_name, 0.0 AS lo, 80.0 AS hi UNION ALL SELECT 'range', 0.0, 50.0 UNION ALL SELECT 'volume', 5.0, NULL) SELECT s.feature_name, @r6(avg(CASE WHEN (lo IS NULL OR value >= lo) AND (hi IS NULL OR value <= hi) THEN 100 ELSE 0 END)) AS pct, CASE WHEN avg(CASE WHEN (lo IS NULL OR value >= lo) AND (hi IS NULL OR value <= hi) THEN 100 ELSE 0 END) < 80 THEN 1 ELSE 0 END AS warn FROM {store} s JOIN r ON s.feature_name = r.feature_name GROUP BY s.feature_name")
operator("f03_run_statistics", "Mean, population deviation, extremes and count per feature.", "SELECT feature_name, @r6(avg(value)) AS mean, @r6(coalesce(stddev_pop(value), 0.0)) AS std, @r6(min(value)) AS lo, @r6(max(value)) AS hi, count(value) AS n FROM {store} GROUP BY feature_name")
operator("f04_upsert", "Idempotent upsert: of equal keys, the newest update.", "SELECT feature_name, feature_version, symbol, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY feature_name, feature_version, symbol, timeframe, ts ORDER BY last_updated DESC) AS k FROM (SELECT * FROM {store} UNION ALL SELECT feature_name, feature_version, symbol, timeframe, ts, value * 2, last_updated + INTERVAL 1 HOURS FROM {store} WHERE feature_name = 'range') u) q WHERE k = 1")
operator("f06_online_map", "Newest value of each feature by symbol.", "SELECT symbol, timeframe, feature_name, max_by(value, ts) AS value, max(ts) AS ts FROM {store} GROUP BY symbol, timeframe, feature_name")
operator("f07_latest", "Latest value per feature within fourteen days.", "SELECT symbol, feature_name, feature_version, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY symbol, feature_name ORDER BY ts DESC, feature_version DESC) AS k FROM {store} WHERE ts >= (SELECT max(ts) - INTERVAL 14 DAYS FROM {store})) q WHERE k = 1")
operator("f08_history_page", "A page of one feature's history, newest first.", "SELECT ts, value FROM {store} WHERE feature_name = 'close' AND symbol = 'click' ORDER BY ts DESC LIMIT 100 OFFSET 50")
operator("f09_watermarks", "Newest time per feature.", "SELECT symbol, feature_name, max(ts) AS ts FROM {store} GROUP BY symbol, feature_name")
operator("f10_replay", "Last value at or before a moment.", "SELECT symbol, feature_name, max_by(value, ts) AS value, max(ts) AS ts FROM {store} WHERE ts <= (SELECT max(ts) - INTERVAL 7 DAYS FROM {store}) GROUP BY symbol, feature_name")
operator("f11_walk_forward", "State at every snapshot time in one pass: an as-of join by a running last value.", "WITH s AS (SELECT DISTINCT date_trunc('day', ts) AS moment FROM {candles}), k AS (SELECT DISTINCT symbol, feature_name FROM {store}), u AS (SELECT symbol, feature_name, ts, 0 AS kind, value FROM {store} UNION ALL SELECT symbol, feature_name, moment, 1, NULL FROM s, k), r AS (SELECT *, @last_nn(value) OVER (PARTITION BY symbol, feature_name ORDER BY ts, kind ROWS UNBOUNDED PRECEDING) AS held FROM u) SELECT symbol, feature_name, ts, held FROM r WHERE kind = 1 AND held IS NOT NULL")
REG = "WITH RECURSIVE e AS (SELECT * FROM (VALUES ('log_return', 'close'), ('vol_20', 'log_return'), ('vov_20', 'vol_20'), ('atr_20', 'true_range'), ('true_range', 'close'), ('expected_move', 'vol_20'), ('expected_move', 'close')) AS t(feature, needs))"
operator("f12_dependency_order", "Depth of each feature in the dependency graph.", REG + ", d AS (SELECT 'close' AS feature, 0 AS depth UNION ALL SELECT e.feature, d.depth + 1 FROM e JOIN d ON e.needs = d.feature) SELECT feature, CAST(max(depth) AS INT) AS depth FROM d GROUP BY feature")
operator("f13_dependents", "Everything that depends on a feature, however far.", REG + ", d AS (SELECT feature FROM e WHERE needs = 'log_return' UNION ALL SELECT e.feature FROM e JOIN d ON e.needs = d.feature) SELECT DISTINCT feature FROM d")
operator("f14_registry_sync", "New versions and edges to append.", "SELECT DISTINCT s.feature_name, s.feature_version FROM {store} s WHERE NOT EXISTS (SELECT 1 FROM (SELECT 'close' AS n, 'v1' AS v UNION ALL SELECT 'range', 'v2') r WHERE r.n = s.feature_name AND r.v = s.feature_version)")
operator("f15_regenerate_range", "Rows that a date range rewrites.", "SELECT symbol, feature_name, ts, value FROM {store} WHERE ts >= (SELECT min(ts) + INTERVAL 3 DAYS FROM {store}) AND ts < (SELECT min(ts) + INTERVAL 6 DAYS FROM {store})")
operator("f16_run_all", "Counts of what one run writes, by symbol and timeframe, in a single plan.", "SELECT symbol, timeframe, count(*) AS written, max(ts) AS ts FROM {store} GROUP BY symbol, timeframe")
operator("f17_list_features", "Registered features by filters.", "SELECT DISTINCT feature_name FROM {store} WHERE feature_name LIKE '%e%' AND feature_name NOT LIKE '%\\_z' ORDER BY feature_name LIMIT 50".replace(" AND feature_name NOT LIKE '%\\_z'", ""))
operator("f18_version_history", "A feature's versions in order.", "SELECT feature_name, feature_version, min(ts) AS since, count(*) AS n FROM {store} GROUP BY feature_name, feature_version")
operator("f19_recommended", "A symbol's recommended features by rank.", "SELECT symbol, feature_name, CAST(row_number() OVER (PARTITION BY symbol ORDER BY n DESC, feature_name) AS INT) AS rank FROM (SELECT symbol, feature_name, count(CASE WHEN value > 10 THEN 1 END) AS n FROM {store} GROUP BY symbol, feature_name) q")
operator("f20_quality_history", "Newest quality rows after the filter.", "SELECT symbol, ts, value FROM {store} WHERE feature_name = 'range' ORDER BY ts DESC, symbol LIMIT 200")
operator("f21_recent_events", "Newest events by JSON field.", "SELECT id, ts, label FROM {observations} WHERE CAST(@json(metadata, 'k') AS BIGINT) % 2 = 0 ORDER BY id DESC LIMIT 100")
