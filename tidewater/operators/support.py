"""Supporting readers and helpers that the other operators rely on."""

from __future__ import annotations

from tidewater.operators.rolling import BARS, P, cols, over
from tidewater.operators.snapshots import BS, CHAIN
from tidewater.operators.statistics import BIN, EDGES, LONG, MATRIX, SPLIT
from tidewater.plans.dialect import operator

operator("h02_epoch_prices", "Epoch and price arrays to ticks; nulls skipped.", "SELECT symbol, @unix(ts) AS epoch, ltp FROM {ticks} WHERE ltp IS NOT NULL")
operator("h04_concatenated_feeds", "Many feeds in one.", "SELECT 'a' AS feed, id, label FROM {observations} WHERE source = 'src0' UNION ALL SELECT 'b', id, label FROM {observations} WHERE source = 'src1'")
operator("h06_best_quote", "Best bid and ask.", "SELECT symbol, ts, @r6(bid) AS bid, @r6(ask) AS ask FROM {quotes} WHERE bid > 0 AND ask > 0")
operator("h07_enrich_legs", "Legs enriched by (strike, side); absent ones stay null.", f"WITH {CHAIN}, g AS (SELECT chain, strike, iv / 10 AS delta FROM c WHERE strike % 2 = 0) SELECT c.chain, c.strike, c.call_oi, @r6(g.delta) AS delta FROM c LEFT JOIN g ON c.chain = g.chain AND c.strike = g.strike")
operator("h08_instrument_resolution", "First spelling wins for a name.", "SELECT key, id FROM (SELECT substr(p_name, 1, 6) AS key, p_partkey AS id, row_number() OVER (PARTITION BY substr(p_name, 1, 6) ORDER BY p_partkey) AS k FROM {part}) q WHERE k = 1")
operator("h09_exchange_routing", "Exchange by set membership.", "SELECT p_partkey, CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN 'bse' ELSE 'nse' END AS exchange FROM {part}")
operator("h10_nearest_expiry", "Nearest expiry as a date.", "SELECT o_orderpriority AS code, min(@date(o_orderdate)) AS expiry FROM {orders} WHERE o_orderdate >= (SELECT min(o_orderdate) + INTERVAL 100 DAYS FROM {orders}) GROUP BY o_orderpriority")
operator("h11_leg_terms", "Terms of each leg's computed sensitivities.", f"WITH {BS} SELECT id, @r6(d1) AS d1, @r6(d2) AS d2, @r6(t) AS years FROM k")
operator("h12_previous_close", "Second newest bar's close.", "SELECT symbol, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM {candles}) q WHERE k = 2")
operator("h13_category_rows", "Last row of each category prefix.", "SELECT substr(o_orderpriority, 1, 1) AS category, max_by(o_orderstatus, o_orderkey) AS status FROM {orders} GROUP BY substr(o_orderpriority, 1, 1)")
operator("h14_today_count", "Today's count, else a seventh of the week's.", "WITH t AS (SELECT label, max(@date(ts)) AS today FROM {observations} GROUP BY label) SELECT o.label, CASE WHEN sum(CASE WHEN @date(ts) = today AND value > 90 THEN 1 ELSE 0 END) > 0 THEN CAST(sum(CASE WHEN @date(ts) = today AND value > 90 THEN 1 ELSE 0 END) AS BIGINT) ELSE CAST(@idiv(count(*), 7) AS BIGINT) END AS n FROM {observations} o JOIN t ON o.label = t.label GROUP BY o.label")
operator("h15_signed_totals", "Totals signed by a flag in a text.", "SELECT c_mktsegment AS segment, @r6(sum(CASE WHEN c_name LIKE '%1%' THEN c_acctbal ELSE -c_acctbal END)) AS net FROM {customer} GROUP BY c_mktsegment")
operator("h16_deal_totals", "Net and gross totals of deals, signed by side.", "SELECT l_returnflag AS symbol, @r6(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE -l_quantity END)) AS net, @r6(sum(abs(l_quantity))) AS gross FROM {lineitem} GROUP BY l_returnflag")
operator("h17_flow_score", "Clamped ratio of today's flow to its average.", f"SELECT symbol, ts, @r6(least(1.0, greatest(-1.0, @div(close - open, greatest(1.0, avg(abs(close - open)) {over(20)}))))) AS flow_score FROM {{candles}}")
operator("h18_data_age", "Age in days, never negative.", "SELECT o_orderpriority AS code, CAST(greatest(0, @days((SELECT max(o_orderdate) FROM {orders}), max(o_orderdate))) AS INT) AS age FROM {orders} GROUP BY o_orderpriority")
operator("h20_event_summary", "One record of all events: count, capped reduction, strongest impact.", "SELECT @date(ts) AS day, count(*) AS n, @r6(least(1.0, sum(CASE WHEN event_type = 'error' THEN 0.01 ELSE 0.0 END))) AS reduction, max(event_type) AS impact FROM {events} GROUP BY @date(ts)")
operator("h21_direction", "Direction with a neutral band.", "SELECT symbol, ts, CASE WHEN @div(close - open, open) > 0.05 THEN 'up' WHEN @div(close - open, open) < -0.05 THEN 'down' ELSE 'neutral' END AS direction FROM {candles}")
operator("h22_restored_ad_line", "Last cumulative line of the log.", "SELECT label, max_by(value, id) AS last_value FROM {observations} WHERE value IS NOT NULL GROUP BY label")
operator("h23_chain_rows", "Typed legs in strike order; missing counts are zero.", f"WITH {CHAIN} SELECT chain, strike, CAST(coalesce(call_oi, 0) AS BIGINT) AS call_oi, CAST(coalesce(put_oi, 0) AS BIGINT) AS put_oi FROM c")
operator("h24_pcr_bands", "Ratio with its direction bands.", f"WITH {CHAIN}, p AS (SELECT chain, @div(sum(put_oi), sum(call_oi)) AS pcr FROM c GROUP BY chain) SELECT chain, CASE WHEN pcr > 1.2 THEN 'bullish' WHEN pcr < 0.8 THEN 'bearish' ELSE 'neutral' END AS direction FROM p")
operator("h25_writing_intensity", "Writing intensity of each chain.", f"WITH {CHAIN} SELECT chain, @r6(@div(sum(greatest(oi_change, 0)), sum(call_oi))) AS intensity FROM c GROUP BY chain")
operator("h26_backfill_gate", "Symbols with too few stored bars.", "SELECT symbol, count(*) AS bars, CASE WHEN count(*) < 200 THEN 1 ELSE 0 END AS backfill FROM {candles} GROUP BY symbol")
operator("h28_volume_history", "Largest volume of each prior day.", "SELECT symbol, @date(ts) AS day, max(volume) AS volume FROM {candles} GROUP BY symbol, @date(ts)")
operator("h31_duplicate_share", "Share of repeated (label, hour, value) rows.", "SELECT label, @r6(avg(CASE WHEN k > 1 THEN 1 ELSE 0 END)) AS duplicates FROM (SELECT label, row_number() OVER (PARTITION BY label, date_trunc('hour', ts), CAST(floor(value / 10) AS INT) ORDER BY id) AS k FROM {observations}) q GROUP BY label")
operator("h32_scaled_confidence", "Confidence scaled by a quality multiplier.", "SELECT id, @r6(least(1.0, coalesce(value, 0) / 100) * CASE source WHEN 'src0' THEN 1.0 WHEN 'src1' THEN 0.8 ELSE 0.5 END) AS confidence FROM {observations}")
operator("h33_quality_group", "Last 500 rows of each feature.", f"WITH {SPLIT} SELECT symbol, feature_name, count(*) AS n, min(ts) AS since FROM v GROUP BY symbol, feature_name")
operator("h34_freshness", "Full inside the allowance, linear to zero at five times it.", "SELECT symbol, @r6(least(1.0, greatest(0.0, 1 - @div(@unix((SELECT max(ts) FROM {ticks})) - @unix(max(ts)) - 600, 2400))) * 100) AS freshness FROM {ticks} GROUP BY symbol")
operator("h35_equal_mass_histogram", "Counts in equal-mass bins; the first matching edge decides.", f"WITH {SPLIT}, {EDGES.replace('{w}', 'recent = 0')}, b AS (SELECT v.symbol, v.feature_name, {BIN} AS bin FROM v JOIN e ON v.symbol = e.symbol AND v.feature_name = e.feature_name) SELECT symbol, feature_name, CAST(bin AS INT) AS bin, count(*) AS n FROM b GROUP BY symbol, feature_name, bin")
operator("h36_pearson", "Correlation with the target; zero on no variance.", f"WITH {MATRIX}, {LONG} SELECT symbol, feature, @r6(coalesce(covar_pop(v, fr) / nullif(sqrt(var_pop(v) * var_pop(fr)), 0.0), 0.0)) AS r FROM l GROUP BY symbol, feature")
operator("h41_earnings_season", "Is a day in an earnings season?", "SELECT DISTINCT @date(o_orderdate) AS day, CASE WHEN extract(MONTH FROM o_orderdate) * 100 + extract(DAY FROM o_orderdate) BETWEEN 110 AND 220 THEN 1 ELSE 0 END AS in_season FROM {orders}")
operator("h43_daily_series", "Newest value of each local date.", "SELECT symbol, @date(@ist(ts)) AS day, max_by(close, ts) AS close FROM {candles} GROUP BY symbol, @date(@ist(ts))")
operator("h44_latest_value", "Newest value of a rolling series that isn't null.", f"WITH {BARS.strip()} SELECT symbol, @r6(max_by(delta, CASE WHEN delta IS NOT NULL THEN ts END)) AS latest FROM rets GROUP BY symbol")
operator("h46_belief_maturity", "Maturity and confidence of beliefs.", "SELECT label, @r6(least(1.0, @div(count(*), 20))) AS maturity, @r6(0.5 * avg(coalesce(value, 0)) / 100 + 0.5 * least(1.0, @div(count(*), 20))) AS confidence FROM {observations} GROUP BY label")
operator("h47_grades", "Grades of scores.", "SELECT id, CASE WHEN value >= 80 THEN 'A' WHEN value >= 65 THEN 'B' WHEN value >= 50 THEN 'C' WHEN value >= 35 THEN 'D' ELSE 'E' END AS grade FROM {observations} WHERE value IS NOT NULL")
operator("h48_score_history", "Twenty newest scores, oldest first.", "SELECT label, id, value FROM (SELECT label, id, value, row_number() OVER (PARTITION BY label ORDER BY id DESC) AS k FROM {observations}) q WHERE k <= 20")
operator("h49_component_summary", "Summary with an availability flag.", "SELECT label, count(value) AS n, CASE WHEN count(value) > 0 THEN 1 ELSE 0 END AS available, @r6(avg(value)) AS score FROM {observations} GROUP BY label")
operator("h50_breach_price", "Breach price by side.", "SELECT symbol, ts, @r6(CASE WHEN close > open THEN low ELSE high END) AS breach FROM {candles}")
operator("h55_logit", "Logit and sigmoid with clipping.", "SELECT doc_id, @r6(ln(p / (1 - p))) AS logit FROM (SELECT doc_id, least(CAST(0.999999 AS DOUBLE), greatest(CAST(0.000001 AS DOUBLE), @div(doc_id % 101, 100))) AS p FROM {labels}) q")
operator("h60_agreement_level", "Band of a model's direction.", "SELECT doc_id, CASE WHEN @div(doc_id % 101, 100) > 0.55 THEN 'up' WHEN @div(doc_id % 101, 100) < 0.45 THEN 'down' ELSE 'flat' END AS direction FROM {labels}")
operator("h61_horizon_minutes", "Minutes to the end of the session, at least one.", "SELECT event_id, CAST(greatest(1, 930 - greatest(555, extract(HOUR FROM @ist(ts)) * 60 + extract(MINUTE FROM @ist(ts)))) AS BIGINT) AS minutes FROM {ticks}")
operator("h62_return_percentiles", "Percentile distribution of returns.", f"WITH {BARS.strip()} SELECT symbol, " + cols({f"p{q}": f"@pct(sr, {q / 100})" for q in (10, 25, 50, 75, 90)}) + " FROM rets GROUP BY symbol")
operator("h63_quality_mappings", "Direct, inverted and centred mappings of scores.", "SELECT id, @r6(value / 100) AS direct, @r6(1 - value / 100) AS inverted, @r6(abs(value - 50) / 50) AS centred FROM {observations} WHERE value IS NOT NULL")
operator("h64_directional_score", "Score mirrored for shorts.", "SELECT symbol, ts, @r6(CASE WHEN close < open THEN 100 - close ELSE close END) AS score FROM {candles}")
operator("h70_repeat_test", "Was there a same-direction row of the symbol within sixty minutes before?", "WITH d AS (SELECT symbol, ts, CASE WHEN close > open THEN 'long' ELSE 'short' END AS dir FROM {candles}) SELECT symbol, ts, CASE WHEN lag(ts) OVER (PARTITION BY symbol, dir ORDER BY ts) >= ts - INTERVAL 60 MINUTES THEN 1 ELSE 0 END AS repeated FROM d")
operator("h71_breakout_reason", "Does a reason name a phrase?", "SELECT doc_id, CASE WHEN lower(text) LIKE '%license%' THEN 1 ELSE 0 END AS named FROM {documents}")
operator("h72_lifecycle_stages", "Stages without repeats, in order.", "SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM {conversations}) q WHERE before IS NULL OR before <> role")
operator("h74_signal_since", "Since when a candidate's direction has held.", f"WITH d AS (SELECT symbol, ts, CASE WHEN close > open THEN 1 ELSE 0 END AS up FROM {{candles}}), f AS (SELECT *, CASE WHEN lag(up) OVER ({P}) = up THEN 0 ELSE 1 END AS turn FROM d), g AS (SELECT *, sum(turn) OVER ({P} ROWS UNBOUNDED PRECEDING) AS run FROM f) SELECT symbol, ts, min(ts) OVER (PARTITION BY symbol, run) AS since FROM g")
operator("h76_snapshot_by_id", "One snapshot by its id.", "SELECT id, label, value FROM {observations} WHERE id = 42")
operator("h78_summary_text", "Regime phrase and text.", "SELECT symbol, ts, symbol || ' is ' || CASE WHEN close > open THEN 'rising' ELSE 'falling' END AS summary FROM {candles}")
