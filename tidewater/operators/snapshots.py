"""Cross-sectional snapshots: breadth, sectors, flows, macro, options, news, events, calendar, and collector aggregates."""

from __future__ import annotations

from tidewater.operators.rolling import cols, over
from tidewater.plans.dialect import operator

#: Stop words of the news operators.
STOPWORDS = ("the", "of", "to", "in", "and", "a", "is")

UNIVERSE = "u AS (SELECT c.c_custkey AS id, n.n_name AS industry, r.r_name AS sector, c.c_acctbal AS last, c.c_acctbal - (c.c_custkey % 7 - 3) * 20 AS prev, c.c_acctbal - (c.c_custkey % 11 - 5) * 30 AS ema20, c.c_acctbal - (c.c_custkey % 5 - 2) * 40 AS ema50, 1 + c.c_custkey % 100 AS mcap FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey)"
SECTORS = "s AS (SELECT label AS sector, @date(ts) AS day, avg(value) AS heat, count(value) AS n FROM {observations} WHERE value IS NOT NULL GROUP BY label, @date(ts))"

# 2.13 ------------------------------------------------------------------------------------------------------------
BREADTH = "b AS (SELECT ts, sum(CASE WHEN close > open THEN 1 ELSE 0 END) AS adv, sum(CASE WHEN close < open THEN 1 ELSE 0 END) AS dec, count(*) AS n FROM {candles} GROUP BY ts), t AS (SELECT ts, 'all' AS symbol, @div(adv - dec, adv + dec) AS strength, @div(adv, n) * 100 AS participation, adv, dec FROM b)"
operator("b01_breadth", "Breadth strength and participation per snapshot.", f"WITH {BREADTH} SELECT ts, @r6(strength) AS strength, @r6(participation) AS participation FROM t")
operator("b02_breadth_momentum", "Slopes of strength and of the cumulative advance line.", f"WITH {BREADTH}, l AS (SELECT *, CAST(sum(adv - dec) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS ad, row_number() OVER (ORDER BY ts) AS rn FROM t) SELECT ts, " + cols({f"{v}_slope_{w}": f"CASE WHEN count({v}) {over(w)} = {w} THEN regr_slope({v}, CAST(rn AS DOUBLE)) {over(w)} END" for v in ("strength", "ad") for w in (5, 20)}) + " FROM l")
operator("b03_sector_leadership", "Cross-sectional z of each sector and its rank; the name breaks ties.", f"WITH {SECTORS}, z AS (SELECT *, count(*) OVER (PARTITION BY day) AS k, avg(heat) OVER (PARTITION BY day) AS m, stddev_pop(heat) OVER (PARTITION BY day) AS sd FROM s) SELECT sector, day, @r6(CASE WHEN k >= 2 AND sd > 1e-12 THEN (heat - m) / nullif(sd, 0.0) END) AS z, CAST(row_number() OVER (PARTITION BY day ORDER BY heat DESC, sector) AS INT) AS rank FROM z")
operator("b04_sector_participation", "Mean strength over sectors and the share above the typical level.", f"WITH {SECTORS} SELECT day, @r6(avg(heat)) AS mean_strength, @r6(avg(CASE WHEN heat > 45 THEN 100 ELSE 0 END)) AS participation FROM s GROUP BY day")
operator("b05_sector_correlation", "Rolling correlation of a sector with the mean over sectors.", f"WITH {SECTORS}, m AS (SELECT sector AS symbol, day AS ts, heat, avg(heat) OVER (PARTITION BY day) AS mean FROM s) SELECT symbol AS sector, ts AS day, @r6(CASE WHEN count(heat) {over(10)} = 10 THEN least(1.0, greatest(-1.0, covar_pop(heat, mean) {over(10)} / nullif(sqrt(var_pop(heat) {over(10)} * var_pop(mean) {over(10)}), 0.0))) END) AS corr_10 FROM m")
operator("b06_flow_features", "Flow score, participation index and its slope.", f"WITH f AS (SELECT 'all' AS symbol, date_trunc('month', o_orderdate) AS ts, @div(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END), sum(o_totalprice)) AS score FROM {{orders}} GROUP BY date_trunc('month', o_orderdate)), n AS (SELECT *, row_number() OVER (ORDER BY ts) AS rn FROM f) SELECT ts, @r6(score) AS score, @r6(50 + 50 * score) AS participation_index, @r6(CASE WHEN count(score) {over(5)} = 5 THEN regr_slope(score, CAST(rn AS DOUBLE)) {over(5)} END) AS slope_5 FROM n")
operator("b07_macro_factors", "Per-factor value, change and z-score.", f"WITH f AS (SELECT o_orderpriority AS symbol, date_trunc('month', o_orderdate) AS ts, avg(o_totalprice) AS value FROM {{orders}} GROUP BY 1, 2) SELECT symbol AS factor, ts, @r6(value) AS value, @r6(@div(value - lag(value) OVER (PARTITION BY symbol ORDER BY ts), lag(value) OVER (PARTITION BY symbol ORDER BY ts)) * 100) AS ret, @r6(CASE WHEN count(value) {over(20)} >= 10 THEN @div(value - avg(value) {over(20)}, stddev_pop(value) {over(20)}) END) AS z FROM f")
CHAIN = "c AS (SELECT p_brand AS chain, p_size AS strike, CAST(sum(CASE WHEN p_partkey % 2 = 0 THEN 1 + p_partkey % 13 ELSE 0 END) AS BIGINT) AS call_oi, CAST(sum(CASE WHEN p_partkey % 2 = 1 THEN 1 + p_partkey % 11 ELSE 0 END) AS BIGINT) AS put_oi, avg(p_retailprice) / 50 AS iv, sum(p_partkey % 5 - 2) AS oi_change, avg(p_retailprice) AS ltp FROM {part} GROUP BY p_brand, p_size)"
operator("b08_option_features", "Open-interest change, expected move, dealer positioning and volume ratio of chains.", f"WITH {CHAIN} SELECT chain, CAST(sum(call_oi + put_oi) AS BIGINT) AS total_oi, @r6(@div(sum(oi_change), sum(call_oi + put_oi)) * 100) AS oi_change_pct, @r6(25 * avg(iv) / 100 * sqrt(CAST(7 AS DOUBLE) / 365)) AS expected_move, @r6(@div(sum(call_oi) - sum(put_oi), sum(call_oi + put_oi))) AS dealer, @r6(@div(sum(put_oi), sum(call_oi))) AS volume_ratio FROM c GROUP BY chain")
operator("b09_iv_rank", "Rank and percentile of implied volatility among trailing snapshots.", f"WITH v AS (SELECT symbol, ts, high - low AS iv FROM {{candles}}), h AS (SELECT *, @list_agg(iv) {over(60)} AS a, min(iv) {over(60)} AS lo, max(iv) {over(60)} AS hi FROM v) SELECT symbol, ts, @r6(@div(iv - lo, hi - lo) * 100) AS iv_rank, @r6(@div(@size(@filter(a, @L(x) x <= iv)), @size(a)) * 100) AS iv_pct FROM h")
SPINE = "n AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS k, avg(value) AS sentiment FROM {observations} WHERE label = 'signup' GROUP BY 1), b AS (SELECT min(hour) AS lo, max(hour) AS hi FROM n), x AS (SELECT @explode(@seq(CAST(0 AS BIGINT), @idiv(@unix(hi) - @unix(lo), 3600))) AS i, lo FROM b), p AS (SELECT @from_unix(@unix(lo) + i * 3600) AS hour FROM x), h AS (SELECT p.hour, coalesce(k, 0) AS k, sentiment FROM p LEFT JOIN n ON p.hour = n.hour)"
operator("b10_news_spine", "Hourly buckets on a gap-free spine.", f"WITH {SPINE} SELECT hour, k, @r6(sentiment) AS sentiment FROM h")
operator("b11_news_momentum", "Hour's count over the trailing day's mean.", f"WITH {SPINE} SELECT hour, @r6(@div(k, avg(k) OVER (ORDER BY hour ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))) AS momentum FROM h")
operator("b12_news_aggregates", "Mean sentiment, entity frequency and a clamped impact.", "SELECT date_trunc('hour', ts) AS hour, @r6(avg(value)) AS sentiment, count(DISTINCT label) AS entities, @r6(least(0.95, greatest(0.05, @div(avg(value), 97) + @div(count(*), 50)))) AS impact FROM {observations} GROUP BY date_trunc('hour', ts)")
#: The first articles of each source and all pairs of them, numbered as two nested loops would: 200 pairs need no more than 201 articles.
PAIRS_OF = """f AS (SELECT doc_id, source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM {documents}),
w AS (SELECT doc_id, source, k, count(*) OVER (PARTITION BY source) AS n, @distinct(@filter(@tokens(text), @L(t) length(t) > 2)) AS ws FROM f WHERE k <= 201 AND text IS NOT NULL),
p AS (SELECT a.source, @size(@intersect(a.ws, b.ws)) AS i, @size(a.ws) AS na, @size(b.ws) AS nb FROM w a JOIN w b ON a.source = b.source AND a.k < b.k
      WHERE (a.k - 1) * a.n - @idiv(a.k * (a.k - 1), 2) + b.k - a.k <= 200)"""
operator("b13_headline_similarity", "Mean pairwise similarity of headlines within a group, over its first 200 pairs.", f"WITH {PAIRS_OF} SELECT source, @r6(avg(@div(i, na + nb - i))) AS similarity, count(*) AS pairs FROM p GROUP BY source")
operator("b14_topic_entropy", "Normalised entropy of categories.", "WITH c AS (SELECT source, lang, count(*) AS n FROM {documents} GROUP BY source, lang), t AS (SELECT *, sum(n) OVER (PARTITION BY source) AS total, count(*) OVER (PARTITION BY source) AS kinds FROM c) SELECT source, @r6(CASE WHEN max(kinds) > 1 THEN -sum(@div(n, total) * ln(@div(n, total))) / ln(CAST(max(kinds) AS DOUBLE)) ELSE 0.0 END) AS entropy FROM t GROUP BY source")
#: Each hour's first event and highest multiplier, told to the twelve hours before: an equality join, however many events.
AHEAD = """h AS (SELECT date_trunc('hour', ts) AS hour, min(ts) AS first_at, max(1 + event_id % 3) AS m, max(CASE WHEN ts = date_trunc('hour', ts) THEN 1 + event_id % 3 END) AS m_at FROM {events} GROUP BY date_trunc('hour', ts)),
o AS (SELECT hour, first_at, m, m_at, @explode(@seq(0, 11)) AS k FROM h),
a AS (SELECT @from_unix(@unix(hour) - 3600 * k) AS start, first_at, CASE WHEN k < 2 THEN m WHEN k = 2 THEN coalesce(m_at, 1) ELSE 1 END AS m FROM o)"""
operator("b15_event_windows", "Nearest upcoming event and the governing multiplier of each hour.", f"WITH {AHEAD} SELECT c.symbol, c.ts, min(@unix(first_at) - @unix(c.ts)) AS seconds_to_next, CAST(max(m) AS BIGINT) AS multiplier FROM {{candles}} c JOIN a ON c.ts = a.start GROUP BY c.symbol, c.ts")
operator("b16_event_similarity", "Best similarity of an hour's event kinds with earlier hours'.", f"WITH k AS (SELECT 'all' AS symbol, date_trunc('hour', ts) AS ts, @cset(source || label) AS kinds FROM {{observations}} GROUP BY date_trunc('hour', ts)), h AS (SELECT *, @list_agg(kinds) {over(500, 1)} AS past FROM k) SELECT ts, @r6(@amax(@transform(past, @L(p) @div(@size(@intersect(p, kinds)), @size(p) + @size(kinds) - @size(@intersect(p, kinds)))))) AS similarity FROM h")
operator("b17_calendar", "Calendar features of each day.", "WITH d AS (SELECT DISTINCT @date(o_orderdate) AS day FROM {orders}) SELECT day, CAST(@isodow(day) AS INT) AS weekday, CAST(extract(MONTH FROM day) AS INT) AS month, CAST(extract(QUARTER FROM day) AS INT) AS quarter, CASE WHEN @isodow(day) = 1 THEN 1 ELSE 0 END AS weekly_expiry, CASE WHEN extract(MONTH FROM day) IN (1, 4, 7, 10) AND extract(DAY FROM day) >= 10 THEN 1 ELSE 0 END AS earnings_season FROM d")
operator("b18_monthly_expiry", "Last given weekday of each month.", "WITH d AS (SELECT DISTINCT last_day(o_orderdate) AS last FROM {orders}) SELECT last, CAST(extract(DAY FROM last) - @pmod(@isodow(last) - 1, 7) AS INT) AS expiry_day FROM d")
operator("b19_holiday_distance", "Days to the next holiday at or after the day.", "WITH d AS (SELECT DISTINCT @date(o_orderdate) AS day FROM {orders}), h AS (SELECT DISTINCT @date(o_orderdate) AS holiday FROM {orders} WHERE extract(DAY FROM o_orderdate) = 26 AND extract(MONTH FROM o_orderdate) IN (1, 8)) SELECT day, CAST(min(@days(holiday, day)) AS INT) AS days_to_holiday FROM d JOIN h ON holiday >= day GROUP BY day")
operator("b20_session_clock", "Minutes since the open and until the close.", "SELECT event_id, CAST(greatest(0, extract(HOUR FROM @ist(ts)) * 60 + extract(MINUTE FROM @ist(ts)) - 555) AS BIGINT) AS since_open, CAST(greatest(0, 930 - extract(HOUR FROM @ist(ts)) * 60 - extract(MINUTE FROM @ist(ts))) AS BIGINT) AS until_close FROM {ticks}")

# 2.14 ------------------------------------------------------------------------------------------------------------
operator("d01_max_pain", "Strike of least total intrinsic payout; the smaller strike wins ties.", f"WITH {CHAIN}, p AS (SELECT a.chain, a.strike, sum(greatest(a.strike - b.strike, 0) * b.call_oi + greatest(b.strike - a.strike, 0) * b.put_oi) AS pain FROM c a JOIN c b ON a.chain = b.chain GROUP BY a.chain, a.strike) SELECT chain, CAST(min_by(strike, pain * 1000 + strike) AS BIGINT) AS max_pain FROM p GROUP BY chain")
operator("d02_pcr", "Put-call ratio, shares around the spot and weighted strike.", f"WITH {CHAIN} SELECT chain, @r6(@div(sum(put_oi), sum(call_oi))) AS pcr, @r6(@div(sum(CASE WHEN strike > 25 THEN call_oi + put_oi ELSE 0 END), sum(call_oi + put_oi))) AS above_share, @r6(@div(sum(strike * (call_oi + put_oi)), sum(call_oi + put_oi))) AS weighted_strike FROM c GROUP BY chain")
operator("d03_iv_skew", "At-the-money volatility and skew.", f"WITH {CHAIN} SELECT chain, @r6(min_by(iv, abs(strike - 25) * 1000 + strike)) AS atm_iv, @r6(avg(CASE WHEN strike < 25 AND put_oi > 0 THEN iv END) - avg(CASE WHEN strike > 25 AND call_oi > 0 THEN iv END)) AS skew FROM c GROUP BY chain")
operator("d04_oi_concentration", "Share of the three largest strikes and writing intensity.", f"WITH {CHAIN}, r AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY call_oi + put_oi DESC, strike) AS k FROM c) SELECT chain, @r6(@div(sum(CASE WHEN k <= 3 THEN call_oi + put_oi ELSE 0 END), sum(call_oi + put_oi))) AS top3, @r6(@div(sum(greatest(oi_change, 0)), sum(call_oi + put_oi))) AS writing FROM r GROUP BY chain")
operator("d05_buildup", "Four-way classification by price and open-interest change.", "SELECT symbol, ts, CASE WHEN close > pc AND volume > pv THEN 'long_buildup' WHEN close < pc AND volume > pv THEN 'short_buildup' WHEN close > pc THEN 'short_covering' WHEN close < pc THEN 'long_unwinding' ELSE 'neutral' END AS buildup FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc, lag(volume) OVER (PARTITION BY symbol ORDER BY ts) AS pv FROM {candles}) q")
operator("d06_iv_percentile", "Strict percentile of the newest value among the stored ones.", "WITH v AS (SELECT symbol, high - low AS iv, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM {candles}), n AS (SELECT symbol, iv FROM v WHERE k = 1) SELECT n.symbol, @r6(CASE WHEN count(*) >= 100 THEN @div(sum(CASE WHEN v.iv < n.iv THEN 1 ELSE 0 END), count(*)) * 100 END) AS iv_percentile FROM n JOIN v ON v.symbol = n.symbol AND v.k > 1 GROUP BY n.symbol, n.iv")
operator("d07_market_breadth", "Advances, declines, share above averages, equal and weighted returns per sector.", f"WITH {UNIVERSE} SELECT sector, CAST(sum(CASE WHEN last > prev THEN 1 ELSE 0 END) AS BIGINT) AS advances, CAST(sum(CASE WHEN last < prev THEN 1 ELSE 0 END) AS BIGINT) AS declines, CAST(sum(CASE WHEN last = prev THEN 1 ELSE 0 END) AS BIGINT) AS unchanged, @r6(avg(CASE WHEN last > ema20 THEN 100 ELSE 0 END)) AS above_ema20, @r6(avg(CASE WHEN last > ema50 THEN 100 ELSE 0 END)) AS above_ema50, @r6(@div(sum((last - prev) * mcap), sum(mcap))) AS cap_weighted, @r6(avg(last - prev)) AS equal_weighted FROM u GROUP BY sector")
operator("d08_sector_rotation", "Blended relative strength, momentum and rotation score of each sector.", f"WITH {UNIVERSE}, s AS (SELECT industry, avg(last - prev) AS r1, avg(last - ema20) AS r5, avg(last - ema50) AS r20 FROM u GROUP BY industry), m AS (SELECT avg(r1) AS b1, avg(r5) AS b5, avg(r20) AS b20 FROM s) SELECT industry, @r6(0.5 * (r1 - b1) + 0.3 * (r5 - b5) + 0.2 * (r20 - b20)) AS rs, @r6((r1 - b1) - (r20 - b20)) AS momentum, @r6(tanh((r1 - b1) / 10)) AS rotation FROM s JOIN m ON 1 = 1")
operator("d09_relative_volume", "Volume against stored days' highs, clamped.", "WITH d AS (SELECT symbol, @date(ts) AS day, max(volume) AS v FROM {candles} GROUP BY symbol, @date(ts)), l AS (SELECT symbol, max(day) AS last FROM d GROUP BY symbol) SELECT d.symbol, @r6(least(10.0, greatest(0.1, @div(max(CASE WHEN day = last THEN v END), avg(CASE WHEN day < last THEN v END))))) AS rel_volume FROM d JOIN l ON d.symbol = l.symbol GROUP BY d.symbol HAVING count(CASE WHEN day < last THEN 1 END) >= 3")
operator("d10_flow_scores", "Clamped flow scores and their renormalised blend.", "WITH f AS (SELECT c.c_mktsegment AS segment, sum(o.o_totalprice * CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE -1 END) AS net, sum(o.o_totalprice) AS gross, avg(abs(o.o_totalprice)) AS base FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment) SELECT segment, @r6(least(1.0, greatest(-1.0, @div(net, greatest(base, 1))))) AS score, @r6(@div(net, gross)) AS net_over_gross FROM f")
operator("d11_stored_average", "Average of days' largest values, given enough days.", "SELECT label, @r6(avg(top)) AS average, count(*) AS days FROM (SELECT label, @date(ts) AS day, max(abs(value)) AS top FROM {observations} GROUP BY label, @date(ts)) q GROUP BY label HAVING count(*) >= 5")
operator("d12_macro_score", "Signed, clamped factor scores and their weighted blend.", "WITH f AS (SELECT symbol, @div(close - avg(close) OVER (PARTITION BY symbol), stddev_pop(close) OVER (PARTITION BY symbol)) AS z, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM {candles}), d AS (SELECT 'click' AS symbol, 1 AS sgn, 0.3 AS w UNION ALL SELECT 'view', -1, 0.2 UNION ALL SELECT 'error', -1, 0.5) SELECT @r6(sum(w * sgn * least(3.0, greatest(-3.0, z)) / 3) / sum(w)) AS composite, count(*) AS present FROM f JOIN d ON f.symbol = d.symbol WHERE k = 1")
#: Each event is told to the full hours that its window holds, a handful each; moments then meet them by equality.
PROFILES = "p AS (SELECT 'error' AS kind, 2 AS pre_h, 4 AS post_h, 0.4 AS reduction UNION ALL SELECT 'purchase', 1, 1, 0.2)"
ACTIVE = """e AS (SELECT kind, reduction, CAST(ceil((@unix(ts) - pre_h * 3600) / 3600.0) AS BIGINT) AS a, @idiv(@unix(ts) + post_h * 3600, 3600) AS b FROM {events} JOIN p ON kind = event_type)"""
#: A window starts at the event's own microsecond: the hour that the event lies in isn't the first whole one within.
ACTIVE_EXACTLY = """w AS (SELECT kind, reduction, @micros(ts) - pre_h * 3600000000 + 3599999999 AS s, @micros(ts) + post_h * 3600000000 AS t FROM {events} JOIN p ON kind = event_type),
e AS (SELECT kind, reduction, @idiv(s - @pmod(s, 3600000000), 3600000000) AS a, @idiv(t - @pmod(t, 3600000000), 3600000000) AS b FROM w)"""


def activity(windows: str) -> str:
    return f"""WITH {PROFILES},
{windows},
x AS (SELECT kind, reduction, @explode(@seq(a, b)) AS hour FROM e), n AS (SELECT hour, count(*) AS active, @r6(least(1.0, sum(reduction))) AS reduction, max(kind) AS kind FROM x GROUP BY hour) SELECT c.ts, active, reduction, kind FROM {{reference}} c JOIN n ON @idiv(@unix(c.ts), 3600) = hour"""


#: By whole seconds, as the SQL of `n14_event_assessment` has it.
ACTIVITY_BY_SECONDS = activity(ACTIVE)
operator("d13_event_activity", "Events whose window, by their kind's profile, holds the moment.", activity(ACTIVE_EXACTLY))
operator("d14_tokens", "Tokens, distinct content tokens and phrase containment.", "SELECT doc_id, CAST(@size(@tokens(text)) AS BIGINT) AS tokens, CAST(@size(@distinct(@filter(@tokens(text), @L(t) t NOT IN " + str(STOPWORDS) + "))) AS BIGINT) AS content_tokens, CASE WHEN (' ' || lower(text) || ' ') LIKE '% and the %' THEN 1 ELSE 0 END AS has_phrase FROM {documents}")
operator("d20_urgency", "Urgency by age and impact by trust.", "WITH a AS (SELECT id, source, value, (@unix((SELECT max(ts) FROM {observations})) - @unix(ts)) / 60 AS age FROM {observations}) SELECT id, CASE WHEN age < 30 THEN 'high' WHEN age < 120 THEN 'medium' ELSE 'low' END AS urgency, @r6(abs(coalesce(value, 0)) / 100 * CASE WHEN age < 30 THEN 1.0 WHEN age < 120 THEN 0.6 ELSE 0.3 END * CASE source WHEN 'src0' THEN 0.9 WHEN 'src1' THEN 0.7 ELSE 0.5 END) AS impact FROM a")
CDF = "(CASE WHEN {x} >= 0 THEN 1 - exp(-({x}) * ({x}) / 2) * 0.3989422804014327 * (0.319381530 * {k} - 0.356563782 * {k} * {k} + 1.781477937 * {k} * {k} * {k} - 1.821255978 * {k} * {k} * {k} * {k} + 1.330274429 * {k} * {k} * {k} * {k} * {k}) ELSE exp(-({x}) * ({x}) / 2) * 0.3989422804014327 * (0.319381530 * {k} - 0.356563782 * {k} * {k} + 1.781477937 * {k} * {k} * {k} - 1.821255978 * {k} * {k} * {k} * {k} + 1.330274429 * {k} * {k} * {k} * {k} * {k}) END)"


def normal_cdf(x: str, k: str) -> str:
    """Normal distribution function by a rational approximation; ``k`` names the column 1 / (1 + 0.2316419 |x|)."""
    out = CDF.replace("{x}", x).replace("{k}", k)
    for v in ("0.3989422804014327", "0.319381530", "0.356563782", "1.781477937", "1.821255978", "1.330274429"):
        out = out.replace(v, f"CAST({v} AS DOUBLE)")
    return out


BS = "b AS (SELECT p_partkey AS id, CAST(100 AS DOUBLE) AS s, CAST(60 + p_size * 2 AS DOUBLE) AS x, CAST(7 + p_partkey % 60 AS DOUBLE) / 365 AS t, CAST(0.1 AS DOUBLE) + CAST(p_partkey % 30 AS DOUBLE) / 100 AS v, CAST(0.065 AS DOUBLE) AS r FROM {part}), d AS (SELECT *, (ln(s / x) + (r + v * v / 2) * t) / (v * sqrt(t)) AS d1 FROM b), e AS (SELECT *, d1 - v * sqrt(t) AS d2 FROM d), k AS (SELECT *, 1 / (1 + CAST(0.2316419 AS DOUBLE) * abs(d1)) AS k1, 1 / (1 + CAST(0.2316419 AS DOUBLE) * abs(d2)) AS k2, exp(-d1 * d1 / 2) * CAST(0.3989422804014327 AS DOUBLE) AS pdf FROM e)"
operator("d21_greeks", "Option sensitivities of a lognormal price: theta by calendar day, vega by point.", f"WITH {BS} SELECT id, " + cols({"delta": normal_cdf("d1", "k1"), "gamma": "pdf / (s * v * sqrt(t))", "theta": f"(-s * pdf * v / (2 * sqrt(t)) - r * x * exp(-r * t) * {normal_cdf('d2', 'k2')}) / 365", "vega": "s * pdf * sqrt(t) / 100"}) + " FROM k")
operator("d22_data_quality", "Weighted quality score of each collector.", "WITH q AS (SELECT source, avg(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS nulls, 1 - @div(count(DISTINCT label || CAST(value AS STRING)), count(*)) AS duplicates, count(*) AS n FROM {observations} GROUP BY source) SELECT source, @r6(nulls) AS nulls, @r6(100 * (0.6 * (1 - nulls) + 0.4 * (1 - duplicates))) AS score, CASE WHEN 0.6 * (1 - nulls) + 0.4 * (1 - duplicates) >= 0.5 THEN 'ok' ELSE 'degraded' END AS status FROM q".replace("CAST(value AS STRING)", "CAST(CAST(floor(value) AS INT) AS STRING)"))
operator("d23_reliability", "Mean of the last fifty scores.", "SELECT label, @r6(avg(value)) AS reliability FROM (SELECT label, value, row_number() OVER (PARTITION BY label ORDER BY id DESC) AS k FROM {observations} WHERE value IS NOT NULL) q WHERE k <= 50 GROUP BY label")
