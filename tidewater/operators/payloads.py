"""Source parsers as queries: payloads written from the tables in each source's own format, and parsed again.

Their twins never see a payload: they say from the tables what must come out of it, rows that a payload spoils included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.plans.dialect import Operator
from tidewater.sources import readers


def _table(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return Operator("", "", sql).run(spark, sf_dir)


#: Keys of the lines that share a delivery file: a day's lines are dealt into as many files as its keys need, so no file grows with the table.
FILE_KEYS = 1 << 20


def delivery_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """body: delivery files of a day, one a range of keys (a symbol's lines share one), with padded headers, other series, dashes, blanks, short lines."""
    rows = _table(spark, sf_dir, "SELECT CAST(l_shipdate AS DATE) AS d, l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount FROM {lineitem}")
    line = F.concat_ws(
        ", ", F.format_string(" p%d-%d ", F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.col("l_partkey")), F.when(F.col("l_linenumber") % 3 == 0, " BE").otherwise(" EQ "), F.date_format("d", "dd-MMM-yyyy"),
        F.col("l_quantity").cast("long").cast("string"), F.floor(F.col("l_quantity") / 2).cast("string"), F.when(F.col("l_partkey") % 7 == 0, "-").when(F.col("l_partkey") % 7 == 1, " ").otherwise(F.round(F.col("l_discount") * 100, 2).cast("string")),
    )
    line = F.when(F.col("l_partkey") % 11 == 0, F.concat(F.lit("p0,"), F.lit(" EQ"))).otherwise(line)
    keys = F.floor((F.col("l_orderkey") * 10 + F.col("l_linenumber")) / FILE_KEYS).alias("keys")
    return rows.groupBy("d", keys).agg(F.concat(F.lit("SYMBOL, SERIES , DATE1, TTL_TRD_QNTY, DELIV_QTY , DELIV_PER\n"), F.concat_ws("\n", F.collect_list(line))).alias("body"))


def tick_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, body: two JSON arrays joined by ``#@#``, times local and without a zone; unreadable times and missing values among them."""
    rows = _table(spark, sf_dir, "SELECT event_id, event_type AS symbol, ts, value FROM {events}")
    local = F.date_format(F.from_utc_timestamp("ts", "Asia/Kolkata"), "EEE MMM dd yyyy HH:mm:ss")
    tick = F.struct(F.when(F.col("event_id") % 13 == 0, "n/a").otherwise(local).alias("date"), F.when(F.col("event_id") % 11 != 0, F.col("value").cast("string")).alias("value1"))
    days = rows.groupBy("symbol", F.to_date("ts").alias("d")).agg(F.to_json(F.collect_list(tick)).alias("j"))
    return days.select("symbol", F.concat(F.lit('[{"open":1}]#@#'), "j").alias("body"))


PLAIN = "[^ -;=?-~À-ÿ]"
TITLE = "substring(regexp_replace(coalesce(text, ''), '[^ -%(-;=?-~À-ÿ]', ' '{g}), 1, 60)"


def feed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """body: a feed of a source's documents a thousand ids: marked-up bodies, sources of their own on every other item, dates of which some can't be read."""
    docs = _table(spark, sf_dir, "SELECT doc_id, source, text FROM {documents}")
    title = F.expr(TITLE.replace("{g}", ""))
    date = F.when(F.col("doc_id") % 9 == 0, "soon").otherwise(F.concat(F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 60), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000")))
    own = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('<source url="http://s">'), F.coalesce("source", F.lit("")), F.lit("</source>"))).otherwise("")
    item = F.concat(F.lit("<item><title>"), title, F.lit(" &amp; more</title><description><![CDATA[<p>"), title, F.lit("</p> <b>end</b>]]></description><link> http://x/"), F.col("doc_id").cast("string"), F.lit(" </link><pubDate>"), date, F.lit("</pubDate>"), own, F.lit("</item>"))
    return docs.groupBy(F.floor(F.col("doc_id") / 1000).alias("k")).agg(F.concat(F.lit("<rss><channel><title>c</title>"), F.concat_ws("", F.collect_list(item)), F.lit("</channel></rss>")).alias("body"))


def iso_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, value: moments in several spellings, some without a zone, some unreadable."""
    rows = _table(spark, sf_dir, "SELECT event_id, ts FROM {events}")
    s = lambda f: F.date_format("ts", f)
    kind = F.col("event_id") % 6
    value = F.when(kind == 0, F.concat(s("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(kind == 1, s("yyyy-MM-dd'T'HH:mm:ss")).when(kind == 2, s("yyyy-MM-dd HH:mm:ss"))
    value = value.when(kind == 3, F.concat(F.date_format(F.from_utc_timestamp("ts", "Asia/Kolkata"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30"))).when(kind == 4, "yesterday")
    return rows.select("event_id", value.alias("value"))


QUERIES = {
    "s13_delivery_files": lambda spark, d: readers.delivery_text(delivery_payloads(spark, d)),
    "h01_tick_strings": lambda spark, d: readers.tick_string(tick_payloads(spark, d)),
    "h03_feed_items": lambda spark, d: readers.feed_items(feed_payloads(spark, d), "search"),
    "h30_iso_times": lambda spark, d: iso_values(spark, d).select("event_id", readers.iso_time(F.col("value")).alias("ts")),
}
_TITLE = TITLE.replace("{g}", ", 'g'")
_CLEAN = "trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
ORACLES = {
    "s13_delivery_files": """SELECT 'P' || (l_orderkey * 10 + l_linenumber) || '-' || l_partkey AS symbol, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) - INTERVAL 330 MINUTES AS ts, CAST(floor(l_quantity) AS DOUBLE) AS quantity, floor(l_quantity / 2) AS delivered, round(l_discount * 100, 2) AS pct
FROM lineitem WHERE l_linenumber % 3 <> 0 AND l_partkey % 7 NOT IN (0, 1) AND l_partkey % 11 <> 0""",
    "h01_tick_strings": "SELECT event_type AS symbol, date_trunc('second', ts) AS ts, value AS ltp FROM events WHERE event_id % 13 <> 0 AND event_id % 11 <> 0",
    "h03_feed_items": f"""SELECT CASE WHEN doc_id % 2 = 0 AND trim(coalesce(source, '')) <> '' THEN trim(source) ELSE 'search' END AS source, {_CLEAN.format(x=f"{_TITLE} || ' & more'")} AS title, {_CLEAN.format(x=f"{_TITLE} || '  end'")} AS body, 'http://x/' || doc_id AS url,
  CASE WHEN doc_id % 9 <> 0 THEN CAST(to_timestamp(1700000000 + doc_id * 60) AS TIMESTAMP) END AS published_at FROM documents""",
    "h30_iso_times": "SELECT event_id, CASE WHEN event_id % 6 < 4 THEN date_trunc('second', ts) END AS ts FROM events",
}
