"""Source parsers: chart JSON, delivery CSV, RSS, option chains, flows, tick strings, positional candles.

All are column expressions over raw text; what can't be parsed becomes null and drops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHART = "struct<chart:struct<result:array<struct<timestamp:array<long>,indicators:struct<quote:array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<long>>>>>>>>"
CHAIN_LEG = "struct<openInterest:double,changeinOpenInterest:double,impliedVolatility:double,totalTradedVolume:double,lastPrice:double>"
CHAIN = f"struct<records:struct<underlyingValue:double,data:array<struct<strikePrice:double,expiryDate:string,CE:{CHAIN_LEG},PE:{CHAIN_LEG}>>>>"


def chart_candles(raw: DataFrame, text: str = "body") -> DataFrame:
    """symbol, ts, open, high, low, close, volume from chart JSON; bars without a close drop."""
    r = F.from_json(F.col(text), CHART)["chart"]["result"][0]
    q = r["indicators"]["quote"][0]
    z = raw.select("symbol", F.explode(F.arrays_zip(r["timestamp"].alias("t"), q["open"].alias("o"), q["high"].alias("h"), q["low"].alias("l"), q["close"].alias("c"), q["volume"].alias("v"))).alias("x"))
    return z.where("x.c IS NOT NULL").select("symbol", F.timestamp_seconds("x.t").alias("ts"), F.col("x.o").alias("open"), F.col("x.h").alias("high"), F.col("x.l").alias("low"), F.col("x.c").alias("close"), F.coalesce("x.v", F.lit(0)).alias("volume"))


def delivery_csv(spark: SparkSession, path: str) -> DataFrame:
    """symbol, ts, quantity, delivered, pct: equity series only; a blank or dash share drops."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    pct = F.expr("try_cast(nullif(trim(DELIV_PER), '-') AS double)")
    ts = F.to_utc_timestamp(F.expr("try_to_timestamp(DATE1, 'dd-MMM-yyyy')"), "Asia/Kolkata")
    out = raw.where(F.trim("SERIES") == "EQ").select(F.trim("SYMBOL").alias("symbol"), ts.alias("ts"), F.expr("try_cast(TTL_TRD_QNTY AS long)").alias("quantity"), F.expr("try_cast(DELIV_QTY AS long)").alias("delivered"), pct.alias("pct"))
    return out.where("pct IS NOT NULL AND ts IS NOT NULL")


def delivery_text(raw: DataFrame, text: str = "body") -> DataFrame:
    """symbol, ts, quantity, delivered, pct from whole delivery files as text: columns by name, equity series only; lines that are
    short, without a share or unreadable drop; of a file's lines for one symbol the last counts."""
    lines = raw.select(F.monotonically_increasing_id().alias("_file"), F.split(F.col(text), "\r?\n").alias("l"))
    lines = lines.select("_file", F.transform(F.split(F.col("l")[0], ","), lambda c: F.trim(c)).alias("names"), F.slice("l", 2, F.greatest(F.size("l"), F.lit(1))).alias("l"))
    places = {f"_{k}": F.array_position("names", F.lit(k)).cast("int") for k in ("SYMBOL", "SERIES", "DATE1", "TTL_TRD_QNTY", "DELIV_QTY", "DELIV_PER")}
    # each line takes along where its columns are, not its whole file
    lines = lines.select("_file", F.size("names").alias("_size"), *[c.alias(k) for k, c in places.items()], "l").select("_file", "_size", *places, F.posexplode("l").alias("n", "line"))
    rows = lines.withColumn("r", F.split("line", ",")).where(F.size("r") >= F.col("_size"))
    cell = lambda k: F.trim(F.get("r", F.col(f"_{k}") - 1))
    number = lambda k: F.coalesce(F.nullif(cell(k), F.lit("")), F.lit("0")).try_cast("double")
    ts = F.to_utc_timestamp(F.try_to_timestamp(cell("DATE1"), F.lit("dd-MMM-yyyy")), "Asia/Kolkata")
    out = rows.where(cell("SERIES") == "EQ").select("_file", "n", F.upper(cell("SYMBOL")).alias("symbol"), ts.alias("ts"), number("TTL_TRD_QNTY").alias("quantity"), number("DELIV_QTY").alias("delivered"), cell("DELIV_PER").try_cast("double").alias("pct"))
    whole = out.where("ts IS NOT NULL AND pct IS NOT NULL AND quantity IS NOT NULL AND delivered IS NOT NULL")
    last = whole.groupBy("_file", "symbol").agg(F.max_by(F.struct("ts", "quantity", "delivered", "pct"), "n").alias("r"))
    return last.select("symbol", "r.*")


FEED = "struct<channel:struct<item:array<struct<title:string,description:string,link:string,pubDate:string,source:struct<_VALUE:string,_url:string>>>>>"


def feed_items(raw: DataFrame, fallback: str, text: str = "body") -> DataFrame:
    """source (the item's own, else ``fallback``), title, body, url, published_at of feeds as text; items without a title drop."""
    d = raw.select(F.explode(F.from_xml(F.col(text), FEED, {"rowTag": "rss"})["channel"]["item"]).alias("i"))
    date = F.try_to_timestamp(F.regexp_replace("i.pubDate", "^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    own = F.nullif(F.trim("i.source._VALUE"), F.lit(""))
    out = d.select(F.coalesce(own, F.lit(fallback)).alias("source"), clean_text(F.col("i.title")).alias("title"), clean_text(F.coalesce("i.description", F.lit(""))).alias("body"), F.trim("i.link").alias("url"), date.alias("published_at"))
    return out.where("title <> ''")


def iso_time(c: Column) -> Column:
    """A moment from ISO text: without a zone it is UTC (the session's zone must be), unreadable it is null."""
    whole = c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}")
    return F.when(whole, F.coalesce(c.try_cast("timestamp"), F.lit(None).cast("timestamp")))


def clean_text(c: Column) -> Column:
    """Markup out, white space to single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), "\\s+", " "))


def rss_items(raw: DataFrame, text: str = "body") -> DataFrame:
    """source, title, body, url, published_at (RFC 822; null if it can't be read) of each item."""
    item = raw.select("source", F.explode(F.expr(f"regexp_extract_all({text}, '(?s)<item>(.*?)</item>', 1)")).alias("item"))
    part = lambda tag: F.regexp_replace(F.regexp_extract("item", f"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1), "(?s)^<!\\[CDATA\\[(.*)\\]\\]>$", "$1")
    date = F.expr("try_to_timestamp(regexp_replace(regexp_extract(item, '(?s)<pubDate>(.*?)</pubDate>', 1), '^[A-Za-z]{3}, ', ''), 'd MMM yyyy HH:mm:ss Z')")
    return item.select("source", clean_text(part("title")).alias("title"), clean_text(part("description")).alias("body"), F.trim(part("link")).alias("url"), date.alias("published_at"))


def option_chain(raw: DataFrame, text: str = "body") -> DataFrame:
    """instrument, spot, expiry, strike and both legs; the nearest expiry of each payload only; missing counts are 0."""
    r = F.from_json(F.col(text), CHAIN)["records"]
    d = raw.select("instrument", r["underlyingValue"].alias("spot"), F.explode(r["data"]).alias("d"))
    d = d.withColumn("expiry", F.expr("try_to_timestamp(d.expiryDate, 'dd-MMM-yyyy')"))
    near = d.groupBy("instrument").agg(F.min("expiry").alias("expiry"))
    legs = [F.coalesce(F.col(f"d.{leg}.{k}"), F.lit(0.0)).alias(f"{n}_{a}") for leg, n in (("CE", "call"), ("PE", "put")) for k, a in (("openInterest", "oi"), ("totalTradedVolume", "volume"))]
    more = [F.col(f"d.{leg}.{k}").alias(f"{n}_{a}") for leg, n in (("CE", "call"), ("PE", "put")) for k, a in (("impliedVolatility", "iv"), ("lastPrice", "ltp"))]
    return d.join(near, ["instrument", "expiry"]).select("instrument", "spot", "expiry", F.col("d.strikePrice").alias("strike"), *legs, *more)


def flow_rows(raw: DataFrame, text: str = "body") -> DataFrame:
    """category, net and gross by day from flow JSON; numbers may hold commas."""
    kind = "array<struct<category:string,date:string,buyValue:string,sellValue:string,netValue:string>>"
    num = lambda c: F.expr(f"try_cast(replace({c}, ',', '') AS double)")
    d = raw.select(F.explode(F.from_json(F.col(text), kind)).alias("f"))
    return d.select(F.col("f.category").alias("category"), F.expr("try_to_timestamp(f.date, 'dd-MMM-yyyy')").alias("ts"), num("f.netValue").alias("net"), (num("f.buyValue") + num("f.sellValue")).alias("gross"))


def tick_string(raw: DataFrame, text: str = "body") -> DataFrame:
    """Ticks from the second of two JSON arrays that ``#@#`` joins; unreadable times drop."""
    kind = "array<struct<date:string,value1:string>>"
    d = raw.select("symbol", F.explode(F.from_json(F.get(F.split(F.col(text), "#@#"), 1), kind)).alias("t"))
    d = d.select("symbol", F.to_utc_timestamp(F.expr("try_to_timestamp(regexp_replace(t.date, '^[A-Za-z]{3} ', ''), 'MMM dd yyyy HH:mm:ss')"), "Asia/Kolkata").alias("ts"), F.expr("try_cast(t.value1 AS double)").alias("ltp"))
    return d.where("ts IS NOT NULL AND ltp IS NOT NULL")


def positional_candles(raw: DataFrame, text: str = "body") -> DataFrame:
    """Candles from positional arrays [time, open, high, low, close, volume]."""
    d = raw.select("symbol", F.explode(F.from_json(F.col(text), "array<array<string>>")).alias("r"))
    at = lambda k, t: F.expr(f"try_cast(r[{k}] AS {t})")
    return d.select("symbol", F.expr("try_to_timestamp(r[0])").alias("ts"), at(1, "double").alias("open"), at(2, "double").alias("high"), at(3, "double").alias("low"), at(4, "double").alias("close"), at(5, "long").alias("volume")).where("ts IS NOT NULL")


def quote_depth(raw: DataFrame, text: str = "body") -> DataFrame:
    """bid, ask and depth totals: five levels, then best quantities, then session totals; zero totals count as missing."""
    kind = "struct<depth:struct<buy:array<struct<price:double,quantity:double>>,sell:array<struct<price:double,quantity:double>>>,bid_qty:double,ask_qty:double,total_buy_qty:double,total_sell_qty:double>"
    q = F.from_json(F.col(text), kind)
    total = lambda side: F.aggregate(F.transform(q["depth"][side], lambda x: F.coalesce(x["quantity"], F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    none = lambda c: F.nullif(c, F.lit(0.0))
    return raw.select("symbol", q["depth"]["buy"][0]["price"].alias("bid"), q["depth"]["sell"][0]["price"].alias("ask"),
                      F.coalesce(none(total("buy")), none(q["bid_qty"]), none(q["total_buy_qty"])).alias("bid_depth"),
                      F.coalesce(none(total("sell")), none(q["ask_qty"]), none(q["total_sell_qty"])).alias("ask_depth"))
