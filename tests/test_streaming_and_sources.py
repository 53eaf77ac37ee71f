import json

import pytest
from pyspark.sql import functions as F

from tidewater.plans import catalog
from tidewater.plans.dialect import CATALOG
from tidewater.sources import readers, sinks
from tidewater.streaming import candles as streams

catalog.queries()


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


@pytest.fixture(scope="module")
def ticks_dir(spark, sf, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("ticks"))
    t = spark.read.parquet(f"{sf}/events.parquet").where("value > 0").selectExpr("event_id", "event_type AS symbol", "ts", "value AS ltp", "event_id AS cum")
    t.orderBy("ts").coalesce(1).write.parquet(d + "/a")
    return d + "/a", t.schema


def stream(spark, ticks_dir):
    return spark.readStream.schema(ticks_dir[1]).parquet(ticks_dir[0])


def test_streamed_bars_equal_batch_bars(spark, sf, ticks_dir):
    drain(streams.bars(stream(spark, ticks_dir), 60), "bars60")
    got = spark.table("bars60")
    batch = CATALOG["t01_session_bucket_1h"].run(spark, sf)
    assert got.count() > 0
    both = got.join(batch.withColumnRenamed("n", "volume"), ["symbol", "ts", "open", "high", "low", "close", "volume"])
    assert both.count() == got.count()


def test_counter_volume_and_beliefs(spark, ticks_dir):
    drain(streams.counter_volume(stream(spark, ticks_dir)), "volumes")
    rows = spark.table("volumes")
    assert rows.where("volume < 0").count() == 0 and rows.count() == spark.read.parquet(ticks_dir[0]).count()
    ev = stream(spark, ticks_dir).select("symbol", "ts", F.when(F.col("ltp") > 20, 0.8).otherwise(0.2).alias("likelihood"))
    drain(streams.beliefs(ev), "beliefs", "update")
    got = {r["symbol"]: (r["belief"], r["updates"]) for r in spark.table("beliefs").collect()}
    for sym, (p, n) in got.items():
        want, k = 0.5, 0
        for r in spark.read.parquet(ticks_dir[0]).where(F.col("symbol") == sym).orderBy("ts").collect():
            want, k = 0.7 * want + 0.3 * (0.8 if r["ltp"] > 20 else 0.2), k + 1
        assert n == k and abs(p - want) < 1e-9


def test_bus_dedup(spark, ticks_dir):
    twice = stream(spark, ticks_dir).unionByName(stream(spark, ticks_dir))
    drain(streams.deduplicated(twice), "bus")
    assert spark.table("bus").groupBy("event_id").count().where("count > 1").count() == 0


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([("x", 1, 1.0), ("y", 1, 2.0)], "symbol string, k int, v double")
    b = spark.createDataFrame([("x", 1, 9.0), ("z", 1, 3.0)], "symbol string, k int, v double")
    for write, want in ((sinks.insert_absent, {"x": 1.0, "y": 2.0, "z": 3.0}), (sinks.upsert, {"x": 9.0, "y": 2.0, "z": 3.0})):
        path = str(tmp_path / write.__name__)
        write(a, path, ["symbol", "k"])
        write(b, path, ["symbol", "k"])
        assert {r["symbol"]: r["v"] for r in sinks.current(spark, path).collect()} == want
    sinks.archive(a.withColumn("timeframe", F.lit("D")), str(tmp_path / "arch"))
    assert spark.read.parquet(str(tmp_path / "arch")).where("symbol = 'x'").count() == 1
    c = spark.sql("SELECT * FROM VALUES ('D', TIMESTAMP '2024-01-01'), ('D', TIMESTAMP '2024-02-01'), ('1m', TIMESTAMP '2023-01-01') t(timeframe, ts)")
    kept, gone = sinks.retained(c, {"D": 10})
    assert kept.count() == 2 and gone.first()["count"] == 1


def test_readers(spark, tmp_path):
    chart = json.dumps({"chart": {"result": [{"timestamp": [1700000000, 1700003600], "indicators": {"quote": [{"open": [1, 2], "high": [2, 3], "low": [0, 1], "close": [1.5, None], "volume": [None, 5]}]}}]}})
    got = readers.chart_candles(spark.createDataFrame([("s", chart)], "symbol string, body string")).collect()
    assert len(got) == 1 and got[0]["close"] == 1.5 and got[0]["volume"] == 0
    csv = tmp_path / "d.csv"
    csv.write_text("SYMBOL, SERIES, DATE1, TTL_TRD_QNTY, DELIV_QTY, DELIV_PER\nAAA, EQ, 05-Jan-2024, 100, 40, 40.0\nBBB, EQ, 05-Jan-2024, 100, -, -\nCCC, BE, 05-Jan-2024, 1, 1, 1\n")
    got = readers.delivery_csv(spark, str(csv)).collect()
    assert [(r["symbol"], r["pct"], str(r["ts"])) for r in got] == [("AAA", 40.0, "2024-01-04 18:30:00")]
    rss = "<rss><channel><item><title>A &amp; <b>B</b></title><description><![CDATA[x  <p>y</p>]]></description><link> http://l </link><pubDate>Mon, 01 Jan 2024 10:00:00 +0530</pubDate></item><item><title>T</title><pubDate>never</pubDate></item></channel></rss>"
    got = readers.rss_items(spark.createDataFrame([("f", rss)], "source string, body string")).collect()
    assert got[0]["url"] == "http://l" and got[0]["body"] == "x y" and str(got[0]["published_at"]) == "2024-01-01 04:30:00" and got[1]["published_at"] is None
    leg = {"openInterest": 5, "totalTradedVolume": 7, "lastPrice": 1.5}
    chain = json.dumps({"records": {"underlyingValue": 100, "data": [{"strikePrice": 90, "expiryDate": "25-Jan-2024", "CE": leg}, {"strikePrice": 90, "expiryDate": "29-Feb-2024", "CE": leg}]}})
    got = readers.option_chain(spark.createDataFrame([("n", chain)], "instrument string, body string")).collect()
    assert len(got) == 1 and got[0]["call_oi"] == 5 and got[0]["put_oi"] == 0 and got[0]["put_iv"] is None
    flow = json.dumps([{"category": "FII", "date": "05-Jan-2024", "buyValue": "1,000.5", "sellValue": "500", "netValue": "500.5"}])
    assert readers.flow_rows(spark.createDataFrame([(flow,)], "body string")).first()["gross"] == 1500.5
    rows = json.dumps([["2024-01-05T09:15:00+05:30", 1, 2, 0.5, 1.5, 10], ["bad", 1, 1, 1, 1, 1]])
    assert readers.positional_candles(spark.createDataFrame([("s", rows)], "symbol string, body string")).count() == 1
    q = json.dumps({"depth": {"buy": [{"price": 9, "quantity": 0}], "sell": [{"price": 10, "quantity": 4}]}, "total_buy_qty": 3})
    r = readers.quote_depth(spark.createDataFrame([("s", q)], "symbol string, body string")).first()
    assert (r["bid"], r["ask"], r["bid_depth"], r["ask_depth"]) == (9, 10, 3, 4)
