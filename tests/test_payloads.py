"""Parsers on hand-written payloads: every defined drop."""

from datetime import datetime

from pyspark.sql import functions as F

from tidewater.operators import payloads
from tidewater.sources import readers


def test_delivery_files(spark):
    body = " SYMBOL, SERIES, DELIV_PER ,DATE1, TTL_TRD_QNTY, DELIV_QTY\n abc , EQ , 45.5, 01-Jan-2024, 100, 45\nabc,EQ,50,01-Jan-2024, ,7\nx,BE,50,01-Jan-2024,1,1\ny,EQ,-,01-Jan-2024,1,1\nz,EQ, ,01-Jan-2024,1,1\nw,EQ,5\nv,EQ,5,2024/01/01,1,1\nu,EQ,5,01-Jan-2024,many,1\n"
    raw = spark.createDataFrame([(body,), (None,), ("",), ("SYMBOL,SERIES\nq,EQ",)], "body string")
    got = [tuple(r) for r in readers.delivery_text(raw).collect()]
    assert got == [("ABC", datetime(2023, 12, 31, 18, 30), 0.0, 7.0, 50.0)]  # the file's last line for a symbol; midnight there


def test_tick_strings(spark):
    raw = spark.createDataFrame([("s", '[]#@#[{"date":"Wed Jul 15 2026 09:00:59","value1":"77.5"},{"date":"x","value1":"1"},{"date":"Wed Jul 15 2026 09:01:59","value1":null}]'), ("t", "[1]"), ("u", "a#@#{"), ("v", None)], "symbol string, body string")
    assert [tuple(r) for r in readers.tick_string(raw).collect()] == [("s", datetime(2026, 7, 15, 3, 30, 59), 77.5)]


def test_feed_items(spark):
    body = '<rss version="2.0"><channel><title>c</title><item><title>A &amp; <![CDATA[<b>B</b>]]></title><source url="u"> Paper </source><link> l </link><pubDate>Tue, 02 Jan 2024 10:00:00 +0530</pubDate></item><item><title> </title></item><item><title>two</title><description>&lt;p&gt;x  y&lt;/p&gt;</description><pubDate>?</pubDate></item></channel></rss>'
    got = sorted(tuple(r) for r in readers.feed_items(spark.createDataFrame([(body,), ("<rss",), (None,)], "body string"), "none").collect())
    assert got == [("Paper", "A & B", "", "l", datetime(2024, 1, 2, 4, 30)), ("none", "two", "x y", None, None)]


def test_iso_times(spark):
    texts = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05", "2024-01-02 03:04:05.5", "2024-01-02", "2024-01-02T03:04:05+05:30", "2024-13-02", "now", "", None]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").coalesce(1).orderBy("k").select(readers.iso_time(F.col("t"))).collect()]
    day = lambda *a: datetime(2024, 1, 2, *a)
    assert got == [day(3, 4, 5), day(3, 4, 5), day(3, 4, 5, 500000), day(), datetime(2024, 1, 1, 21, 34, 5), None, None, None, None]


def test_delivery_lines_leave_their_file_behind(spark):
    raw = spark.createDataFrame([("SYMBOL,SERIES,DATE1,TTL_TRD_QNTY,DELIV_QTY,DELIV_PER\nabc,EQ,01-Jan-2024,100,45,45.5",)], "body string")
    plan = readers.delivery_text(raw)._jdf.queryExecution().optimizedPlan().toString()
    exploded = next(x for x in plan.splitlines() if "Generate posexplode" in x)
    assert "[], false" not in exploded  # the list of lines isn't kept beside each line


def test_delivery_files_do_not_grow_with_the_table(spark, tmp_path):
    line = "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_discount double, l_shipdate timestamp"
    rows = [(k * 10**6, 1, k, 5.0, 0.05, datetime(2024, 1, 2)) for k in range(1, 9)] + [(8 * 10**6, 1, 8, 7.0, 0.05, datetime(2024, 1, 2))]
    spark.createDataFrame(rows, line).write.parquet(str(tmp_path / "lineitem.parquet"))
    files = [r["body"] for r in payloads.delivery_payloads(spark, str(tmp_path)).collect()]
    assert len(files) == 8 and max(len(f.split("\n")) for f in files) == 3  # a symbol's lines of a day share a file
