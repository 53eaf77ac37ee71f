"""Windows over quotes in blocks give what they give over whole histories."""

import duckdb

from tidewater.operators import quotes
from tidewater.plans import catalog
from tidewater.plans.dialect import Operator


def test_blocks_hold_every_quote_once_and_what_frames_reach(spark):
    rows = [(s, t) for s in "ab" for t in range(0, 1000, 3)]
    got = quotes.dealt(spark.createDataFrame(rows, "symbol string, ts long"), span=50, block=7, reach=10).collect()
    own = {(r["symbol"], r["ts"]): r for r in got if r["own"]}
    assert len(own) == len(rows) == sum(r["own"] for r in got) and all(r["rn"] == t // 3 + 1 and r["block"] == t // 3 // 7 for (_, t), r in own.items())
    held = {}
    for r in got:
        held.setdefault((r["symbol"], r["block"]), set()).add(r["rn"])
    assert all(set(range(max(1, b * 7 + 1 - 10), b * 7 + 2)) <= held[s, b] for s, b in {(s, r["block"]) for (s, _), r in own.items()}) and max(map(len, held.values())) <= 17


def test_scores_and_slopes_are_those_of_whole_histories(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{sf}/lineitem.parquet'")
    whole = Operator("", "", "SELECT * FROM {quotes}").run(spark, sf)
    small = quotes.dealt(whole, span=10**9, block=150)
    assert small.groupBy("symbol", "block").count().agg({"count": "max"}).first()[0] <= 150 + quotes.REACH
    for name in ("l02_liquidity_score", "l03_spread_trend"):
        df = quotes.in_blocks(name, small)
        cols = sorted(df.columns)
        want = con.execute(f"SELECT {', '.join(cols)} FROM ({catalog.oracle_sql()[name]}) q").fetchall()
        canon = lambda rows: sorted((tuple(None if v is None else f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in rows), key=str)
        assert canon(df.select(*cols).collect()) == canon(want)
        plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "block" in plan
