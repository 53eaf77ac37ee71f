"""Every registered query has a twin in DuckDB that gives the same rows on the smallest tables."""

import math
from datetime import datetime

import duckdb
import pytest

from tidewater.plans import catalog
from tidewater.plans.dialect import TABLES, render

NAMES = sorted(catalog.oracle_sql())


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canon(rows):
    out = [tuple(None if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.5g}" if isinstance(v, float) else str(v) for v in r) for r in rows]
    return sorted(out, key=str)


@pytest.mark.parametrize("name", NAMES[::4])
def test_same_rows_as_duckdb(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    cols = sorted(df.columns)
    rel = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert canon(df.select(*cols).collect()) == canon([tuple(r[i] for i in at) for r in rel.fetchall()])


def test_render_splits_arguments_at_the_top_level():
    assert render("@g", duck=False) == ""
    assert render("@div(f(a, b), c)", duck=False) == "(CAST(f(a, b) AS DOUBLE) / nullif(CAST(c AS DOUBLE), 0.0))"
    assert render("@filter(a, @L(x) x > 1)", duck=True) == "list_filter(a, lambda x: x > 1)"
    assert render("@json(p, 'k')", duck=False) == "get_json_object(p, '$.k')"


def test_entry_works_without_the_llm_package():
    import __spark_entry__ as e

    assert set(catalog.oracle_sql()) <= set(catalog.queries()) <= set(e.queries())


def test_nulls_and_logarithms_of_zero_are_the_databases():
    assert render("max_by(v, id)", duck=True) == "max_by(v, id)" and render("@ln(x)", duck=True) == "ln(x)"
    assert render("max_by(f(v, 1), id)", duck=False) == "max_BY(f(v, 1), CASE WHEN (f(v, 1)) IS NOT NULL THEN id END)"


def _run(spark, folder, name, **tables):
    for t, rows in tables.items():
        rows.write.mode("overwrite").parquet(str(folder / f"{t}.parquet"))
    return catalog.queries()[name](spark, str(folder)).collect()


EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def test_an_event_of_a_fraction_of_a_second_starts_after_its_hour(spark, tmp_path):
    at = lambda h, us: datetime(2024, 1, 1, h, 0, 0, us)
    rows = [(k, at(h, 0), 1, "view", 5.0, "") for k, h in enumerate(range(0, 20))] + [(100, at(10, 500_000), 1, "purchase", 5.0, ""), (101, at(15, 0), 1, "purchase", 5.0, "")]
    got = _run(spark, tmp_path, "d13_event_activity", events=spark.createDataFrame(rows, EVENT))
    assert sorted(r["ts"].hour for r in got) == [10, 11, 14, 15, 16]  # not 9: half a second before the window


def test_temperature_of_a_sure_miss_is_infinite(spark, tmp_path):
    rows = [(96, 0, 0), (3, 1, 0)]  # 96 % 97 / 96 = 1
    got = {r["temp"]: r["nll"] for r in _run(spark, tmp_path, "h54_temperature", labels=spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))}
    assert got[0.25] == math.inf and got[10.0] < math.inf


def test_report_lookup_skips_reports_without_a_value(spark, tmp_path):
    rows = [(k, datetime(2024, 1, 1, k % 24, k // 24), 1, "view", float(k), "") for k in range(18, 35)]  # 34 has none
    got = _run(spark, tmp_path, "h75_report_lookup", events=spark.createDataFrame(rows, EVENT))
    assert {r["confidence"] for r in got} == {33.0}
