import pytest
from pyspark.sql import functions as F

from tests.test_kernels import CLOSES, series
from tidewater.functions import kernels
from tidewater.plans import catalog
from tidewater.plans.dialect import CATALOG

catalog.queries()


@pytest.mark.parametrize("method, query, column, n", [("zscore", "k01_rolling_zscore", "z_50", 50), ("minmax", "k02_rolling_minmax", "mm_20", 20), ("robust", "k03_rolling_robust", "rb_20", 20), ("percentile", "k04_percentile_rank", "pr_20", 20), ("winsorize", "k06_winsorize", "wins_50", 50)])
def test_builders_equal_the_operators(spark, method, query, column, n):
    candles = series(spark, CLOSES)
    w = kernels.frame(["symbol"], "ts")
    sr = candles.withColumn("sr", F.col("close") / F.lag("close").over(w) - 1)
    if method in ("percentile", "winsorize"):
        sr = sr.where("sr IS NOT NULL")
    got = {r["ts"]: r["sr_z"] for r in kernels.normalise(sr, ["sr"], method, ["symbol"], "ts", n).collect()}
    for r in CATALOG[query].apply(spark, candles=candles).collect():
        a, b = got[r["ts"]], r[column]
        assert (a is None) == (b is None) and (a is None or abs(a - b) < 2e-6)


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        kernels.normalise(series(spark, CLOSES), ["close"], "nope", ["symbol"], "ts")
