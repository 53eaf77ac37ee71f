"""Rolling kernels as Column builders, for use on any DataFrame; ``normalise`` picks one by name.

A frame is ``Window.partitionBy(...).orderBy(...)``; each builder adds its own rows. Values stay null where a window is
short or flat, and no division can fail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def frame(keys: list[str], order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def _rows(w: WindowSpec, n: int, upto: int = 0) -> WindowSpec:
    return w.rowsBetween(-(n - 1 + upto), -upto)


def zscore(v: Column, w: WindowSpec, n: int = 100, least: int | None = None) -> Column:
    o = _rows(w, n)
    sd = F.stddev_pop(v).over(o)
    return F.when(v.isNotNull() & (F.count(v).over(o) >= (least or max(10, n // 10))) & (sd > 1e-12), (v - F.avg(v).over(o)) / F.nullif(sd, F.lit(0.0)))


def minmax(v: Column, w: WindowSpec, n: int = 100, least: int = 10) -> Column:
    o = _rows(w, n)
    low, high = F.min(v).over(o), F.max(v).over(o)
    return F.when(v.isNotNull() & (F.count(v).over(o) >= least), (v - low) / F.nullif(high - low, F.lit(0.0)))


def robust(v: Column, w: WindowSpec, n: int = 100, least: int = 10) -> Column:
    o = _rows(w, n)
    q = lambda p: F.percentile(v, F.lit(p)).over(o)
    return F.when(v.isNotNull() & (F.count(v).over(o) >= least), (v - q(0.5)) / F.nullif(q(0.75) - q(0.25), F.lit(0.0)))


def percentile_rank(v: Column, w: WindowSpec, n: int = 100, least: int = 10) -> Column:
    held = F.collect_list(v).over(_rows(w, n))
    return F.when(v.isNotNull() & (F.size(held) >= least), F.size(F.filter(held, lambda x: x <= v)) / F.size(held))


def log_transform(v: Column, *_: object) -> Column:
    return F.signum(v) * F.log1p(F.abs(v))


def winsorize(v: Column, w: WindowSpec, n: int = 100, least: int = 10, low: float = 0.05, high: float = 0.95) -> Column:
    """Clamped to the order statistics of the prior n rows; the current row is no part of them."""
    held = F.array_sort(F.collect_list(v).over(_rows(w, n, 1)))
    k = F.size(held)
    at = lambda q, up: F.element_at(held, ((F.ceil if up else F.floor)(F.lit(q) * (k - 1)) + 1).cast("int"))
    return F.when(k < least, v).otherwise(F.least(F.greatest(v, at(low, False)), at(high, True)))


def slope(v: Column, position: Column, w: WindowSpec, n: int) -> Column:
    o = _rows(w, n)
    return F.when(F.count(v).over(o) == n, F.regr_slope(v, position).over(o))


def correlation(a: Column, b: Column, w: WindowSpec, n: int) -> Column:
    o = _rows(w, n)
    r = F.covar_pop(a, b).over(o) / F.nullif(F.sqrt(F.var_pop(a).over(o) * F.var_pop(b).over(o)), F.lit(0.0))
    return F.when(F.count(a * b).over(o) == n, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r)))


METHODS = {"zscore": zscore, "minmax": minmax, "robust": robust, "percentile": percentile_rank, "log": log_transform, "winsorize": winsorize}


def normalise(df: DataFrame, columns: list[str], method: str, keys: list[str], order: str, n: int = 100, suffix: str = "_z") -> DataFrame:
    """Companion columns by a method's name, all on one window specification; unknown names raise."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {sorted(METHODS)}")
    w = frame(keys, order)
    return df.select("*", *[METHODS[method](F.col(c), w, n).alias(f"{c}{suffix}") for c in columns])
