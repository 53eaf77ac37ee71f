"""All of the engine's registered queries, with the SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

def _catalog():
    from tidewater.operators import analogs, assessments, candidates, decision, engines, readouts, rolling, scoring, snapshots, statistics, store, support, training  # noqa: F401  definitions register themselves
    from tidewater.plans.dialect import CATALOG

    return CATALOG


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tidewater.operators import analogs, assessments, engines, folds, labels, lifecycle, members, newswords, payloads, quotes, readouts, recurrences, selection, similarity, training

    return {name: op.run for name, op in _catalog().items()} | folds.QUERIES | readouts.QUERIES | engines.QUERIES | newswords.QUERIES | training.QUERIES | analogs.QUERIES | members.QUERIES | selection.QUERIES | lifecycle.QUERIES | payloads.QUERIES | labels.QUERIES | assessments.QUERIES | recurrences.QUERIES | similarity.QUERIES | quotes.QUERIES


def oracle_sql() -> dict[str, str]:
    from tidewater.operators import analogs, labels, lifecycle, newswords, payloads, readouts, recurrences, training
    from tidewater.plans import assessment_oracles, oracles

    return {name: op.oracle() for name, op in _catalog().items()} | readouts.oracle_sql() | oracles.oracle_sql() | newswords.ORACLES | training.oracle_sql() | analogs.oracle_sql() | lifecycle.oracle_sql() | payloads.ORACLES | labels.oracle_sql() | assessment_oracles.oracle_sql() | recurrences.oracle_sql()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candles to momentum and their normalised companions."""
    return _catalog()["p05_momentum"].run(spark, sf_dir)
