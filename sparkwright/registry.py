"""All queries of the engine's own operators by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from sparkwright.plans import annotations, backtests, bundle, domain, ensembles, event_study, places, profile, staging, studies, traces, traces_sql, trips
from sparkwright.sources import variants

Query = Callable[[SparkSession, str], DataFrame]


def trace_query(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return (traces.ALL | annotations.ALL)[name](bundle.stand_in(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly panel, baseline of the first days, scores, runs of peaks."""
    return domain.panel_scores(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: partial(trace_query, name) for name in traces.ALL | annotations.ALL} | domain.QUERIES | studies.QUERIES | ensembles.QUERIES | backtests.QUERIES | event_study.QUERIES | places.QUERIES | profile.QUERIES | staging.QUERIES | trips.QUERIES | variants.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: traces_sql.sql(name) for name in traces.ALL} | {name: traces_sql.over_bundle(text) for name, text in annotations.SQL.items()} | domain.SQL | studies.SQL | ensembles.SQL | backtests.SQL | event_study.SQL | profile.SQL | staging.SQL | trips.SQL | variants.SQL
