"""Collects the queries and oracle SQL of the engine's own modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .functions import similarity, templates, text
from .operators import baseline, coverage, extract, filters, hooks, joins, ordered, paths, placed, stats, variants
from .plans import scenario
from .sources import containers, documents, samples, stores
from .streaming import stateful, timers

MODULES = [baseline.R, coverage.R, extract.R, filters.R, hooks.R, joins.R, ordered.R, paths.R, placed.R, stats.R, variants.R, scenario.R, containers.R, documents.R, samples.R, stores.R, stateful.R, timers.R, similarity.R, templates.R, text.R]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
