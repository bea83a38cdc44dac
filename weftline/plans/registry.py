"""Every query of the page engine by name, and the SQL that it must equal. All run over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.plans import content, jobs, links, ordered, pages, rendered, reports, stats

_MODULES = (links, content, ordered, reports, rendered, jobs, stats, pages)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for m in _MODULES for n, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for m in _MODULES for n, (_, s) in m.QUERIES.items() if s}
