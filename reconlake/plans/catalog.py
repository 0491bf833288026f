"""The registry of queries: a Spark form for each, and SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reconlake.plans.views import Views, with_views

Build = Callable[[Views], DataFrame]
REGISTRY: dict[str, tuple[Build, str | None]] = {}


def query(name: str, sql: str | None = None, dates: tuple[str, ...] = ()):
    """Register a query under a name; `sql` may use the views' names and the input tables. `dates` are shown as text."""

    def add(build: Build) -> Build:
        shown = (lambda v: build(v).withColumns({c: F.col(c).cast("string") for c in dates})) if dates else build
        texts = ", ".join(f"CAST({c} AS string) AS {c}" for c in dates)
        REGISTRY[name] = (shown, f"SELECT * REPLACE ({texts}) FROM ({with_views(sql)})" if sql and dates else with_views(sql) if sql else None)
        return build

    return add


def _load() -> None:
    from reconlake.plans import queries_closing, queries_files, queries_journals, queries_match, queries_parties, queries_report, queries_rules, queries_text, queries_upkeep  # noqa: F401  they register themselves


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, sf_dir, build=build: build(Views(spark, sf_dir))) for name, (build, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
