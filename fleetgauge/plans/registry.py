"""Registry of named jobs. A job is a Spark callable and, where SQL can say it, the SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetgauge.plans.views import SQL_VIEWS

Job = Callable[[SparkSession, str], DataFrame]

JOBS: dict[str, Job] = {}
CHECKS: dict[str, str] = {}


def with_views(body: str, views: str = "", ctes: dict[str, str] | None = None) -> str:
    """``body`` behind the CTEs of the named input views (and extra CTEs)."""
    needed: list[str] = []

    def need(name: str) -> None:
        requires, _ = SQL_VIEWS[name]
        for r in requires:
            need(r)
        if name not in needed:
            needed.append(name)

    for v in views.split():
        need(v)
    parts = [f"{n} AS ({SQL_VIEWS[n][1]})" for n in needed]
    parts += [f"{n} AS ({sql})" for n, sql in (ctes or {}).items()]
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body


def job(key: str, sql: str | None = None, views: str = "", ctes: dict[str, str] | None = None):
    """Register a job under its inventory key."""

    def register(fn: Job) -> Job:
        if key in JOBS:
            raise ValueError(f"{key} registered twice")
        JOBS[key] = fn
        if sql is not None:
            CHECKS[key] = with_views(sql, views, ctes)
        return fn

    return register
