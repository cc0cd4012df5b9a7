"""Where queries register: a Spark job, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .derived import with_views

Job = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Job] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: list[str] | None = None) -> Callable[[Job], Job]:
    def add(job: Job) -> Job:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = job
        if sql is not None:
            ORACLES[name] = with_views(views, sql) if views else sql
        return job

    return add


def rnd(x: str, n: int) -> str:
    """SQL of the shared rounding rule."""
    return f"(sign({x}) * floor(abs({x}) * 1e{n} + 0.5e0) / 1e{n} + 0.0e0)"


def clock(x: str) -> str:
    whole = f"greatest(0, cast(floor({x} + 0.5e0) as bigint))"
    return f"(cast({whole} // 60 as varchar) || ':' || lpad(cast({whole} % 60 as varchar), 2, '0'))"
