"""Query registry: a Spark callable and, where SQL can say it, an independent SQL text."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from ..session import configure
from .bindings import Entities, with_entities


class Plan(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


PLANS: dict[str, Plan] = {}


def plan(name: str, sql: str | None = None, uses: str = ""):
    """Register ``fn(entities) -> DataFrame``. ``uses`` names the entity views the SQL needs."""

    def register(fn: Callable[[Entities], DataFrame]):
        if name in PLANS:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Entities(configure(spark), sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        PLANS[name] = Plan(run, with_entities(uses.split(), sql) if sql else None)
        return fn

    return register
