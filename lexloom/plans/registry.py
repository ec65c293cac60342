"""Registered queries: a Spark plan, the survey rows it covers, and SQL for a second engine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lexloom.plans.tables import VIEWS, check_sql, table, view
from lexloom.session import spread

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    plan: Plan
    check: str | None


REGISTRY: dict[str, Query] = {}


class Inputs:
    """Given tables by ``t.orders`` and derived tables by ``t.docs``."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def spread(self, name: str) -> DataFrame:
        """A table dealt out over all cores, for expensive work per row."""
        if name in VIEWS:
            return view(self.spark, self.sf_dir, name, dealt=True)
        return spread(getattr(self, name))

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return view(self.spark, self.sf_dir, name)
        return table(self.spark, self.sf_dir, name)


def query(covers: str, views: tuple[str, ...] = (), check: str | None = None):
    """Register ``fn(t)`` under its own name. ``views`` are the derived tables the check uses."""

    def register(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        name = fn.__name__
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        sql = None if check is None else check_sql(list(views), check)
        REGISTRY[name] = Query(name, covers, lambda spark, d: fn(Inputs(spark, d)), sql)
        return fn

    return register
