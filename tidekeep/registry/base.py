"""Register of named queries: a Spark callable and, where SQL can say it, a DuckDB text."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidekeep import fixtures
from tidekeep.session import configure


@dataclass
class Query:
    build: Callable[["Inputs"], DataFrame]
    sql: str | None


class Inputs:
    """Tables and views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = configure(spark), sf_dir

    def table(self, name: str) -> DataFrame:
        return fixtures.table(self.spark, self.sf_dir, name)

    def view(self, name: str) -> DataFrame:
        return fixtures.view(self.spark, self.sf_dir, name)


REGISTRY: dict[str, Query] = {}


def query(name: str, views=(), sql: str | None = None):
    """Registers the decorated builder; ``views`` are the views its SQL text reads.

    A text that starts with a comma adds its own common table expressions.
    """
    def register(build):
        text = None
        if sql is not None:
            text = (fixtures.with_views(*views) if views else "") + sql.strip()
        REGISTRY[name] = Query(build, text)
        return build
    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build):
        return lambda spark, sf_dir: build(Inputs(spark, sf_dir))
    return {name: bind(q.build) for name, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in REGISTRY.items() if q.sql is not None}
