"""Registration of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.session import pin_utc
from lectern.sources.store import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


# Tables whose rows take long to process.
TEXT_TABLES = {"documents", "pages", "part", "conversations"}


class Inputs:
    """The given tables, read on demand."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        path = f"{self.path}/{name}.parquet"
        return read_table(self.spark, path) if name in TEXT_TABLES else self.spark.read.parquet(path)


def query(name: str, sql: str | None = None):
    """Registers ``build(inputs)`` under a name, with the equivalent SQL if there is one."""

    def register(build: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = lambda spark, path: build(Inputs(pin_utc(spark), path))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register
