"""Queries by name, with the SQL they are held against."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, tables: str, sql: str | None = None):
    """Register a function of the named tables."""

    def add(build):
        QUERIES[name] = lambda spark, sf_dir: build(*[table(spark, sf_dir, t) for t in tables.split()])
        if sql:
            ORACLES[name] = sql
        return build

    return add
