"""Registered queries and the SQL each one is checked against."""

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
CHECKS: dict = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function, with its DuckDB equivalent if SQL can say it."""
    def keep(function):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            CHECKS[name] = sql
        return function
    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
