"""All queries and their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.plans import glossary, pages, relational, toolkit  # noqa: F401  # the modules register their queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def bind(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views over the tables of a folder; nothing is read yet but schemas."""
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def _sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bind(spark, sf_dir)
        return spark.sql(text)

    return run


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolkit.baseline_apply(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _sql(spark_sql) for k, (spark_sql, _) in relational.QUERIES.items()} | toolkit.queries()


def oracle_sql() -> dict[str, str]:
    return {k: duck or spark_sql for k, (spark_sql, duck) in relational.QUERIES.items()} | toolkit.ORACLES
