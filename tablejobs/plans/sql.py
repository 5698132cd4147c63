"""User SQL over a table set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def run_sql(spark: SparkSession, text: str, frames: dict[str, DataFrame] | None = None) -> DataFrame:
    """Run SQL text; ``{name}`` in it stands for the DataFrame of that name, so
    no temporary view is left in the session."""
    return spark.sql(text, **(frames or {}))


def create_function(spark: SparkSession, name: str, params: str, returns: str, body: str) -> None:
    """A SQL scalar function of this session; Catalyst inlines its body."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {returns} RETURN {body}")
