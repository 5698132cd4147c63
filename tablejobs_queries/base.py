"""Query registry and helpers shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tablejobs.functions.types import quote
from tablejobs.session import Namespace, load_table, load_tables
from tablejobs.sources.tables import table_location

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with its oracle SQL."""
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn
    return register


def folder(sf_dir: str) -> dict:
    return {"format": "folder", "path": sf_dir}


def time_text(df: DataFrame) -> DataFrame:
    """Timestamps as text to the second (the tables hold whole seconds where
    this is used)."""
    return df.select([
        (F.date_format(quote(f.name), "yyyy-MM-dd HH:mm:ss").alias(f.name)
         if isinstance(f.dataType, T.TimestampNTZType) else F.col(quote(f.name)))
        for f in df.schema.fields])


def current_rows(spark: SparkSession, ns: Namespace, table: str) -> DataFrame:
    """The table's present version, readable after the namespace is dropped."""
    location = table_location(spark, ns.name, table)
    schema = spark.table(f"`{ns.name}`.`{table}`").schema
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(location)


ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, " \
    "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority"

LINE_ORDER = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
              "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
              "l_shipdate"]

__all__ = ["LINE_ORDER", "ORDER_COLUMNS", "current_rows", "folder", "load_table", "load_tables",
           "query", "time_text"]
