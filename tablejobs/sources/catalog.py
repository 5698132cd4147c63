"""Catalogue list and schema description of a table set."""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from ..functions.types import is_nested, quote, text
from ..session import small_frame
from . import tables

DESCRIBE = ("table_name string, position int, column_name string, data_type string, "
            "nullable boolean, default_value string, column_key string")


def catalogue(spark: SparkSession, spec: dict, names: list[str] | None = None) -> DataFrame:
    """name, object_type, schema_name, size_bytes, row_count of each table."""
    label = spec.get("database") or spec.get("path") or spec["format"]
    parts = []
    for name in names or tables.table_names(spark, spec):
        size = tables.table_bytes(spark, spec, name)
        parts.append(tables.read_table(spark, spec, name).selectExpr("count(1) AS row_count").selectExpr(
            f"{text(name)} AS name", "'TABLE' AS object_type", f"{text(label)} AS schema_name",
            f"{size}L AS size_bytes", "row_count"))
    return reduce(DataFrame.unionByName, parts)


def describe(spark: SparkSession, frames: dict[str, DataFrame],
             keys: dict[str, list[str]] | None = None,
             defaults: dict[tuple[str, str], str] | None = None,
             required: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per column from the schemas alone; reads no data."""
    keys, defaults, required = keys or {}, defaults or {}, required or {}
    rows = []
    for table, df in frames.items():
        fixed = set(keys.get(table, [])) | set(required.get(table, []))
        for i, f in enumerate(df.schema.fields, start=1):
            rows.append((table, i, f.name, f.dataType.simpleString(),
                         f.nullable and f.name not in fixed,
                         defaults.get((table, f.name)),
                         "PRI" if f.name in keys.get(table, []) else ""))
    return small_frame(spark, rows, DESCRIBE)


def null_counts(df: DataFrame, table: str, columns: list[str] | None = None) -> DataFrame:
    """table_name, column_name, row_count, null_count in one pass over ``df``."""
    columns = columns or df.columns
    counted = df.selectExpr("count(1) AS _rows", *[
        f"count({quote(c)}) AS _n{i}" for i, c in enumerate(columns)])
    cells = ", ".join(f"{text(c)}, _rows - _n{i}" for i, c in enumerate(columns))
    return counted.selectExpr(
        f"{text(table)} AS table_name", "_rows AS row_count",
        f"stack({len(columns)}, {cells}) AS (column_name, null_count)")


@contextmanager
def _footer_reads(spark: SparkSession):
    """Within, counts over parquet files are answered from the files' footers."""
    own = {"spark.sql.sources.useV1SourceList": lambda v: ",".join(x for x in v.split(",") if x != "parquet"),
           "spark.sql.parquet.aggregatePushdown": lambda v: "true"}
    before = {key: spark.conf.get(key) for key in own}
    try:
        for key, change in own.items():
            spark.conf.set(key, change(before[key]))
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def footer_counts(spark: SparkSession, paths: dict[str, str]) -> dict[tuple[str, str], tuple[int, int]]:
    """(rows, NULLs) by table and column of parquet tables, from their footers;
    only nested columns, of which footers keep no counts, are read."""
    out = {}
    with _footer_reads(spark):
        for table, path in paths.items():
            df = spark.read.parquet(path)
            nested = [f.name for f in df.schema.fields if is_nested(f.dataType)]
            plain = [c for c in df.columns if c not in nested]
            for part in filter(None, (plain, nested)):
                for r in null_counts(df.select([quote(c) for c in part]), table).collect():
                    out[table, r.column_name] = (r.row_count, r.null_count)
    return out


def describe_measured(spark: SparkSession, frames: dict[str, DataFrame],
                      keys: dict[str, list[str]] | None = None,
                      defaults: dict[tuple[str, str], str] | None = None,
                      paths: dict[str, str] | None = None) -> DataFrame:
    """``describe`` with nullability taken from the data, since parquet tables
    keep no NOT NULL: a column is nullable if it holds a NULL now.

    Tables whose parquet folder ``paths`` names are described from file footers;
    the others are read once, here. What comes back is one row per column, so a
    compare that uses the description several times reads no table again. To
    compare declared schemas only, ``describe`` reads no data at all.
    """
    keys, defaults = keys or {}, defaults or {}
    counts = footer_counts(spark, {t: p for t, p in (paths or {}).items() if t in frames})
    scanned = [null_counts(df, table) for table, df in frames.items() if table not in (paths or {})]
    if scanned:
        counts |= {(r.table_name, r.column_name): (r.row_count, r.null_count)
                   for r in reduce(DataFrame.unionByName, scanned).collect()}
    rows = []
    for table, df in frames.items():
        for i, f in enumerate(df.schema.fields, start=1):
            row_count, null_count = counts[table, f.name]
            rows.append((table, i, f.name, f.dataType.simpleString(), null_count > 0,
                         defaults.get((table, f.name)),
                         "PRI" if f.name in keys.get(table, []) else "",
                         row_count, null_count))
    return small_frame(spark, rows, DESCRIBE + ", row_count long, null_count long")


_DESCRIBED = ("struct<table_name:string, type:string, provider:string, location:string, view_text:string, "
              "columns:array<struct<name:string, type:struct<name:string>, nullable:boolean, default:string>>>")


def describe_stored(spark: SparkSession, database: str) -> DataFrame:
    """Tables and views of a database as the catalogue holds them: one row per
    column with the table's type (EXTERNAL, MANAGED, VIEW), the column's
    place, type name, nullability and default expression.

    Each object's ``DESCRIBE TABLE EXTENDED ... AS JSON`` is one text, bounded
    by its schema; all are parsed together by ``from_json`` and exploded."""
    from pyspark.sql import functions as F

    names = [r.tableName for r in spark.sql(f"SHOW TABLES IN {quote(database)}").collect() if not r.isTemporary]
    texts = [(n, spark.sql(f"DESCRIBE TABLE EXTENDED {quote(database)}.{quote(n)} AS JSON").first()[0])
             for n in sorted(names)]
    parsed = small_frame(spark, texts, "object string, json string").select(
        F.from_json("json", _DESCRIBED).alias("d"))
    return parsed.select("d.table_name", F.col("d.type").alias("table_type"), "d.provider",
                         F.posexplode("d.columns").alias("position", "c")).select(
        "table_name", "table_type", (F.col("position") + 1).alias("position"), F.col("c.name").alias("column_name"),
        F.col("c.type.name").alias("data_type"), F.col("c.nullable").alias("nullable"),
        F.col("c.default").alias("default_value"))
