"""Find text in tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.scalars import contains_text
from ..functions.types import quote
from ..session import small_frame

MATCH = "table_name string, column_name string, value string, row string"


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def find_in_table(df: DataFrame, table: str, needle: str, keys: list[str] | None,
                  per_table: int | None = None) -> DataFrame:
    """Hits in the text columns of one table, one per (row, column).

    The limit counts rows. With ``keys`` the first rows by key are taken (a
    top-n with partial results per task); without, any rows, which stops early.
    """
    columns = text_columns(df)
    hit = reduce(lambda a, b: a | b, [contains_text(F.col(quote(c)), needle) for c in columns])
    rows = df.where(hit)
    if per_table is not None:
        rows = (rows.orderBy(*keys) if keys else rows).limit(per_table)
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(quote(c)).alias("value"))
                      for c in columns])
    row = F.to_json(F.struct(*[F.col(quote(c)) for c in df.columns]), {"ignoreNullFields": "false"})
    return (rows.select(row.alias("row"), F.explode(cells).alias("c"))
            .where(contains_text(F.col("c.value"), needle))
            .select(F.lit(table).alias("table_name"), "c.column_name", "c.value", "row"))


def find_in_tables(spark: SparkSession, frames: dict[str, DataFrame], needle: str,
                   keys: dict[str, list[str]] | None = None,
                   max_tables: int | None = None, per_table: int | None = None) -> DataFrame:
    """Hits over many tables; tables without text columns are passed over. An
    empty needle finds nothing. All tables and rows are searched unless the
    caller sets a limit."""
    needle = needle.strip()
    parts = []
    if needle:
        for table, df in list(frames.items())[:max_tables]:
            if text_columns(df):
                parts.append(find_in_table(df, table, needle, (keys or {}).get(table), per_table))
    return reduce(DataFrame.unionByName, parts) if parts else small_frame(spark, [], MATCH)
