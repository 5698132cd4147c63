"""Column mapping, row handles, defaults and dense ids."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.types import quote, text as sql_text
from .ordering import number_rows


@dataclass(frozen=True)
class ColumnMapping:
    source: str
    target: str | None = None
    skip: bool = False
    default: Any = None


def map_columns(df: DataFrame, mappings: list[ColumnMapping], when_null: bool = False) -> DataFrame:
    """Rename, skip or set columns; columns without a mapping pass as they are.

    A default replaces the source value always, or only a NULL one with
    ``when_null``.
    """
    by_source = {m.source: m for m in mappings}
    out = []
    for field in df.schema.fields:
        m = by_source.get(field.name, ColumnMapping(field.name))
        if m.skip:
            continue
        value = F.col(quote(field.name))
        if m.default is not None:
            fixed = F.lit(m.default).cast(field.dataType)
            value = F.coalesce(value, fixed) if when_null else fixed
        out.append(value.alias(m.target or field.name))
    if not out:
        raise ValueError("the mappings leave no column")
    return df.select(out)


def row_handle(df: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``handle``, the struct of the key columns."""
    return df.withColumn("handle", F.struct(*[F.col(quote(k)) for k in keys]))


def preview(df: DataFrame, keys: list[str] | None = None, n: int = 100) -> DataFrame:
    return (df.orderBy(*keys) if keys else df).limit(n)


def default_expression(raw: str | None, dtype: T.DataType) -> str | None:
    """SQL text of a column default as another system states it.

    Casts of the ``'x'::type`` form are cut off, zero dates become 1970-01-01,
    sequence calls and NULL mean no default.
    """
    if raw is None or not raw.strip() or "nextval" in raw.lower():
        return None
    text = raw.strip()
    quoted = re.match(r"'(?:[^']|'')*'", text)  # a cast follows the quoted text, not inside it
    text = quoted.group() if quoted else text.split("::", 1)[0].strip()
    if text.upper() in ("NULL", ""):
        return None
    if text.strip("'").startswith("0000-00-00"):
        text = "'1970-01-01'"
    if text.upper() in ("NOW()", "SYSDATE", "SYSTIMESTAMP", "LOCALTIMESTAMP"):
        text = "CURRENT_TIMESTAMP"
    if text.startswith("'"):
        text = sql_text(text[1:-1].replace("''", "'"))
    elif isinstance(dtype, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)) and not re.match(
            r"(?i)current_|[a-z_]+\(", text):
        text = sql_text(text)  # bare text
    return f"CAST({text} AS {dtype.simpleString()})"


def fill_defaults(df: DataFrame, schema: T.StructType, defaults: dict[str, str],
                  when_null: bool = False) -> DataFrame:
    """Shape ``df`` to ``schema``: a column that is missing takes its default;
    with ``when_null`` a NULL does too."""
    have = set(df.columns)
    out = []
    for f in schema.fields:
        value = F.col(quote(f.name)).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        text = default_expression(defaults.get(f.name), f.dataType)
        if text is not None and f.name not in have:
            value = F.expr(text)
        elif text is not None and when_null:
            value = F.coalesce(value, F.expr(text))
        out.append(value.alias(f.name))
    return df.select(out)


def auto_increment_columns(described: DataFrame) -> DataFrame:
    """The columns of a ``describe`` frame that number their rows themselves, as
    their default says: a sequence call, an identity or an auto-increment."""
    return described.where(F.lower("default_value").rlike(r"nextval\(|auto_?increment|identity")).select(
        "table_name", "column_name")


def continue_ids(df: DataFrame, target: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """Number ``df`` in the given order from the target's highest ``name`` on; from
    1 where the target has none."""
    highest = target.agg(F.coalesce(F.max(quote(name)), F.lit(0)).cast("long")).first()[0]
    return add_dense_ids(df, order, name, highest + 1)


def add_dense_ids(df: DataFrame, order: list[str], name: str = "id", start: int = 1) -> DataFrame:
    """Add consecutive ids from ``start`` in the given order."""
    return (number_rows(df, order, "_pos")
            .select((F.col("_pos") + start).alias(name), *[quote(c) for c in df.columns]))
