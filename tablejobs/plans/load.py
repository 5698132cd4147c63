"""File import into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..functions.scalars import csv_null
from ..functions.types import quote
from ..session import Namespace, materialize
from ..sinks import store
from ..sources.files import read_csv, read_json_lines, read_json_rows


def typed_rows(rows: DataFrame, schema) -> DataFrame:
    """Text rows as the target's columns. A value that does not fit fails the
    job, and with it the whole load; a column the file lacks is NULL."""
    unknown = set(rows.columns) - set(schema.names)
    if unknown:
        raise ValueError(f"no such column: {sorted(unknown)}")
    return rows.select([
        (csv_null(F.col(quote(f.name))).cast(f.dataType) if f.name in rows.columns
         else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


REJECTS = "column string, value string, reason string"


def checked_rows(rows: DataFrame, schema) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Text rows bound to ``schema`` in one pass, and the rows that do not fit.

    Every cell is converted with ``try_cast``; a cell whose text is set but
    whose value comes out NULL is refused. Both sides are written once (one
    table, split by a flag), and counted while that is written. Returns the
    good rows (typed), the refused rows (their text, plus ``_rejects``: column,
    value, reason of each refused cell) and the counts.
    """
    unknown = set(rows.columns) - set(schema.names)
    if unknown:
        raise ValueError(f"no such column: {sorted(unknown)}")
    typed, problems = [], []
    for f in schema.fields:
        if f.name in rows.columns:
            text = csv_null(F.col(quote(f.name)))
            value = text.try_cast(f.dataType) if f.dataType.simpleString() != "string" else text
            problems.append(F.when(text.isNotNull() & value.isNull(), F.struct(
                F.lit(f.name).alias("column"), text.alias("value"),
                F.lit(f"not a {f.dataType.simpleString()}").alias("reason"))))
        else:
            value = F.lit(None).cast(f.dataType)
        typed.append(value.alias(f.name))
    rejects = F.filter(F.array(*problems), lambda x: x.isNotNull()) if problems else F.array().cast(f"array<struct<{REJECTS.replace(' string', ':string')}>>")
    seen = Observation()
    both = materialize(rows.select(*[F.col(quote(c)).alias(f"_raw_{i}") for i, c in enumerate(rows.columns)],
                                   *typed, rejects.alias("_rejects"))
                       .observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.size("_rejects") > 0).alias("rejected")),
                       "checked")
    good = both.where(F.size("_rejects") == 0).select(*[quote(f.name) for f in schema.fields])
    bad = both.where(F.size("_rejects") > 0).select(
        *[F.col(f"_raw_{i}").alias(c) for i, c in enumerate(rows.columns)], "_rejects")
    return good, bad, dict(seen.get)


def import_file(spark: SparkSession, path: str, ns: Namespace, table: str,
                keys: list[str] | None = None, multi_line: bool = True, ragged: bool = False,
                on_error: str = "fail") -> int:
    """Append CSV (``multi_line=False``: no line breaks in fields, so files are
    split), JSON or JSON-lines files to a table; returns the number of rows.

    ``on_error="skip"`` loads the rows that fit and appends the others, with
    column, value and reason of each refused cell, to ``<table>_rejects``
    (made when missing); ``"fail"`` (the default) fails the load on the first
    value that does not fit and leaves the table as it was."""
    if path.endswith((".jsonl", ".ndjson")):
        rows = read_json_lines(spark, path)
    elif path.endswith(".json"):
        rows = read_json_rows(spark, path)
    else:
        rows = read_csv(spark, path, multi_line, ragged)
    schema = spark.table(store.qualified(ns, table)).schema
    if on_error == "fail":
        return store.load_rows(ns, table, typed_rows(rows, schema), keys)
    if on_error != "skip":
        raise ValueError(f"unknown on_error {on_error}")
    good, bad, counts = checked_rows(rows, schema)
    loaded = store.load_rows(ns, table, good, keys)
    refused = bad.select(*[F.col(quote(c)) for c in rows.columns], F.explode("_rejects").alias("_r")).select(
        *[F.col(quote(c)) for c in rows.columns], "_r.column", "_r.value", "_r.reason")
    if counts["rejected"]:
        name = f"{table}_rejects"
        if store.exists(spark, ns, name):
            store.append_rows(ns, name, refused)
        else:
            store.write_table(ns, name, refused)
    return loaded
