"""Snapshot of chosen tables to a folder, and restore."""

from __future__ import annotations

import json
import time

from pyspark.sql import SparkSession, types as T

from ..session import Namespace, in_parallel, small_frame
from ..sinks import store
from ..sources import tables as source_tables

MANIFEST = "table_name string, n_rows long, schema_json string"


def take_snapshot(spark: SparkSession, source: dict, names: list[str], path: str,
                  parallelism: int = 4) -> tuple[int, float]:
    """Write tables and a manifest; missing tables are passed over. Returns the
    table count and the seconds taken.

    The manifest is written last: a folder without one is no snapshot.
    """
    start = time.monotonic()

    def save(name: str) -> tuple:
        df = source_tables.read_table(spark, source, name)
        df.write.parquet(f"{path}/tables/{name}")
        rows = spark.read.schema(df.schema).parquet(f"{path}/tables/{name}").count()
        return name, rows, df.schema.json()

    found = [n for n in names if source_tables.has_table(spark, source, n)]
    entries = in_parallel(spark, save, found, parallelism)
    small_frame(spark, entries, MANIFEST).coalesce(1).write.json(f"{path}/manifest")
    return len(entries), time.monotonic() - start


def restore_snapshot(spark: SparkSession, path: str, target: Namespace,
                     parallelism: int = 4) -> tuple[int, list[str]]:
    """Write the snapshot's tables to a namespace; a table that fails, or whose
    rows do not match the manifest, is reported and the rest goes on."""

    def load(entry) -> str | None:
        schema = T.StructType.fromJson(json.loads(entry.schema_json))
        try:
            df = spark.read.schema(schema).parquet(f"{path}/tables/{entry.table_name}")
            found = df.count()
            if found != entry.n_rows:
                raise ValueError(f"{entry.table_name}: {found} rows, expected {entry.n_rows}")
            store.write_table(target, entry.table_name, df)
        except Exception as e:
            return str(e).split("\n")[0]

    entries = spark.read.schema(MANIFEST).json(f"{path}/manifest").collect()
    results = in_parallel(spark, load, entries, parallelism)
    errors = [r for r in results if r is not None]
    return len(results) - len(errors), errors
