"""Whole-namespace jobs and table changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.types import quote
from ..operators.reshape import reshape
from ..session import Namespace, create_namespace, delete_path, small_frame
from ..sinks import store
from ..sources.tables import table_names
from .transfer import TransferOptions, transfer


def duplicate_namespace(spark: SparkSession, source: dict, name: str, root: str,
                        parallelism: int = 4) -> Namespace:
    """Copy all tables into a new namespace, which goes again if one fails."""
    if name == source.get("database"):
        raise ValueError("the target must differ from the source")
    if spark.catalog.databaseExists(name):
        raise ValueError(f"namespace {name} exists")
    target = create_namespace(spark, name, root)
    result = transfer(spark, source, target, TransferOptions(
        tables=table_names(spark, source), parallelism=parallelism))
    if result.errors:
        spark.sql(f"DROP DATABASE {quote(name)} CASCADE")
        delete_path(spark, root)
        raise RuntimeError("; ".join(result.errors))
    return target


def reshape_table(spark: SparkSession, ns: Namespace, table: str, **changes) -> int:
    """Rewrite a table with changed columns (see ``operators.reshape``)."""
    before = store.state(spark, ns, table)
    return store.write_table(ns, table, reshape(spark.table(store.qualified(ns, table)), **changes),
                             before)


def add_columns(spark: SparkSession, ns: Namespace, table: str, columns: dict[str, tuple[str, str | None]]) -> None:
    """Add columns in the catalogue alone: ``ALTER TABLE ... ADD COLUMNS``. No
    file is written; rows stored before read NULL, or the column's default
    (a SQL expression) if it has one, which later loads also take for a
    missing column."""
    parts = [f"{quote(name)} {dtype}" + (f" DEFAULT {default}" if default is not None else "")
             for name, (dtype, default) in columns.items()]
    name = store.qualified(ns, table)
    spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(parts)})")
    spark.catalog.refreshTable(name)


def rename_table(spark: SparkSession, ns: Namespace, table: str, new_name: str) -> None:
    spark.sql(f"ALTER TABLE {store.qualified(ns, table)} RENAME TO {store.qualified(ns, new_name)}")


def create_table(spark: SparkSession, ns: Namespace, table: str, ddl: str) -> None:
    """An empty table from a column list such as ``id long, name string``."""
    if store.exists(spark, ns, table):
        raise ValueError(f"table {table} exists")
    store.write_table(ns, table, small_frame(spark, [], ddl))


def apply_sync(spark: SparkSession, ns: Namespace, plan: DataFrame, source: dict[str, DataFrame],
               drop: bool = False) -> list[str]:
    """Bring stored tables up to a ``sync_plan``: add missing columns (NULL in the
    rows there are; the catalogue changes, no file is written) and make missing
    tables, empty, with the source's columns.
    Tables only in the target go with ``drop`` alone. Returns the tables changed.

    The plan holds one row per table or column, so reading it is bounded by the
    schema."""
    steps = plan.select("table_name", "action", "column_name", "data_type").collect()
    added: dict[str, dict] = {}
    changed = []
    for r in steps:
        if r.action == "add_column":
            added.setdefault(r.table_name, {})[r.column_name] = (r.data_type, None)
        elif r.action == "create_table":
            store.write_table(ns, r.table_name, source[r.table_name].limit(0))
            changed.append(r.table_name)
        elif r.action == "drop_table" and drop:
            store.drop_table(spark, ns, r.table_name)
            changed.append(r.table_name)
    for table, columns in added.items():
        add_columns(spark, ns, table, columns)
        changed.append(table)
    return sorted(changed)
