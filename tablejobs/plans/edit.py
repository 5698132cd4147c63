"""Edit batch: apply a change set to a table, all or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..functions.types import quote
from ..operators.merge import ConflictError, duplicate_keys, edit_states, existing_keys
from ..session import Namespace, materialize
from ..sinks import store

STATES = ("modified", "added", "deleted")


def apply_edits(spark: SparkSession, ns: Namespace, table: str, changes: DataFrame,
                keys: list[str], by_file: bool = False) -> dict[str, int]:
    """Write the edited table as a new version; returns affected row counts.

    Without keys nothing can be addressed, so the batch is refused. An insert
    whose key exists fails the whole batch and leaves the table as it was.
    ``by_file`` rewrites only the files that hold an updated or deleted key
    (see ``store.rewrite_files``); ``files`` then counts them.
    """
    if not keys:
        raise ValueError(f"table {table} has no primary key")
    base = spark.table(store.qualified(ns, table))
    before = store.state(spark, ns, table)
    changes = materialize(changes, "changes")
    inserts = changes.where("op = 'insert'")
    if not duplicate_keys(inserts, keys).isEmpty() or not existing_keys(base, inserts, keys).isEmpty():
        raise ConflictError(f"the batch adds rows whose {keys} exist")
    files = None
    if by_file:
        store.finish_rewrites(spark, ns, table)
        files = store.touched_files(base, changes.where("op <> 'insert'"), keys)
        base = spark.read.schema(base.schema).parquet(*files) if files else base.limit(0)
    # Counted while the new version is written, in the same pass.
    seen = Observation()
    states = edit_states(base, changes, keys).observe(seen, *[
        F.count_if(F.col("row_state") == s).alias(s) for s in STATES])
    kept = states.where("row_state IS NULL OR row_state <> 'deleted'").select(*[quote(c) for c in base.columns])
    if files is None:
        store.write_table(ns, table, kept, before)
    else:
        store.rewrite_files(ns, table, files, kept, before)
    counts = {s: seen.get[s] for s in STATES}
    return {**counts, "affected": sum(counts.values()), **({"files": len(files)} if files is not None else {})}
