"""Writing Spark tables all or nothing.

A table is an external parquet table. A change writes a new version folder and
then points the table at it with ALTER TABLE ... SET LOCATION, so readers see
the old rows or the new rows. The folder that was current stays for readers that
have started; older ones go with ``drop_old_versions``. An append writes a folder
of its own beside the table's, which one rename puts into the version folder: all
its rows show at once, and appends at the same time do not touch each other.

All loads into a table bind the rows to its columns and types first; a value that
cannot be bound fails the load and leaves the table as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from .. import session
from ..functions.types import bind_to, quote
from ..operators.merge import (STRATEGIES, ConflictError, duplicate_keys, existing_keys, merge_load,
                               new_rows, one_per_key)
from ..session import Namespace
from ..sources.tables import table_location


def qualified(ns: Namespace, table: str) -> str:
    return f"{quote(ns.name)}.{quote(table)}"


def exists(spark: SparkSession, ns: Namespace, table: str) -> bool:
    return spark.catalog.tableExists(qualified(ns, table))


def new_version(ns: Namespace, table: str, job: str | None = None) -> str:
    """A folder nobody else uses; it carries the id of the job that writes it."""
    return f"{ns.root}/{table}/v-{job or 'none'}-{uuid.uuid4().hex}"


def state(spark: SparkSession, ns: Namespace, table: str) -> tuple[str, tuple[str, ...]]:
    """What the table holds now: its version folder and the loads in it."""
    location = table_location(spark, ns.name, table)
    loads = [p.rsplit("/", 1)[1] for p in session.path_children(spark, location)]
    return location, tuple(p for p in loads if p.startswith("load-"))


def written_by(spark: SparkSession, ns: Namespace, table: str, job: str) -> bool:
    """Whether the table's present rows came from, or include, this job's."""
    if not exists(spark, ns, table):
        return False
    location, loads = state(spark, ns, table)
    return (location.rsplit("/", 1)[1].startswith(f"v-{job}-")
            or any(name.startswith(f"load-{job}-") for name in loads))


def same_columns(a, b) -> bool:
    return [(f.name, f.dataType) for f in a.fields] == [(f.name, f.dataType) for f in b.fields]


def publish(spark: SparkSession, ns: Namespace, table: str, path: str, schema,
            expected: tuple | None = None) -> None:
    """Point the table at ``path``. With ``expected`` (the ``state`` the change
    was computed from) a table changed by someone else in between is refused."""
    name = qualified(ns, table)
    if exists(spark, ns, table):
        _unchanged(spark, ns, table, expected)
        if same_columns(spark.table(name).schema, schema):
            spark.sql(f"ALTER TABLE {name} SET LOCATION '{path}'")
            spark.catalog.refreshTable(name)
            return
        # Parquet tables take no column drop or rename; the files stay.
        spark.sql(f"DROP TABLE {name}")
    spark.catalog.createTable(name, path=path, source="parquet", schema=schema, recursiveFileLookup="true")


def _unchanged(spark: SparkSession, ns: Namespace, table: str, expected: tuple | None) -> None:
    if expected is not None and state(spark, ns, table) != expected:
        raise RuntimeError(f"table {table} was changed by another job")


def write_table(ns: Namespace, table: str, df: DataFrame, expected: tuple | None = None,
                job: str | None = None) -> int:
    """Replace the table's rows; returns the row count, read back from the new
    files' footers."""
    spark = df.sparkSession
    path = new_version(ns, table, job)
    try:
        df.write.parquet(path)
        rows = spark.read.schema(df.schema).parquet(path).count()
        publish(spark, ns, table, path, df.schema, expected)
    except Exception:
        session.delete_path(spark, path)
        raise
    return rows


DEFAULT_KEY = "CURRENT_DEFAULT"  # where Spark keeps a column's default expression


def bound(df: DataFrame, schema) -> DataFrame:
    """``df`` as a table of ``schema`` takes it. Columns the table lacks are
    refused; a column ``df`` lacks takes the table's default for it, else
    NULL; a value that does not fit fails when it is read."""
    unknown = set(df.columns) - set(schema.names)
    if unknown:
        raise ValueError(f"the table has no columns {sorted(unknown)}")
    for f in schema.fields:
        if f.name not in df.columns and DEFAULT_KEY in f.metadata:
            df = df.withColumn(f.name, F.expr(f.metadata[DEFAULT_KEY]).cast(f.dataType))
    return bind_to(df, schema)


def append_rows(ns: Namespace, table: str, df: DataFrame, expected: tuple | None = None,
                job: str | None = None) -> int:
    """Bulk append, all rows at once or none. With ``expected`` (a ``state``) a
    table that others have changed since is refused. Returns the number of rows,
    counted as they are written."""
    spark = df.sparkSession
    name = qualified(ns, table)
    staged = f"{ns.root}/{table}/staged-{uuid.uuid4().hex}"
    written = Observation()
    try:
        (bound(df, spark.table(name).schema).observe(written, F.count(F.lit(1)).alias("n_rows"))
         .write.parquet(staged))
        _unchanged(spark, ns, table, expected)
        load = f"load-{job or 'none'}-{uuid.uuid4().hex}"
        session.move_path(spark, staged, f"{table_location(spark, ns.name, table)}/{load}")
    except Exception:
        session.delete_path(spark, staged)
        raise
    spark.catalog.refreshTable(name)
    return written.get["n_rows"]


def check_strategy(strategy: str, keys: list[str] | None) -> None:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown conflict strategy {strategy}")
    if strategy != "error" and not keys:
        raise ValueError(f"conflict strategy {strategy} needs the table's keys")


def one_of_each(source: DataFrame, keys: list[str], strategy: str, order: str | None) -> DataFrame:
    """A source with one row for each key: replace takes the last and ignore the
    first by ``order``; otherwise repeated keys are refused."""
    if order is not None and strategy != "error":
        return one_per_key(source, keys, order, last=strategy == "replace")
    if not duplicate_keys(source, keys).isEmpty():
        raise ConflictError(f"the source has rows with the same {keys}")
    return source


def load_rows(ns: Namespace, table: str, source: DataFrame, keys: list[str] | None = None,
              strategy: str = "error", order: str | None = None, job: str | None = None,
              by_file: bool = False) -> int:
    """Load rows into an existing table by conflict strategy; returns how many
    rows came from the source.

    ignore and error only append; replace rewrites the table, or with
    ``by_file`` only the files that hold a replaced key. The source is
    staged once, as its keys and then its rows are read. ignore and replace need
    keys; without keys rows are appended as they are.
    """
    spark = source.sparkSession
    check_strategy(strategy, keys)
    if by_file and strategy == "replace":
        return replace_by_file(ns, table, source, keys, order, job)["rows"]
    target = spark.table(qualified(ns, table))
    if not keys:
        return append_rows(ns, table, source, job=job)
    before = state(spark, ns, table)
    if order is not None and strategy != "error":
        source = one_of_each(source, keys, strategy, order)
    source = session.materialize(bound(source, target.schema), "load")
    if order is None or strategy == "error":
        one_of_each(source, keys, strategy, None)
    if strategy == "replace":
        write_table(ns, table, merge_load(target, source, keys, "replace"), before, job)
        return source.count()
    if strategy == "error":
        if not existing_keys(target, source, keys).isEmpty():
            raise ConflictError(f"the target has rows with the same {keys}")
        return append_rows(ns, table, source, before, job)
    return append_rows(ns, table, new_rows(target, source, keys), before, job)


def touched_files(target: DataFrame, keyed: DataFrame, keys: list[str]) -> list[str]:
    """The files of the table's present version that hold a key of ``keyed``.

    Only key columns and the hidden file name are read; the result is one path
    per touched file, so its size is bound by the table's file count.
    """
    hits = (target.select(*[quote(k) for k in keys], F.col("_metadata.file_path").alias("_file"))
            .join(keyed.select(*[quote(k) for k in keys]).distinct(), keys, "left_semi"))
    return sorted(r._file for r in hits.select("_file").distinct().collect())


def _journal(ns: Namespace, table: str) -> str:
    return f"{ns.root}/{table}/retire"


def finish_rewrites(spark: SparkSession, ns: Namespace, table: str) -> int:
    """Complete file rewrites that stopped half-way; returns how many.

    A rewrite notes the files it retires before its new files go live. If the
    new files are in the table, the old ones still listed are deleted (roll
    forward); if not, the note and the staged files are dropped (roll back).
    """
    done = 0
    for note in session.path_children(spark, _journal(ns, table)):
        name = note.rsplit("/", 1)[1]
        location = table_location(spark, ns.name, table)
        if session.path_exists(spark, f"{location}/{name}"):
            for row in spark.read.text(note).collect():
                session.delete_uri(spark, row.value)
        else:
            session.delete_path(spark, f"{ns.root}/{table}/staged-{name}")
        session.delete_path(spark, note)
        done += 1
    return done


def rewrite_files(ns: Namespace, table: str, files: list[str], rows: DataFrame,
                  expected: tuple | None = None, job: str | None = None) -> int:
    """Put ``rows`` in the table in place of the rows of ``files``; the other
    files stay as they are. Returns the number of rows written.

    ``rows`` must not read ``files`` lazily after this returns: it is written
    once to a staged folder first. The staged folder then goes into the table
    by one rename, and the retired files are deleted after it; between the two
    a reader may see a replaced row twice. The list of retired files is noted
    first, so :func:`finish_rewrites` completes a rewrite cut off in between.
    """
    spark = rows.sparkSession
    finish_rewrites(spark, ns, table)
    name = qualified(ns, table)
    load = f"load-{job or 'none'}-{uuid.uuid4().hex}"
    staged = f"{ns.root}/{table}/staged-{load}"
    written = Observation()
    try:
        (bound(rows, spark.table(name).schema).observe(written, F.count(F.lit(1)).alias("n_rows"))
         .write.parquet(staged))
        _unchanged(spark, ns, table, expected)
        spark.createDataFrame([(f,) for f in files], "value string").coalesce(1).write.text(
            f"{_journal(ns, table)}/{load}")
        session.move_path(spark, staged, f"{table_location(spark, ns.name, table)}/{load}")
    except Exception:
        session.delete_path(spark, staged)
        session.delete_path(spark, f"{_journal(ns, table)}/{load}")
        raise
    for f in files:
        session.delete_uri(spark, f)
    session.delete_path(spark, f"{_journal(ns, table)}/{load}")
    spark.catalog.refreshTable(name)
    return written.get["n_rows"]


def replace_by_file(ns: Namespace, table: str, source: DataFrame, keys: list[str],
                    order: str | None = None, job: str | None = None) -> dict[str, int]:
    """The replace load that rewrites only the files holding a replaced key.

    Rows of the source whose key is new are added in the same step. Returns
    the rows loaded and the files rewritten.
    """
    spark = source.sparkSession
    check_strategy("replace", keys)
    finish_rewrites(spark, ns, table)
    target = spark.table(qualified(ns, table))
    before = state(spark, ns, table)
    if order is not None:
        source = one_of_each(source, keys, "replace", order)
    source = session.materialize(bound(source, target.schema), "load")
    if order is None:
        one_of_each(source, keys, "replace", None)
    files = touched_files(target, source, keys)
    old = spark.read.schema(target.schema).parquet(*files) if files else target.limit(0)
    rows = old.join(source.select(*[quote(k) for k in keys]), keys, "left_anti").unionByName(source)
    rewrite_files(ns, table, files, rows, before, job)
    return {"rows": source.count(), "files": len(files)}


def truncate_table(spark: SparkSession, ns: Namespace, table: str) -> None:
    """No rows, same columns."""
    write_table(ns, table, spark.table(qualified(ns, table)).limit(0))


def drop_table(spark: SparkSession, ns: Namespace, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {qualified(ns, table)}")
    session.delete_path(spark, f"{ns.root}/{table}")


def drop_old_versions(spark: SparkSession, ns: Namespace, table: str) -> int:
    """Delete version folders the table does not point at."""
    current = table_location(spark, ns.name, table).rsplit("/", 1)[1]
    old = [p for p in session.path_children(spark, f"{ns.root}/{table}")
           if p.rsplit("/", 1)[1] != current]
    for path in old:
        session.delete_path(spark, path)
    return len(old)


def write_jdbc(df: DataFrame, url: str, table: str, options: dict | None = None,
               batch: int = 500, mode: str = "append") -> None:
    """Append to a database table in batches. Every task commits its own rows,
    so the target's key must refuse a repeated task's rows."""
    (df.write.format("jdbc").mode(mode)
     .options(url=url, dbtable=table, batchsize=str(batch), **(options or {})).save())
