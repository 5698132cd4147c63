"""Table transfer: copy a list of tables from a source to a Spark namespace."""

from __future__ import annotations

import hashlib
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import session
from ..functions.types import to_lattice
from ..operators.filters import where_text
from ..operators.ordering import row_limit
from ..operators.project import ColumnMapping, map_columns
from ..session import Namespace
from ..sinks import store
from ..sources import tables as source_tables

STATS = ("table_name string, n_rows long, size_bytes long, duration_ms long, "
         "status string, error string")
MODES = ("structure_and_data", "structure_only", "data_only")
ERROR_MODES = ("skip", "skip_table", "stop")


@dataclass(frozen=True)
class TransferOptions:
    tables: list[str]
    mode: str = "structure_and_data"
    conflict: str = "error"
    drop_target: bool = False
    truncate_target: bool = False
    where: str | None = None
    limit: int | None = None
    mappings: list[ColumnMapping] = field(default_factory=list)
    when_null: bool = False
    portable_types: bool = False
    rebalance: bool = False
    error_mode: str = "skip"
    parallelism: int = 4
    keys: dict[str, list[str]] = field(default_factory=dict)
    order: dict[str, str] = field(default_factory=dict)
    checkpoint: str | None = None
    check: bool = False
    references: list[tuple[str, str, dict[str, str]]] = field(default_factory=list)

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode}")
        for table in self.tables:
            store.check_strategy(self.conflict, self.keys.get(table))
        if self.error_mode not in ERROR_MODES:
            raise ValueError(f"unknown error mode {self.error_mode}")


CHECKS = "kind string, table_name string, detail string, bad_values long, bad_rows long"


@dataclass
class TransferResult:
    stats: list[tuple]
    checks: list[tuple] = field(default_factory=list)

    def frame(self, spark: SparkSession) -> DataFrame:
        return session.small_frame(spark, self.stats, STATS)

    def check_frame(self, spark: SparkSession) -> DataFrame:
        return session.small_frame(spark, self.checks, CHECKS)

    @property
    def transferred(self) -> list[str]:
        return [s[0] for s in self.stats if s[4] == "ok"]

    @property
    def rows(self) -> int:
        return sum(s[1] for s in self.stats)

    @property
    def errors(self) -> list[str]:
        return [s[5] for s in self.stats if s[5] is not None]


def transfer_totals(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count_if(F.col("status") == "ok").alias("n_tables"),
                     F.sum("n_rows").alias("n_rows"),
                     F.count_if(F.col("error").isNotNull()).alias("n_errors"))


def checkpoint_path(root: str, source: str, source_db: str, target: str, target_db: str) -> str:
    """Folder of the finished-table records of one source and target pair."""
    key = "|".join((source, source_db, target, target_db))
    return f"{root}/transfer-{hashlib.sha256(key.encode()).hexdigest()[:32]}"


def completed_tables(spark: SparkSession, checkpoint: str | None) -> set[str]:
    if checkpoint is None or not session.path_exists(spark, checkpoint):
        return set()
    done = spark.read.schema(STATS).json(f"{checkpoint}/*").where("status = 'ok'")
    return {r.table_name for r in done.select("table_name").distinct().collect()}


def transfer_id(spark: SparkSession, checkpoint: str | None) -> str | None:
    """The id of the transfer that the checkpoint folder belongs to. It is in
    the names of the folders the transfer writes, so that a resumed one knows a
    table it has published but not recorded."""
    if checkpoint is None:
        return None
    path = f"{checkpoint}/id"
    if not session.path_exists(spark, f"{path}/_SUCCESS"):
        made = session.small_frame(spark, [(uuid.uuid4().hex,)], "transfer string")
        made.coalesce(1).write.mode("overwrite").json(path)
    return spark.read.schema("transfer string").json(path).first()["transfer"]


def prepared(spark: SparkSession, source: dict, table: str, opts: TransferOptions) -> DataFrame:
    """The rows of one table as the target gets them, as one lazy plan."""
    df = where_text(source_tables.read_table(spark, source, table), opts.where)
    if opts.limit is not None:
        df = row_limit(df, opts.limit, opts.keys.get(table) or df.columns)
    if opts.mappings:
        df = map_columns(df, opts.mappings, opts.when_null)
    if opts.portable_types:
        df = to_lattice(df)
    # Off unless asked for: a copy needs no shuffle. With a filter that keeps
    # little of each split it pays, as AQE then merges rows into few files.
    return df.hint("rebalance") if opts.rebalance else df


def _mapped_keys(table: str, opts: TransferOptions) -> list[str]:
    names = {m.source: m.target or m.source for m in opts.mappings if not m.skip}
    return [names.get(k, k) for k in opts.keys.get(table, [])]


def copy_table(spark: SparkSession, source: dict, target: Namespace, table: str,
               opts: TransferOptions, job: str | None = None) -> int:
    """Copy one table; returns the rows taken from the source. The target shows
    all of them or none. Rows for a table that exists are bound to its types; the
    conflict strategy holds within the source too."""
    df = prepared(spark, source, table, opts)
    there = store.exists(spark, target, table)
    if opts.mode == "structure_only":
        if not there or opts.drop_target:
            store.write_table(target, table, df.limit(0))
        return 0
    if opts.mode == "data_only" and not there:
        raise LookupError(f"table '{table}' not found in target")
    fresh = not there or (opts.drop_target and opts.mode != "data_only")
    keys, order = _mapped_keys(table, opts), opts.order.get(table)
    if fresh or opts.truncate_target:
        before = None
        if not fresh:
            before = store.state(spark, target, table)
            df = store.bound(df, spark.table(store.qualified(target, table)).schema)
        if keys:
            df = store.one_of_each(df, keys, opts.conflict, order)
        return store.write_table(target, table, df, before, job)
    return store.load_rows(target, table, df, keys, opts.conflict, order, job)


def transfer(spark: SparkSession, source: dict, target: Namespace,
             opts: TransferOptions) -> TransferResult:
    """Copy tables, ``parallelism`` at a time, each as one distributed job.

    Every table gets a stats row. A failed table leaves the target as it was;
    skip and skip_table go on with the next one, stop starts no more tables (and
    copies one at a time, so that none after the failed one is written). With a
    ``checkpoint`` folder finished tables are recorded as they finish and passed
    over on the next run; the record goes once a run has no error.
    """
    done = completed_tables(spark, opts.checkpoint)
    todo = [t for t in opts.tables if t not in done]
    job = transfer_id(spark, opts.checkpoint)

    def run(table: str) -> tuple:
        start, size, rows, status, error = time.monotonic(), 0, 0, "ok", None
        try:
            # Published before a stop, but not recorded: nothing is left to copy.
            if job is None or not store.written_by(spark, target, table, job):
                rows = copy_table(spark, source, target, table, opts, job)
            size = source_tables.table_bytes(spark, source, table)
        except Exception as e:
            status, error = "error", str(e).split("\n")[0]
        stat = (table, rows, size, int((time.monotonic() - start) * 1000), status, error)
        if opts.checkpoint is not None and status == "ok":
            # A folder per table: tables that finish together write apart.
            name = hashlib.sha256(table.encode()).hexdigest()[:32]
            record = session.small_frame(spark, [stat], STATS)
            record.write.mode("overwrite").json(f"{opts.checkpoint}/{name}")
        return stat

    if opts.error_mode == "stop":
        stats = []
        for table in todo:
            stats.append(run(table))
            if stats[-1][4] == "error":
                break
    else:
        stats = session.in_parallel(spark, run, todo, opts.parallelism)
    result = TransferResult(stats)
    if opts.check:
        result.checks = check_copy(spark, target, [s[0] for s in stats if s[4] == "ok"], opts)
    if opts.checkpoint is not None and not result.errors:
        session.delete_path(spark, opts.checkpoint)
    return result


def check_copy(spark: SparkSession, target: Namespace, tables: list[str], opts: TransferOptions) -> list[tuple]:
    """Checks of the copied tables, as a step of the transfer: each key (as
    mapped) is unique and has no NULL part, and each reference (child table,
    parent table, child column to parent column) has a parent row. One row per
    check: values and rows that break it (0 and 0: it holds). Tables that were
    not copied are not checked; a reference to one is."""
    from ..operators.checks import orphan_keys, unique_violations

    def table(name):
        return spark.table(store.qualified(target, name))

    out = []
    for name in tables:
        keys = _mapped_keys(name, opts)
        if keys:
            bad = unique_violations(table(name), keys, nulls_too=True).agg(
                F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("r")).first()
            out.append(("key", name, ", ".join(keys), bad["v"], bad["r"]))
    for child, parent, on in opts.references:
        if child not in tables:
            continue
        detail = ", ".join(on) + f" -> {parent}." + ", ".join(on.values())
        if not store.exists(spark, target, parent):
            n = table(child).dropna(subset=list(on)).count()
            out.append(("reference", child, detail, None, n))
            continue
        bad = orphan_keys(table(child), table(parent), on).agg(
            F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("r")).first()
        out.append(("reference", child, detail, bad["v"], bad["r"]))
    return out


class Stopped(RuntimeError):
    """A copy stopped on purpose (tests and drills)."""


def copy_in_groups(spark: SparkSession, path: str, target: Namespace, table: str, checkpoint: str,
                   files_per_group: int = 8, stop_after: int | None = None) -> dict[str, int]:
    """Copy a parquet folder into a new table by groups of source files, with
    resume below the table.

    The first run writes a manifest (file groups, in file order) to
    ``checkpoint``; each group is copied to a folder of its own and then
    recorded as done. A later run with the same ``checkpoint`` reads the
    manifest, passes over recorded groups, and copies only the rest; a group
    cut off half-way is written again from scratch into a fresh folder, so no
    row comes twice. When all groups are there, their folders go into one
    version folder by renames and the table is published at once; the
    checkpoint goes last. ``stop_after`` stops after that many groups of this
    run (to drill a stop). Returns groups copied now and in all.
    """
    manifest = f"{checkpoint}/manifest"
    if session.path_exists(spark, manifest):
        groups = {r.group: r.files for r in spark.read.json(manifest).collect()}
    else:
        files = sorted(spark.read.parquet(path).inputFiles())
        groups = {i // files_per_group: files[i:i + files_per_group] for i in range(0, len(files), files_per_group)}
        spark.createDataFrame([(g, f) for g, f in groups.items()], "group long, files array<string>") \
            .coalesce(1).write.json(manifest)
    schema = spark.read.parquet(path).schema
    done = {int(p.rsplit("-", 1)[1]) for p in session.path_children(spark, f"{checkpoint}/done")}
    copied = 0
    for group in sorted(groups):
        if group in done:
            continue
        if stop_after is not None and copied >= stop_after:
            raise Stopped(f"stopped after {copied} groups")
        folder = f"{checkpoint}/groups/{group}-{uuid.uuid4().hex}"
        spark.read.schema(schema).parquet(*groups[group]).write.parquet(folder)
        session.small_frame(spark, [(group, folder)], "group long, folder string").coalesce(1).write.json(
            f"{checkpoint}/done/group-{group}")
        copied += 1
    version = store.new_version(target, table)
    for note in session.path_children(spark, f"{checkpoint}/done"):
        row = spark.read.json(note).first()
        session.move_path(spark, row.folder, f"{version}/group-{row.group}")
    store.publish(spark, target, table, version, schema)
    session.delete_path(spark, checkpoint)
    return {"copied": copied, "groups": len(groups)}
