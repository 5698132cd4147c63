"""Session settings, scratch folders and small file-system helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def build_session(master: str | None = None, app: str = "tablejobs", **conf) -> SparkSession:
    """A session with the settings the jobs are written for.

    Nothing here fixes a partition count: AQE starts from a generous number of
    shuffle partitions, merges small ones and splits skewed join partitions.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.parquet.aggregatePushdown": "true",
        "spark.scheduler.mode": "FAIR",
        "spark.ui.enabled": "false",
        # Call-site capture costs milliseconds for every Column made in Python.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load_tables(spark: SparkSession, folder: str, names=TABLES) -> dict[str, DataFrame]:
    return {name: load_table(spark, folder, name) for name in names}


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop_path(spark, path)
    return fs.exists(p)


def path_bytes(spark: SparkSession, path: str) -> int:
    fs, p = _hadoop_path(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def path_children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _hadoop_path(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().toString() for s in fs.listStatus(p))


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop_path(spark, path)
    fs.delete(p, True)


def delete_uri(spark: SparkSession, uri: str) -> None:
    """Delete a file named as Spark names it in ``_metadata.file_path``."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri))
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, False)


def move_path(spark: SparkSession, path: str, to: str) -> None:
    fs, p = _hadoop_path(spark, path)
    if not fs.rename(p, _hadoop_path(spark, to)[1]):
        raise OSError(f"could not move {path} to {to}")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it.

    Only a local master may fall back to a folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.gettempdir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path nobody else uses, below one folder per application."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/tablejobs-{app}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove this application's scratch data, once no result needs it."""
    delete_path(spark, f"{shared_folder(spark)}/tablejobs-{spark.sparkContext.applicationId}")


def in_parallel(spark: SparkSession, job: Callable, items: list, at_once: int) -> list:
    """Run ``job`` for each item, some at a time, each in its own FAIR pool, so
    that a small table's job does not wait for a large one's tasks."""
    context = spark.sparkContext

    def run(place, item):
        context.setLocalProperty("spark.scheduler.pool", f"job-{place % at_once}")
        try:
            return job(item)
        finally:
            context.setLocalProperty("spark.scheduler.pool", None)

    at_once = max(at_once, 1)
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(inheritable_thread_target(spark)(run), range(len(items)), items))


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The written table cuts the lineage, so a lost executor re-reads files
    instead of re-running (and re-sampling) the plan that made them.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def freed_shuffles(spark: SparkSession):
    """Inside, the shuffle files of a query go when it ends, not when the
    driver collects its garbage: for jobs in passes that each write a result."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def short_batches(spark: SparkSession, n_bytes: int = 1 << 22):
    """Inside, rows go to Python in Arrow batches of about so many bytes,
    however long their texts are: both sides hold whole batches."""
    return _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(n_bytes))


def small_frame(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """Driver-side facts (statistics, schema rows) as a local relation, whose
    size the optimizer knows when it picks a join."""
    schema = T.StructType.fromDDL(ddl)
    data = [dict(zip(schema.names, row)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(data, to_arrow_schema(schema)), schema)


@dataclass(frozen=True)
class Namespace:
    """A Spark database plus the folder its table versions are written to."""

    name: str
    root: str


def create_namespace(spark: SparkSession, name: str, root: str) -> Namespace:
    # Data sits beside, not inside, the database folder: dropping a database
    # removes its folder, and readers of a table version must keep their files.
    spark.sql(f"CREATE DATABASE `{name}` LOCATION '{root}/db'")
    return Namespace(name, f"{root}/data")


@contextmanager
def scratch_namespace(spark: SparkSession, label: str = "ns"):
    """A throw-away namespace; its files outlive it until ``clear_scratch``."""
    root = scratch_path(spark, label)
    ns = create_namespace(spark, "tj_" + uuid.uuid4().hex, root)
    try:
        yield ns
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS `{ns.name}` CASCADE")


def cpu_count() -> int:
    return int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
