"""Table sources: a source spec names where the tables are.

Specs are plain dicts:
  {"format": "folder", "path": ..., "suffix": ".parquet"}   one parquet per table
  {"format": "catalog", "database": ...}                     Spark tables
  {"format": "jdbc", "url": ..., "options": {...}}           a database
  {"format": "frames", "frames": {name: DataFrame}}          given DataFrames
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import session


def table_names(spark: SparkSession, spec: dict) -> list[str]:
    kind = spec["format"]
    if kind == "frames":
        return sorted(spec["frames"])
    if kind == "catalog":
        return sorted(t.name for t in spark.catalog.listTables(spec["database"])
                      if not t.isTemporary and t.tableType != "VIEW")
    if kind == "folder":
        suffix = spec.get("suffix", ".parquet")
        files = (p.rsplit("/", 1)[1] for p in session.path_children(spark, spec["path"]))
        return [f.removesuffix(suffix) for f in files
                if f.endswith(suffix) and not f.startswith(("_", "."))]
    raise ValueError(f"tables of a {kind} source must be named")


def has_table(spark: SparkSession, spec: dict, table: str) -> bool:
    if spec["format"] == "jdbc":
        return True
    if spec["format"] == "catalog":
        return spark.catalog.tableExists(f"`{spec['database']}`.`{table}`")
    if spec["format"] == "folder":
        return session.path_exists(spark, _folder_path(spec, table))
    return table in table_names(spark, spec)


def _folder_path(spec: dict, table: str) -> str:
    return f"{spec['path']}/{table}{spec.get('suffix', '.parquet')}"


def read_table(spark: SparkSession, spec: dict, table: str) -> DataFrame:
    """A lazy scan; filters and column lists added later reach the source."""
    kind = spec["format"]
    if kind == "jdbc":
        return read_jdbc(spark, spec, table)
    if not has_table(spark, spec, table):
        raise LookupError(f"table '{table}' not found in source")
    if kind == "frames":
        return spec["frames"][table]
    if kind == "catalog":
        return spark.table(f"`{spec['database']}`.`{table}`")
    if kind == "folder":
        return spark.read.parquet(_folder_path(spec, table))
    raise ValueError(f"unknown source format {kind}")


def table_bytes(spark: SparkSession, spec: dict, table: str) -> int:
    if spec["format"] == "folder":
        return session.path_bytes(spark, _folder_path(spec, table))
    if spec["format"] == "catalog":
        return session.path_bytes(spark, table_location(spark, spec["database"], table))
    return 0


def table_location(spark: SparkSession, database: str, table: str) -> str:
    described = spark.sql(f"DESCRIBE TABLE EXTENDED `{database}`.`{table}`")
    return described.where("col_name = 'Location'").first()["data_type"]


def jdbc_options(spec: dict, table: str, bounds: tuple | None = None) -> dict:
    """Reader options. ``spec['partition']`` maps a table to its split column;
    with it the scan runs in ``num_partitions`` range queries."""
    options = {"url": spec["url"], "dbtable": table, "fetchsize": "2000",
               "pushDownPredicate": "true", **spec.get("options", {})}
    column = spec.get("partition", {}).get(table)
    if column and bounds and bounds[0] is not None:
        options |= {"partitionColumn": column, "lowerBound": str(bounds[0]),
                    "upperBound": str(bounds[1]),
                    "numPartitions": str(spec.get("num_partitions", 32))}
    return options


def read_jdbc(spark: SparkSession, spec: dict, table: str) -> DataFrame:
    column = spec.get("partition", {}).get(table)
    bounds = None
    if not column and not spec.get("one_task"):
        raise ValueError(f"name a split column for {table} in 'partition', or set 'one_task' to read it in one task")
    if column:
        edges = {k: v for k, v in jdbc_options(spec, table).items() if k != "dbtable"}
        query = f"SELECT min({column}) AS lo, max({column}) AS hi FROM {table}"
        bounds = tuple(spark.read.format("jdbc").options(query=query, **edges).load().first())
    return spark.read.format("jdbc").options(**jdbc_options(spec, table, bounds)).load()
