"""Whole-table jobs: transfer, snapshot, duplicate, reshape."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tablejobs.operators import checks
from tablejobs.operators.project import ColumnMapping
from tablejobs.plans import namespaces, snapshot
from tablejobs.plans.transfer import CHECKS, TransferOptions, checkpoint_path, transfer, transfer_totals
from tablejobs.session import scratch_namespace, scratch_path, small_frame
from tablejobs.sinks import store
from tablejobs.sources.tables import read_table

from .base import ORDER_COLUMNS, current_rows, folder, load_table, load_tables, query, time_text

COPIED = ["customer", "supplier", "orders"]


@query("""
SELECT o_orderkey, o_custkey, o_totalprice AS price, 'X' AS o_orderstatus,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate
FROM orders WHERE o_totalprice >= 1000 AND o_orderstatus <> 'P'
""")
def transfer_mapped(spark, sf):
    with scratch_namespace(spark) as ns:
        transfer(spark, folder(sf), ns, TransferOptions(
            tables=["orders"], where="o_totalprice >= 1000 AND o_orderstatus <> 'P'",
            mappings=[ColumnMapping("o_totalprice", "price"),
                      ColumnMapping("o_orderpriority", skip=True),
                      ColumnMapping("o_orderstatus", default="X")]))
        return time_text(current_rows(spark, ns, "orders"))


@query("""
SELECT 'structure_only' AS step, 'orders' AS table_name, CAST(0 AS BIGINT) AS n_rows
UNION ALL SELECT 'data_only', 'orders', count(*) FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT 'append', 'orders', count(*) FROM orders WHERE o_orderstatus IN ('O', 'F')
UNION ALL SELECT 'truncate', 'orders', count(*) FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT 'drop', 'orders', count(*) FROM orders
""")
def transfer_modes(spark, sf):
    parts = []
    with scratch_namespace(spark) as ns:
        def step(name, **options):
            result = transfer(spark, folder(sf), ns, TransferOptions(tables=["orders"], **options))
            if result.errors:
                raise RuntimeError(result.errors)
            # Counted now: a later append adds a load to the same version folder.
            parts.append((name, "orders", current_rows(spark, ns, "orders").count()))
        step("structure_only", mode="structure_only")
        step("data_only", mode="data_only", where="o_orderstatus = 'O'")
        step("append", where="o_orderstatus = 'F'")
        step("truncate", truncate_target=True, where="o_orderstatus = 'P'")
        step("drop", drop_target=True)
    return small_frame(spark, parts, "step string, table_name string, n_rows long")


@query("""
SELECT 'customer' AS table_name, count(*) AS n_rows, 'ok' AS status, false AS has_error FROM customer
UNION ALL SELECT 'no_such_table', 0, 'error', true
UNION ALL SELECT 'supplier', count(*), 'ok', false FROM supplier
UNION ALL SELECT 'orders', count(*), 'ok', false FROM orders
""")
def transfer_stats(spark, sf):
    """The missing table is skipped, the rest is copied."""
    with scratch_namespace(spark) as ns:
        result = transfer(spark, folder(sf), ns, TransferOptions(
            tables=["customer", "no_such_table", "supplier", "orders"]))
    return result.frame(spark).select("table_name", "n_rows", "status",
                                      F.col("error").isNotNull().alias("has_error"))


@query("""
SELECT CAST(1 AS BIGINT) AS n_tables, (SELECT count(*) FROM customer) AS n_rows,
       CAST(1 AS BIGINT) AS n_errors
""")
def transfer_stop(spark, sf):
    """The job ends at the missing table."""
    with scratch_namespace(spark) as ns:
        result = transfer(spark, folder(sf), ns, TransferOptions(
            tables=["customer", "no_such_table", "supplier"], error_mode="stop"))
    return transfer_totals(result.frame(spark))


@query("""
SELECT 1 AS run, 'customer' AS table_name, count(*) AS n_rows, 'ok' AS status FROM customer
UNION ALL SELECT 1, 'late', 0, 'error'
UNION ALL SELECT 1, 'supplier', count(*), 'ok' FROM supplier
UNION ALL SELECT 2, 'late', count(*), 'ok' FROM orders
""")
def transfer_resume(spark, sf):
    """The second run passes over the tables that the first one finished."""
    frames = load_tables(spark, sf, ["customer", "supplier", "orders"])
    late = frames.pop("orders")
    checkpoint = checkpoint_path(scratch_path(spark, "resume"), "files", sf, "spark", "copy")
    options = TransferOptions(tables=["customer", "late", "supplier"], checkpoint=checkpoint)
    with scratch_namespace(spark) as ns:
        first = transfer(spark, {"format": "frames", "frames": frames}, ns, options)
        second = transfer(spark, {"format": "frames", "frames": {**frames, "late": late}}, ns, options)
    return (first.frame(spark).withColumn("run", F.lit(1))
            .unionByName(second.frame(spark).withColumn("run", F.lit(2)))
            .select("run", "table_name", "n_rows", "status"))


@query(f"""
SELECT {ORDER_COLUMNS} FROM orders WHERE o_orderstatus = 'O'
UNION ALL
SELECT {ORDER_COLUMNS} FROM orders WHERE o_orderstatus <> 'O' AND o_orderpriority = '1-URGENT'
""")
def transfer_conflict_ignore(spark, sf):
    """Two copies into one table: the second brings only keys it lacks."""
    with scratch_namespace(spark) as ns:
        for where in ("o_orderstatus = 'O'", "o_orderpriority = '1-URGENT'"):
            transfer(spark, folder(sf), ns, TransferOptions(
                tables=["orders"], where=where, conflict="ignore", keys={"orders": ["o_orderkey"]}))
        return time_text(current_rows(spark, ns, "orders"))


@query("""
SELECT l_orderkey, l_quantity, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate
FROM lineitem
""")
def transfer_portable_types(spark, sf):
    with scratch_namespace(spark) as ns:
        transfer(spark, folder(sf), ns, TransferOptions(tables=["lineitem"], portable_types=True))
        return current_rows(spark, ns, "lineitem").select("l_orderkey", "l_quantity", "l_shipdate")


@query(" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS source_rows, count(*) AS target_rows, true AS ok FROM {t}"
    for t in COPIED) + " UNION ALL SELECT 'part', count(*), NULL, false FROM part")
def row_count_check(spark, sf):
    with scratch_namespace(spark) as ns:
        transfer(spark, folder(sf), ns, TransferOptions(tables=COPIED))
        target = {t: current_rows(spark, ns, t) for t in COPIED}
    return checks.row_count_check(load_tables(spark, sf, [*COPIED, "part"]), target)


@query("""
SELECT 'customer' AS table_name, c_custkey AS id, c_name AS name FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier
UNION ALL SELECT 'orders', o_orderkey, o_orderpriority FROM orders
""")
def snapshot_restore(spark, sf):
    path = scratch_path(spark, "snapshot")
    snapshot.take_snapshot(spark, folder(sf), ["customer", "no_such_table", "supplier", "orders"], path)
    with scratch_namespace(spark) as ns:
        count, errors = snapshot.restore_snapshot(spark, path, ns)
        if (count, errors) != (3, []):
            raise RuntimeError(f"restored {count} tables, errors {errors}")
        rows = {t: current_rows(spark, ns, t) for t in COPIED}
    return reduce(DataFrame.union, [
        rows[t].select(F.lit(t).alias("table_name"), F.col(k).alias("id"), F.col(n).alias("name"))
        for t, k, n in (("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"),
                        ("orders", "o_orderkey", "o_orderpriority"))])


@query("""
SELECT p_partkey, p_name, p_retailprice FROM part
""")
def duplicate_namespace(spark, sf):
    path = scratch_path(spark, "duplicate")
    with scratch_namespace(spark) as ns:
        for table in ("part", "supplier"):
            store.write_table(ns, table, load_table(spark, sf, table))
        source = {"format": "catalog", "database": ns.name}
        copy = namespaces.duplicate_namespace(spark, source, ns.name + "_copy", path)
        rows = current_rows(spark, copy, "part")
        spark.sql(f"DROP DATABASE `{copy.name}` CASCADE")
    return rows.select("p_partkey", "p_name", "p_retailprice")


@query("""
SELECT p_partkey AS id, p_name, p_brand, CAST(p_size AS BIGINT) AS p_size,
       CAST(p_retailprice AS VARCHAR) AS p_retailprice, 'none' AS note, CAST(NULL AS INTEGER) AS rank
FROM part
""")
def reshape_table(spark, sf):
    with scratch_namespace(spark) as ns:
        store.write_table(ns, "part", load_table(spark, sf, "part"))
        namespaces.reshape_table(
            spark, ns, "part", drop=["p_type"], rename={"p_partkey": "id"},
            retype={"p_size": "bigint", "p_retailprice": "string"},
            add={"note": ("string", "'none'"), "rank": ("int", None)})
        namespaces.rename_table(spark, ns, "part", "part_two")
        return current_rows(spark, ns, "part_two")


def copy_orders(spark, sf) -> DataFrame:
    """The flagship: copy orders with a filter and a mapping, then join and
    group what was written."""
    with scratch_namespace(spark) as ns:
        transfer(spark, folder(sf), ns, TransferOptions(
            tables=["orders"], where="o_orderstatus <> 'P'",
            mappings=[ColumnMapping("o_totalprice", "price"),
                      ColumnMapping("o_orderpriority", skip=True)]))
        orders = current_rows(spark, ns, "orders")
    customer = read_table(spark, folder(sf), "customer")
    return (orders.join(customer, orders.o_custkey == customer.c_custkey)
            .groupBy("c_mktsegment", "o_orderstatus")
            .agg(F.count(F.lit(1)).alias("n_orders"), F.max("price").alias("top_price")))


@query("""
SELECT c_mktsegment, o_orderstatus, count(*) AS n_orders, max(o_totalprice) AS top_price
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'
GROUP BY c_mktsegment, o_orderstatus
""")
def copy_join_group(spark, sf):
    return copy_orders(spark, sf)



def _ends(spark, ns, table, columns):
    """A table as it is stored now, with its column types as text."""
    df = current_rows(spark, ns, table)
    return df.select(*[F.lit(df.schema[c].dataType.simpleString()).alias(f"{c}_type") for c in columns], *columns)


@query("""
SELECT 'bigint' AS c_custkey_type, 'int' AS c_nationkey_type, 'double' AS c_acctbal_type,
       c_custkey, c_nationkey, c_acctbal FROM customer
UNION ALL SELECT 'bigint', 'int', 'double', -c_custkey - 1, c_nationkey, c_acctbal FROM customer
""")
def transfer_bound_types(spark, sf):
    """Text rows loaded into a typed table take its types."""
    columns = ["c_custkey", "c_nationkey", "c_acctbal"]
    customer = load_table(spark, sf, "customer").select(
        F.col("c_custkey").cast("long"), F.col("c_nationkey").cast("int"), F.col("c_acctbal").cast("double"))
    texts = customer.withColumn("c_custkey", -F.col("c_custkey") - 1).select(
        *[F.col(c).cast("string").alias(c) for c in columns])
    with scratch_namespace(spark) as ns:
        store.write_table(ns, "customer", customer)
        result = transfer(spark, {"format": "frames", "frames": {"customer": texts}}, ns, TransferOptions(
            tables=["customer"], mode="data_only", keys={"customer": ["c_custkey"]}))
        if result.errors:
            raise RuntimeError(result.errors)
        return _ends(spark, ns, "customer", columns)


@query("""
SELECT 'bigint' AS s_suppkey_type, 'string' AS s_name_type, s_suppkey, s_name FROM supplier
""")
def transfer_truncate_types(spark, sf):
    """A truncated table keeps its types, whatever the source's are."""
    supplier = load_table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long"), "s_name")
    texts = supplier.withColumn("s_suppkey", F.col("s_suppkey").cast("string"))
    with scratch_namespace(spark) as ns:
        store.write_table(ns, "supplier", supplier.limit(1))
        result = transfer(spark, {"format": "frames", "frames": {"supplier": texts}}, ns, TransferOptions(
            tables=["supplier"], truncate_target=True))
        if result.errors:
            raise RuntimeError(result.errors)
        return _ends(spark, ns, "supplier", ["s_suppkey", "s_name"])


@query("""
SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice
FROM orders GROUP BY o_custkey
""")
def transfer_first_load_replace(spark, sf):
    """The first load of a table keeps the last row of each key as well."""
    orders = load_table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    with scratch_namespace(spark) as ns:
        result = transfer(spark, {"format": "frames", "frames": {"orders": orders}}, ns, TransferOptions(
            tables=["orders"], conflict="replace", keys={"orders": ["o_custkey"]}, order={"orders": "o_orderkey"}))
        if result.errors:
            raise RuntimeError(result.errors)
        return current_rows(spark, ns, "orders")


@query("""
SELECT 'key' AS kind, 'customer' AS table_name, 'c_custkey' AS detail, CAST(0 AS BIGINT) AS bad_values,
       CAST(0 AS BIGINT) AS bad_rows
UNION ALL SELECT 'key', 'orders', 'o_orderkey', 0, 0
UNION ALL
SELECT 'reference', 'orders', 'o_custkey -> customer.c_custkey', count(DISTINCT o_custkey), count(*)
FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)
""")
def transfer_checked(spark, sf):
    """Keys and a reference checked as a step of the copy: customers are copied
    in part, so orders of the others have no parent."""
    with scratch_namespace(spark) as ns:
        first = transfer(spark, folder(sf), ns, TransferOptions(
            tables=["customer"], where="c_custkey % 10 <> 0", keys={"customer": ["c_custkey"]}, check=True))
        second = transfer(spark, folder(sf), ns, TransferOptions(
            tables=["orders"], keys={"orders": ["o_orderkey"]}, check=True,
            references=[("orders", "customer", {"o_custkey": "c_custkey"})]))
        return small_frame(spark, first.checks + second.checks, CHECKS)


@query(f"SELECT {ORDER_COLUMNS} FROM orders")
def transfer_resume_groups(spark, sf):
    """A copy by groups of files, stopped after its first group and resumed:
    the second run copies only the rest; no row twice."""
    from tablejobs.plans.transfer import Stopped, copy_in_groups

    source = f"{sf}/orders.parquet"
    with scratch_namespace(spark) as ns:
        checkpoint = scratch_path(spark, "groups")
        try:
            copy_in_groups(spark, source, ns, "orders", checkpoint, files_per_group=1, stop_after=1)
        except Stopped:
            pass
        if not store.exists(spark, ns, "orders"):
            copy_in_groups(spark, source, ns, "orders", checkpoint, files_per_group=1)
        return time_text(current_rows(spark, ns, "orders"))
