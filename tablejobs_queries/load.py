"""Edit merges and loads with conflict strategies."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tablejobs.operators import merge
from tablejobs.plans import edit
from tablejobs.session import scratch_namespace
from tablejobs.sinks import store

from .base import ORDER_COLUMNS, current_rows, load_table, query, time_text

# The change set over orders: status P becomes F and 100 dearer, 5-LOW orders
# are deleted, dear orders come again as urgent ones under negative keys.
_CHANGED = """
changed AS (
  SELECT o_orderkey, o_custkey,
         CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS o_orderstatus,
         CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 100 ELSE o_totalprice END AS o_totalprice,
         o_orderdate, o_orderpriority,
         CASE WHEN o_orderpriority = '5-LOW' THEN 'deleted'
              WHEN o_orderstatus = 'P' THEN 'modified' END AS row_state
  FROM orders),
added AS (
  SELECT -(o_orderkey + 1) AS o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
         '1-URGENT' AS o_orderpriority, 'added' AS row_state
  FROM orders WHERE o_totalprice > 400000)
"""

_MERGED = f"""
WITH {_CHANGED}
SELECT {ORDER_COLUMNS} FROM changed WHERE row_state IS NULL OR row_state <> 'deleted'
UNION ALL SELECT {ORDER_COLUMNS} FROM added
"""


def orders_changes(orders: DataFrame) -> DataFrame:
    def change(rows, op, cells):
        return rows.withColumn("op", F.lit(op)).withColumn(
            "set", F.array(*[F.lit(c) for c in cells]).cast("array<string>"))
    updates = change(
        orders.where("o_orderstatus = 'P'").withColumn("o_orderstatus", F.lit("F"))
        .withColumn("o_totalprice", F.col("o_totalprice") + 100),
        "update", ["o_orderstatus", "o_totalprice"])
    deletes = change(orders.where("o_orderpriority = '5-LOW'"), "delete", [])
    inserts = change(
        orders.where("o_totalprice > 400000")
        .withColumn("o_orderkey", -(F.col("o_orderkey") + 1))
        .withColumn("o_orderpriority", F.lit("1-URGENT")), "insert", [])
    return reduce(DataFrame.unionByName, [updates, deletes, inserts])


@query(_MERGED)
def edit_merge(spark, sf):
    orders = load_table(spark, sf, "orders")
    return time_text(merge.merge_edits(orders, orders_changes(orders), ["o_orderkey"]))


@query(f"""
WITH {_CHANGED}
SELECT row_state, count(*) AS n_rows, min(o_orderkey) AS low_key, max(o_orderkey) AS high_key
FROM (SELECT * FROM changed UNION ALL SELECT * FROM added) GROUP BY row_state
""")
def edit_row_states(spark, sf):
    orders = load_table(spark, sf, "orders")
    states = merge.edit_states(orders, orders_changes(orders), ["o_orderkey"])
    return states.groupBy("row_state").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("o_orderkey").alias("low_key"),
        F.max("o_orderkey").alias("high_key"))


@query(_MERGED)
def edit_batch(spark, sf):
    orders = load_table(spark, sf, "orders")
    with scratch_namespace(spark) as ns:
        store.write_table(ns, "orders", orders)
        edit.apply_edits(spark, ns, "orders", orders_changes(orders), ["o_orderkey"])
        return time_text(current_rows(spark, ns, "orders"))


@query(f"""
SELECT {ORDER_COLUMNS.replace("o_orderstatus,", "CASE WHEN o_orderpriority = '1-URGENT' THEN 'U' ELSE o_orderstatus END AS o_orderstatus,")
        .replace("o_totalprice,", "CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,")}
FROM orders
""")
def edit_cells_no_seq(spark, sf):
    """Two cells of one row edited apart, without an order."""
    orders = load_table(spark, sf, "orders")
    urgent = orders.where("o_orderpriority = '1-URGENT'").withColumn("op", F.lit("update"))
    one = urgent.withColumn("o_orderstatus", F.lit("U")).withColumn("set", F.array(F.lit("o_orderstatus")))
    two = urgent.withColumn("o_totalprice", F.col("o_totalprice") + 1).withColumn("set", F.array(F.lit("o_totalprice")))
    return time_text(merge.merge_edits(orders, one.unionByName(two), ["o_orderkey"]))


@query("""
SELECT doc_id, CASE WHEN lang = 'de' THEN NULL WHEN lang = 'fr' THEN '' ELSE lang END AS lang,
       CASE WHEN lang IN ('de', 'fr') THEN 'modified' END AS row_state FROM documents
""")
def edit_to_null(spark, sf):
    """A cell from empty text to NULL and from NULL to empty text: both change it."""
    docs = load_table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("lang") == "de", "").when(F.col("lang") == "fr", None).otherwise(F.col("lang")).alias("lang"),
        F.col("lang").alias("was"))
    edits = (docs.where("was IN ('de', 'fr')")
             .select("doc_id", F.when(F.col("was") == "fr", "").alias("lang"), F.lit("update").alias("op"),
                     F.array(F.lit("lang")).alias("set")))
    return merge.edit_states(docs.drop("was"), edits, ["doc_id"])


def _load_sides(spark, sf):
    """Target: orders of status F or O. Source: urgent and high orders at
    another price; both sides share keys."""
    orders = load_table(spark, sf, "orders")
    target = orders.where("o_orderstatus IN ('F', 'O')")
    source = orders.where("o_orderpriority IN ('1-URGENT', '2-HIGH')").withColumn(
        "o_totalprice", F.col("o_totalprice") + 1000)
    return target, source


_SIDES = """
target AS (SELECT * FROM orders WHERE o_orderstatus IN ('F', 'O')),
source AS (SELECT * REPLACE (o_totalprice + 1000 AS o_totalprice)
           FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))
"""


@query(f"""
WITH {_SIDES}
SELECT {ORDER_COLUMNS} FROM target UNION ALL
SELECT {ORDER_COLUMNS} FROM source WHERE o_orderkey NOT IN (SELECT o_orderkey FROM target)
""")
def load_ignore(spark, sf):
    target, source = _load_sides(spark, sf)
    return time_text(merge.merge_load(target, source, ["o_orderkey"], "ignore"))


@query(f"""
WITH {_SIDES}
SELECT {ORDER_COLUMNS} FROM source UNION ALL
SELECT {ORDER_COLUMNS} FROM target WHERE o_orderkey NOT IN (SELECT o_orderkey FROM source)
""")
def load_replace(spark, sf):
    target, source = _load_sides(spark, sf)
    return time_text(merge.merge_load(target, source, ["o_orderkey"], "replace"))


@query(f"""
WITH {_SIDES}
SELECT {ORDER_COLUMNS} FROM source WHERE o_orderkey IN (SELECT o_orderkey FROM target)
""")
def load_error_conflicts(spark, sf):
    target, source = _load_sides(spark, sf)
    return time_text(merge.conflicts(target, source, ["o_orderkey"]))


_LINE_SOURCE = """
ranked AS (
  SELECT l_orderkey AS o_orderkey, l_extendedprice AS o_totalprice,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate {0}, l_partkey {0},
           l_suppkey {0}, l_linenumber {0}, l_extendedprice {0}) AS place
  FROM lineitem),
source AS (SELECT o_orderkey, o_totalprice FROM ranked WHERE place = 1),
target AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F')
"""


def _line_load(spark, sf, strategy):
    """Many source rows per key: the line with the latest ship date wins for
    replace, the earliest for ignore."""
    target = load_table(spark, sf, "orders").where("o_orderstatus = 'F'").select(
        "o_orderkey", "o_totalprice")
    source = load_table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("o_totalprice"),
        F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice").alias("at"))
    return merge.merge_load(target, source, ["o_orderkey"], strategy, order="at")


@query("WITH " + _LINE_SOURCE.format("DESC") + """
SELECT * FROM source UNION ALL
SELECT * FROM target WHERE o_orderkey NOT IN (SELECT o_orderkey FROM source)
""")
def load_replace_last(spark, sf):
    return _line_load(spark, sf, "replace")


@query("WITH " + _LINE_SOURCE.format("ASC") + """
SELECT * FROM target UNION ALL
SELECT * FROM source WHERE o_orderkey NOT IN (SELECT o_orderkey FROM target)
""")
def load_ignore_first(spark, sf):
    return _line_load(spark, sf, "ignore")


@query(f"""
WITH {_SIDES}
SELECT {ORDER_COLUMNS} FROM source UNION ALL
SELECT {ORDER_COLUMNS} FROM target WHERE o_orderkey NOT IN (SELECT o_orderkey FROM source)
""")
def load_into_table(spark, sf):
    """The replace load through a stored table: new version, then the switch."""
    target, source = _load_sides(spark, sf)
    with scratch_namespace(spark) as ns:
        store.write_table(ns, "orders", target)
        store.load_rows(ns, "orders", source, ["o_orderkey"], "replace")
        return time_text(current_rows(spark, ns, "orders"))


@query(f"""
WITH {_SIDES} SELECT {ORDER_COLUMNS} FROM target UNION ALL SELECT {ORDER_COLUMNS} FROM source
""")
def bulk_append(spark, sf):
    target, source = _load_sides(spark, sf)
    with scratch_namespace(spark) as ns:
        store.write_table(ns, "orders", target)
        store.append_rows(ns, "orders", source)
        return time_text(current_rows(spark, ns, "orders"))


def _in_files(orders: DataFrame, files: int = 20) -> DataFrame:
    """Orders as a table of ``files`` files, each a range of keys."""
    return orders.repartitionByRange(files, "o_orderkey")


@query(f"""
WITH {_SIDES}
SELECT {ORDER_COLUMNS} FROM source UNION ALL
SELECT {ORDER_COLUMNS} FROM target WHERE o_orderkey NOT IN (SELECT o_orderkey FROM source)
""")
def load_replace_by_file(spark, sf):
    """The replace load that rewrites only the files holding a replaced key."""
    target, source = _load_sides(spark, sf)
    with scratch_namespace(spark) as ns:
        store.write_table(ns, "orders", _in_files(target))
        store.replace_by_file(ns, "orders", source, ["o_orderkey"])
        return time_text(current_rows(spark, ns, "orders"))


@query(_MERGED)
def edit_batch_by_file(spark, sf):
    """The edit batch that rewrites only the files holding an edited key."""
    orders = load_table(spark, sf, "orders")
    with scratch_namespace(spark) as ns:
        store.write_table(ns, "orders", _in_files(orders))
        edit.apply_edits(spark, ns, "orders", orders_changes(orders), ["o_orderkey"], by_file=True)
        return time_text(current_rows(spark, ns, "orders"))
