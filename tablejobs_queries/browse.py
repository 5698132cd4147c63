"""Mapping, filters, pages and previews."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tablejobs.operators import filters, ordering, project
from tablejobs.operators.project import ColumnMapping
from tablejobs.sources import catalog

from .base import LINE_ORDER, ORDER_COLUMNS, load_table, query, time_text


@query("""
SELECT o_orderkey, o_custkey, 'X' AS o_orderstatus, o_totalprice AS price,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate
FROM orders
""")
def map_rename_skip_default(spark, sf):
    mapped = project.map_columns(load_table(spark, sf, "orders"), [
        ColumnMapping("o_totalprice", "price"),
        ColumnMapping("o_orderpriority", skip=True),
        ColumnMapping("o_orderstatus", default="X")])
    return time_text(mapped)


@query("""
SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'unknown') AS state
FROM orders
""")
def map_default_when_null(spark, sf):
    orders = load_table(spark, sf, "orders").select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("o_orderstatus"))
    return project.map_columns(
        orders, [ColumnMapping("o_orderstatus", "state", default="unknown")], when_null=True)


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice
FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'
""")
def where_text(spark, sf):
    return filters.where_text(load_table(spark, sf, "lineitem"),
                              "l_quantity > 45 and l_returnflag = 'R'").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")


@query("""
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment
FROM customer WHERE c_acctbal >= 1000 AND c_mktsegment LIKE '%ING' AND c_nationkey <> 3
""")
def filter_boxes(spark, sf):
    return filters.filter_boxes(load_table(spark, sf, "customer"), {
        "c_acctbal": ">=1000", "c_mktsegment": "%ING", "c_nationkey": "<> 3", "c_name": "  "})


@query(f"""
SELECT {ORDER_COLUMNS} FROM orders
ORDER BY o_totalprice DESC, orders.o_orderkey LIMIT 100 OFFSET 200
""")
def page_sorted(spark, sf):
    return time_text(ordering.page(load_table(spark, sf, "orders"), 3, 100, "o_totalprice",
                                   "desc", ["o_orderkey"]))


@query(f"""
SELECT {', '.join(c for c in LINE_ORDER if c != 'l_shipdate')},
       strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate
FROM lineitem ORDER BY {', '.join(LINE_ORDER)[:-len('l_shipdate')]} lineitem.l_shipdate
LIMIT 100 OFFSET 4900
""")
def page_deep(spark, sf):
    """Page 50 by range-partitioned row numbers, as pages far down are read."""
    return time_text(ordering.page(load_table(spark, sf, "lineitem"), 50, 100,
                                   keys=LINE_ORDER, top_n=1000))


@query("""
WITH n AS (SELECT event_type, event_id, user_id,
                  row_number() OVER (ORDER BY event_type, event_id) - 1 AS pos
           FROM (SELECT event_type, event_id, user_id FROM events))
SELECT CAST(floor(pos / 400) + 1 AS BIGINT) AS page, event_type, event_id, user_id FROM n WHERE pos < 2400
""")
def page_ties(spark, sf):
    """Pages by a column of few values, on both sides of the switch to row
    numbers: no row comes twice or never."""
    events = load_table(spark, sf, "events").select("event_type", "event_id", "user_id")
    pages = [ordering.page(events, n, 400, "event_type", top_n=1000).withColumn("page", F.lit(n).cast("long"))
             for n in range(1, 7)]
    return reduce(DataFrame.unionByName, pages)


@query("""
SELECT count(*) AS total, CAST(ceil(count(*) / 100.0) AS BIGINT) AS pages
FROM orders WHERE o_orderstatus = 'O'
""")
def page_total(spark, sf):
    return ordering.page_total(load_table(spark, sf, "orders").where("o_orderstatus = 'O'"))


@query(f"SELECT {ORDER_COLUMNS} FROM orders ORDER BY orders.o_orderkey LIMIT 2500")
def row_limit(spark, sf):
    return time_text(ordering.row_limit(load_table(spark, sf, "orders"), 2500, ["o_orderkey"]))


@query("SELECT * FROM part ORDER BY p_partkey LIMIT 100")
def preview(spark, sf):
    return project.preview(load_table(spark, sf, "part"), ["p_partkey"])


@query("SELECT conv_id AS key_conv, turn AS key_turn, role FROM conversations")
def row_handle(spark, sf):
    rows = project.row_handle(load_table(spark, sf, "conversations"), ["conv_id", "turn"])
    return rows.select(F.col("handle.conv_id").alias("key_conv"),
                       F.col("handle.turn").alias("key_turn"), "role")


@query("""
SELECT s_suppkey, s_name, s_nationkey, nullif(s_nationkey, 3) AS home,
       'ne::w' AS status, 5 AS rating, '1970-01-01' AS since, CAST(NULL AS VARCHAR) AS note, 'active' AS state
FROM supplier
""")
def column_defaults(spark, sf):
    from pyspark.sql import types as T
    supplier = load_table(spark, sf, "supplier").withColumn(
        "home", F.nullif("s_nationkey", F.lit(3)))
    target = T.StructType.fromDDL(
        "s_suppkey long, s_name string, s_nationkey int, home int, status string, rating int, "
        "since string, note string, state string")
    return project.fill_defaults(supplier, target, {
        "home": "99", "status": "'ne::w'::character varying", "rating": "5",
        "since": "'0000-00-00'", "note": "NULL::text", "s_suppkey": "nextval('s')", "state": "active"})


@query("""
SELECT s_suppkey, coalesce(nullif(s_nationkey, 3), 99) AS home FROM supplier
""")
def column_defaults_when_null(spark, sf):
    from pyspark.sql import types as T
    supplier = load_table(spark, sf, "supplier").select(
        "s_suppkey", F.nullif("s_nationkey", F.lit(3)).alias("home"))
    return project.fill_defaults(supplier, T.StructType.fromDDL("s_suppkey long, home int"),
                                 {"home": "99"}, when_null=True)


@query("""
SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) + 1000 AS id, o_orderkey, o_custkey
FROM orders
""")
def dense_ids(spark, sf):
    orders = load_table(spark, sf, "orders").select("o_orderdate", "o_orderkey", "o_custkey")
    return project.add_dense_ids(orders, ["o_orderdate", "o_orderkey"], start=1001).drop("o_orderdate")


@query("""
WITH t AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F')
SELECT (SELECT max(id) FROM t) + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id, o_orderkey
FROM orders WHERE o_orderstatus <> 'F'
""")
def ids_continue(spark, sf):
    """New rows of a table whose ids count up by themselves."""
    orders = load_table(spark, sf, "orders")
    target = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    facts = catalog.describe(spark, {"t": target}, defaults={("t", "id"): "nextval('t_id_seq'::regclass)"})
    numbered = [r.column_name for r in project.auto_increment_columns(facts).collect()]
    new = orders.where("o_orderstatus <> 'F'").select("o_orderdate", "o_orderkey")
    return project.continue_ids(new, target, ["o_orderdate", "o_orderkey"], numbered[0]).drop("o_orderdate")


@query("""
SELECT l_orderkey, CAST(0 AS BIGINT) AS piece,
       array_to_string(list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey), ',') AS parts
FROM lineitem GROUP BY l_orderkey
""")
def ordered_list(spark, sf):
    lists = ordering.ordered_list(load_table(spark, sf, "lineitem"), ["l_orderkey"],
                                  ["l_linenumber", "l_partkey", "l_suppkey"], "l_partkey", "parts")
    return lists.withColumn("parts", F.array_join(F.col("parts").cast("array<string>"), ","))


@query("""
WITH numbered AS (
  SELECT event_type, user_id, event_id,
         row_number() OVER (PARTITION BY event_type ORDER BY user_id, event_id) - 1 AS pos
  FROM events)
SELECT event_type, CAST(floor(pos / 50) AS BIGINT) AS piece,
       array_to_string(list(event_id ORDER BY pos), ',') AS ids
FROM numbered GROUP BY ALL
""")
def ordered_list_pieces(spark, sf):
    """Groups over the size limit come in pieces of at most that many items."""
    lists = ordering.ordered_list(load_table(spark, sf, "events"), ["event_type"],
                                  ["user_id", "event_id"], "event_id", "ids", max_items=50)
    return lists.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query(f"""
SELECT {', '.join(c for c in LINE_ORDER if c != 'l_shipdate')},
       strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate
FROM lineitem ORDER BY {', '.join(LINE_ORDER)[:-len('l_shipdate')]} lineitem.l_shipdate
LIMIT 300 OFFSET 4900
""")
def page_run(spark, sf):
    """Pages 50, 51 and 52 from one sorted run: one sort, three page reads."""
    run = ordering.SortedRun(load_table(spark, sf, "lineitem"), keys=LINE_ORDER)
    pages = [run.page(n, 100) for n in (50, 51, 52)]
    return time_text(reduce(DataFrame.unionByName, pages))
