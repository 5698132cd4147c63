"""Reference, uniqueness, NULL and row-count checks."""

from pyspark.sql import functions as F

from tablejobs.operators import checks

from .base import load_table, load_tables, query


@query("""
SELECT d.doc_id, count(*) AS n_rows FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY d.doc_id
""")
def fk_orphans(spark, sf):
    frames = load_tables(spark, sf, ["documents", "labels"])
    return checks.orphan_keys(frames["documents"], frames["labels"], {"doc_id": "doc_id"})


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
""")
def fk_orphan_rows(spark, sf):
    parent = load_table(spark, sf, "orders").where("o_orderstatus <> 'P'")
    rows = checks.orphan_rows(load_table(spark, sf, "lineitem"), parent,
                              {"l_orderkey": "o_orderkey"})
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")


_REFERENCES = [
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("documents", "doc_id", "labels", "doc_id"),
    ("events", "user_id", "customer", "c_custkey"),
]


@query(" UNION ALL ".join(
    f"SELECT '{c}.{ck}' AS reference, count(DISTINCT {ck}) AS orphan_values, "
    f"count(*) AS orphan_rows FROM {c} WHERE {ck} NOT IN (SELECT {pk} FROM {p})"
    for c, ck, p, pk in _REFERENCES))
def fk_report(spark, sf):
    frames = load_tables(spark, sf)
    return checks.reference_report([(f"{c}.{ck}", frames[c], frames[p], {ck: pk})
                                    for c, ck, p, pk in _REFERENCES])


@query("""
SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
""")
def unique_violations(spark, sf):
    return checks.unique_violations(load_table(spark, sf, "lineitem"),
                                    ["l_orderkey", "l_linenumber"])


@query("""
WITH t AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus,
                  CASE WHEN o_totalprice < 400000 THEN o_totalprice END AS o_totalprice FROM orders)
SELECT 'orders' AS table_name, 'o_orderkey' AS column_name, count(*) - count(o_orderkey) AS n_null,
       count(*) = count(o_orderkey) AS ok FROM t
UNION ALL SELECT 'orders', 'o_orderstatus', count(*) - count(o_orderstatus),
       count(*) = count(o_orderstatus) FROM t
UNION ALL SELECT 'orders', 'o_totalprice', count(*) - count(o_totalprice),
       count(*) = count(o_totalprice) FROM t
""")
def not_null_report(spark, sf):
    orders = load_table(spark, sf, "orders").select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"),
        F.when(F.col("o_totalprice") < 400000, F.col("o_totalprice")).alias("o_totalprice"))
    return checks.not_null_report(orders, "orders", ["o_orderkey", "o_orderstatus", "o_totalprice"])


@query("""
SELECT 'left_only' AS side, o_orderkey FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)
UNION ALL
SELECT 'right_only' AS side, o_orderkey FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)
""")
def content_diff(spark, sf):
    """A copy of orders with one cell changed: narrowing finds that row."""
    orders = load_table(spark, sf, "orders")
    first = orders.agg(F.min("o_orderkey")).first()[0]
    copy = orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") == first, F.col("o_totalprice") + 1)
                             .otherwise(F.col("o_totalprice")))
    found, _ = checks.content_differences(orders, copy, ["o_orderkey"], few=256)
    return found.select("side", "o_orderkey")


@query("SELECT count(*) AS n_rows, 0 AS n_differing, 1 AS levels FROM orders")
def content_equal(spark, sf):
    """A table and its copy: the first level, one row a side, settles it."""
    orders = load_table(spark, sf, "orders")
    found, sizes = checks.content_differences(orders, orders.select(*reversed(orders.columns)).select(*orders.columns),
                                              ["o_orderkey"])
    return spark.createDataFrame([(orders.count(), found.count(), len(sizes))],
                                 "n_rows long, n_differing long, levels int")



_KEYED = ['region', 'nation', 'supplier', 'customer', 'part', 'orders', 'lineitem']


@query("""
WITH t AS (SELECT 'region' AS table_name, column_name, v FROM (UNPIVOT (SELECT COLUMNS(*)::VARCHAR FROM region) ON COLUMNS(*) INTO NAME column_name VALUE v) UNION ALL
 SELECT 'nation' AS table_name, column_name, v FROM (UNPIVOT (SELECT COLUMNS(*)::VARCHAR FROM nation) ON COLUMNS(*) INTO NAME column_name VALUE v) UNION ALL
 SELECT 'supplier' AS table_name, column_name, v FROM (UNPIVOT (SELECT COLUMNS(*)::VARCHAR FROM supplier) ON COLUMNS(*) INTO NAME column_name VALUE v) UNION ALL
 SELECT 'customer' AS table_name, column_name, v FROM (UNPIVOT (SELECT COLUMNS(*)::VARCHAR FROM customer) ON COLUMNS(*) INTO NAME column_name VALUE v) UNION ALL
 SELECT 'part' AS table_name, column_name, v FROM (UNPIVOT (SELECT COLUMNS(*)::VARCHAR FROM part) ON COLUMNS(*) INTO NAME column_name VALUE v) UNION ALL
 SELECT 'orders' AS table_name, column_name, v FROM (UNPIVOT (SELECT COLUMNS(*)::VARCHAR FROM orders) ON COLUMNS(*) INTO NAME column_name VALUE v) UNION ALL
 SELECT 'lineitem' AS table_name, column_name, v FROM (UNPIVOT (SELECT COLUMNS(*)::VARCHAR FROM lineitem) ON COLUMNS(*) INTO NAME column_name VALUE v)),
     n AS (SELECT 'region' AS table_name, count(*) AS n FROM region UNION ALL SELECT 'nation' AS table_name, count(*) AS n FROM nation UNION ALL SELECT 'supplier' AS table_name, count(*) AS n FROM supplier UNION ALL SELECT 'customer' AS table_name, count(*) AS n FROM customer UNION ALL SELECT 'part' AS table_name, count(*) AS n FROM part UNION ALL SELECT 'orders' AS table_name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem' AS table_name, count(*) AS n FROM lineitem)
SELECT table_name, column_name FROM t JOIN n USING (table_name)
GROUP BY table_name, column_name, n HAVING count(DISTINCT v) = n AND count(v) = n
""")
def key_candidates(spark, sf):
    """Columns that are keys, by sketch first and exact count after."""
    return checks.key_candidates(load_tables(spark, sf, _KEYED))
