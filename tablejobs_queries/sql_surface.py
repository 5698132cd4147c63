"""The SQL that users write: joins, groups, sets, expressions, functions."""

from pyspark.sql import functions as F

from tablejobs.plans import sql
from tablejobs.session import scratch_namespace, scratch_path

from .base import load_table, load_tables, query


def _run(spark, sf, text, *names):
    return sql.run_sql(spark, text, load_tables(spark, sf, names))


def _same_sql(name, text, *names):
    """Register a query whose Spark SQL and oracle SQL are one text."""
    def run(spark, sf):
        return _run(spark, sf, text.format(**{n: "{" + n + "}" for n in names}), *names)
    run.__name__ = name
    query(text.format(**{n: n for n in names}))(run)


_same_sql("inner_join", """
SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id WHERE l.quality = 1
""", "documents", "labels")

_same_sql("left_join", """
SELECT d.doc_id, d.lang, l.quality, l.toxic
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
""", "documents", "labels")

_same_sql("right_join", """
SELECT l.doc_id, l.quality, d.lang, d.n_chars
FROM (SELECT * FROM {documents} WHERE lang <> 'en') d
RIGHT JOIN {labels} l ON d.doc_id = l.doc_id
""", "documents", "labels")

_same_sql("full_join", """
SELECT d.doc_id AS doc_id, d.lang, l.doc_id AS label_id, l.quality
FROM (SELECT * FROM {documents} WHERE lang <> 'en') d
FULL JOIN {labels} l ON d.doc_id = l.doc_id
""", "documents", "labels")

_same_sql("semi_exists", """
SELECT d.doc_id, d.source FROM {documents} d
WHERE EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id AND l.toxic = 0)
""", "documents", "labels")

@query("""
SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")
def anti_in(spark, sf):
    """NOT IN over a key without NULLs as an anti join: the SQL form would
    broadcast the inner table whatever its size."""
    frames = load_tables(spark, sf, ["documents", "labels"])
    keys = frames["labels"].select("doc_id").dropna()
    return frames["documents"].join(keys, "doc_id", "left_anti").select("doc_id", "source")


_same_sql("semi_in", """
SELECT d.doc_id, d.source FROM {documents} d
WHERE d.doc_id IN (SELECT doc_id FROM {labels} WHERE quality = 1)
""", "documents", "labels")

_same_sql("anti_not_exists", """
SELECT d.doc_id, d.source FROM {documents} d
WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id)
""", "documents", "labels")

_same_sql("group_count", """
SELECT o_orderstatus, o_orderpriority, count(*) AS n_orders
FROM {orders} GROUP BY o_orderstatus, o_orderpriority ORDER BY n_orders DESC
""", "orders")

_same_sql("group_having", """
SELECT o_custkey, count(*) AS n_orders, max(o_totalprice) AS top_price
FROM {orders} GROUP BY o_custkey HAVING count(*) > 10
""", "orders")

_same_sql("distinct_values", """
SELECT DISTINCT c_mktsegment, c_nationkey FROM {customer}
""", "customer")

_same_sql("union_all", """
SELECT c_nationkey AS nationkey, 'customer' AS kind FROM {customer}
UNION ALL SELECT s_nationkey, 'supplier' FROM {supplier}
""", "customer", "supplier")

_same_sql("union_distinct", """
SELECT c_nationkey AS nationkey FROM {customer} UNION SELECT s_nationkey FROM {supplier}
""", "customer", "supplier")

_same_sql("case_in_between_like", """
SELECT p_partkey,
       CASE WHEN p_size < 10 THEN 'small' WHEN p_size BETWEEN 10 AND 30 THEN 'medium'
            ELSE 'large' END AS size_class,
       p_brand IN ('Brand#1', 'Brand#2') AS low_brand,
       p_name LIKE '%ring%' AS is_ring,
       nullif(p_type, 'ECONOMY') IS NULL AS is_economy
FROM {part}
""", "part")

_same_sql("segment_revenue", """
SELECT c.c_mktsegment, count(*) AS n_orders,
       CAST(sum(CAST(round(o.o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
GROUP BY c.c_mktsegment
""", "orders", "customer")

_same_sql("with_view_scalar", """
WITH big AS (SELECT o_custkey, o_totalprice FROM {orders}
             WHERE o_totalprice > (SELECT avg(o_totalprice) FROM {orders}))
SELECT o_custkey, count(*) AS n_big FROM big GROUP BY o_custkey
""", "orders")


@query("SELECT p_partkey, CAST(round(p_retailprice * 1.19 * 100) AS BIGINT) AS gross_cents FROM part")
def sql_function(spark, sf):
    sql.create_function(spark, "tj_gross_cents", "price DOUBLE", "BIGINT",
                        "CAST(round(price * 1.19D * 100) AS BIGINT)")
    return _run(spark, sf, "SELECT p_partkey, tj_gross_cents(p_retailprice) AS gross_cents "
                           "FROM {part}", "part")


@query("""
SELECT p_brand, count(*) AS n_parts, min(p_retailprice) AS lowest FROM part GROUP BY p_brand
""")
def ctas(spark, sf):
    path = scratch_path(spark, "ctas")
    with scratch_namespace(spark) as ns:
        sql.run_sql(spark, f"CREATE TABLE `{ns.name}`.brands USING parquet LOCATION '{path}' AS "
                           "SELECT p_brand, count(*) AS n_parts, min(p_retailprice) AS lowest "
                           "FROM {part} GROUP BY p_brand", load_tables(spark, sf, ["part"]))
    return spark.read.parquet(path)


@query("""
SELECT p_partkey AS id, p_name AS name FROM part WHERE p_size > 25
UNION ALL SELECT s_suppkey, s_name FROM supplier
""")
def insert_select(spark, sf):
    path = scratch_path(spark, "insert")
    frames = load_tables(spark, sf, ["part", "supplier"])
    with scratch_namespace(spark) as ns:
        sql.run_sql(spark, f"CREATE TABLE `{ns.name}`.names (id BIGINT, name STRING) "
                           f"USING parquet LOCATION '{path}'")
        sql.run_sql(spark, f"INSERT INTO `{ns.name}`.names SELECT p_partkey, p_name FROM {{part}} "
                           "WHERE p_size > 25", frames)
        sql.run_sql(spark, f"INSERT INTO `{ns.name}`.names SELECT s_suppkey, s_name FROM {{supplier}}",
                    frames)
    return spark.read.parquet(path)


@query("""
SELECT c_nationkey, count(*) AS n_rich FROM customer WHERE c_acctbal > 5000 GROUP BY c_nationkey
""")
def create_view(spark, sf):
    """A permanent view over a stored table, queried by name."""
    path = scratch_path(spark, "view")
    load_table(spark, sf, "customer").write.parquet(path)
    with scratch_namespace(spark) as ns:
        spark.catalog.createTable(f"`{ns.name}`.customer", path=path, source="parquet")
        sql.run_sql(spark, f"CREATE VIEW `{ns.name}`.rich AS SELECT * FROM `{ns.name}`.customer "
                           "WHERE c_acctbal > 5000")
        return sql.run_sql(spark, "SELECT c_nationkey, count(*) AS n_rich "
                                  f"FROM `{ns.name}`.rich GROUP BY c_nationkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1e12")
def empty_select(spark, sf):
    """A query without rows still has its columns."""
    return load_table(spark, sf, "orders").where(F.col("o_totalprice") > 1e12).select(
        "o_orderkey", "o_totalprice")
