"""Catalogue list, schema description and compare.

Nullability and row counts are measured on the data, so the work of these
queries grows with the tables.
"""

from pyspark.sql import functions as F

from tablejobs.operators import compare
from tablejobs.plans import namespaces
from tablejobs.session import TABLES, scratch_namespace
from tablejobs.sinks import store
from tablejobs.sources import catalog

from .base import current_rows, folder, load_tables, query

# Columns and types of the given tables.
COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"],
    "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "events": ["event_id"], "documents": ["doc_id"], "embeddings": ["vec_id"],
    "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id"],
    "conversations": ["conv_id", "turn"],
}
DEFAULTS = {("orders", "o_orderstatus"): "'O'", ("documents", "lang"): "'en'"}


def _describe_sql(tables) -> str:
    parts = []
    for table in tables:
        for i, column in enumerate(COLUMNS[table].split(", "), start=1):
            name, dtype = column.split(" ")
            default = DEFAULTS.get((table, name))
            default = "NULL" if default is None else "'" + default.replace("'", "''") + "'"
            key = "PRI" if name in KEYS.get(table, []) else ""
            parts.append(
                f"SELECT '{table}' AS table_name, {i} AS position, '{name}' AS column_name, "
                f"'{dtype}' AS data_type, count(*) > count({name}) AS nullable, "
                f"CAST({default} AS VARCHAR) AS default_value, '{key}' AS column_key, "
                f"count(*) AS row_count, count(*) - count({name}) AS null_count FROM {table}")
    return " UNION ALL ".join(parts)


@query(_describe_sql(TABLES))
def schema_describe(spark, sf):
    return catalog.describe_measured(spark, load_tables(spark, sf), KEYS, DEFAULTS, _paths(sf))


@query(" UNION ALL ".join(
    f"SELECT '{t}' AS name, 'TABLE' AS object_type, count(*) AS row_count FROM {t}" for t in TABLES))
def catalog_counts(spark, sf):
    return catalog.catalogue(spark, folder(sf), list(TABLES)).select(
        "name", "object_type", "row_count")


def _paths(sf, names=TABLES):
    return {t: f"{sf}/{t}.parquet" for t in names}


def _sides(spark, sf):
    """Source: six tables. Target: orders with a NULL-able status, documents
    without n_chars and with another default, part with a retyped size and an
    added column, labels with another key; supplier is missing, nation is new."""
    frames = load_tables(spark, sf, ["customer", "supplier", "part", "orders", "documents",
                                     "labels", "nation"])
    nation = frames.pop("nation")
    target = {
        "customer": frames["customer"],
        "part": frames["part"].withColumn("p_size", F.col("p_size").cast("bigint"))
                              .withColumn("p_note", F.col("p_type")),
        "orders": frames["orders"].withColumn(
            "o_orderstatus", F.nullif("o_orderstatus", F.lit("P"))),
        "documents": frames["documents"].drop("n_chars"),
        "labels": frames["labels"],
        "nation": nation,
    }
    source = catalog.describe_measured(spark, frames, KEYS, DEFAULTS, _paths(sf))
    changed = catalog.describe_measured(
        spark, target, {**KEYS, "labels": ["doc_id", "quality"]},
        {**DEFAULTS, ("documents", "lang"): "'fr'"}, _paths(sf, ["customer", "labels", "nation"]))
    return source, changed


_ORDERS_STATUS = "(SELECT count(*) > 0 FROM orders WHERE o_orderstatus = 'P')"


def _compare_sql() -> str:
    out = []
    for table in ("customer", "supplier", "part", "orders", "documents", "labels"):
        for column in COLUMNS[table].split(", "):
            name, dtype = column.split(" ")
            has = f"(SELECT count(*) > count({name}) FROM {table})"
            target_type, status, target_null = f"'{dtype}'", "'match'", has
            if table == "supplier":
                target_type, status, target_null = "NULL", "'missing'", "NULL"
            elif name == "n_chars":
                target_type, status, target_null = "NULL", "'missing_in_target'", "NULL"
            elif name == "p_size":
                target_type, status = "'bigint'", "'type_mismatch'"
            elif name == "o_orderstatus":
                target_null = _ORDERS_STATUS
                status = f"CASE WHEN {_ORDERS_STATUS} THEN 'nullable_mismatch' ELSE 'match' END"
            elif name == "lang":
                status = "'default_mismatch'"
            elif name == "quality":
                status = "'key_mismatch'"
            out.append(f"SELECT '{table}' AS table_name, '{name}' AS column_name, "
                       f"'{dtype}' AS source_data_type, CAST({target_type} AS VARCHAR) AS "
                       f"target_data_type, {has} AS source_nullable, CAST({target_null} AS BOOLEAN) "
                       f"AS target_nullable, {status} AS status")
    out.append("SELECT 'part', 'p_note', NULL, 'string', NULL, "
               "(SELECT count(*) > count(p_type) FROM part), 'extra_in_target'")
    return " UNION ALL ".join(out)


@query(_compare_sql())
def schema_compare(spark, sf):
    return compare.compare_columns(*_sides(spark, sf)).select(
        "table_name", "column_name", "source_data_type", "target_data_type",
        "source_nullable", "target_nullable", "status")


@query("""
SELECT CAST(1 AS BIGINT) AS n_match, CAST(6 AS BIGINT) AS n_differ,
       CAST(1 AS BIGINT) AS extra_in_source, CAST(1 AS BIGINT) AS extra_in_target,
       '1 tables match, 6 differ, 1 extra in source, 1 extra in target' AS summary
""")
def compare_summary(spark, sf):
    return compare.compare_summary(compare.compare_tables(*_sides(spark, sf)))


@query("""
SELECT 'supplier' AS table_name, 'create_table' AS action, CAST(NULL AS VARCHAR) AS column_name,
       CAST(NULL AS VARCHAR) AS data_type, 'CREATE TABLE supplier' AS statement
UNION ALL SELECT 'nation', 'drop_table', NULL, NULL, 'DROP TABLE nation'
UNION ALL SELECT 'documents', 'add_column', 'n_chars', 'bigint',
       'ALTER TABLE documents ADD COLUMN n_chars bigint'
""")
def sync_plan(spark, sf):
    return compare.sync_plan(*_sides(spark, sf))


@query("""
SELECT doc_id, text, lang, source, CAST(NULL AS BIGINT) AS n_chars FROM documents
""")
def sync_apply(spark, sf):
    source, target = _sides(spark, sf)
    documents = load_tables(spark, sf, ["documents"])["documents"].drop("n_chars")
    return compare.add_missing_columns(documents, compare.sync_plan(source, target), "documents")


@query("""
SELECT 'supplier' AS table_name, 'only_in_source' AS status
UNION ALL SELECT 'nation', 'only_in_target'
""")
def table_set_difference(spark, sf):
    """Names only: the declared schemas say which tables there are."""
    frames = load_tables(spark, sf, ["customer", "supplier", "part", "orders", "documents", "labels", "nation"])
    one_side = lambda without: catalog.describe(spark, {t: df for t, df in frames.items() if t != without})
    return compare.table_difference(one_side("nation"), one_side("supplier"))


@query("""
WITH s AS (SELECT 'orders' AS table_name, 'by_status' AS index_name, o_orderstatus AS part, count(*) AS n_rows
           FROM orders GROUP BY ALL),
     t AS (SELECT * FROM s WHERE part <> 'P'
           UNION ALL SELECT 'orders', 'by_status', 'X', 1)
SELECT table_name, index_name, part,
       CASE WHEN t.n_rows IS NULL THEN 'missing_in_target' WHEN s.n_rows IS NULL THEN 'extra_in_target'
            ELSE 'match' END AS status
FROM s FULL JOIN t USING (table_name, index_name, part)
""")
def index_compare(spark, sf):
    """Lists of index parts, as a catalogue keeps them, compared both ways."""
    orders = load_tables(spark, sf, ["orders"])["orders"]
    source = orders.groupBy(F.lit("orders").alias("table_name"), F.lit("by_status").alias("index_name"),
                            F.col("o_orderstatus").alias("part")).agg(F.count("*").alias("n_rows"))
    target = source.where("part <> 'P'").unionByName(
        orders.sparkSession.range(1).select(F.lit("orders").alias("table_name"), F.lit("by_status").alias("index_name"),
                                            F.lit("X").alias("part"), F.lit(1).cast("long").alias("n_rows")))
    found = compare.compare_lists(source, target, ["table_name", "index_name", "part"])
    return found.select("table_name", "index_name", "part", "status")


@query("""
SELECT doc_id, text, lang, source, CAST(NULL AS BIGINT) AS n_chars FROM documents
""")
def sync_apply_table(spark, sf):
    """The plan applied to stored tables: a column added, a table made."""
    frames = load_tables(spark, sf, ["documents", "supplier"])
    with scratch_namespace(spark) as ns:
        store.write_table(ns, "documents", frames["documents"].drop("n_chars"))
        source = catalog.describe(spark, frames)
        target = catalog.describe(spark, {"documents": spark.table(store.qualified(ns, "documents"))})
        namespaces.apply_sync(spark, ns, compare.sync_plan(source, target), frames)
        if spark.table(store.qualified(ns, "supplier")).schema != frames["supplier"].schema:
            raise RuntimeError("the new table has other columns")
        return current_rows(spark, ns, "documents")


@query("""
SELECT * FROM (VALUES
  ('documents', 'EXTERNAL', 1, 'doc_id', 'bigint', true, NULL),
  ('documents', 'EXTERNAL', 2, 'text', 'string', true, NULL),
  ('documents', 'EXTERNAL', 3, 'lang', 'string', true, NULL),
  ('documents', 'EXTERNAL', 4, 'source', 'string', true, NULL),
  ('documents', 'EXTERNAL', 5, 'n_chars', 'bigint', true, NULL),
  ('documents', 'EXTERNAL', 6, 'checked', 'string', true, '''no'''),
  ('langs', 'VIEW', 1, 'lang', 'string', true, NULL),
  ('langs', 'VIEW', 2, 'n', 'bigint', false, NULL)
) AS v(table_name, table_type, position, column_name, data_type, nullable, default_value)
""")
def describe_stored(spark, sf):
    """A stored table with a column added by default, and a view, as the
    catalogue describes them."""
    with scratch_namespace(spark) as ns:
        store.write_table(ns, "documents", load_tables(spark, sf, ["documents"])["documents"])
        namespaces.add_columns(spark, ns, "documents", {"checked": ("string", "'no'")})
        spark.sql(f"CREATE VIEW {store.qualified(ns, 'langs')} AS "
                  f"SELECT lang, count(*) AS n FROM {store.qualified(ns, 'documents')} GROUP BY lang")
        return catalog.describe_stored(spark, ns.name)


@query("""
SELECT CAST(3 AS BIGINT) AS n_tables, CAST(1 AS BIGINT) AS n_same, CAST(2 AS BIGINT) AS n_differ,
       (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) AS source_rows,
       (SELECT count(*) FROM orders WHERE o_orderkey % 100 <> 0) + (SELECT count(*) FROM customer)
         + (SELECT count(*) FROM nation) AS target_rows,
       (SELECT count(*) FROM orders WHERE o_orderkey % 100 = 0)
         + (SELECT count(*) FROM customer WHERE c_custkey % 50 = 0) AS rows_only_source,
       (SELECT count(*) FROM customer WHERE c_custkey % 50 = 0) AS rows_only_target
""")
def compare_content(spark, sf):
    """A summary that depends on rows: orders lose every hundredth order,
    customers get a new balance for every fiftieth, nations stay."""
    frames = load_tables(spark, sf, ["orders", "customer", "nation"])
    changed = frames["customer"].withColumn("c_acctbal", F.when(F.col("c_custkey") % 50 == 0, F.col("c_acctbal") + 1)
                                            .otherwise(F.col("c_acctbal")))
    return compare.content_summary({
        "orders": (frames["orders"], frames["orders"].where("o_orderkey % 100 <> 0"), ["o_orderkey"]),
        "customer": (frames["customer"], changed, ["c_custkey"]),
        "nation": (frames["nation"], frames["nation"], ["n_nationkey"])})
