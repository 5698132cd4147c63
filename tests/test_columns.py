"""Columns added in the catalogue: no file written, defaults on old rows and loads."""

from pyspark.sql import functions as F

from conftest import rows
from tablejobs.plans import namespaces
from tablejobs.sinks import store
from tablejobs.sources.tables import table_location


def files_of(spark, ns, table):
    return {r.f for r in spark.table(store.qualified(ns, table)).select(F.input_file_name().alias("f")).collect()}


def test_added_columns_write_no_file_and_loads_take_defaults(spark, ns):
    store.write_table(ns, "t", spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"))
    where, before = table_location(spark, ns.name, "t"), files_of(spark, ns, "t")
    namespaces.add_columns(spark, ns, "t", {"n": ("bigint", None), "d": ("string", "'zz'")})
    assert table_location(spark, ns.name, "t") == where and files_of(spark, ns, "t") == before
    assert rows(spark.table(store.qualified(ns, "t"))) == [(1, "a", None, "zz"), (2, "b", None, "zz")]
    store.load_rows(ns, "t", spark.createDataFrame([(3, "c")], "k long, v string"), ["k"], "ignore")
    assert rows(spark.table(store.qualified(ns, "t"))) == [(1, "a", None, "zz"), (2, "b", None, "zz"), (3, "c", None, "zz")]
    store.load_rows(ns, "t", spark.createDataFrame([(4, "q")], "k long, d string"), ["k"], "ignore")
    assert (4, None, None, "q") in rows(spark.table(store.qualified(ns, "t")))


def test_sync_adds_a_column_without_rewriting(spark, ns):
    from tablejobs.operators import compare
    from tablejobs.sources import catalog

    source = {"t": spark.createDataFrame([(1, "a", 5)], "k long, v string, extra int")}
    store.write_table(ns, "t", spark.createDataFrame([(1, "a")], "k long, v string"))
    before = files_of(spark, ns, "t")
    plan = compare.sync_plan(catalog.describe(spark, source),
                             catalog.describe(spark, {"t": spark.table(store.qualified(ns, "t"))}))
    assert namespaces.apply_sync(spark, ns, plan, source) == ["t"]
    assert files_of(spark, ns, "t") == before
    assert rows(spark.table(store.qualified(ns, "t"))) == [(1, "a", None)]
