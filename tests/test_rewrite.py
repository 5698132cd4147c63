"""Replace loads and edits that rewrite only the files holding a touched key."""

from pyspark.sql import functions as F

from conftest import rows
from tablejobs import session
from tablejobs.operators import merge
from tablejobs.plans import edit
from tablejobs.sinks import store
from tablejobs.sources.tables import table_location

DATA = "/root/testdata/sf0.01"


def files_of(spark, ns, table):
    return set(r.f for r in spark.table(store.qualified(ns, table)).select(F.input_file_name().alias("f")).distinct().collect())


def orders(spark):
    return spark.read.parquet(f"{DATA}/orders.parquet").repartitionByRange(20, "o_orderkey")


def test_replacing_one_percent_of_keys_rewrites_only_their_files(spark, ns):
    target = orders(spark)
    store.write_table(ns, "orders", target)
    before = files_of(spark, ns, "orders")
    assert len(before) == 20
    keys = sorted(r.o_orderkey for r in target.select("o_orderkey").collect())
    low, high = keys[len(keys) // 2], keys[len(keys) // 2 + len(keys) // 100]
    source = target.where(F.col("o_orderkey").between(low, high)).withColumn("o_totalprice", F.lit(1.0))
    source = source.unionByName(source.limit(3).withColumn("o_orderkey", -F.col("o_orderkey")))
    done = store.replace_by_file(ns, "orders", source, ["o_orderkey"])
    after = files_of(spark, ns, "orders")
    assert 1 <= done["files"] <= 2
    assert len(before - after) == done["files"]  # only the touched files are gone
    assert len(before & after) == 20 - done["files"]  # the others are the very same files
    want = merge.merge_load(target, source, ["o_orderkey"], "replace")
    assert rows(spark.table(store.qualified(ns, "orders"))) == rows(want)
    assert session.path_children(spark, f"{ns.root}/orders/retire") == []


def test_edits_by_file_match_a_full_rewrite(spark, ns):
    base = orders(spark)
    store.write_table(ns, "orders", base)
    before = files_of(spark, ns, "orders")
    few = base.where("o_orderkey < 200")
    changes = (few.where("o_orderkey % 2 = 0").withColumn("op", F.lit("update")).withColumn("set", F.array(F.lit("o_orderpriority")))
               .withColumn("o_orderpriority", F.lit("edited"))
               .unionByName(few.where("o_orderkey % 2 = 1").withColumn("op", F.lit("delete")).withColumn("set", F.array()))
               .unionByName(few.limit(2).withColumn("o_orderkey", -F.col("o_orderkey") - 1)
                            .withColumn("op", F.lit("insert")).withColumn("set", F.array())))
    counts = edit.apply_edits(spark, ns, "orders", changes, ["o_orderkey"], by_file=True)
    assert counts["files"] == 1 and counts["added"] == 2 and counts["deleted"] > 0
    assert len(before & files_of(spark, ns, "orders")) == 19
    assert rows(spark.table(store.qualified(ns, "orders"))) == rows(merge.merge_edits(base, changes, ["o_orderkey"]))


def test_a_rewrite_cut_off_after_its_move_is_rolled_forward(spark, ns):
    target = orders(spark).where("o_orderkey < 2000")
    store.write_table(ns, "orders", target.repartitionByRange(4, "o_orderkey"))
    table = spark.table(store.qualified(ns, "orders"))
    files = store.touched_files(table, table.where("o_orderkey < 10"), ["o_orderkey"])
    assert len(files) == 1
    old = spark.read.parquet(*files)
    # The rewrite's first steps by hand: staged rows noted and moved, old file still there.
    name = "load-cut-1"
    old.write.parquet(f"{ns.root}/orders/staged-{name}")
    spark.createDataFrame([(f,) for f in files], "value string").write.text(f"{ns.root}/orders/retire/{name}")
    session.move_path(spark, f"{ns.root}/orders/staged-{name}", f"{table_location(spark, ns.name, 'orders')}/{name}")
    spark.catalog.refreshTable(store.qualified(ns, "orders"))
    assert spark.table(store.qualified(ns, "orders")).count() == target.count() + old.count()
    assert store.finish_rewrites(spark, ns, "orders") == 1
    spark.catalog.refreshTable(store.qualified(ns, "orders"))
    assert rows(spark.table(store.qualified(ns, "orders"))) == rows(target)


def test_a_rewrite_cut_off_before_its_move_is_rolled_back(spark, ns):
    target = orders(spark).where("o_orderkey < 2000")
    store.write_table(ns, "orders", target)
    name = "load-cut-2"
    target.limit(5).write.parquet(f"{ns.root}/orders/staged-{name}")
    spark.createDataFrame([("file:/nowhere/x.parquet",)], "value string").write.text(f"{ns.root}/orders/retire/{name}")
    assert store.finish_rewrites(spark, ns, "orders") == 1
    assert not session.path_exists(spark, f"{ns.root}/orders/staged-{name}")
    assert rows(spark.table(store.qualified(ns, "orders"))) == rows(target)
