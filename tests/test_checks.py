"""Checks, compare, search, key/value, documents, sources, SQL."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tablejobs.operators import checks, compare, documents, keyvalue as kv, search
from tablejobs.plans import namespaces, sql
from tablejobs.session import small_frame
from tablejobs.sinks import store
from tablejobs.sources import catalog, tables


def test_orphans_ignore_null_references(spark):
    child = spark.createDataFrame([(1, 10), (2, 99), (3, 99), (4, None)], "id int, fk int")
    parent = spark.createDataFrame([(10,), (11,)], "pk int")
    assert rows(checks.orphan_keys(child, parent, {"fk": "pk"})) == [(99, 2)]
    assert rows(checks.orphan_rows(child, parent, {"fk": "pk"})) == [(99, 2), (99, 3)]
    report = checks.reference_report([("a", child, parent, {"fk": "pk"}),
                                      ("b", child.limit(0), parent, {"fk": "pk"})])
    assert rows(report) == [("a", 1, 2), ("b", 0, 0)]


def test_unique_and_not_null(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, None)], "id int, v string")
    assert rows(checks.unique_violations(df, ["id"])) == [(1, 2)]
    gaps = spark.createDataFrame([(None,), (None,), (1,), (1,), (2,)], "id int")
    assert rows(checks.unique_violations(gaps, ["id"])) == [(1, 2)]
    assert rows(checks.unique_violations(gaps, ["id"], nulls_too=True)) == [(1, 2), (None, 2)]
    assert rows(checks.not_null_report(df, "t", ["id", "v"])) == [
        ("t", "id", 0, True), ("t", "v", 2, False)]


def test_row_count_check(spark):
    a, b = spark.range(3), spark.range(2)
    got = rows(checks.row_count_check({"x": a, "y": a, "z": a}, {"x": a, "y": b}))
    assert got == [("x", 3, 3, True), ("y", 3, 2, False), ("z", 3, None, False)]


def schemas(spark):
    def frame(rows_):
        return small_frame(spark, rows_, catalog.DESCRIBE)
    source = frame([("t1", 1, "id", "int", False, None, "PRI"), ("t1", 2, "name", "text", True, None, ""),
                    ("t1", 3, "flag", "int", True, "0", ""), ("t1", 4, "k", "int", True, None, "PRI"),
                    ("t1", 5, "gone", "int", True, None, ""), ("t2", 1, "val", "text", True, None, ""),
                    ("same", 1, "a", "int", True, None, "")])
    target = frame([("t1", 1, "id", "bigint", True, None, ""), ("t1", 2, "name", "text", False, "x", ""),
                    ("t1", 3, "flag", "int", True, None, "PRI"), ("t1", 4, "k", "int", True, None, ""),
                    ("t1", 6, "extra", "int", True, None, ""), ("t3", 1, "x", "int", True, None, ""),
                    ("same", 1, "a", "int", True, None, "")])
    return source, target


def test_compare_columns_precedence(spark):
    got = {(r.table_name, r.column_name): r.status
           for r in compare.compare_columns(*schemas(spark)).collect()}
    assert got == {
        ("t1", "id"): "type_mismatch", ("t1", "name"): "nullable_mismatch",
        ("t1", "flag"): "default_mismatch", ("t1", "k"): "key_mismatch",
        ("t1", "gone"): "missing_in_target", ("t1", "extra"): "extra_in_target",
        ("t2", "val"): "missing", ("same", "a"): "match"}


def test_compare_tables_summary_and_plan(spark):
    found = compare.compare_tables(*schemas(spark))
    assert {r.table_name: r.status for r in found.collect()} == {
        "t1": "differs", "t2": "only_in_source", "t3": "only_in_target", "same": "match"}
    assert compare.compare_summary(found).first().summary == \
        "1 tables match, 3 differ, 1 extra in source, 1 extra in target"
    plan = compare.sync_plan(*schemas(spark))
    assert sorted(r.statement for r in plan.collect()) == [
        "ALTER TABLE t1 ADD COLUMN gone int", "CREATE TABLE t2", "DROP TABLE t3"]
    grown = compare.add_missing_columns(spark.range(1), plan, "t1")
    assert grown.dtypes == [("id", "bigint"), ("gone", "int")]


def test_index_lists_count_in_the_table_status(spark):
    ddl = "table_name string, index_name string, columns string, is_unique boolean"
    a = small_frame(spark, [("same", "i1", "a", True), ("same", "i2", "a", False)], ddl)
    b = small_frame(spark, [("same", "i1", "a", False), ("same", "i3", "a", False)], ddl)
    lists = compare.compare_lists(a, b, ["table_name", "index_name"])
    assert {r.index_name: r.status for r in lists.collect()} == {
        "i1": "mismatch", "i2": "missing_in_target", "i3": "extra_in_target"}
    found = compare.compare_tables(*schemas(spark), lists)
    assert {r.table_name: r.status for r in found.collect()}["same"] == "differs"


def test_describe(spark):
    df = spark.createDataFrame([(1, None)], "id int, v string")
    plain = catalog.describe(spark, {"t": df}, {"t": ["id"]}, {("t", "v"): "'x'"})
    assert rows(plain) == [("t", 1, "id", "int", False, None, "PRI"),
                           ("t", 2, "v", "string", True, "'x'", "")]
    measured = catalog.describe_measured(spark, {"t": df})
    assert [(r.column_name, r.nullable, r.row_count, r.null_count)
            for r in measured.orderBy("position").collect()] == [("id", False, 1, 0), ("v", True, 1, 1)]


def test_search_rules(spark):
    t = spark.createDataFrame([(i, f"row {i}", "Needle" if i % 2 else "hay", b"needle") for i in range(20)],
                              "id int, a string, b string, c binary")
    n = spark.createDataFrame([(1, 2)], "id int, m int")
    find = lambda needle, **kw: search.find_in_tables(spark, {"t": t, "n": n}, needle, {"t": ["id"]}, **kw)
    hits = find(" needle ", per_table=5).collect()
    assert len(hits) == 5 and {h.column_name for h in hits} == {"b"}
    assert '"id":1,' in min(h.row for h in hits)
    assert find("needle").count() == 10
    gap = spark.createDataFrame([("x", None)], "a string, b string")
    assert search.find_in_table(gap, "t", "x", None).first().row == '{"a":"x","b":null}'
    assert find("").columns == ["table_name", "column_name", "value", "row"] and find("  ").count() == 0
    assert find("%").count() == 0 and find("_").count() == 0
    assert find("needle", max_tables=0).count() == 0
    both = spark.createDataFrame([(1, "xx", "xx")], "id int, a string, b string")
    assert search.find_in_table(both, "t", "x", ["id"]).count() == 2


def kv_frame(spark):
    ddl = ("key string, type string, ttl long, str string, list array<string>, set array<string>, "
           "hash map<string,string>, zset array<struct<member:string,score:double>>, "
           "stream array<struct<id:string,fields:map<string,string>>>")
    n = None
    return spark.createDataFrame([
        ("s", "string", -1, "v\"", n, n, n, n, n),
        ("l", "list", 60, n, ["a", "b", "c"], n, n, n, n),
        ("e", "set", -1, n, n, ["y", "x"], n, n, n),
        ("h", "hash", -1, n, n, n, {"f": "1"}, n, n),
        ("z", "zset", -1, n, n, n, n, [("m", 2.0), ("b", 1.0), ("a", 1.0)], n),
        ("t", "stream", -1, n, n, n, n, n, [(f"{i}-0", {"k": str(i)}) for i in range(120)]),
        ("o", "module", -1, n, n, n, n, n, n)], ddl)


def test_kv_rows(spark):
    df = kv_frame(spark)
    assert rows(kv.kv_rows(df, "string")) == [("s", "string", -1, 'v"')]
    assert rows(kv.kv_rows(df, "list", page=2, size=2)) == [("l", "list", 60, 2, "c")]
    assert rows(kv.kv_rows(df, "set", page=1, size=1)) == [("e", "set", -1, "x")]
    assert rows(kv.kv_rows(df, "hash")) == [("h", "hash", -1, "f", "1")]
    assert [r.member for r in kv.kv_rows(df, "zset").orderBy("rank").collect()] == ["a", "b", "m"]
    top = kv.kv_rows(df, "zset", page=1, size=2, descending=True).orderBy("rank").collect()
    assert [(r.member, r.score) for r in top] == [("m", 2.0), ("b", 1.0)]
    assert kv.kv_rows(df, "stream").count() == 120
    with pytest.raises(ValueError):
        kv.kv_rows(df, "module")


def test_kv_facts(spark):
    df = kv_frame(spark)
    assert {r.key: r.n_elements for r in kv.key_info(df).collect()} == {
        "s": 1, "l": 3, "e": 2, "h": 1, "z": 3, "t": 120, "o": 1}
    places = {r.object_type: r.place for r in kv.type_counts(df).collect()}
    assert sorted(places, key=places.get) == ["STRING", "HASH", "LIST", "SET", "ZSET", "STREAM", "MODULE"]
    value = {r.key: r.value for r in kv.value_json(df).collect()}
    assert value["s"] == '"v\\""' and value["l"] == '["a","b","c"]' and value["h"] == '{"f":"1"}'
    assert value["z"].startswith('[{"member":"a","score":1.0}')
    assert value["t"].count('"id"') == 120 and value["o"] == '"(unknown type)"'


@pytest.mark.parametrize("pattern, keys", [
    ("*", "abc a.c a*c ab/c xabc abd"), ("a?c", "abc a.c a*c"), ("a.c", "a.c"), ("a\\*c", "a*c"),
    ("a[b.]c", "abc a.c"), ("a[^b]c", "a.c a*c"), ("a[a-c]*", "abc ab/c abd"), ("*c", "abc a.c a*c ab/c xabc"),
    ("[", "")])
def test_key_patterns(spark, pattern, keys):
    df = spark.createDataFrame([(k, "string", 5) for k in "abc a.c a*c ab/c xabc abd".split()],
                               "key string, type string, ttl long")
    assert sorted(r.name for r in kv.scan_keys(df, pattern).collect()) == sorted(keys.split())


def test_key_scan_pages_and_ttl(spark):
    df = kv_frame(spark)
    first = kv.scan_keys(df, count=3).collect()
    assert [r.name for r in first] == ["e", "h", "l"] and [r.ttl for r in first] == [None, None, 60]
    assert [r.name for r in kv.scan_keys(df, after="l", count=3).collect()] == ["o", "s", "t"]
    assert rows(kv.scan_keys(df, kind="ZSet")) == [("z", "ZSET", None)]


def test_document_keys_and_flatten(spark):
    df = spark.createDataFrame([('{"b":1,"a":{"x":2}}',), ('{"c":null,"a":"t"}',), ("no",)], "doc string")
    assert rows(documents.document_keys(df, "doc")) == [("a", 2), ("b", 1), ("c", 1)]
    flat = documents.flatten_documents(df, "doc")
    assert flat.columns == ["a", "b", "c"] and flat.first().a == '{"x":2}'


def test_sources(spark, ns, tmp_path):
    df = spark.createDataFrame([(1, "x")], "id int, v string")
    df.write.parquet(str(tmp_path / "t.parquet"))
    folder = {"format": "folder", "path": str(tmp_path)}
    assert tables.table_names(spark, folder) == ["t"] and tables.table_bytes(spark, folder, "t") > 0
    with pytest.raises(LookupError):
        tables.read_table(spark, folder, "nope")
    store.write_table(ns, "a", df)
    catalog_spec = {"format": "catalog", "database": ns.name}
    assert tables.table_names(spark, catalog_spec) == ["a"]
    listed = catalog.catalogue(spark, catalog_spec).first()
    assert (listed.name, listed.object_type, listed.row_count) == ("a", "TABLE", 1)
    assert listed.size_bytes > 0
    with pytest.raises(ValueError, match="exists"):
        namespaces.create_table(spark, ns, "a", "id int")


def test_jdbc_options_split_by_column():
    spec = {"format": "jdbc", "url": "jdbc:x", "options": {"user": "u"}, "partition": {"t": "id"},
            "num_partitions": 8}
    options = tables.jdbc_options(spec, "t", (1, 900))
    assert options["partitionColumn"] == "id" and options["upperBound"] == "900"
    assert options["numPartitions"] == "8" and options["user"] == "u"
    assert "partitionColumn" not in tables.jdbc_options(spec, "other", (1, 2))
    assert "partitionColumn" not in tables.jdbc_options(spec, "t", (None, None))


def test_user_sql(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id int, name string")
    empty = sql.run_sql(spark, "SELECT * FROM {t} WHERE 1 = 0", {"t": df})
    assert empty.columns == ["id", "name"] and empty.count() == 0
    sql.create_function(spark, "tj_one", "x INT", "INT", "x + 1")
    assert [r.n for r in sql.run_sql(spark, "SELECT tj_one(id) AS n FROM {t} ORDER BY 1", {"t": df}).collect()] == [2, 3]
    spark.sql("DROP TEMPORARY FUNCTION tj_one")


def test_content_differences_narrow_to_the_rows(spark):
    from tablejobs.operators.checks import content_differences

    base = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"), F.lit("x").alias("s"))
    same, sizes = content_differences(base, base.select("s", "v", "k"), ["k"])
    assert same.count() == 0 and len(sizes) == 1
    changed = (base.withColumn("v", F.when(F.col("k") == 5, 99).otherwise(F.col("v")))
               .where("k <> 7").unionByName(base.where("k = 9")).unionByName(base.limit(0).unionByName(
                   spark.createDataFrame([(None, 1, "n")], "k long, v long, s string"))))
    found, sizes = content_differences(base, changed, ["k"], fan=16, few=100)
    got = sorted((r.side, r.k) for r in found.collect() if r.k is not None)
    assert got == [("left_only", 5), ("left_only", 7), ("right_only", 5), ("right_only", 9)]
    assert [r.side for r in found.collect() if r.k is None] == ["right_only"]
    assert len(sizes) >= 2 and sizes[-1] < sizes[0]


def test_key_candidates_are_measured_and_confirmed(spark):
    from tablejobs.operators.checks import key_candidates

    df = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 4999).alias("near"),
                                  F.when(F.col("id") == 3, None).otherwise(F.col("id")).alias("nully"),
                                  F.concat(F.lit("x"), F.col("id").cast("string")).alias("name"))
    got = sorted(tuple(r) for r in key_candidates({"t": df, "empty": df.limit(0)}).collect())
    assert got == [("t", "k"), ("t", "name")]


def test_describe_stored_lists_views_types_and_defaults(spark, ns):
    from tablejobs.plans import namespaces
    from tablejobs.sinks import store
    from tablejobs.sources.catalog import describe_stored

    store.write_table(ns, "t", spark.createDataFrame([(1, 2.5)], "k long, x double"))
    namespaces.add_columns(spark, ns, "t", {"d": ("int", "7")})
    spark.sql(f"CREATE VIEW {store.qualified(ns, 'v')} AS SELECT k FROM {store.qualified(ns, 't')}")
    got = sorted((r.table_name, r.table_type, r.position, r.column_name, r.data_type, r.default_value)
                 for r in describe_stored(spark, ns.name).collect())
    assert got == [("t", "EXTERNAL", 1, "k", "bigint", None), ("t", "EXTERNAL", 2, "x", "double", None),
                   ("t", "EXTERNAL", 3, "d", "int", "7"), ("v", "VIEW", 1, "k", "bigint", None)]


def test_content_summary_depends_on_rows(spark):
    from tablejobs.operators.compare import content_summary

    a = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    b = a.withColumn("v", F.when(F.col("k") == 7, 0).otherwise(F.col("v"))).where("k <> 9")
    row = content_summary({"x": (a, b, ["k"]), "y": (a, a, ["k"]), "z": (a.limit(0), a.limit(0), ["k"])}).first()
    assert tuple(row) == (3, 2, 1, 1000, 999, 2, 1)
