"""Filters, pages, numbering, lists, defaults."""

import pytest
from conftest import rows
from pyspark.sql import functions as F, types as T

from tablejobs.operators import filters, ordering, project


def people(spark):
    return spark.createDataFrame(
        [(1, "Ann", 10.5), (2, "Bob", None), (3, "bo%b", 30.0), (4, "007", 4.0)],
        "id int, name string, score double")


@pytest.mark.parametrize("boxes, ids", [
    ({}, [1, 2, 3, 4]),
    ({"id": " "}, [1, 2, 3, 4]),
    ({"id": "2"}, [2]),
    ({"id": ">= 2", "score": "<30.5"}, [3, 4]),
    ({"id": "<>2"}, [1, 3, 4]),
    ({"id": "!= 2"}, [1, 3, 4]),
    ({"name": "B%"}, [2]),
    ({"name": "%b"}, [2, 3]),
    ({"name": "Ann"}, [1]),
    ({"name": "007"}, [4]),
    ({"name": "=Bob"}, [2]),
    ({"score": "=10.5"}, [1]),
])
def test_filter_boxes(spark, boxes, ids):
    assert [r.id for r in filters.filter_boxes(people(spark), boxes).orderBy("id").collect()] == ids


def test_where_text(spark):
    assert filters.where_text(people(spark), "id > 1 and name like '%b'").count() == 2
    assert filters.where_text(people(spark), None).count() == 4


def test_document_filter(spark):
    df = spark.createDataFrame([(1, "x", (5,)), (2, "y", (6,)), (3, None, (6,))],
                               "id int, t string, o struct<k:int>")
    pick = lambda text: [r.id for r in filters.document_filter(df, text).orderBy("id").collect()]
    assert pick('{"t": "y", "o": {"k": 6}}') == [2]
    assert pick('{"o.k": 6}') == [2, 3]
    assert pick('{"t": null}') == [3]
    for bad in ("{t: y}", "", None, "[1]", "3"):
        assert pick(bad) == [1, 2, 3]


def test_sort_places_nulls(spark):
    order = lambda d: [r.id for r in ordering.sort_by(people(spark), "score", d, ["id"]).collect()]
    assert order("asc") == [2, 4, 1, 3]
    assert order("DESC") == [3, 1, 4, 2]


@pytest.mark.parametrize("top_n", [ordering.TOP_N_ROWS, 0])
def test_pages_cover_the_table_once(spark, top_n):
    df = spark.range(0, 57).withColumn("g", F.col("id") % 3)
    pages = [[r.id for r in ordering.page(df, p, 10, "g", "desc", ["id"], top_n=top_n)
              .orderBy(F.desc("g"), "id").collect()] for p in range(1, 8)]
    want = sorted(range(57), key=lambda i: (-(i % 3), i))
    assert sum(pages, []) == want and [len(p) for p in pages] == [10] * 5 + [7, 0]
    assert tuple(ordering.page_total(df, 10).first()) == (57, 6)


@pytest.mark.parametrize("top_n", [ordering.TOP_N_ROWS, 5])
def test_row_limit_is_a_true_maximum(spark, top_n):
    got = ordering.row_limit(spark.range(100), 30, ["id"], top_n=top_n)
    assert sorted(r.id for r in got.collect()) == list(range(30))


def test_numbers_are_dense_with_a_hot_value(spark):
    df = spark.range(0, 3000, numPartitions=7).withColumn(
        "k", F.when(F.col("id") < 1000, 5).otherwise(F.col("id") % 50))
    numbered = ordering.number_rows(df, ["k", "id"]).orderBy("pos").collect()
    assert [r.pos for r in numbered] == list(range(3000))
    assert [(r.k, r.id) for r in numbered] == sorted((r.k, r.id) for r in numbered)
    ties = ordering.number_rows(df, ["k"])
    assert sorted(r.pos for r in ties.collect()) == list(range(3000))
    assert ordering.number_rows(df.limit(0), ["k"]).count() == 0


def test_hot_value_is_spread_over_partitions(spark):
    df = spark.range(0, 4000, numPartitions=4).withColumn("k", F.lit(1))
    keyed = df.withColumn("_tie", F.xxhash64("id", "k")).repartitionByRange(4, "k", "_tie")
    sizes = [r["count"] for r in keyed.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2000


def test_dense_ids_start_after_the_maximum(spark):
    got = project.add_dense_ids(people(spark), ["name"], "new_id", start=10)
    assert {r.name: r.new_id for r in got.collect()} == {"007": 10, "Ann": 11, "Bob": 12, "bo%b": 13}


@pytest.mark.parametrize("max_items", [100_000, 40, 7])
def test_ordered_list_pieces_are_whole_and_bounded(spark, max_items):
    df = spark.range(0, 300).select(
        F.when(F.col("id") < 100, 0).otherwise(F.col("id")).alias("k"), (-F.col("id")).alias("o"),
        F.concat(F.lit("v"), F.col("id")).alias("v"))
    got = ordering.ordered_list(df, ["k"], ["o"], "v", max_items=max_items).collect()
    assert max(len(r["items"]) for r in got) <= max_items
    hot = sorted((r.piece, r["items"]) for r in got if r.k == 0)
    assert sum((items for _, items in hot), []) == [f"v{i}" for i in range(99, -1, -1)]
    assert [p for p, _ in hot] == list(range(len(hot)))
    assert sum(len(r["items"]) for r in got) == 300


def test_row_handle_and_preview(spark):
    handle = project.row_handle(people(spark), ["id", "name"]).orderBy("id").first().handle
    assert tuple(handle) == (1, "Ann")
    assert [r.id for r in project.preview(spark.range(500), ["id"]).collect()] == list(range(100))


@pytest.mark.parametrize("raw, dtype, want", [
    ("NULL::character varying", T.StringType(), None),
    ("'{}'::text", T.StringType(), "CAST('{}' AS string)"),
    ("nextval('s'::regclass)", T.LongType(), None),
    ("'0000-00-00 00:00:00'", T.StringType(), "CAST('1970-01-01' AS string)"),
    ("CURRENT_TIMESTAMP", T.TimestampType(), "CAST(CURRENT_TIMESTAMP AS timestamp)"),
    ("", T.StringType(), None), (None, T.StringType(), None),
    ("5", T.IntegerType(), "CAST(5 AS int)"),
])
def test_default_expression(raw, dtype, want):
    assert project.default_expression(raw, dtype) == want


def test_fill_defaults(spark):
    schema = T.StructType.fromDDL("id long, name string, score double, note string")
    got = project.fill_defaults(people(spark), schema, {"score": "1.5", "note": "'n'"})
    assert rows(got)[1] == (2, "Bob", None, "n")  # an explicit NULL stays
    got = project.fill_defaults(people(spark), schema, {"score": "1.5"}, when_null=True)
    assert rows(got)[1] == (2, "Bob", 1.5, None)


@pytest.mark.parametrize("raw, want", [
    ("'a::b'::text", "a::b"), ("active", "active"), ("'it''s'", "it's"), ("lower('X')", "x")])
def test_default_text(spark, raw, want):
    schema = T.StructType.fromDDL("id int, note string")
    assert rows(project.fill_defaults(people(spark).select("id"), schema, {"note": raw}))[0] == (1, want)


def test_pages_of_tied_rows_share_and_miss_none(spark):
    df = spark.range(0, 400).selectExpr("id % 2 AS g", "id AS v", "id % 7 AS w").repartition(5)
    seen = [r.v for p in range(1, 41) for r in ordering.page(df, p, 10, "g", top_n=200).collect()]
    assert sorted(seen) == list(range(400))
    assert [r.v for r in ordering.page(df, 1, 3).collect()] == [0, 2, 4]


@pytest.mark.parametrize("limits", [{}, {"max_items": 2}, {"max_bytes": 2}])
def test_list_of_ties_is_the_same_in_pieces(spark, limits):
    df = spark.createDataFrame([(1, 0, v) for v in (5, 9, 1, 3)], "k int, o int, v int")
    pieces = ordering.ordered_list(df, ["k"], ["o"], "v", **limits).orderBy("piece").collect()
    assert [v for p in pieces for v in p["items"]] == [1, 3, 5, 9]
    assert len(pieces) == (2 if limits else 1)


def test_a_sorted_run_serves_pages_without_sorting_again(spark):
    from pyspark.sql import functions as F

    from tablejobs.operators.ordering import SortedRun, page

    df = spark.range(3000).select((F.col("id") % 17).alias("g"), F.col("id").alias("k"), F.lit("x").alias("s"))
    df = df.unionByName(df.where("k < 40"))  # repeated rows
    run = SortedRun(df.repartition(7), "g", "desc", ["k"])
    pages = [run.page(n, 250) for n in range(1, 15)]
    got = [tuple(r) for p in pages for r in p.collect()]
    want = [tuple(r) for r in df.orderBy(F.col("g").desc(), "k", "s").collect()]
    assert got == want and run.total == 3040
    assert [tuple(r) for r in run.page(3, 250).collect()] == [tuple(r) for r in page(df, 3, 250, "g", "desc", ["k"]).collect()]
    plan = pages[5]._jdf.queryExecution().executedPlan().toString()
    assert "_at" in plan and "PushedFilters" in plan
    assert run.page(100, 250).count() == 0
