"""Transfer rules: mapping, modes, errors, conflicts, limits, resume."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tablejobs.operators.project import ColumnMapping, map_columns
from tablejobs.plans import transfer as t
from tablejobs.plans.transfer import TransferOptions, transfer
from tablejobs import session
from tablejobs.session import path_exists, scratch_path
from tablejobs.sinks import store


def source(spark, **tables):
    return {"format": "frames", "frames": {
        name: spark.createDataFrame(data, ddl) for name, (data, ddl) in tables.items()}}


def table(spark, ns, name):
    return spark.table(store.qualified(ns, name))


PAIRS = ([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "id int, val string")


def test_plain_copy_keeps_quotes_and_nulls(spark, ns):
    data = [(1, "hello", 1), (2, "world", 0), (3, "foo'bar", None)]
    result = transfer(spark, source(spark, bulk=(data, "id int, v string, flag int")), ns,
                      TransferOptions(tables=["bulk"]))
    assert (result.rows, result.errors, result.transferred) == (3, [], ["bulk"])
    assert rows(table(spark, ns, "bulk")) == sorted(data, key=repr)


def test_mapping_rename_skip_default(spark):
    df = spark.createDataFrame([(1, "x", "s"), (2, None, "t")], "id int, val string, secret string")
    mapped = map_columns(df, [ColumnMapping("val", "value"), ColumnMapping("secret", skip=True)])
    assert mapped.columns == ["id", "value"]
    fixed = map_columns(df, [ColumnMapping("val", default="d")])
    assert [r.val for r in fixed.orderBy("id").collect()] == ["d", "d"]
    filled = map_columns(df, [ColumnMapping("val", default="d")], when_null=True)
    assert [r.val for r in filled.orderBy("id").collect()] == ["x", "d"]


def test_mapping_of_all_columns_skipped_is_an_error(spark, ns):
    skip = [ColumnMapping("id", skip=True), ColumnMapping("val", skip=True)]
    result = transfer(spark, source(spark, p=PAIRS), ns, TransferOptions(tables=["p"], mappings=skip))
    assert "leave no column" in result.errors[0]
    assert not store.exists(spark, ns, "p")


def test_where_and_limit(spark, ns):
    transfer(spark, source(spark, p=PAIRS), ns, TransferOptions(tables=["p"], where="id > 2"))
    assert rows(table(spark, ns, "p")) == [(3, "c"), (4, "d")]
    transfer(spark, source(spark, p=PAIRS), ns, TransferOptions(
        tables=["p"], limit=3, drop_target=True, keys={"p": ["id"]}))
    assert rows(table(spark, ns, "p")) == [(1, "a"), (2, "b"), (3, "c")]


def test_skip_goes_on_and_stop_ends(spark, ns):
    src = source(spark, t1=([(1, "a")], "id int, val string"), t2=([(2, "b")], "id int, val string"))
    names = ["t1", "nonexistent", "t2"]
    for mode in ("skip", "skip_table"):
        result = transfer(spark, src, ns, TransferOptions(tables=names, error_mode=mode, drop_target=True))
        assert (result.transferred, result.rows, len(result.errors)) == (["t1", "t2"], 2, 1)
        assert [s[4] for s in result.stats] == ["ok", "error", "ok"]
    result = transfer(spark, src, ns, TransferOptions(tables=names, error_mode="stop", drop_target=True))
    assert (result.transferred, result.rows, len(result.errors)) == (["t1"], 1, 1)


def test_structure_only_data_only_drop_truncate(spark, ns):
    src = source(spark, p=PAIRS)
    missing = transfer(spark, src, ns, TransferOptions(tables=["p"], mode="data_only"))
    assert "not found in target" in missing.errors[0]
    empty = transfer(spark, src, ns, TransferOptions(tables=["p"], mode="structure_only"))
    assert empty.stats[0][:2] == ("p", 0) and empty.stats[0][4] == "ok"
    assert table(spark, ns, "p").columns == ["id", "val"] and table(spark, ns, "p").count() == 0
    transfer(spark, src, ns, TransferOptions(tables=["p"], mode="data_only"))
    transfer(spark, src, ns, TransferOptions(tables=["p"]))
    assert table(spark, ns, "p").count() == 8
    transfer(spark, src, ns, TransferOptions(tables=["p"], truncate_target=True))
    assert table(spark, ns, "p").count() == 4
    other = source(spark, p=([(1,)], "other int"))
    transfer(spark, other, ns, TransferOptions(tables=["p"], drop_target=True))
    assert table(spark, ns, "p").columns == ["other"]


@pytest.mark.parametrize("strategy, value", [("replace", "replaced"), ("ignore", "original")])
def test_conflict_strategies_by_key(spark, ns, strategy, value):
    transfer(spark, source(spark, c=([(1, "original"), (2, "kept")], "id int, val string")), ns,
             TransferOptions(tables=["c"]))
    transfer(spark, source(spark, c=([(1, "replaced"), (3, "new")], "id int, val string")), ns,
             TransferOptions(tables=["c"], conflict=strategy, keys={"c": ["id"]}))
    assert rows(table(spark, ns, "c")) == [(1, value), (2, "kept"), (3, "new")]


def test_conflict_error_leaves_the_target(spark, ns):
    transfer(spark, source(spark, c=([(1, "original")], "id int, val string")), ns,
             TransferOptions(tables=["c"]))
    result = transfer(spark, source(spark, c=([(1, "x"), (2, "y")], "id int, val string")), ns,
                      TransferOptions(tables=["c"], keys={"c": ["id"]}))
    assert len(result.errors) == 1
    assert rows(table(spark, ns, "c")) == [(1, "original")]


def test_failed_table_is_not_ok_and_leaves_nothing(spark, ns):
    bad = {"format": "frames", "frames": {
        "bad": spark.createDataFrame([("x",)], "v string").select(F.col("v").cast("int"))}}
    result = transfer(spark, bad, ns, TransferOptions(tables=["bad"]))
    assert result.stats[0][4] == "error" and not store.exists(spark, ns, "bad")


def test_resume_passes_over_finished_tables(spark, ns):
    checkpoint = t.checkpoint_path(scratch_path(spark, "cp"), "s", "db", "t", "db2")
    options = TransferOptions(tables=["t1", "t2"], checkpoint=checkpoint)
    first = transfer(spark, source(spark, t1=PAIRS), ns, options)
    assert first.transferred == ["t1"] and t.completed_tables(spark, checkpoint) == {"t1"}
    second = transfer(spark, source(spark, t1=PAIRS, t2=PAIRS), ns, options)
    assert [s[0] for s in second.stats] == ["t2"]
    assert not path_exists(spark, checkpoint)
    assert t.completed_tables(spark, checkpoint) == set()


def test_totals(spark, ns):
    result = transfer(spark, source(spark, p=PAIRS), ns, TransferOptions(tables=["p", "q"]))
    assert tuple(t.transfer_totals(result.frame(spark)).first()) == (1, 4, 1)


def test_unknown_options_are_refused():
    with pytest.raises(ValueError):
        TransferOptions(tables=[], mode="all")
    with pytest.raises(ValueError):
        TransferOptions(tables=[], error_mode="later")


def test_transfer_checks_strategy_and_first_load(spark, ns):
    for options in ({"conflict": "repalce", "keys": {"t": ["id"]}}, {"conflict": "ignore"}):
        with pytest.raises(ValueError):
            TransferOptions(tables=["t"], **options)
    twice = {"format": "frames", "frames": {"t": spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "id int, v string, n int")}}
    result = transfer(spark, twice, ns, TransferOptions(tables=["t"], keys={"t": ["id"]}))
    assert result.errors and not store.exists(spark, ns, "t")
    result = transfer(spark, twice, ns, TransferOptions(tables=["t"], keys={"t": ["id"]}, conflict="ignore", order={"t": "n"}))
    assert not result.errors and rows(spark.table(store.qualified(ns, "t"))) == [(1, "a", 1)]


def test_truncate_keeps_types(spark, ns):
    store.write_table(ns, "t", spark.createDataFrame([(1,)], "id long"))
    source = {"format": "frames", "frames": {"t": spark.createDataFrame([("7",)], "id string")}}
    assert not transfer(spark, source, ns, TransferOptions(tables=["t"], truncate_target=True)).errors
    table = spark.table(store.qualified(ns, "t"))
    assert table.schema["id"].dataType.simpleString() == "bigint" and rows(table) == [(7,)]


def test_resume_without_a_record_repeats_no_rows(spark, ns):
    """Stopped after a table is published and before it is recorded."""
    source = {"format": "frames", "frames": {"a": spark.range(3), "b": spark.range(4)}}
    store.write_table(ns, "b", spark.range(0))
    path = scratch_path(spark, "resume")
    options = TransferOptions(tables=["a", "b", "none"], checkpoint=path)
    assert transfer(spark, source, ns, options).errors  # the third table is missing
    for name in session.path_children(spark, path):
        if not name.endswith("/id"):
            session.delete_path(spark, name)
    again = transfer(spark, source, ns, options)
    assert len(again.errors) == 1
    assert [spark.table(store.qualified(ns, t)).count() for t in "ab"] == [3, 4]


def test_checks_run_as_a_step_of_the_transfer(spark, ns):
    from tablejobs.plans.transfer import TransferOptions, transfer

    frames = {"p": spark.createDataFrame([(1,), (2,), (None,)], "id long"),
              "c": spark.createDataFrame([(10, 1), (11, 3), (14, 3), (12, None), (13, 4)], "k long, pid long")}
    result = transfer(spark, {"format": "frames", "frames": frames}, ns, TransferOptions(
        tables=["p", "c"], keys={"p": ["id"], "c": ["k"]}, check=True, conflict="error",
        references=[("c", "p", {"pid": "id"}), ("c", "gone", {"pid": "id"})]))
    got = sorted(result.checks, key=repr)
    assert ("key", "p", "id", 1, 1) in got  # a NULL key part
    assert ("key", "c", "k", 0, 0) in got
    assert ("reference", "c", "pid -> p.id", 2, 3) in got  # 3 twice and 4; NULL is no orphan
    assert ("reference", "c", "pid -> gone.id", None, 4) in got


def test_a_copy_in_groups_resumes_below_the_table(spark, ns, tmp_path):
    from tablejobs.plans.transfer import Stopped, copy_in_groups

    data = spark.range(6000).select(F.col("id"), (F.col("id") % 13).alias("v"))
    data.repartition(10).write.parquet(str(tmp_path / "src"))
    checkpoint = scratch_path(spark, "groups")
    with pytest.raises(Stopped):
        copy_in_groups(spark, str(tmp_path / "src"), ns, "t", checkpoint, files_per_group=3, stop_after=2)
    assert not store.exists(spark, ns, "t")
    # A group cut off half-way: a folder without its record is ignored.
    data.limit(5).write.parquet(f"{checkpoint}/groups/2-halfway")
    done = copy_in_groups(spark, str(tmp_path / "src"), ns, "t", checkpoint, files_per_group=3)
    assert done == {"copied": 2, "groups": 4}
    assert rows(spark.table(store.qualified(ns, "t"))) == rows(data)
    assert not path_exists(spark, checkpoint)
