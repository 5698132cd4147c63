"""Edit merges, edit batches, loads."""

import pytest
from conftest import rows

from tablejobs.operators import merge
from tablejobs.plans import edit
from tablejobs.sinks import store
from tablejobs.sources.tables import table_location

CHANGES = "id int, v string, w int, op string, set array<string>, seq int"


def base(spark):
    return spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, None, 3), (4, "d", 4)],
                                 "id int, v string, w int")


def test_states_and_merge(spark):
    changes = spark.createDataFrame([
        (1, "A", None, "update", ["v"], 1),
        (2, "b", None, "update", ["v"], 1),        # same text: no change
        (3, "", None, "update", ["v"], 1),         # NULL to empty text: a change
        (4, "x", None, "update", ["v"], 1),
        (4, None, None, "delete", [], 2),          # deleted wins
        (5, "e", 5, "insert", [], 1),
        (9, "z", None, "update", ["v"], 1),        # no such row
    ], CHANGES)
    states = {r.id: r.row_state for r in merge.edit_states(base(spark), changes, ["id"]).collect()}
    assert states == {1: "modified", 2: None, 3: "modified", 4: "deleted", 5: "added"}
    assert rows(merge.merge_edits(base(spark), changes, ["id"])) == [
        (1, "A", 1), (2, "b", 2), (3, "", 3), (5, "e", 5)]


def test_last_edit_of_a_cell_wins_and_null_can_be_set(spark):
    changes = spark.createDataFrame([
        (1, "first", None, "update", ["v"], 1), (1, "last", None, "update", ["v"], 2),
        (1, None, 7, "update", ["w"], 3), (2, None, None, "update", ["v"], 1)], CHANGES)
    merged = {r.id: (r.v, r.w) for r in merge.merge_edits(base(spark), changes, ["id"]).collect()}
    assert merged[1] == ("last", 7) and merged[2] == (None, 2)


def test_edits_without_a_sequence_meet_cell_by_cell(spark):
    changes = spark.createDataFrame([
        (1, "A", None, "update", ["v"], 1), (1, None, 9, "update", ["w"], 1), (1, "A", None, "update", ["v"], 1)],
        CHANGES).drop("seq")
    assert rows(merge.merge_edits(base(spark), changes, ["id"]))[0] == (1, "A", 9)
    clash = changes.unionByName(spark.createDataFrame([(1, None, None, "update", ["v"], 1)], CHANGES).drop("seq"))
    with pytest.raises(Exception, match="different values"):
        merge.merge_edits(base(spark), clash, ["id"]).collect()


def test_appends_bind_and_leave_the_table_as_it_was(spark, ns):
    store.write_table(ns, "t", spark.createDataFrame([(1, "a")], "id long, v string"))
    store.append_rows(ns, "t", spark.createDataFrame([("2",)], "id string"))
    read = lambda: rows(spark.table(store.qualified(ns, "t")))
    assert read() == [(1, "a"), (2, None)]
    for bad in (spark.createDataFrame([("x",)], "id string"), spark.createDataFrame([(1,)], "other int")):
        with pytest.raises(Exception):
            store.append_rows(ns, "t", bad)
        assert read() == [(1, "a"), (2, None)]
    before = store.state(spark, ns, "t")
    store.append_rows(ns, "t", spark.createDataFrame([(3,)], "id long"))
    with pytest.raises(RuntimeError, match="another job"):
        store.append_rows(ns, "t", spark.createDataFrame([(4,)], "id long"), before)
    assert len(read()) == 3


def test_strategies_are_checked(spark, ns):
    store.write_table(ns, "t", spark.createDataFrame([(1,)], "id long"))
    for strategy, keys in (("ignore", None), ("replace", []), ("repalce", ["id"])):
        with pytest.raises(ValueError):
            store.load_rows(ns, "t", spark.createDataFrame([(1,)], "id long"), keys, strategy)


def test_edits_without_a_sequence(spark):
    changes = spark.createDataFrame([
        (1, "A", None, "update", ["v", "w"], 1), (2, "B", None, "update", ["v"], 1),
        (2, None, None, "delete", [], 1), (4, "D", 0, "update", ["v"], 1)], CHANGES).drop("seq")
    assert rows(merge.merge_edits(base(spark), changes, ["id"])) == [
        (1, "A", None), (3, None, 3), (4, "D", 4)]


def test_batch_counts_and_writes(spark, ns):
    store.write_table(ns, "t", base(spark))
    changes = spark.createDataFrame([
        (1, "A", None, "update", ["v"], 1), (2, None, None, "delete", [], 1),
        (9, "n", 9, "insert", [], 1)], CHANGES)
    counts = edit.apply_edits(spark, ns, "t", changes, ["id"])
    assert counts == {"modified": 1, "added": 1, "deleted": 1, "affected": 3}
    assert rows(spark.table(store.qualified(ns, "t"))) == [
        (1, "A", 1), (3, None, 3), (4, "d", 4), (9, "n", 9)]


def test_failing_batch_changes_nothing(spark, ns):
    store.write_table(ns, "t", base(spark))
    before = table_location(spark, ns.name, "t")
    changes = spark.createDataFrame([
        (1, "A", None, "update", ["v"], 1), (2, "again", 0, "insert", [], 1)], CHANGES)
    with pytest.raises(merge.ConflictError):
        edit.apply_edits(spark, ns, "t", changes, ["id"])
    assert table_location(spark, ns.name, "t") == before
    with pytest.raises(ValueError, match="no primary key"):
        edit.apply_edits(spark, ns, "t", changes, [])


def test_change_by_another_job_is_refused(spark, ns):
    store.write_table(ns, "t", base(spark))
    stale = table_location(spark, ns.name, "t")
    store.write_table(ns, "t", base(spark).limit(1))
    with pytest.raises(RuntimeError, match="another job"):
        store.write_table(ns, "t", base(spark), stale)
    assert spark.table(store.qualified(ns, "t")).count() == 1
    assert store.drop_old_versions(spark, ns, "t") == 1
    assert spark.table(store.qualified(ns, "t")).count() == 1


def test_load_strategies(spark):
    target = spark.createDataFrame([(1, "t"), (2, "t")], "id int, v string")
    source = spark.createDataFrame([(2, "s"), (3, "s")], "id int, v string")
    load = lambda s: rows(merge.merge_load(target, source, ["id"], s))
    assert load("ignore") == [(1, "t"), (2, "t"), (3, "s")]
    assert load("replace") == [(1, "t"), (2, "s"), (3, "s")]
    assert rows(merge.conflicts(target, source, ["id"])) == [(2, "s")]
    with pytest.raises(merge.ConflictError):
        load("error")
    with pytest.raises(ValueError):
        load("merge")


def test_duplicate_keys_in_the_source(spark):
    target = spark.createDataFrame([(1, "t", 0)], "id int, v string, n int")
    source = spark.createDataFrame([(2, "first", 1), (2, "last", 2)], "id int, v string, n int")
    with pytest.raises(merge.ConflictError):
        merge.merge_load(target, source, ["id"], "replace")
    assert rows(merge.merge_load(target, source, ["id"], "replace", order="n"))[1] == (2, "last", 2)
    assert rows(merge.merge_load(target, source, ["id"], "ignore", order="n"))[1] == (2, "first", 1)
    with pytest.raises(merge.ConflictError):
        merge.merge_load(target, source, ["id"], "error", order="n")


def test_truncate_keeps_columns(spark, ns):
    store.write_table(ns, "t", base(spark))
    store.truncate_table(spark, ns, "t")
    table = spark.table(store.qualified(ns, "t"))
    assert table.count() == 0 and table.columns == ["id", "v", "w"]
    store.drop_table(spark, ns, "t")
    assert not store.exists(spark, ns, "t")


def test_append_counts_rows(spark, ns):
    store.write_table(ns, "t", base(spark))
    assert store.append_rows(ns, "t", base(spark).limit(2)) == 2
    assert spark.table(store.qualified(ns, "t")).count() == 6
