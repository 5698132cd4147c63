"""File exports and imports, snapshots, scripts."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tablejobs.plans import load, namespaces, snapshot
from tablejobs.session import path_children, scratch_path
from tablejobs.sinks import files, store
from tablejobs.sources import files as scans


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def lines(spark, df):
    return [r[0] for r in df.select(files.csv_record(df)).collect()]


def test_csv_record_quoting(spark):
    df = spark.createDataFrame([("x,y", 'say "hi"', None, 2.0)], "a string, b string, c string, d double")
    assert lines(spark, df) == ['"x,y","say ""hi""",,2']
    df = spark.createDataFrame([("l1\nl2", [1, 2], True)], "a string, b array<int>, c boolean")
    assert lines(spark, df) == ['"l1\nl2","[1,2]",true']


def test_csv_scan_trims_and_unquotes(spark, tmp_path):
    path = put(tmp_path / "u.csv", 'id, name ,email\n1, "a ""b""" ,x@y\n\n2,"two\nlines",\n')
    df = scans.read_csv(spark, path)
    assert df.columns == ["id", "name", "email"]
    got = {r.id: (r.name, r.email) for r in df.collect()}
    assert got["2"] == ("two\nlines", None)


def test_csv_needs_a_data_row(spark, tmp_path):
    with pytest.raises(ValueError, match="data below it"):
        scans.read_csv(spark, put(tmp_path / "e.csv", "id,name\n"))


def test_csv_write_and_read_back(spark):
    df = spark.createDataFrame([(1, " a,b ", None), (2, 'q"\n', "")], "id int, t string, n string")
    path = scratch_path(spark, "csv")
    files.write_csv(df, path)
    assert rows(scans.read_csv(spark, path)) == [("1", "a,b", None), ("2", 'q"', None)]


@pytest.mark.parametrize("data, want", [
    ([{"id": 1, "name": "a"}, {"id": 2, "extra": {"k": 1}}],
     [("1", "a", None), ("2", None, '{"k":1}')]),
    ({"rows": [{"id": 1, "name": "a", "extra": None}]}, [("1", "a", None)]),
    ({"data": [{"id": 1, "name": "a", "extra": "x"}]}, [("1", "a", "x")]),
    ([["id", "name", "extra"], [1, "a", None], [2, "b", "c"]], [("1", "a", None), ("2", "b", "c")]),
    ({"rows": [["id", "name", "extra"], [1, "a", "z"]]}, [("1", "a", "z")]),
])
def test_json_forms(spark, tmp_path, data, want):
    df = scans.read_json_rows(spark, put(tmp_path / "d.json", json.dumps(data, indent=1)))
    names = [c for c in ("id", "name", "extra") if c in df.columns]
    got = rows(df.select(*names))
    assert got == [tuple(v for v, c in zip(w, ("id", "name", "extra")) if c in names) for w in want]


@pytest.mark.parametrize("text", ["[]", '{"rows": []}', '{"other": 1}'])
def test_json_needs_rows(spark, tmp_path, text):
    with pytest.raises(ValueError, match="at least one row"):
        scans.read_json_rows(spark, put(tmp_path / "d.json", text))


def test_json_that_is_no_json_fails(spark, tmp_path):
    with pytest.raises(Exception):
        scans.read_json_rows(spark, put(tmp_path / "d.json", '[{"a": 1}, {"a": ')).collect()


def test_import_casts_and_fails_whole(spark, ns, tmp_path):
    namespaces.create_table(spark, ns, "t", "id long, name string, score double")
    good = put(tmp_path / "g.csv", "id,name,score\n1,NULL,1.5\n2,,\n")
    assert load.import_file(spark, good, ns, "t") == 2
    assert rows(spark.table(store.qualified(ns, "t"))) == [(1, None, 1.5), (2, None, None)]
    bad = put(tmp_path / "b.csv", "id,name,score\n3,x,1\nfour,y,2\n")
    with pytest.raises(Exception):
        load.import_file(spark, bad, ns, "t")
    with pytest.raises(ValueError, match="no such column"):
        load.import_file(spark, put(tmp_path / "c.csv", "id,nope\n3,x\n"), ns, "t")
    assert spark.table(store.qualified(ns, "t")).count() == 2


def test_insert_statements(spark):
    df = spark.createDataFrame([(1, "O'Brien"), (2, None)], "id int, name string")
    got = files.insert_statements(df, "people", ["id"]).collect()
    assert [tuple(r) for r in got] == [
        (0, "INSERT INTO `people` (`id`, `name`) VALUES\n  (1, 'O''Brien'),\n  (2, NULL);")]
    many = spark.range(150).select(F.col("id"), F.lit("a\\b").alias("t"))
    got = {r.statement_no: r.statement for r in files.insert_statements(many, "m", ["id"]).collect()}
    assert sorted(got) == [0, 1]
    assert got[0].count("\n  (") == 100 and got[1].count("\n  (") == 50
    assert got[1].startswith("INSERT INTO `m` (`id`, `t`) VALUES\n  (100, 'a\\\\b'),")
    path = scratch_path(spark, "script")
    files.write_script(files.insert_statements(many, "m", ["id"]), path)
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    assert text.count("INSERT INTO") == 2


def test_update_statements(spark):
    df = spark.createDataFrame([(1, "O'Brien", True)], "id int, name string, ok boolean")
    keyed = files.update_statements(df, "t", ["id"]).first()[0]
    assert keyed == "UPDATE `t` SET `id` = 1, `name` = 'O''Brien', `ok` = 1 WHERE `id` = 1;"
    plain = files.update_statements(df, "t").first()[0]
    assert plain.endswith("WHERE `id` = 1 AND `name` = 'O''Brien' AND `ok` = 1;")


def test_documents_keep_null_fields(spark):
    df = spark.createDataFrame([(1, None)], "id int, v string")
    path = scratch_path(spark, "docs")
    assert files.write_documents(df, path) == 1
    assert spark.read.text(path).first()[0] == '{"id":1,"v":null}'
    files.write_json(df, path + "2")
    assert spark.read.text(path + "2").first()[0] == '{"id":1,"v":null}'


def test_snapshot_round_trip(spark, ns):
    df = spark.createDataFrame([(1, "one"), (2, "two;"), (3, None)], "id int, val string")
    source = {"format": "frames", "frames": {"b": df, "empty": df.limit(0)}}
    path = scratch_path(spark, "snap")
    count, seconds = snapshot.take_snapshot(spark, source, ["b", "missing", "empty"], path)
    assert count == 2 and seconds > 0
    assert snapshot.restore_snapshot(spark, path, ns) == (2, [])
    assert rows(spark.table(store.qualified(ns, "b"))) == rows(df)
    assert spark.table(store.qualified(ns, "empty")).columns == ["id", "val"]


def test_restore_reports_and_goes_on(spark, ns):
    df = spark.createDataFrame([(1, "one")], "id int, val string")
    path = scratch_path(spark, "snap")
    snapshot.take_snapshot(spark, {"format": "frames", "frames": {"a": df, "b": df}}, ["a", "b"], path)
    df.write.mode("append").parquet(f"{path}/tables/a")
    count, errors = snapshot.restore_snapshot(spark, path, ns)
    assert count == 1 and "2 rows, expected 1" in errors[0]
    assert not store.exists(spark, ns, "a") and store.exists(spark, ns, "b")


def test_duplicate_namespace(spark, ns):
    df = spark.createDataFrame([(1, "one")], "id int, val string")
    store.write_table(ns, "a", df)
    source = {"format": "catalog", "database": ns.name}
    copy = namespaces.duplicate_namespace(spark, source, ns.name + "_c", scratch_path(spark, "dup"))
    assert rows(spark.table(store.qualified(copy, "a"))) == [(1, "one")]
    with pytest.raises(ValueError, match="exists"):
        namespaces.duplicate_namespace(spark, source, copy.name, scratch_path(spark, "dup"))
    with pytest.raises(ValueError, match="differ"):
        namespaces.duplicate_namespace(spark, source, ns.name, scratch_path(spark, "dup"))
    spark.sql(f"DROP DATABASE `{copy.name}` CASCADE")


def test_duplicate_goes_again_on_failure(spark):
    bad = spark.createDataFrame([("x",)], "v string").select(F.col("v").cast("int"))
    root = scratch_path(spark, "dup")
    with pytest.raises(RuntimeError):
        namespaces.duplicate_namespace(
            spark, {"format": "frames", "frames": {"bad": bad}}, "tj_failed", root)
    assert not spark.catalog.databaseExists("tj_failed") and path_children(spark, root) == []


def test_reshape_and_rename(spark, ns):
    store.write_table(ns, "t", spark.createDataFrame([(1, "7", 0)], "id int, n string, gone int"))
    namespaces.reshape_table(spark, ns, "t", drop=["gone"], rename={"id": "key"},
                             retype={"n": "long"}, add={"note": ("string", "'x'")})
    namespaces.rename_table(spark, ns, "t", "t2")
    table = spark.table(store.qualified(ns, "t2"))
    assert table.dtypes == [("key", "int"), ("n", "bigint"), ("note", "string")]
    assert rows(table) == [(1, 7, "x")]
    with pytest.raises(ValueError, match="no such column"):
        namespaces.reshape_table(spark, ns, "t2", drop=["nope"])


def test_json_files_keep_their_own_form_and_names(spark, tmp_path):
    (tmp_path / "j").mkdir()
    for name, text in {"a": '[["id","name"],["1","x"]]', "b": ' [ [ "name", "id" ], [ "y", "2" ] ]',
                       "c": '{"data": [["id"], ["3"]]}', "d": '[{"name": "z", "more": {"k": [1]}}]',
                       "e": '{"rows": [{"id": 4}], "other": 1}'}.items():
        (tmp_path / "j" / f"{name}.json").write_text(text)
    df = scans.read_json_rows(spark, str(tmp_path / "j")).select("id", "name", "more")
    assert rows(df) == rows(spark.createDataFrame([
        ("1", "x", None), ("2", "y", None), ("3", None, None), (None, "z", '{"k":[1]}'), ("4", None, None)],
        "id string, name string, more string"))
    with pytest.raises(Exception, match="more or fewer cells"):
        scans.read_json_rows(spark, put(tmp_path / "r.json", '[["a"],["1","2"]]')).collect()


def test_csv_files_with_other_headers_or_ragged_rows_fail(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.csv").write_text("id,name\n1,x\n")
    (tmp_path / "c" / "b.csv").write_text("name,id\ny,2\n")
    with pytest.raises(Exception):
        scans.read_csv(spark, str(tmp_path / "c")).collect()
    for text in ("id,name\n1,x,9\n", "id,name\n1\n"):
        with pytest.raises(Exception):
            scans.read_csv(spark, put(tmp_path / "r.csv", text)).select("id").collect()
    assert rows(scans.read_csv(spark, put(tmp_path / "r.csv", "id,name\n1,x,9\n2\n"), ragged=True)) == [
        ("1", "x"), ("2", None)]


def test_json_lines(spark, tmp_path):
    path = put(tmp_path / "l.jsonl", '{"id": 1, "o": {"k": 1}}\n{"id": 2.50, "b": true}\n')
    assert rows(scans.read_json_lines(spark, path).select("id", "b")) == [("1", None), ("2.50", "true")]


def test_csv_with_line_breaks_is_read_split_over_many_tasks(spark, tmp_path):
    import random

    from tablejobs.sources.files import read_csv_split

    r = random.Random(2)
    for k, end in enumerate(["\n", "\r\n"]):
        with open(tmp_path / f"p{k}.csv", "w", newline="") as fh:
            fh.write("id,name, note " + end)
            for i in range(2500):
                note = r.choice(["plain", '"two\nlines"', '"q ""x"" \n y\n z"', '"a,b"', "", '"\n"', " pad ", '"' + "w\n" * 300 + '"'])
                fh.write(f"{i},n{i},{note}{end}")
            fh.write(end)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        split = read_csv_split(spark, str(tmp_path))
        got = sorted(map(tuple, split.collect()), key=repr)
        tasks = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    whole = (spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
             .csv(str(tmp_path)))
    want = sorted((tuple(None if v is None else v.strip(" \t\n\r\x0b\x0c\xa0﻿") for v in row) for row in whole.collect()),
                  key=repr)
    assert tasks > 50 and len(got) == 5000 and got == want
    assert split.columns == ["id", "name", "note"]


def test_csv_split_refuses_other_headers_and_ragged_rows(spark, tmp_path):
    from tablejobs.sources.files import read_csv_split

    (tmp_path / "a.csv").write_text('x,y\n1,"2\n3"\n')
    (tmp_path / "b.csv").write_text("x,z\n1,2\n")
    with pytest.raises(ValueError):
        read_csv_split(spark, str(tmp_path))
    (tmp_path / "b.csv").write_text("x,y\n1,2,3\n")
    with pytest.raises(Exception):
        read_csv_split(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, read_csv_split(spark, str(tmp_path), ragged=True).collect())) == [("1", "2"), ("1", "2\n3")]


def test_import_sets_refused_rows_aside_or_fails_whole(spark, ns, tmp_path):
    from tablejobs.plans.load import checked_rows, import_file
    from tablejobs.plans.namespaces import create_table
    from tablejobs.sinks import store

    (tmp_path / "in.csv").write_text("k,v,d\n1,2.5,2024-01-02\n2,abc,2024-01-03\n3,,bad\n4,NULL,\n5,7,2024-02-30\n")
    create_table(spark, ns, "t", "k long, v double, d date")
    with pytest.raises(Exception):
        import_file(spark, str(tmp_path / "in.csv"), ns, "t", ["k"])
    assert spark.table(store.qualified(ns, "t")).count() == 0
    assert import_file(spark, str(tmp_path / "in.csv"), ns, "t", ["k"], on_error="skip") == 2
    assert sorted(r.k for r in spark.table(store.qualified(ns, "t")).collect()) == [1, 4]
    refused = sorted((r.k, r.column, r.value, r.reason) for r in spark.table(store.qualified(ns, "t_rejects")).collect())
    assert refused == [("2", "v", "abc", "not a double"), ("3", "d", "bad", "not a date"), ("5", "d", "2024-02-30", "not a date")]
    rows = spark.createDataFrame([("1", "x", "y")], "k string, v string, d string")
    good, bad, counts = checked_rows(rows, spark.table(store.qualified(ns, "t")).schema)
    assert counts == {"rows": 1, "rejected": 1} and good.count() == 0
    assert [len(r._rejects) for r in bad.collect()] == [2]


def test_json_array_is_read_split_at_braces_over_many_tasks(spark, tmp_path):
    import json
    import random

    from tablejobs.sources.files import read_json_array_split

    r = random.Random(3)
    odd = ["br}ace{ [x] \"q\" \\ end", {"nested": {"deep": [1, {"x": "}"}]}}, None, 1.5, [1, {"a": "]"}], "ü€ \n\t"]
    want = []
    for k in range(3):
        rows = [{"id": str(i), "v": r.choice(odd + [i]), ("w" if k else "u"): str(2 * i)} for i in range(600)]
        body = json.dumps({"rows": rows} if k == 2 else rows, ensure_ascii=k == 1, indent=1 if k == 1 else None)
        (tmp_path / f"f{k}.json").write_text(body)  # one line for k = 0 and 2
        want += rows
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2500")
    try:
        df = read_json_array_split(spark, str(tmp_path))
        got, columns = sorted((tuple(x) for x in df.collect()), key=repr), df.columns
        tasks = spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, separators=(",", ":"))
    assert columns == ["id", "v", "u", "w"] and tasks > 40
    assert got == sorted((tuple(text(x.get(c)) for c in columns) for x in want), key=repr)


def test_json_split_refuses_what_is_no_array(spark, tmp_path):
    from tablejobs.sources.files import read_json_array_split

    (tmp_path / "a.json").write_text('"just text"')
    with pytest.raises(ValueError):
        read_json_array_split(spark, str(tmp_path))
