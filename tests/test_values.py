"""Types, value forms and literals."""

import datetime

import pytest
from pyspark.sql import functions as F, types as T

from tablejobs.functions import scalars, types


def one(spark, value, dtype, fn):
    df = spark.createDataFrame([(value,)], f"v {dtype}")
    return df.select(fn(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("raw, kind, want", [
    ("int(11)", "mysql", "INTEGER"), ("bigint(20) unsigned", "mysql", "BIGINT"),
    ("varchar(255)", "mysql", "TEXT"), ("decimal(10,2)", "mysql", "REAL"),
    ("datetime", "mysql", "TEXT"), ("longblob", "mysql", "BLOB"), ("json", "mysql", "TEXT"),
    ("character varying(10)", "postgresql", "TEXT"), ("boolean", "postgresql", "INTEGER"),
    ("double precision", "postgresql", "REAL"), ("bytea", "postgresql", "BLOB"),
    ("bigserial", "postgresql", "BIGINT"), ("timestamp without time zone", "postgresql", "TEXT"),
    ("INTEGER", "sqlite", "INTEGER"), ("CLOB", "sqlite", "TEXT"), ("numeric", "sqlite", "REAL"),
    ("NUMBER(38)", "oracle", "BIGINT"), ("number(10,2)", "oracle", "REAL"),
    ("BINARY_DOUBLE", "oracle", "REAL"), ("nvarchar2(20)", "oracle", "TEXT"),
    ("raw(16)", "oracle", "BLOB"), ("nclob", "oracle", "TEXT"),
    ("timestamp(6) with time zone", "oracle", "TEXT"), ("anything", "other", "TEXT"),
])
def test_lattice(raw, kind, want):
    assert types.lattice_type(raw, kind) == want


@pytest.mark.parametrize("raw, kind, want", [
    ("decimal(10,2)", "mysql", "decimal(10,2)"), ("bigint unsigned", "mysql", "decimal(20,0)"),
    ("tinyint(1)", "mysql", "boolean"), ("int unsigned", "mysql", "bigint"),
    ("date", "postgresql", "date"), ("datetime", "mysql", "timestamp_ntz"),
    ("timestamptz", "postgresql", "timestamp"), ("real", "postgresql", "float"),
    ("number(38)", "oracle", "decimal(38,0)"), ("time", "mysql", "string"),
    ("geometry", "postgresql", "string"),
])
def test_spark_type(raw, kind, want):
    assert types.spark_type(raw, kind).simpleString() == want


@pytest.mark.parametrize("value, want", [
    (b"hello", "hello"), (b"a\x00b", "a\x00b"), (b"\xde\xad", "0xdead"), (b"\x00\xff", "0x00ff"),
    (b"tab\t", "0x74616209"), (b"\x7f", "0x7f"), (b"", ""), (None, None), (b"x" * 100_000, "x" * 100_000),
])
def test_display_bytes(spark, value, want):
    assert one(spark, value, "binary", types.display_bytes) == want


@pytest.mark.parametrize("value, want", [
    ("0xDEAD", b"\xde\xad"), ("de ad", b"\xde\xad"), ("zz41", b"A"), ("414", b"A"), ("", b"")])
def test_hex_to_bytes(spark, value, want):
    assert bytes(one(spark, value, "string", types.hex_to_bytes)) == want


def test_display_keeps_null_booleans_and_shows_times(spark):
    df = spark.createDataFrame([(None, datetime.datetime(2024, 1, 15, 10, 30), [1])],
                               "b boolean, t timestamp_ntz, a array<int>")
    assert tuple(types.display(df).first()) == (None, "2024-01-15 10:30:00", "[1]")


def test_bind_to(spark):
    df = spark.createDataFrame([(True, "0x00ff", "12", (1,)), (None, "plain", None, None)],
                               "b boolean, h string, n string, o struct<k:int>")
    got = types.bind_to(df, T.StructType.fromDDL("b string, h binary, n int, o string, more long"))
    assert [tuple(r) for r in got.collect()] == [
        ("TRUE", bytearray(b"\x00\xff"), 12, '{"k":1}', None), (None, bytearray(b"plain"), None, None, None)]


@pytest.mark.parametrize("n, want", [
    (None, ""), (-1, ""), (0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1280, "1.3 KB"),
    (102399, "100.0 KB"), (102400, "100 KB"), (1048576, "1.0 MB"), (1073741824, "1.0 GB"),
    (1099511627776, "1.0 TB"), (1125899906842624, "1024 TB")])
def test_human_bytes(spark, n, want):
    assert one(spark, n, "long", scalars.human_bytes) == want


@pytest.mark.parametrize("n, want", [
    (None, ""), (-5, ""), (0, "0"), (999, "999"), (1000, "1.0k"), (1250, "1.3k"), (9999, "10.0k"),
    (10000, "10k"), (999999, "1000k"), (1500000, "1.5M"), (25000000, "25M"), (3200000000, "3.2B")])
def test_human_count(spark, n, want):
    assert one(spark, n, "long", scalars.human_count) == want


@pytest.mark.parametrize("n, want", [
    (5, "5s"), (59, "59s"), (90, "2m"), (3600, "1h"), (5400, "2h"), (129600, "2d"), (86400, "1d")])
def test_human_ttl(spark, n, want):
    assert one(spark, n, "long", scalars.human_ttl) == want


@pytest.mark.parametrize("text, want", [
    ("12", (12.0, None)), ("-1.5", (-1.5, None)), (" 7 ", (7.0, None)), ("1.", (None, "1.")),
    ("1e5", (None, "1e5")), ("", (None, "")), ("abc", (None, "abc")), (None, (None, None))])
def test_number_or_text(spark, text, want):
    assert tuple(one(spark, text, "string", scalars.number_or_text)) == want


@pytest.mark.parametrize("view, text, want", [
    ("json", '{ "a" : [1, 2] }', '{"a":[1,2]}'), ("json", "no json", "no json"),
    ("hex", "AB", "41 42"), ("hex", "é€😀", "e9 20ac d83d de00"),
    ("hex", "a" * 17, " ".join(["61"] * 16) + "\n61"), ("hex", "a" * 16, " ".join(["61"] * 16)),
    ("base64", "hé" * 60, None), ("ascii", "a\té", "a��"), ("text", "x", "x")])
def test_text_views(spark, view, text, want):
    import base64
    want = base64.b64encode(text.encode()).decode() if want is None else want
    assert one(spark, text, "string", lambda c: scalars.text_views(c)[view]) == want


def test_hex_lines(spark):
    df = spark.createDataFrame([(1, b"0123456789abcdef\x00z\xe9"), (2, b"")], "id int, b binary")
    got = [tuple(r) for r in scalars.hex_lines(df, "id", F.col("b")).orderBy("offset").collect()]
    assert got == [
        (1, "00000000", "30 31 32 33 34 35 36 37 38 39 61 62 63 64 65 66", "0123456789abcdef"),
        (1, "00000010", "00 7A E9", ".z.")]


@pytest.mark.parametrize("value, dtype, want", [
    (None, "int", "NULL"), (7, "int", "7"), (True, "boolean", "1"), (False, "boolean", "0"),
    (73.0, "double", "73"), (-2.5, "double", "-2.5"), (0.0, "double", "0"), (1e10, "double", "10000000000"),
    (12345678.9, "double", "12345678.9"), (1.25e-5, "double", "0.0000125"), (1e21, "double", "1e+21"),
    (1.5e-7, "double", "1.5e-7"), (float("nan"), "double", "NULL"), (float("inf"), "double", "NULL"),
    (0.1, "float", "0.1"), ("O'Brien", "string", "'O''Brien'"), ("a\\b", "string", "'a\\\\b'"),
    ("", "string", "''"), (datetime.datetime(2024, 6, 1), "timestamp_ntz", "'2024-06-01 00:00:00'"),
    ([1, 2], "array<int>", "'[1,2]'"), (b"\xde\xad", "binary", "X'DEAD'"),
])
def test_sql_literal(spark, value, dtype, want):
    df = spark.createDataFrame([(value,)], f"v {dtype}")
    field = df.schema["v"].dataType
    assert df.select(scalars.sql_literal(F.col("v"), field).alias("r")).first().r == want


@pytest.mark.parametrize("text, needle, want", [
    ("Hello", "ELL", True), ("50%", "%", True), ("50", "%", False), ("a_b", "_", True), ("ab", "_", False)])
def test_contains_text(spark, text, needle, want):
    assert one(spark, text, "string", lambda c: scalars.contains_text(c, needle)) is want


@pytest.mark.parametrize("text, want", [("", None), ("NULL", None), ("null", "null"), ("x", "x"), (None, None)])
def test_csv_null(spark, text, want):
    assert one(spark, text, "string", scalars.csv_null) == want
