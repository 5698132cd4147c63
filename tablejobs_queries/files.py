"""File exports and imports."""

from pyspark.sql import functions as F

from tablejobs.operators.merge import merge_edits
from tablejobs.operators.ordering import number_rows
from tablejobs.plans.load import import_file
from tablejobs.plans.namespaces import create_table
from tablejobs.session import scratch_namespace, scratch_path
from tablejobs.sinks import files
from tablejobs.sources.files import read_csv, read_json_array_split, read_json_rows

from .base import current_rows, load_table, query

_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160) || chr(65279)"


@query(f"""
SELECT CAST(doc_id AS VARCHAR) AS doc_id, nullif(trim(text, {_BLANKS}), '') AS text,
       nullif(lang, 'en') AS lang, CAST(n_chars AS VARCHAR) AS n_chars
FROM documents
""")
def csv_round_trip(spark, sf):
    path = scratch_path(spark, "csv")
    docs = load_table(spark, sf, "documents").select(
        "doc_id", "text", F.nullif("lang", F.lit("en")).alias("lang"), "n_chars")
    files.write_csv(docs, path, max_records=50_000)
    return read_csv(spark, path)


@query("""
SELECT doc_id, CAST(doc_id AS VARCHAR) || ',' ||
       CASE WHEN regexp_matches(text, '[",\\n\\r]') THEN '"' || replace(text, '"', '""') || '"'
            ELSE text END || ',' || coalesce(nullif(lang, 'en'), '') || ',' ||
       CAST(n_chars AS VARCHAR) AS line
FROM documents
""")
def csv_lines(spark, sf):
    docs = load_table(spark, sf, "documents").select(
        "doc_id", "text", F.nullif("lang", F.lit("en")).alias("lang"), "n_chars")
    return docs.select("doc_id", files.csv_record(docs).alias("line"))


@query("""
SELECT CAST(doc_id AS VARCHAR) || ',' ||
       CASE WHEN regexp_matches(text, '[",\n\r]') THEN '"' || replace(text, '"', '""') || '"'
            ELSE text END || ',' || CASE WHEN lang = 'de' THEN 'German' ELSE lang END AS line
FROM documents WHERE source <> (SELECT min(source) FROM documents)
""")
def csv_edited(spark, sf):
    """A table with buffered edits as CSV: edits merged, deleted rows left out."""
    docs = load_table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    first = docs.agg(F.min("source").alias("source"))
    nothing = F.array().cast("array<string>")
    edits = (docs.where("lang = 'de'").withColumn("lang", F.lit("German"))
             .withColumn("op", F.lit("update")).withColumn("set", F.array(F.lit("lang"))))
    gone = (docs.join(first, "source").select(*docs.columns).withColumn("op", F.lit("delete"))
            .withColumn("set", nothing))
    merged = merge_edits(docs, edits.unionByName(gone), ["doc_id"]).drop("source")
    return merged.select(files.csv_record(merged).alias("line"))


@query("""
SELECT CAST(json_object('doc_id', doc_id, 'text', text, 'lang', nullif(lang, 'en')) AS VARCHAR) AS line
FROM documents
""")
def json_export(spark, sf):
    path = scratch_path(spark, "json")
    files.write_json(load_table(spark, sf, "documents").select(
        "doc_id", "text", F.nullif("lang", F.lit("en")).alias("lang")), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("""
SELECT doc_id, text, nullif(lang, 'en') AS lang, n_chars FROM documents
""")
def json_round_trip(spark, sf):
    path = scratch_path(spark, "json")
    docs = load_table(spark, sf, "documents").select(
        "doc_id", "text", F.nullif("lang", F.lit("en")).alias("lang"), "n_chars")
    files.write_json(docs, path)
    return spark.read.schema(docs.schema).json(path)


_TEXT = r"""'''' || replace(replace({0}, chr(92), chr(92) || chr(92)), '''', '''''') || ''''"""


@query(f"""
WITH r AS (
  SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos,
         '(' || CAST(doc_id AS VARCHAR) || ', ' || {_TEXT.format('text')} || ', ' ||
         CASE WHEN lang = 'en' THEN 'NULL' ELSE {_TEXT.format('lang')} END || ')' AS row
  FROM documents)
SELECT CAST(floor(pos / 100) AS BIGINT) AS statement_no,
       'INSERT INTO `documents` (`doc_id`, `text`, `lang`) VALUES' || chr(10) || '  ' ||
       string_agg(row, ',' || chr(10) || '  ' ORDER BY pos) || ';' AS statement
FROM r GROUP BY floor(pos / 100)
""")
def insert_script(spark, sf):
    docs = load_table(spark, sf, "documents").select(
        "doc_id", "text", F.nullif("lang", F.lit("en")).alias("lang"))
    return files.insert_statements(docs, "documents", ["doc_id"])


_NUMBER = "regexp_replace(CAST({0} AS VARCHAR), '\\.0$', '')"


@query(f"""
SELECT 'UPDATE `customer` SET `c_custkey` = ' || CAST(c_custkey AS VARCHAR) ||
       ', `c_name` = ' || {_TEXT.format('c_name')} || ', `c_acctbal` = ' || {_NUMBER.format('c_acctbal')} ||
       ' WHERE `c_custkey` = ' || CAST(c_custkey AS VARCHAR) || ';' AS statement
FROM customer
""")
def update_script(spark, sf):
    rows = load_table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    return files.update_statements(rows, "customer", ["c_custkey"])


@query(f"""
SELECT 'UPDATE `it``s` SET `s_suppkey` = ' || CAST(s_suppkey AS VARCHAR) || ', `s_name` = ' ||
       {_TEXT.format('s_name')} || ' WHERE `s_suppkey` = ' || CAST(s_suppkey AS VARCHAR) ||
       ' AND `s_name` = ' || {_TEXT.format('s_name')} || ';' AS statement
FROM supplier
""")
def update_script_no_key(spark, sf):
    rows = load_table(spark, sf, "supplier").select("s_suppkey", "s_name")
    return files.update_statements(rows, "it`s")


_CUSTOMER = "c_custkey long, c_name string, c_acctbal double, c_mktsegment string"
_CUSTOMER_SQL = """
SELECT c_custkey, c_name, c_acctbal, nullif(c_mktsegment, 'MACHINERY') AS c_mktsegment FROM customer
"""


def _customers(spark, sf):
    return load_table(spark, sf, "customer").select(
        "c_custkey", "c_name", "c_acctbal",
        F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("c_mktsegment"))


def _imported(spark, path):
    with scratch_namespace(spark) as ns:
        create_table(spark, ns, "customer", _CUSTOMER)
        import_file(spark, path, ns, "customer", ["c_custkey"])
        return current_rows(spark, ns, "customer")


@query(_CUSTOMER_SQL)
def import_csv(spark, sf):
    path = scratch_path(spark, "in") + ".csv"
    files.write_csv(_customers(spark, sf), path)
    return _imported(spark, path)


_BLANKS_SQL = "chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160) || chr(65279)"


@query(f"""
SELECT c_custkey,
       trim(CASE WHEN c_custkey % 3 = 0 THEN replace(c_name, '#', chr(10) || '"' || chr(10)) ELSE c_name END, {_BLANKS_SQL})
         AS c_name,
       c_mktsegment
FROM customer
""")
def import_csv_breaks(spark, sf):
    """A CSV file whose quoted fields hold line breaks, read split over tasks."""
    rows = load_table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.replace("c_name", F.lit("#"), F.lit('\n"\n')))
        .otherwise(F.col("c_name")).alias("c_name"), "c_mktsegment")
    path = scratch_path(spark, "in") + ".csv"
    files.write_csv(rows, path)
    with scratch_namespace(spark) as ns:
        create_table(spark, ns, "customer", "c_custkey long, c_name string, c_mktsegment string")
        import_file(spark, path, ns, "customer", ["c_custkey"])
        return current_rows(spark, ns, "customer")


def _import_with_rejects(spark, sf):
    """Customers from a CSV file where every seventh balance is no number,
    loaded with refused rows set aside."""
    rows = _customers(spark, sf).withColumn("c_acctbal", F.when(
        F.col("c_custkey") % 7 == 0, F.concat(F.lit("x"), F.col("c_acctbal").cast("string")))
        .otherwise(F.col("c_acctbal").cast("string")))
    path = scratch_path(spark, "in") + ".csv"
    files.write_csv(rows, path)
    with scratch_namespace(spark) as ns:
        create_table(spark, ns, "customer", _CUSTOMER)
        import_file(spark, path, ns, "customer", ["c_custkey"], on_error="skip")
        return current_rows(spark, ns, "customer"), current_rows(spark, ns, "customer_rejects")


@query(_CUSTOMER_SQL + " WHERE c_custkey % 7 <> 0")
def import_skip(spark, sf):
    return _import_with_rejects(spark, sf)[0]


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, 'c_acctbal' AS "column", 'x' AS value_head,
       'not a double' AS reason
FROM customer WHERE c_custkey % 7 = 0
""")
def import_rejects(spark, sf):
    rejects = _import_with_rejects(spark, sf)[1]
    return rejects.select("c_custkey", "column", F.substring("value", 1, 1).alias("value_head"), "reason")


def _write_json_files(spark, sf, item, wrap, path=None, keep="true"):
    """JSON files of up to 5,000 rows each, one document per file."""
    rows = number_rows(_customers(spark, sf).where(keep), ["c_custkey"], "pos")
    blocks = (rows.select((F.col("pos") / 5000).cast("long").alias("block"), "pos", item.alias("item"))
              .groupBy("block").agg(F.array_join(F.transform(F.sort_array(
                  F.collect_list(F.struct("pos", "item"))), lambda r: r["item"]), ",").alias("items")))
    path = path or scratch_path(spark, "in") + ".json"
    blocks.select(wrap(F.col("items")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


@query(_CUSTOMER_SQL)
def import_json_rows(spark, sf):
    """Objects under ``rows``."""
    item = F.to_json(F.struct("c_custkey", "c_name", "c_acctbal", "c_mktsegment"))
    path = _write_json_files(spark, sf, item, lambda v: F.concat(F.lit('{"rows":['), v, F.lit("]}")))
    return _imported(spark, path)


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_acctbal AS VARCHAR) AS c_acctbal,
       nullif(c_mktsegment, 'MACHINERY') AS c_mktsegment
FROM customer
""")
def import_json_objects(spark, sf):
    """An array of objects, as text rows."""
    item = F.to_json(F.struct("c_custkey", "c_name", "c_acctbal", "c_mktsegment"))
    path = _write_json_files(spark, sf, item, lambda v: F.concat(F.lit("["), v, F.lit("]")))
    return read_json_rows(spark, path)


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_acctbal AS VARCHAR) AS c_acctbal,
       nullif(c_mktsegment, 'MACHINERY') AS c_mktsegment
FROM customer
""")
def import_json_split(spark, sf):
    """Arrays of objects and objects under ``rows``, read split at every "}"."""
    item = F.to_json(F.struct("c_custkey", "c_name", "c_acctbal", "c_mktsegment"))
    folder = scratch_path(spark, "in")
    _write_json_files(spark, sf, item, lambda v: F.concat(F.lit("["), v, F.lit("]")), f"{folder}/a",
                      "c_custkey % 2 = 0")
    _write_json_files(spark, sf, item, lambda v: F.concat(F.lit('{"rows":['), v, F.lit("]}")), f"{folder}/b",
                      "c_custkey % 2 = 1")
    return read_json_array_split(spark, folder)


@query(_CUSTOMER_SQL)
def import_json_arrays(spark, sf):
    """Arrays whose first one holds the column names."""
    text = lambda c: F.col(c).cast("string")
    item = F.to_json(F.array(text("c_custkey"), text("c_name"), text("c_acctbal"),
                             text("c_mktsegment")))
    head = '[["c_custkey","c_name","c_acctbal","c_mktsegment"],'
    path = _write_json_files(spark, sf, item, lambda v: F.concat(F.lit(head), v, F.lit("]")))
    return _imported(spark, path)


@query(_CUSTOMER_SQL)
def import_json_headers(spark, sf):
    """Files whose columns are in other orders: each one's own header counts."""
    text = lambda c: F.col(c).cast("string")
    names = ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"]
    folder = scratch_path(spark, "json-headers")
    for n, order in enumerate((names, names[::-1], names[2:] + names[:2])):
        head = "[[" + ",".join(f'"{c}"' for c in order) + "],"
        _write_json_files(spark, sf, F.to_json(F.array(*[text(c) for c in order])),
                          lambda v: F.concat(F.lit(head), v, F.lit("]")), f"{folder}/{n}.json", f"c_custkey % 3 = {n}")
    return _imported(spark, f"{folder}/*.json")
