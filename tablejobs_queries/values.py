"""Value forms: bytes, text views, readable numbers, parsing, types."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from tablejobs.functions import scalars, types

from .base import load_table, query


@query("""
SELECT doc_id,
       CASE WHEN regexp_matches(text, '[^\\x00\\x20-\\x7E]') THEN '0x' || lower(hex(encode(text)))
            ELSE text END AS shown
FROM documents
""")
def bytes_display(spark, sf):
    docs = load_table(spark, sf, "documents").select(
        "doc_id", F.encode("text", "UTF-8").alias("shown"))
    return types.display(docs)


@query("""
SELECT p_partkey, p_name || chr(0) AS with_zero, '0x' || lower(hex(p_name)) || '0a' AS with_break
FROM part
""")
def bytes_display_zero(spark, sf):
    """Zero bytes count as printable, a line break does not."""
    part = load_table(spark, sf, "part").select(
        "p_partkey",
        F.encode(F.concat("p_name", F.char(F.lit(0))), "UTF-8").alias("with_zero"),
        F.encode(F.concat("p_name", F.lit("\n")), "UTF-8").alias("with_break"))
    return types.display(part)


@query("SELECT doc_id, text AS back, CAST(octet_length(encode(text)) AS INTEGER) AS n_bytes FROM documents")
def hex_round_trip(spark, sf):
    """Bytes to hex, spaced out as an editor shows it, and back."""
    spaced = F.regexp_replace(types.hex_text(F.encode("text", "UTF-8")), "(..)", "$1 ")
    return (load_table(spark, sf, "documents").select("doc_id", spaced.alias("shown"))
            .select("doc_id", types.hex_to_bytes(F.col("shown")).alias("data"))
            .select("doc_id", F.decode("data", "UTF-8").alias("back"),
                    F.octet_length("data").alias("n_bytes")))


@query("""
WITH units AS (
  SELECT doc_id, text,
         list_transform(string_split(text, ''), lambda c: printf('%02x', unicode(c))) AS u
  FROM documents)
SELECT doc_id, text AS json,
       regexp_replace(array_to_string(u, ' '), '((?:[0-9a-f]+ ){15}[0-9a-f]+) ', '\\1' || chr(10), 'g') AS hex,
       base64(encode(text)) AS base64,
       regexp_replace(text, '[^\\x20-\\x7E]', '�', 'g') AS ascii
FROM units
""")
def text_views(spark, sf):
    views = scalars.text_views(F.col("text"))
    return load_table(spark, sf, "documents").select(
        "doc_id", *[views[v].alias(v) for v in ("json", "hex", "base64", "ascii")])


@query("""
SELECT event_id, CAST(json(props) AS VARCHAR) AS compact FROM events
""")
def json_view(spark, sf):
    return load_table(spark, sf, "events").select(
        "event_id", scalars.json_view(F.col("props")).alias("compact"))


@query("""
WITH d AS (SELECT doc_id, hex(encode(text)) AS h FROM documents),
r AS (SELECT doc_id, h, unnest(range(0, length(h) // 2, 16)) AS pos FROM d),
c AS (SELECT doc_id, pos, substr(h, CAST(pos * 2 + 1 AS BIGINT), 32) AS part FROM r)
SELECT doc_id, printf('%08x', pos) AS offset,
       rtrim(regexp_replace(part, '(..)', '\\1 ', 'g')) AS bytes,
       array_to_string(list_transform(range(0, length(part) // 2), lambda j:
         CASE WHEN substr(part, CAST(j * 2 + 1 AS BIGINT), 2) BETWEEN '20' AND '7E'
              THEN chr(CAST('0x' || substr(part, CAST(j * 2 + 1 AS BIGINT), 2) AS INTEGER))
              ELSE '.' END), '') AS ascii
FROM c
""")
def hex_lines(spark, sf):
    return scalars.hex_lines(load_table(spark, sf, "documents"), "doc_id",
                             F.encode("text", "UTF-8"))


_SIZES = """
sizes AS (SELECT doc_id, n_chars AS n FROM documents
          UNION ALL SELECT doc_id, n_chars * n_chars FROM documents
          UNION ALL SELECT doc_id, n_chars * n_chars * n_chars FROM documents
          UNION ALL SELECT doc_id, -n_chars FROM documents)
"""


def _sizes(spark, sf):
    docs = load_table(spark, sf, "documents")
    n = F.col("n_chars")
    return reduce(DataFrame.unionByName,
                  [docs.select("doc_id", v.alias("n")) for v in (n, n * n, n * n * n, -n)])


@query(f"""
WITH {_SIZES},
u AS (SELECT doc_id, n, CASE WHEN n >= 1099511627776 THEN 4 WHEN n >= 1073741824 THEN 3
                             WHEN n >= 1048576 THEN 2 WHEN n >= 1024 THEN 1 ELSE 0 END AS i FROM sizes),
v AS (SELECT doc_id, n, i, n / pow(1024, i) AS x FROM u)
SELECT doc_id, n, CASE WHEN n < 0 THEN ''
         ELSE (CASE WHEN x >= 100 OR i = 0 THEN CAST(CAST(x AS DECIMAL(38,0)) AS VARCHAR)
                    ELSE CAST(CAST(x AS DECIMAL(38,1)) AS VARCHAR) END)
              || ' ' || (['B', 'KB', 'MB', 'GB', 'TB'])[i + 1] END AS shown
FROM v
""")
def human_bytes(spark, sf):
    return _sizes(spark, sf).select("doc_id", "n", scalars.human_bytes(F.col("n")).alias("shown"))


@query(f"""
WITH {_SIZES},
u AS (SELECT doc_id, n, CASE WHEN n < 1000 THEN 1 WHEN n < 1000000 THEN 1000
                             WHEN n < 1000000000 THEN 1000000 ELSE 1000000000 END AS unit FROM sizes),
v AS (SELECT doc_id, n, unit, CAST(n AS DOUBLE) / unit AS x FROM u)
SELECT doc_id, n, CASE WHEN n < 0 THEN '' WHEN unit = 1 THEN CAST(n AS VARCHAR)
         ELSE (CASE WHEN x < 10 OR unit = 1000000000 THEN CAST(CAST(x AS DECIMAL(38,1)) AS VARCHAR)
                    ELSE CAST(CAST(x AS DECIMAL(38,0)) AS VARCHAR) END)
              || (CASE unit WHEN 1000 THEN 'k' WHEN 1000000 THEN 'M' ELSE 'B' END) END AS shown
FROM v
""")
def human_count(spark, sf):
    return _sizes(spark, sf).select("doc_id", "n", scalars.human_count(F.col("n")).alias("shown"))


@query("""
SELECT event_id, user_id * event_id AS ttl,
       CASE WHEN user_id * event_id >= 86400 THEN CAST(CAST(round(user_id * event_id / 86400.0) AS BIGINT) AS VARCHAR) || 'd'
            WHEN user_id * event_id >= 3600 THEN CAST(CAST(round(user_id * event_id / 3600.0) AS BIGINT) AS VARCHAR) || 'h'
            WHEN user_id * event_id >= 60 THEN CAST(CAST(round(user_id * event_id / 60.0) AS BIGINT) AS VARCHAR) || 'm'
            ELSE CAST(user_id * event_id AS VARCHAR) || 's' END AS shown
FROM events
""")
def human_ttl(spark, sf):
    events = load_table(spark, sf, "events").select(
        "event_id", (F.col("user_id") * F.col("event_id")).alias("ttl"))
    return events.withColumn("shown", scalars.human_ttl(F.col("ttl")))


@query("""
WITH v AS (SELECT p_partkey, CAST(p_size AS VARCHAR) AS raw FROM part
           UNION ALL SELECT p_partkey, '-' || CAST(p_retailprice AS VARCHAR) || ' ' FROM part
           UNION ALL SELECT p_partkey, p_brand FROM part
           UNION ALL SELECT p_partkey, CAST(p_size AS VARCHAR) || '.' FROM part)
SELECT p_partkey, raw,
       CASE WHEN regexp_matches(trim(raw), '^[-+]?\\d+(\\.\\d+)?$') THEN CAST(trim(raw) AS DOUBLE) END AS number,
       CASE WHEN NOT regexp_matches(trim(raw), '^[-+]?\\d+(\\.\\d+)?$') THEN raw END AS text
FROM v
""")
def number_or_text(spark, sf):
    part = load_table(spark, sf, "part")
    size, price = F.col("p_size").cast("string"), F.col("p_retailprice").cast("string")
    raw = [size, F.concat(F.lit("-"), price, F.lit(" ")), F.col("p_brand"),
           F.concat(size, F.lit("."))]
    values = reduce(DataFrame.unionByName, [part.select("p_partkey", r.alias("raw")) for r in raw])
    return (values.withColumn("v", scalars.number_or_text(F.col("raw")))
            .select("p_partkey", "raw", F.col("v.number").alias("number"), F.col("v.text").alias("text")))


@query("""
WITH v AS (SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN '' WHEN p_size < 10 THEN 'NULL'
                                  ELSE p_name END AS raw FROM part)
SELECT p_partkey, CASE WHEN raw IN ('', 'NULL') THEN NULL ELSE raw END AS value FROM v
""")
def csv_null_rule(spark, sf):
    raw = (F.when(F.col("p_type") == "SMALL", "").when(F.col("p_size") < 10, "NULL")
           .otherwise(F.col("p_name")))
    return load_table(spark, sf, "part").select("p_partkey", scalars.csv_null(raw).alias("value"))


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
       l_tax, l_returnflag, l_linestatus,
       strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate,
       CAST(l_returnflag = 'R' AS INTEGER) AS returned
FROM lineitem
""")
def type_map(spark, sf):
    lines = load_table(spark, sf, "lineitem").withColumn("returned", F.col("l_returnflag") == "R")
    return types.to_lattice(lines)


@query("""
SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'TRUE' ELSE 'FALSE' END AS in_credit,
       CAST(c_acctbal > 0 AS INTEGER) AS in_credit_n,
       '{"n":"' || c_name || '","s":"' || c_mktsegment || '"}' AS doc,
       hex(c_name) AS name_bytes
FROM customer
""")
def typed_bind(spark, sf):
    credit = F.col("c_acctbal") > 0
    rows = load_table(spark, sf, "customer").select(
        "c_custkey", credit.alias("in_credit"), credit.alias("in_credit_n"),
        F.struct(F.col("c_name").alias("n"), F.col("c_mktsegment").alias("s")).alias("doc"),
        types.hex_text(F.encode("c_name", "UTF-8")).alias("name_bytes"))
    bound = types.bind_to(rows, T.StructType.fromDDL(
        "c_custkey long, in_credit string, in_credit_n int, doc string, name_bytes binary"))
    return bound.withColumn("name_bytes", F.hex("name_bytes"))
