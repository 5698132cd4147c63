"""Typed key/value snapshots.

The snapshot comes from the given tables row by row: a string per supplier, a
hash per customer, a list of lines and a set of words per document, a sorted
set of vector parts per embedding, a stream of words per conversation turn.
"""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tablejobs.operators import keyvalue as kv

from .base import load_table, query

_VALUES = ("str string", "list array<string>", "set array<string>", "hash map<string,string>",
           "zset array<struct<member:string,score:double>>",
           "stream array<struct<id:string,fields:map<string,string>>>")


def _entries(rows: DataFrame, prefix: str, key: list[str], kind: str, column: str, value) -> DataFrame:
    """Snapshot rows of one type; every third group of keys has a time to live."""
    number = F.col(key[0])
    columns = []
    for spec in _VALUES:
        name, dtype = spec.split(" ", 1)
        columns.append((value if name == column else F.lit(None)).cast(dtype).alias(name))
    return rows.select(
        F.concat_ws(":", F.lit(prefix), *[F.col(k).cast("string") for k in key]).alias("key"),
        F.lit(kind).alias("type"),
        F.when(number % 3 == 0, number * 60).otherwise(F.lit(-1)).cast("long").alias("ttl"),
        *columns)


def snapshot(spark, sf, kinds=("string", "hash", "list", "set", "zset", "stream")) -> DataFrame:
    def text_of(c):
        return F.col(c).cast("string")
    makers = {
        "string": lambda: _entries(load_table(spark, sf, "supplier"), "sup", ["s_suppkey"],
                                   "string", "str", F.col("s_name")),
        "hash": lambda: _entries(
            load_table(spark, sf, "customer"), "cust", ["c_custkey"], "hash", "hash",
            F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"),
                         F.lit("nation"), text_of("c_nationkey"))),
        "list": lambda: _entries(load_table(spark, sf, "documents"), "doc", ["doc_id"], "list",
                                 "list", F.split("text", "\n")),
        "set": lambda: _entries(load_table(spark, sf, "documents"), "words", ["doc_id"], "set",
                                "set", F.array_distinct(F.split("text", " "))),
        "zset": lambda: _entries(
            load_table(spark, sf, "embeddings"), "vec", ["vec_id"], "zset", "zset",
            F.transform("embedding", lambda x, i: F.struct(
                F.concat(F.lit("d"), i.cast("string")).alias("member"),
                x.cast("double").alias("score")))),
        "stream": lambda: _entries(
            load_table(spark, sf, "conversations"), "talk", ["conv_id", "turn"], "stream", "stream",
            F.transform(F.split("text", " "), lambda w, i: F.struct(
                F.concat(text_of("turn"), F.lit("-"), i.cast("string")).alias("id"),
                F.create_map(F.lit("role"), F.col("role"), F.lit("word"), w).alias("fields")))),
    }
    return reduce(DataFrame.unionByName, [makers[k]() for k in kinds])


def _key_sql(prefix: str, *key: str) -> str:
    parts = " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in key)
    return (f"'{prefix}:' || {parts} AS key, "
            f"CASE WHEN {key[0]} % 3 = 0 THEN {key[0]} * 60 ELSE -1 END AS ttl")


_LISTS = f"SELECT {_key_sql('doc', 'doc_id')}, string_split(text, chr(10)) AS v FROM documents"
_SETS = f"SELECT {_key_sql('words', 'doc_id')}, list_distinct(string_split(text, ' ')) AS v FROM documents"
_VECTORS = f"SELECT {_key_sql('vec', 'vec_id')}, vec_id, embedding AS v FROM embeddings"
_STREAMS = (f"SELECT {_key_sql('talk', 'conv_id', 'turn')}, turn, role, string_split(text, ' ') AS v "
            "FROM conversations")

# key, type, ttl and element count of all keys.
_KEYS = f"""
SELECT {_key_sql('sup', 's_suppkey')}, 'string' AS type, 1 AS n FROM supplier
UNION ALL SELECT {_key_sql('cust', 'c_custkey')}, 'hash', 3 FROM customer
UNION ALL SELECT key, ttl, 'list', len(v) FROM ({_LISTS})
UNION ALL SELECT key, ttl, 'set', len(v) FROM ({_SETS})
UNION ALL SELECT key, ttl, 'zset', len(v) FROM ({_VECTORS})
UNION ALL SELECT key, ttl, 'stream', len(v) FROM ({_STREAMS})
"""


@query(f"""
SELECT {_key_sql('sup', 's_suppkey')}, 'string' AS type, s_name AS value FROM supplier
""")
def kv_string(spark, sf):
    return kv.kv_rows(snapshot(spark, sf), "string")


@query(f"""
SELECT key, 'list' AS type, ttl, CAST(i - 1 AS INTEGER) AS index, v[i] AS value
FROM (SELECT key, ttl, v, unnest(range(1, len(v) + 1)) AS i FROM ({_LISTS}))
""")
def kv_list(spark, sf):
    return kv.kv_rows(snapshot(spark, sf), "list")


@query(f"""
SELECT key, 'list' AS type, ttl, CAST(i - 1 AS INTEGER) AS index, v[i] AS value
FROM (SELECT key, ttl, v, unnest(range(1, len(v) + 1)) AS i FROM ({_LISTS})) WHERE i BETWEEN 6 AND 10
""")
def kv_list_page(spark, sf):
    """The second page of five elements of every list."""
    return kv.kv_rows(snapshot(spark, sf), "list", page=2, size=5)


@query(f"SELECT key, 'set' AS type, ttl, unnest(v) AS member FROM ({_SETS})")
def kv_set(spark, sf):
    return kv.kv_rows(snapshot(spark, sf), "set")


@query(f"""
WITH c AS (SELECT {_key_sql('cust', 'c_custkey')}, * FROM customer)
SELECT key, 'hash' AS type, ttl, 'name' AS field, c_name AS value FROM c
UNION ALL SELECT key, 'hash', ttl, 'segment', c_mktsegment FROM c
UNION ALL SELECT key, 'hash', ttl, 'nation', CAST(c_nationkey AS VARCHAR) FROM c
""")
def kv_hash(spark, sf):
    return kv.kv_rows(snapshot(spark, sf), "hash")


def _zset_sql(direction: str) -> str:
    return f"""
WITH e AS (SELECT key, ttl, 'd' || CAST(i - 1 AS VARCHAR) AS member, CAST(v[i] AS DOUBLE) AS score
           FROM (SELECT key, ttl, v, unnest(range(1, len(v) + 1)) AS i FROM ({_VECTORS})))
SELECT key, 'zset' AS type, ttl,
       CAST(row_number() OVER (PARTITION BY key ORDER BY score {direction}, member {direction}) - 1 AS INTEGER)
         AS rank, member, score
FROM e
"""


@query(_zset_sql("ASC"))
def kv_zset(spark, sf):
    return kv.kv_rows(snapshot(spark, sf), "zset")


@query(_zset_sql("DESC") + " QUALIFY rank < 10")
def kv_zset_top(spark, sf):
    """The first page of ten members, highest score first."""
    return kv.kv_rows(snapshot(spark, sf), "zset", page=1, size=10, descending=True)


@query(f"""
SELECT key, 'stream' AS type, ttl, CAST(turn AS VARCHAR) || '-' || CAST(i - 1 AS VARCHAR) AS id,
       role, v[i] AS word
FROM (SELECT key, ttl, turn, role, v, unnest(range(1, len(v) + 1)) AS i FROM ({_STREAMS}))
""")
def kv_stream(spark, sf):
    rows = kv.kv_rows(snapshot(spark, sf), "stream")
    return rows.select("key", "type", "ttl", "id", F.col("fields")["role"].alias("role"),
                       F.col("fields")["word"].alias("word"))


@query(f"""
SELECT key AS name, upper(type) AS object_type, CASE WHEN ttl >= 0 THEN ttl END AS ttl
FROM ({_KEYS}) WHERE regexp_matches(key, '^[dw]o.*:.*7$') AND type = 'list'
""")
def kv_scan(spark, sf):
    return kv.scan_keys(snapshot(spark, sf), "[dw]o*:*7", "LIST")


@query(f"""
SELECT key AS name, upper(type) AS object_type, CASE WHEN ttl >= 0 THEN ttl END AS ttl
FROM ({_KEYS}) WHERE key > 'cust:5' ORDER BY key LIMIT 50
""")
def kv_scan_page(spark, sf):
    """Fifty keys in key order after a given key."""
    return kv.scan_keys(snapshot(spark, sf), after="cust:5", count=50)


@query(f"SELECT key, type AS key_type, ttl, CAST(n AS BIGINT) AS n_elements FROM ({_KEYS})")
def kv_info(spark, sf):
    return kv.key_info(snapshot(spark, sf))


@query(f"""
SELECT type, count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_elements FROM ({_KEYS}) GROUP BY type
""")
def kv_counts(spark, sf):
    return kv.element_totals(snapshot(spark, sf))


@query(f"""
SELECT upper(type) AS object_type, count(*) AS n_keys,
       CAST(CASE type WHEN 'string' THEN 8 WHEN 'hash' THEN 9 WHEN 'list' THEN 10 WHEN 'set' THEN 11
                 WHEN 'zset' THEN 12 ELSE 13 END AS BIGINT) AS place
FROM ({_KEYS}) GROUP BY type
""")
def kv_type_counts(spark, sf):
    return kv.type_counts(snapshot(spark, sf))


@query(f"""
SELECT {_key_sql('cust', 'c_custkey').split(', CASE')[0]}, 'hash' AS type,
       CAST(json_object('name', c_name, 'segment', c_mktsegment, 'nation', CAST(c_nationkey AS VARCHAR))
            AS VARCHAR) AS value FROM customer
UNION ALL SELECT key, 'list', CAST(to_json(v) AS VARCHAR) FROM ({_LISTS})
UNION ALL SELECT {_key_sql('sup', 's_suppkey').split(', CASE')[0]}, 'string',
       CAST(to_json(s_name) AS VARCHAR) FROM supplier
UNION ALL SELECT key, 'stream', CAST(to_json(list_transform(range(1, len(v) + 1), lambda i:
       {{'id': CAST(turn AS VARCHAR) || '-' || CAST(i - 1 AS VARCHAR),
         'fields': {{'role': role, 'word': v[i]}}}})) AS VARCHAR) FROM ({_STREAMS})
UNION ALL SELECT key, 'set', CAST(to_json(list_sort(v)) AS VARCHAR) FROM ({_SETS})
""")
def kv_json(spark, sf):
    return kv.value_json(snapshot(spark, sf, ("string", "hash", "list", "stream", "set")))


@query(f"""
WITH e AS (SELECT key, 'd' || CAST(i - 1 AS VARCHAR) AS member, CAST(v[i] AS DOUBLE) AS score
           FROM (SELECT key, v, unnest(range(1, len(v) + 1)) AS i FROM ({_VECTORS})))
SELECT key, 'zset' AS type, CAST(count(*) AS BIGINT) AS n,
       array_to_string(list(member ORDER BY score, member), ',') AS members,
       list(score ORDER BY score, member)[1] AS least, list(score ORDER BY score, member)[-1] AS most
FROM e GROUP BY key
""")
def kv_json_zset(spark, sf):
    """Sorted sets as JSON, read back: member order is by score and member."""
    value = F.from_json("value", "array<struct<member:string,score:double>>")
    return kv.value_json(snapshot(spark, sf, ("zset",))).select(
        "key", "type", F.size(value).cast("long").alias("n"),
        F.array_join(value["member"], ",").alias("members"),
        F.element_at(value["score"], 1).alias("least"), F.element_at(value["score"], -1).alias("most"))
