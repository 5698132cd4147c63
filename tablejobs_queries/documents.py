"""Documents with differing keys."""

from pyspark.sql import functions as F

from tablejobs.operators import documents, filters
from tablejobs.session import scratch_path
from tablejobs.sinks.files import write_documents
from tablejobs.sources.files import read_documents

from .base import load_table, query


def _event_documents(spark, sf):
    """Events as documents: purchases alone have a value, errors alone a code,
    and the parsed props sit in a nested object."""
    events = load_table(spark, sf, "events")
    return events.select(
        "event_id", "event_type", "user_id",
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("amount"),
        F.when(F.col("event_type") == "error", F.col("user_id") + 500).alias("code"),
        F.from_json("props", "k int").alias("props"))


def _scanned(spark, sf):
    path = scratch_path(spark, "docs")
    _event_documents(spark, sf).write.json(path)
    return read_documents(spark, path)


_DOCS = """
SELECT CASE WHEN event_type = 'purchase' THEN value END AS amount,
       CASE WHEN event_type = 'error' THEN user_id + 500 END AS code,
       event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, user_id
FROM events
"""


@query(_DOCS)
def doc_scan(spark, sf):
    return _scanned(spark, sf).select("amount", "code", "event_id", "event_type",
                                      F.col("props.k").alias("k"), "user_id")


@query(f"SELECT * FROM ({_DOCS}) WHERE event_type = 'purchase' AND k = 42")
def doc_filter(spark, sf):
    found = filters.document_filter(_scanned(spark, sf), '{"event_type":"purchase","props":{"k":42}}')
    return found.select("amount", "code", "event_id", "event_type", F.col("props.k").alias("k"),
                        "user_id")


@query(f"SELECT * FROM ({_DOCS})")
def doc_filter_bad_json(spark, sf):
    found = filters.document_filter(_scanned(spark, sf), "{event_type: purchase")
    return found.select("amount", "code", "event_id", "event_type", F.col("props.k").alias("k"),
                        "user_id")


@query("""
SELECT 'event_id' AS key_name, count(*) AS n_docs FROM events
UNION ALL SELECT 'event_type', count(*) FROM events
UNION ALL SELECT 'user_id', count(*) FROM events
UNION ALL SELECT 'props', count(*) FROM events
UNION ALL SELECT 'amount', count(*) FROM events WHERE event_type = 'purchase'
UNION ALL SELECT 'code', count(*) FROM events WHERE event_type = 'error'
""")
def doc_key_union(spark, sf):
    docs = _event_documents(spark, sf).select(F.to_json(F.struct("*")).alias("doc"))
    return documents.document_keys(docs, "doc")


@query("""
SELECT event_id, CAST(CASE WHEN event_type = 'purchase' THEN value END AS VARCHAR) AS amount,
       CAST(CASE WHEN event_type = 'error' THEN user_id + 500 END AS VARCHAR) AS code, event_type,
       json_extract_string(props, '$.k') AS k
FROM events
""")
def doc_flatten(spark, sf):
    """Document text to one text column per key."""
    docs = _event_documents(spark, sf)
    text = docs.select("event_id", F.to_json(F.struct("amount", "code", "event_type", "props")).alias("doc"))
    flat = documents.flatten_documents(text, "doc", ["event_id"])
    return flat.select("event_id", "amount", "code", "event_type",
                       F.get_json_object("props", "$.k").alias("k"))


@query("""
SELECT doc_id, text, nullif(lang, 'en') AS lang FROM documents
""")
def doc_write(spark, sf):
    path = scratch_path(spark, "documents")
    docs = load_table(spark, sf, "documents").select(
        "doc_id", "text", F.nullif("lang", F.lit("en")).alias("lang"))
    written = write_documents(docs, path)
    back = spark.read.schema(docs.schema).json(path)
    if written != back.count():
        raise RuntimeError("documents were lost")
    return back
