"""Typed key/value snapshots: rows of values, key lists, key facts.

A snapshot has one row per key: ``key``, ``type`` (lower case), ``ttl`` and the
value in the column of its type: ``str``, ``list``, ``set``, ``hash`` (map),
``zset`` (array of member, score) or ``stream`` (array of id, fields map).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Order of object types in a grouped list.
TYPE_ORDER = ("TABLE", "BASE TABLE", "VIEW", "FUNCTION", "PROCEDURE", "TRIGGER", "COLLECTION",
              "STRING", "HASH", "LIST", "SET", "ZSET", "STREAM")

_KEY = ("key", "type", "ttl")


def _by_score(descending: bool) -> Column:
    ranked = F.sort_array(F.transform("zset", lambda e: F.struct(
        e["score"].alias("score"), e["member"].alias("member"))))
    return F.reverse(ranked) if descending else ranked


def kv_rows(snapshot: DataFrame, kind: str, page: int | None = None, size: int = 100,
            descending: bool = False) -> DataFrame:
    """Rows of all keys of one type, or one page of rows per key.

    Each row has key, type and ttl. Sorted sets come with their rank, by score
    and member.
    """
    keys = snapshot.where(F.col("type") == kind)
    if kind == "string":
        return keys.where("str IS NOT NULL").select(*_KEY, F.col("str").alias("value"))
    exploded = {
        "list": ("list", lambda v: [F.col("_at").alias("index"), v.alias("value")]),
        "set": ("set" if page is None else F.sort_array("set"), lambda v: [v.alias("member")]),
        "hash": (F.map_entries("hash") if page is None else F.sort_array(F.map_entries("hash")),
                 lambda v: [v["key"].alias("field"), v["value"].alias("value")]),
        "zset": (_by_score(descending),
                 lambda v: [F.col("_at").alias("rank"), v["member"].alias("member"),
                            v["score"].alias("score")]),
        "stream": ("stream", lambda v: [v["id"].alias("id"), v["fields"].alias("fields")]),
    }
    if kind not in exploded:
        raise ValueError(f"unknown key type {kind}")
    values, columns = exploded[kind]
    first = 0 if page is None else (page - 1) * size
    if page is not None:  # only the page's elements become rows
        values = F.slice(values, F.lit(first + 1), F.lit(size))
    rows = keys.select(*_KEY, F.posexplode(values).alias("_at", "_value"))
    rows = rows.withColumn("_at", F.col("_at") + first)
    return rows.select(*_KEY, *columns(F.col("_value")))


def element_count() -> Column:
    """Elements of a value; 1 for a string."""
    sizes = F.when(F.col("type") == "hash", F.size("hash"))
    for kind in ("list", "set", "zset", "stream"):
        sizes = sizes.when(F.col("type") == kind, F.size(kind))
    return sizes.otherwise(1).cast("long")


def live_ttl() -> Column:
    return F.when(F.col("ttl") >= 0, F.col("ttl"))


def key_info(snapshot: DataFrame) -> DataFrame:
    """type, ttl and element count of each key."""
    return snapshot.select("key", F.col("type").alias("key_type"), "ttl",
                           element_count().alias("n_elements"))


def glob_regex(pattern: str) -> str:
    """A key pattern (``*``, ``?``, ``[ab]``, ``[^a]``, ``\\x``) as an anchored
    regular expression."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        close = pattern.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(_literal(pattern[i]))
        elif close > 0:
            out.append("[" + pattern[i + 1:close].replace("\\", "\\\\").replace("[", "\\[") + "]")
            i = close
        else:
            out.append(_literal(ch))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def _literal(ch: str) -> str:
    return ch if ch.isalnum() or ch == "_" else f"\\x{{{ord(ch):x}}}"


def scan_keys(snapshot: DataFrame, pattern: str = "*", kind: str | None = None,
              after: str | None = None, count: int | None = None) -> DataFrame:
    """Keys by pattern and type: name, object_type, ttl (NULL if it has none).

    With ``count`` one page in key order, after the key ``after``; the next page
    starts after the last key of this one, so no page costs more than the first.
    """
    keys = snapshot
    if pattern != "*":
        keys = keys.where(F.col("key").rlike(glob_regex(pattern)))
    if kind:
        keys = keys.where(F.lower("type") == kind.lower())
    if after is not None:
        keys = keys.where(F.col("key") > after)
    keys = keys.select(F.col("key").alias("name"), F.upper("type").alias("object_type"),
                       live_ttl().alias("ttl"))
    return keys if count is None else keys.orderBy("name").limit(max(count, 1))


def type_counts(snapshot: DataFrame) -> DataFrame:
    """Keys per type with the type's place in the list; unknown types last."""
    counted = snapshot.groupBy(F.upper("type").alias("object_type")).agg(
        F.count(F.lit(1)).alias("n_keys"))
    place = F.array_position(F.array(*[F.lit(t) for t in TYPE_ORDER]), F.col("object_type"))
    return counted.select("object_type", "n_keys",
                          F.when(place > 0, place).otherwise(len(TYPE_ORDER) + 1).alias("place"))


def element_totals(snapshot: DataFrame) -> DataFrame:
    """Keys and elements per type."""
    return snapshot.groupBy("type").agg(F.count(F.lit(1)).alias("n_keys"),
                                        F.sum(element_count()).alias("n_elements"))


def value_json(snapshot: DataFrame, stream_entries: int | None = None) -> DataFrame:
    """The whole value of each key as JSON; ``stream_entries`` cuts streams for
    a caller that wants to see their first entries only."""
    stream = F.col("stream") if stream_entries is None else F.slice("stream", 1, stream_entries)
    cases = {
        "list": F.to_json("list"), "set": F.to_json(F.array_sort("set")), "hash": F.to_json("hash"),
        "zset": F.to_json(F.transform(_by_score(False), lambda e: F.struct(
            e["member"].alias("member"), e["score"].alias("score")))),
        "stream": F.to_json(stream),
        "string": F.to_json(F.array("str")).substr(F.lit(2), F.length(F.to_json(F.array("str"))) - 2),
    }
    value = F.lit(None).cast("string")
    for kind, text in cases.items():
        value = F.when(F.col("type") == kind, text).otherwise(value)
    known = F.col("type").isin(*cases)
    return snapshot.select("key", "type",
                           F.when(known, value).otherwise('"(unknown type)"').alias("value"))
