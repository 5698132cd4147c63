"""Text search over tables."""

from tablejobs.operators import search

from .base import load_tables, query

# Text columns by table, with key columns first in the list of all columns.
_SEARCHED = {
    "customer": ("c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment", ["c_custkey"],
                 ["c_name", "c_mktsegment"]),
    "part": ("p_partkey, p_name, p_brand, p_type, p_size, p_retailprice", ["p_partkey"],
             ["p_name", "p_brand", "p_type"]),
    "documents": ("doc_id, text, lang, source, n_chars", ["doc_id"], ["text", "lang", "source"]),
    "pages": ("page_id, url, html", ["page_id"], ["url", "html"]),
    "conversations": ("conv_id, turn, role, text", ["conv_id", "turn"], ["role", "text"]),
    "benchmark": ("item_id, text", ["item_id"], ["text"]),
    "labels": ("doc_id, quality, toxic", ["doc_id"], []),
}


def _find_sql(needle: str, limit: int | None) -> str:
    parts = []
    for table, (columns, keys, texts) in _SEARCHED.items():
        if not texts:
            continue
        holds = " OR ".join(f"contains(lower({c}), lower('{needle}'))" for c in texts)
        cut = f"ORDER BY {', '.join(keys)} LIMIT {limit}" if limit else ""
        pairs = ", ".join(f"'{c}', {c}" for c in columns.split(", "))
        for c in texts:
            parts.append(
                f"SELECT '{table}' AS table_name, '{c}' AS column_name, {c} AS value, "
                f"CAST(json_object({pairs}) AS VARCHAR) AS row FROM "
                f"(SELECT * FROM {table} WHERE {holds} {cut}) WHERE contains(lower({c}), lower('{needle}'))")
    return " UNION ALL ".join(parts)


def _find(spark, sf, needle, limit=None):
    frames = load_tables(spark, sf, list(_SEARCHED))
    return search.find_in_tables(spark, frames, needle,
                                 {t: keys for t, (_, keys, _) in _SEARCHED.items()},
                                 per_table=limit)


@query(_find_sql("red", None))
def find_in_tables(spark, sf):
    return _find(spark, sf, " Red ")


@query(_find_sql("_", None))
def find_literal_wildcards(spark, sf):
    return _find(spark, sf, "_")


@query(_find_sql("%", None))
def find_all_rows(spark, sf):
    """Without a row limit: every hit of a literal percent sign."""
    return _find(spark, sf, "%", None)


@query("SELECT '' AS table_name, '' AS column_name, '' AS value, '' AS row FROM orders WHERE false")
def find_nothing(spark, sf):
    return _find(spark, sf, "no such words in any of the tables")


@query(_find_sql("red", 5))
def find_first_rows(spark, sf):
    """The first five rows by key of each table, as the caller asks."""
    return _find(spark, sf, "red", 5)
