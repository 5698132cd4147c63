"""Documents as JSON text: key union, flattening, writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.types import quote


def document_keys(df: DataFrame, column: str) -> DataFrame:
    """Distinct top-level keys with the number of documents that hold each."""
    keys = df.select(F.explode(F.json_object_keys(quote(column))).alias("key_name"))
    return keys.groupBy("key_name").agg(F.count(F.lit(1)).alias("n_docs"))


def flatten_documents(df: DataFrame, column: str, keep: list[str] = (), names: list[str] | None = None,
                      most: int = 10_000) -> DataFrame:
    """One text column per key, in key order, from one parse of each document.

    ``names`` are the wanted keys; without them they are read first, as a schema
    is. More than ``most`` distinct keys are no schema, and fail: such documents
    need the keys they are wanted for.
    """
    if names is None:
        found = [r.key_name for r in document_keys(df, column).select("key_name").limit(most + 1).collect()]
        if len(found) > most:
            raise ValueError(f"the documents have over {most} distinct keys; name the wanted ones")
        names = sorted(found)
    names = [n for n in names if n not in keep]
    if not names:
        return df.select(*keep)
    parsed = F.json_tuple(F.col(quote(column)), *names).alias(*[f"_{i}" for i in range(len(names))])
    return df.select(*keep, parsed).select(*keep, *[F.col(f"_{i}").alias(n) for i, n in enumerate(names)])


def to_documents(df: DataFrame, name: str = "document") -> DataFrame:
    """Each row as one JSON document, with NULL fields kept."""
    row = F.struct(*[F.col(quote(c)) for c in df.columns])
    return df.select(F.to_json(row, {"ignoreNullFields": "false"}).alias(name))
