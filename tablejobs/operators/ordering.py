"""Sort, page, row limit and row numbers without a one-task bottleneck."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.types import quote
from ..session import materialize, small_frame

# A top-n merges n rows per task in one task. Beyond this many rows (offset
# included) positions come from a range-partitioned sort instead.
TOP_N_ROWS = 100_000

_PARTITION_BITS = 33  # monotonically_increasing_id: partition in the high bits


def number_rows(df: DataFrame, order: list[str | Column], name: str = "pos") -> DataFrame:
    """Add the 0-based position of each row in the given order.

    Rows are range-partitioned and sorted in parallel; the start of each
    partition comes from the partition counts (one small row per partition).
    The row hash comes last in the sort, so a value that many rows share is
    spread over partitions too. The sorted rows are written once, so that both
    passes see the same partition bounds also after an executor is lost.
    """
    spark = df.sparkSession
    keys = [F.col(quote(c)) if isinstance(c, str) else c for c in order]
    plain = [F.col(quote(f.name)) for f in df.schema.fields
             if not f.dataType.simpleString().startswith(("map", "variant"))]
    tie = F.xxhash64(*plain)
    sorted_rows = materialize(
        df.withColumn("_tie", tie)
        .repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie")
        .drop("_tie").withColumn("_at", F.monotonically_increasing_id()),
        "numbered")
    part = F.shiftright("_at", _PARTITION_BITS)
    counts = sorted_rows.groupBy(part.alias("_part")).count().orderBy("_part").collect()
    starts, total = [], 0
    for row in counts:
        starts.append((row._part, total))
        total += row["count"]
    # One row per shuffle partition; a local relation, so its size is known.
    offsets = small_frame(spark, starts, "_part long, _start long")
    inside = F.col("_at").bitwiseAND((1 << _PARTITION_BITS) - 1)
    return (sorted_rows.withColumn("_part", part).join(offsets, "_part")
            .select(*[quote(c) for c in df.columns], (F.col("_start") + inside).alias(name)))


def sort_by(df: DataFrame, column: str, direction: str = "asc", keys: list[str] = ()) -> DataFrame:
    """One-column sort, NULLs first ascending and last descending, key as tie
    break."""
    return df.orderBy(*_sort_keys(column, direction, keys))


def _orderable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if not any(t in f.dataType.simpleString() for t in ("map<", "variant", "interval"))]


def _total_order(df: DataFrame, column, direction, keys) -> list[Column]:
    """The wanted order, then all other columns: rows that tie are equal, so
    every path cuts the same rows at the same place."""
    known = {column, *keys}
    rest = [F.col(quote(c)).asc_nulls_first() for c in _orderable(df) if c not in known]
    return _sort_keys(column, direction, keys) + rest


def _sort_keys(column, direction, keys) -> list[Column]:
    first = []
    if column is not None:
        c = F.col(quote(column))
        first = [c.desc_nulls_last() if direction.lower() == "desc" else c.asc_nulls_first()]
    return first + [F.col(quote(k)).asc_nulls_first() for k in keys if k != column]


def _slice(df: DataFrame, order: list[Column], skip: int, count: int, top_n: int) -> DataFrame:
    if skip + count <= top_n:
        return df.orderBy(*order).offset(skip).limit(count)
    numbered = number_rows(df, order, "_pos")
    return numbered.where((F.col("_pos") >= skip) & (F.col("_pos") < skip + count)).drop("_pos")


def page(df: DataFrame, number: int, size: int = 100, column: str | None = None,
         direction: str = "asc", keys: list[str] = (), top_n: int = TOP_N_ROWS) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows. Ties, also without keys, are in
    the order of the other columns, so pages neither share nor miss rows."""
    return _slice(df, _total_order(df, column, direction, keys), (number - 1) * size, size, top_n)


def row_limit(df: DataFrame, n: int, keys: list[str], top_n: int = TOP_N_ROWS) -> DataFrame:
    """The first ``n`` rows by key: a true maximum, whatever its size."""
    return _slice(df, _total_order(df, None, "asc", keys), 0, n, top_n)


def page_total(df: DataFrame, size: int = 100) -> DataFrame:
    """Row count and page count."""
    total = F.count(F.lit(1))
    return df.agg(total.alias("total"), F.ceil(total / size).cast("long").alias("pages"))


def ordered_list(df: DataFrame, keys: list[str], order: list[str], item: str,
                 name: str = "items", max_items: int = 100_000,
                 max_bytes: int = 256 << 20) -> DataFrame:
    """Ordered array of ``item`` per group, with its ``piece`` number; ties are in
    the order of the items.

    A group of up to ``max_items`` rows and ``max_bytes`` of item text is one row
    with piece 0. A larger group is cut into pieces of as many items each as keep
    to both on average, in order, so that no task holds a group of unbounded
    size.
    """
    cols = list(dict.fromkeys([*keys, *order, item]))
    rows = df.select([quote(c) for c in cols])
    width = F.coalesce(F.sum(F.octet_length(F.col(quote(item)).cast("string"))), F.lit(0))
    per_piece = F.least(F.lit(max_items).cast("long"),
                        F.greatest(F.floor(F.col("_n") * max_bytes / F.greatest("_bytes", F.lit(1))), F.lit(1)))
    large = (rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), width.alias("_bytes"))
             .where((F.col("_n") > max_items) | (F.col("_bytes") > max_bytes))
             .withColumn("_per", per_piece).drop("_n", "_bytes"))
    packed = lambda by: F.transform(F.sort_array(F.collect_list(F.struct(
        *[F.col(quote(c)).alias(f"_by{i}") for i, c in enumerate(by)],
        F.col(quote(item)).alias("_item")))), lambda x: x["_item"])
    if large.isEmpty():
        return rows.groupBy(*keys).agg(packed(order).alias(name)).withColumn("piece", F.lit(0).cast("long"))
    large = materialize(large, "large-groups")
    small = (rows.join(large, keys, "left_anti").groupBy(*keys).agg(packed(order).alias(name))
             .withColumn("piece", F.lit(0).cast("long")))
    numbered = number_rows(rows.join(large, keys, "left_semi"), [*keys, *order, item], "_pos")
    # At most one row per max_items rows; written, so the join knows its size.
    firsts = materialize(numbered.groupBy(*keys).agg(F.min("_pos").alias("_first")), "firsts")
    pieces = (numbered.join(firsts, keys).join(large, keys)
              .withColumn("piece", F.floor((F.col("_pos") - F.col("_first")) / F.col("_per")))
              .groupBy(*keys, "piece").agg(packed(["_pos"]).alias(name)))
    return small.unionByName(pieces)


class SortedRun:
    """A table sorted once, kept for many pages.

    The rows are range-partitioned and sorted in parallel (row hash last, as
    in ``number_rows``) and written once with their place ``_at``; the count of
    each written part is kept. A page then reads only the parts that hold it:
    its filter on ``_at`` reaches the parquet scan, whose file statistics skip
    the other parts, and nothing is sorted again.
    """

    def __init__(self, df: DataFrame, column: str | None = None, direction: str = "asc", keys: list[str] = ()):
        spark = df.sparkSession
        order = _total_order(df, column, direction, keys)
        plain = [F.col(quote(f.name)) for f in df.schema.fields
                 if not f.dataType.simpleString().startswith(("map", "variant"))]
        self.columns = list(df.columns)
        self.rows = materialize(
            df.withColumn("_tie", F.xxhash64(*plain)).repartitionByRange(*order, "_tie")
            .sortWithinPartitions(*order, "_tie").drop("_tie").withColumn("_at", F.monotonically_increasing_id()),
            "sorted-run")
        part = F.shiftright("_at", _PARTITION_BITS)
        counts = self.rows.groupBy(part.alias("_part")).count().orderBy("_part").collect()
        self.parts, total = [], 0
        for row in counts:  # one small row per written part
            self.parts.append((row._part, total, row["count"]))
            total += row["count"]
        self.total = total

    def slice(self, skip: int, count: int) -> DataFrame:
        """Rows ``skip`` .. ``skip + count - 1`` of the order, with ``_pos``."""
        end, ranges = skip + count, []
        for part, start, n in self.parts:
            if start < end and start + n > skip:
                base = part << _PARTITION_BITS
                low, high = base + max(0, skip - start), base + min(n, end - start) - 1
                ranges.append((F.col("_at") >= low) & (F.col("_at") <= high))
        spark = self.rows.sparkSession
        if not ranges:
            return self.rows.limit(0).select(*[quote(c) for c in self.columns])
        where = ranges[0]
        for r in ranges[1:]:
            where = where | r
        offsets = small_frame(spark, [(p, s) for p, s, _ in self.parts], "_part long, _start long")
        inside = F.col("_at").bitwiseAND((1 << _PARTITION_BITS) - 1)
        return (self.rows.where(where).withColumn("_part", F.shiftright("_at", _PARTITION_BITS))
                .join(offsets, "_part").withColumn("_pos", F.col("_start") + inside)
                .orderBy("_pos").select(*[quote(c) for c in self.columns]))

    def page(self, number: int, size: int = 100) -> DataFrame:
        """Page ``number`` (from 1) of ``size`` rows, in order."""
        return self.slice((number - 1) * size, size)
