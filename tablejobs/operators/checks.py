"""Checks in place of constraints: references, uniqueness, NULLs, row counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.types import quote, text
from ..session import materialize
from ..sources.catalog import null_counts
from .merge import duplicate_keys


def orphan_keys(child: DataFrame, parent: DataFrame, on: dict[str, str]) -> DataFrame:
    """Child key values without a parent row, with their row count.

    The child is counted by key first (combined before the shuffle), so a value
    that many rows share is one row in the join.
    """
    fk = list(on)
    counted = (child.dropna(subset=fk).groupBy(*fk).agg(F.count(F.lit(1)).alias("n_rows")))
    parents = parent.select([F.col(quote(p)).alias(c) for c, p in on.items()])
    return counted.join(parents, fk, "left_anti")


def orphan_rows(child: DataFrame, parent: DataFrame, on: dict[str, str]) -> DataFrame:
    """Child rows without a parent row; a NULL reference is no orphan."""
    return child.join(orphan_keys(child, parent, on).drop("n_rows"), list(on), "left_semi")


def reference_report(checks: list[tuple[str, DataFrame, DataFrame, dict[str, str]]]) -> DataFrame:
    """Per reference: number of key values and of rows without a parent."""
    parts = [orphan_keys(child, parent, on)
             .agg(F.count(F.lit(1)).alias("orphan_values"),
                  F.coalesce(F.sum("n_rows"), F.lit(0)).alias("orphan_rows"))
             .select(F.lit(name).alias("reference"), "orphan_values", "orphan_rows")
             for name, child, parent, on in checks]
    return reduce(DataFrame.unionByName, parts)


def unique_violations(df: DataFrame, keys: list[str], nulls_too: bool = False) -> DataFrame:
    """Keys that occur more than once, with their row count. A key with a NULL
    part repeats nothing; with ``nulls_too`` (a primary key is meant) rows with
    such keys are reported as well, however often they occur."""
    whole = duplicate_keys(df.dropna(subset=keys), keys)
    if not nulls_too:
        return whole
    broken = reduce(lambda a, b: a | b, [F.col(quote(k)).isNull() for k in keys])
    return whole.unionByName(df.where(broken).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")))


def not_null_report(df: DataFrame, table: str, required: list[str]) -> DataFrame:
    """NULL count of each required column, in one pass."""
    return null_counts(df, table, required).selectExpr(
        "table_name", "column_name", "null_count AS n_null", "null_count = 0 AS ok")


def row_counts(frames: dict[str, DataFrame], name: str = "n_rows") -> DataFrame:
    """table_name and row count of each table."""
    return reduce(DataFrame.unionByName, [
        df.selectExpr(f"{text(table)} AS table_name", f"count(1) AS {quote(name)}")
        for table, df in frames.items()])


def row_count_check(source: dict[str, DataFrame], target: dict[str, DataFrame]) -> DataFrame:
    """Row counts of both sides per table; a missing side counts as NULL."""
    joined = row_counts(source, "source_rows").join(
        row_counts(target, "target_rows"), "table_name", "full")
    return joined.withColumn("ok", F.col("source_rows").eqNullSafe(F.col("target_rows")))


def _fingerprints(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key columns, a 64-bit key hash and two 64-bit row hashes of every row."""
    cols = [F.col(quote(c)) for c in sorted(df.columns)]
    return df.select(*[F.col(quote(k)) for k in keys], F.xxhash64(*[F.col(quote(k)) for k in keys]).alias("_kh"),
                     F.xxhash64(*cols).alias("_h1"), F.xxhash64(F.lit(1), *cols).alias("_h2"))


def _sums(rows: DataFrame, bucket) -> DataFrame:
    """Per bucket: row count and the 128 bits of summed row hashes, exact in
    decimals, so the order of rows does not matter."""
    wide = "decimal(38,0)"
    return rows.groupBy(bucket.alias("_b")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("_h1").cast(wide)).alias("_s1"),
        F.sum(F.col("_h2").cast(wide)).alias("_s2"))


def content_differences(left: DataFrame, right: DataFrame, keys: list[str], fan: int = 64,
                        few: int = 10_000) -> tuple[DataFrame, list[int]]:
    """Rows that differ between two tables of the same columns, found by
    narrowing: both sides are summed (count and 128 bits of row hashes, order
    free) in ``fan`` key-hash buckets, then only the buckets that differ are
    split ``fan`` times finer, until the rows of the differing buckets are
    ``few`` or less on each side; those rows are compared by hash.

    Equal tables stop after the first level, a single row per side. Each level
    reads key hashes and row hashes only, of the rows still in doubt; the
    differing buckets are a written table joined by the next level, and only
    their count and largest size go to the driver. Returns the differing rows
    (``side``: left_only or right_only, the keys, ``row_hash``) and the number
    of rows in doubt at each level.
    """
    a, b = _fingerprints(left, keys), _fingerprints(right, keys)
    width, doubt, sizes = 1, None, []
    while True:
        bucket = F.pmod(F.col("_kh"), F.lit(width))
        if doubt is not None:
            a_in = a.join(doubt, F.pmod(F.col("_kh"), F.lit(width // fan)) == doubt["_d"], "left_semi")
            b_in = b.join(doubt, F.pmod(F.col("_kh"), F.lit(width // fan)) == doubt["_d"], "left_semi")
        else:
            a_in, b_in = a, b
        sa, sb = _sums(a_in, bucket).alias("l"), _sums(b_in, bucket).alias("r")
        both = sa.join(sb, "_b", "full_outer")
        differs = both.where(~(F.col("l._n").eqNullSafe(F.col("r._n")) & F.col("l._s1").eqNullSafe(F.col("r._s1"))
                               & F.col("l._s2").eqNullSafe(F.col("r._s2"))))
        found = materialize(differs.select(F.col("_b").alias("_d"), F.greatest(
            F.coalesce("l._n", F.lit(0)), F.coalesce("r._n", F.lit(0))).alias("n")), "content-doubt")
        stats = found.agg(F.count(F.lit(1)).alias("buckets"), F.max("n").alias("most"), F.sum("n").alias("rows")).first()
        sizes.append(int(stats["rows"] or 0))
        if not stats["buckets"]:
            return left.sparkSession.createDataFrame([], _diff_schema(left, keys)), sizes
        if stats["most"] <= few or width >= (1 << 62) // fan:
            break
        doubt, width = found, width * fan
    pick = lambda df: df.join(found, F.pmod(F.col("_kh"), F.lit(width)) == found["_d"], "left_semi")
    cols = [*keys, "_h1", "_h2"]
    la = pick(a).groupBy(*cols).agg(F.count(F.lit(1)).alias("_ln"))
    rb = pick(b).groupBy(*cols).agg(F.count(F.lit(1)).alias("_rn"))
    # Copies of a row count: a row twice on one side and once on the other is
    # one row of difference.
    both = la.alias("l").join(rb.alias("r"), [F.col(f"l.{quote(c)}").eqNullSafe(F.col(f"r.{quote(c)}")) for c in cols], "full_outer")
    excess = F.coalesce(F.col("_ln"), F.lit(0)) - F.coalesce(F.col("_rn"), F.lit(0))
    pick_side = lambda side: [F.coalesce(F.col(f"{side}.{quote(k)}"), F.col(f"{'r' if side == 'l' else 'l'}.{quote(k)}")).alias(k)
                              for k in keys]
    diff = both.select(*pick_side("l"), F.coalesce("l._h1", "r._h1").alias("row_hash"), excess.alias("_x"))
    rows = diff.where("_x <> 0").select(
        F.when(F.col("_x") > 0, "left_only").otherwise("right_only").alias("side"), *keys, "row_hash",
        F.explode(F.array_repeat(F.lit(1), F.abs(F.col("_x")).cast("int"))).alias("_one"))
    return rows.drop("_one"), sizes


def _diff_schema(df: DataFrame, keys: list[str]) -> str:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(["side string", *[f"{quote(k)} {types[k]}" for k in keys], "row_hash long"])


def key_candidates(tables: dict[str, DataFrame], slack: float = 0.9, at_once: int = 4) -> DataFrame:
    """Single columns that are keys (no NULL, no repeat), measured, not given.

    One pass per table gives the row count and, per column, the non-NULL count
    and a distinct-count sketch (``hll_sketch_agg``, combined before the
    shuffle); a column is a candidate when it has no NULL and its estimate
    reaches ``slack`` times the rows. A second pass counts the candidates'
    distinct values exactly; only those equal to the row count are kept.
    Tables run ``at_once`` at a time. Returns (table_name, column_name).
    """
    spark = next(iter(tables.values())).sparkSession

    def one(item):
        name, df = item
        cols = df.columns
        text = lambda c: F.col(quote(c)).cast("string")
        first = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(quote(c))).alias(f"c{i}") for i, c in enumerate(cols)],
                       *[F.hll_sketch_estimate(F.hll_sketch_agg(text(c))).alias(f"e{i}") for i, c in enumerate(cols)]).first()
        n = first["_n"]
        maybe = [c for i, c in enumerate(cols) if n and first[f"c{i}"] == n and first[f"e{i}"] >= slack * n]
        if not maybe:
            return []
        exact = df.agg(*[F.count_distinct(F.col(quote(c))).alias(f"d{i}") for i, c in enumerate(maybe)]).first()
        return [(name, c) for i, c in enumerate(maybe) if exact[f"d{i}"] == n]

    from ..session import in_parallel, small_frame
    found = [row for rows in in_parallel(spark, one, list(tables.items()), at_once) for row in rows]
    return small_frame(spark, found, "table_name string, column_name string")
