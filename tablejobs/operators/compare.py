"""Schema compare over two ``describe`` frames, summary and sync plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

_FACTS = ("data_type", "nullable", "default_value", "column_key")


def _side(df: DataFrame, prefix: str) -> DataFrame:
    return df.select("table_name", "column_name", F.lit(True).alias(f"{prefix}_has"),
                     F.col("position").alias(f"{prefix}_position"),
                     *[F.col(c).alias(f"{prefix}_{c}") for c in _FACTS])


def _tables(source: DataFrame, target: DataFrame) -> DataFrame:
    names = lambda df, flag: df.select("table_name").distinct().withColumn(flag, F.lit(True))
    return (names(source, "in_source").join(names(target, "in_target"), "table_name", "full")
            .select("table_name", F.coalesce("in_source", F.lit(False)).alias("in_source"),
                    F.coalesce("in_target", F.lit(False)).alias("in_target")))


def table_difference(source: DataFrame, target: DataFrame) -> DataFrame:
    """Tables on one side only."""
    side = F.when(F.col("in_source"), "only_in_source").otherwise("only_in_target")
    return (_tables(source, target).where("in_source <> in_target")
            .select("table_name", side.alias("status")))


def compare_columns(source: DataFrame, target: DataFrame) -> DataFrame:
    """Column pairs with a status. The first difference in the order type,
    nullable, default, key gives it. Tables only in the target list no columns.
    """
    s, t = _side(source, "source"), _side(target, "target")
    joined = (s.join(t, ["table_name", "column_name"], "full")
              .join(_tables(source, target), "table_name").where("in_source"))
    differs = lambda fact: ~F.col(f"source_{fact}").eqNullSafe(F.col(f"target_{fact}"))
    status = (F.when(~F.col("in_target"), "missing")
              .when(F.col("target_has").isNull(), "missing_in_target")
              .when(F.col("source_has").isNull(), "extra_in_target")
              .when(differs("data_type"), "type_mismatch")
              .when(differs("nullable"), "nullable_mismatch")
              .when(differs("default_value"), "default_mismatch")
              .when(differs("column_key"), "key_mismatch")
              .otherwise("match"))
    sides = [f"{side}_{fact}" for fact in _FACTS for side in ("source", "target")]
    return joined.select("table_name", "column_name", *sides, status.alias("status"),
                         F.coalesce("source_position", "target_position").alias("position"))


def compare_lists(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Index or foreign-key lists by ``keys``, both ways: match, mismatch,
    missing_in_target or extra_in_target."""
    facts = [c for c in source.columns if c not in keys]
    side = lambda df, p: df.select(*keys, F.struct(*facts).alias(f"{p}_facts"))
    joined = side(source, "source").join(side(target, "target"), keys, "full")
    status = (F.when(F.col("target_facts").isNull(), "missing_in_target")
              .when(F.col("source_facts").isNull(), "extra_in_target")
              .when(F.col("source_facts") != F.col("target_facts"), "mismatch")
              .otherwise("match"))
    return joined.select(*keys, "source_facts", "target_facts", status.alias("status"))


def compare_tables(source: DataFrame, target: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """Status per table. ``lists`` is a ``compare_lists`` result with a
    table_name column; its differences count too."""
    found = compare_columns(source, target).select("table_name", "status")
    if lists is not None:
        found = found.unionByName(lists.select("table_name", "status"))
    differing = found.where("status <> 'match'").groupBy("table_name").agg(
        F.count(F.lit(1)).alias("n_diffs"))
    status = (F.when(~F.col("in_target"), "only_in_source")
              .when(~F.col("in_source"), "only_in_target")
              .when(F.col("n_diffs") > 0, "differs").otherwise("match"))
    return (_tables(source, target).join(differing, "table_name", "left")
            .select("table_name", status.alias("status"),
                    F.coalesce("n_diffs", F.lit(0)).alias("n_diffs")))


def compare_summary(tables: DataFrame) -> DataFrame:
    """One row of counts; "differ" counts the one-sided tables too."""
    n = lambda condition: F.count_if(F.expr(condition))
    return tables.agg(n("status = 'match'").alias("n_match"),
                      n("status <> 'match'").alias("n_differ"),
                      n("status = 'only_in_source'").alias("extra_in_source"),
                      n("status = 'only_in_target'").alias("extra_in_target")).withColumn(
        "summary", F.format_string(
            "%d tables match, %d differ, %d extra in source, %d extra in target",
            "n_match", "n_differ", "extra_in_source", "extra_in_target"))


def sync_plan(source: DataFrame, target: DataFrame) -> DataFrame:
    """Statements that bring the target's structure up to the source's."""
    columns = (compare_columns(source, target).where("status = 'missing_in_target'")
               .select("table_name", F.lit("add_column").alias("action"), "column_name",
                       F.col("source_data_type").alias("data_type"),
                       F.concat(F.lit("ALTER TABLE "), "table_name", F.lit(" ADD COLUMN "),
                                "column_name", F.lit(" "), "source_data_type").alias("statement")))
    none = F.lit(None).cast("string")
    create = F.col("status") == "only_in_source"
    tables = table_difference(source, target).select(
        "table_name", F.when(create, "create_table").otherwise("drop_table").alias("action"),
        none.alias("column_name"), none.alias("data_type"),
        F.concat(F.when(create, "CREATE TABLE ").otherwise("DROP TABLE "), "table_name")
        .alias("statement"))
    return columns.unionByName(tables)


def add_missing_columns(df: DataFrame, plan: DataFrame, table: str) -> DataFrame:
    """Apply the plan's ADD COLUMN rows to a table. The plan holds one row per
    missing column, so reading it here is bounded by the schema."""
    missing = plan.where((F.col("table_name") == table) & (F.col("action") == "add_column"))
    added = [F.lit(None).cast(r.data_type).alias(r.column_name)
             for r in missing.select("column_name", "data_type").collect()]
    return df.select("*", *added)


def content_summary(pairs: dict[str, tuple[DataFrame, DataFrame, list[str]]]) -> DataFrame:
    """One row that depends on the rows: tables whose content is the same or
    differs (by ``checks.content_differences``), rows on each side, and rows
    found on one side only. Tables are compared one after another; each
    comparison reads hashes only and narrows to the differing rows."""
    from ..session import small_frame
    from .checks import content_differences

    rows = []
    for name, (source, target, keys) in pairs.items():
        found, _ = content_differences(source, target, keys)
        sides = found.agg(F.count_if(F.col("side") == "left_only").alias("s"),
                          F.count_if(F.col("side") == "right_only").alias("t")).first()
        rows.append((name, source.count(), target.count(), sides["s"], sides["t"]))
    every = small_frame(source.sparkSession, rows, "table_name string, source_rows long, target_rows long, "
                        "only_source long, only_target long")
    same = (F.col("only_source") == 0) & (F.col("only_target") == 0)
    return every.agg(F.count(F.lit(1)).alias("n_tables"), F.count_if(same).alias("n_same"),
                     F.count_if(~same).alias("n_differ"), F.sum("source_rows").alias("source_rows"),
                     F.sum("target_rows").alias("target_rows"), F.sum("only_source").alias("rows_only_source"),
                     F.sum("only_target").alias("rows_only_target"))
