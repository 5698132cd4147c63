"""Keyed merges: an edit change set, and load with a conflict strategy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.types import quote

STRATEGIES = ("error", "ignore", "replace")


class ConflictError(ValueError):
    """Rows of a load have keys that exist already, or twice."""


def _cells(df: DataFrame, keys: list[str]) -> list[str]:
    return [c for c in df.columns if c not in keys]


def _edits_by_key(changes: DataFrame, keys: list[str], cells: list[str]) -> DataFrame:
    """One row per edited key: deleted flag, and per cell a set flag and the
    last value. Plain aggregates, so many edits of one key combine before the
    shuffle. Without ``seq`` several updates of a key are put together cell by
    cell; a cell that they set to different values fails the job."""
    edits = changes.where(F.col("op") != "insert").groupBy(*keys)
    deleted = F.max(F.col("op") == "delete").alias("_deleted")
    out, last = [deleted], []
    if "seq" not in changes.columns:
        for i, c in enumerate(cells):
            is_set = (F.col("op") == "update") & F.array_contains("set", c)
            value = F.when(is_set, F.struct(F.col(quote(c)).alias("v")))
            out += [F.max(is_set).alias(f"_set{i}"), F.max(value).alias(f"_last{i}"), F.min(value).alias(f"_first{i}")]
            same = F.col(f"_first{i}.v").eqNullSafe(F.col(f"_last{i}.v"))
            clash = F.raise_error(F.lit(f"two edits of one row set {c} to different values"))
            last += [F.col(f"_set{i}"), F.when(same, F.col(f"_last{i}.v")).otherwise(clash).alias(f"_new{i}")]
        return edits.agg(*out).select(*keys, "_deleted", *last)
    for i, c in enumerate(cells):
        is_set = (F.col("op") == "update") & F.array_contains("set", c)
        out.append(F.max(is_set).alias(f"_set{i}"))
        value = F.max_by(F.struct(F.col(quote(c)).alias("v")), F.when(is_set, F.col("seq")))
        out.append(value.alias(f"_last{i}"))
        last += [F.col(f"_set{i}"), F.col(f"_last{i}.v").alias(f"_new{i}")]
    return edits.agg(*out).select(*keys, "_deleted", *last)


def edit_states(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """All rows with ``row_state``: NULL, modified, added or deleted.

    ``changes`` has the table's columns plus ``op`` (update, delete, insert),
    ``set`` (array of the edited columns) and, if a row is edited twice, ``seq``.
    An edit to the same text is no change (NULL and empty text differ); a deleted
    row stays deleted. The base
    is joined from the left, so a small change set is broadcast by size and the
    base is not shuffled.
    """
    cells = _cells(base, keys)
    edits = _edits_by_key(changes, keys, cells)
    joined = base.join(edits, keys, "left")
    changed, out = [], [F.col(quote(k)) for k in keys]
    for i, c in enumerate(cells):
        old, new = F.col(quote(c)), F.col(f"_new{i}")
        dirty = F.coalesce(F.col(f"_set{i}"), F.lit(False)) & ~old.cast("string").eqNullSafe(new.cast("string"))
        changed.append(dirty)
        out.append(F.when(dirty, new).otherwise(old).alias(c))
    any_changed = reduce(lambda a, b: a | b, changed, F.lit(False))
    state = F.when(F.col("_deleted"), "deleted").when(any_changed, "modified")
    edited = joined.select(*out, state.alias("row_state"))
    added = (changes.where("op = 'insert'")
             .select(*[quote(c) for c in edited.columns if c != "row_state"],
                     F.lit("added").alias("row_state")))
    return edited.unionByName(added).select(*[quote(c) for c in base.columns], "row_state")


def merge_edits(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table after the edits."""
    states = edit_states(base, changes, keys)
    return states.where("row_state IS NULL OR row_state <> 'deleted'").drop("row_state")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def one_per_key(df: DataFrame, keys: list[str], order: str, last: bool = True) -> DataFrame:
    """The last (or first) row of each key by ``order``."""
    row = F.struct(*[F.col(quote(c)) for c in df.columns])
    pick = F.max_by(row, F.col(quote(order))) if last else F.min_by(row, F.col(quote(order)))
    return df.groupBy(*keys).agg(pick.alias("_row")).select("_row.*")


def existing_keys(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of ``source`` that ``target`` has. Only key columns of the target are
    read, and a small source is broadcast by size instead of shuffling them."""
    wanted = source.select(*keys).distinct()
    return target.select(*keys).join(wanted, keys, "left_semi").distinct()


def new_rows(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``source`` whose key ``target`` lacks."""
    return source.join(existing_keys(target, source, keys), keys, "left_anti")


def conflicts(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``source`` whose key ``target`` has."""
    return source.join(existing_keys(target, source, keys), keys, "left_semi")


def merge_load(target: DataFrame, source: DataFrame, keys: list[str], strategy: str,
               order: str | None = None) -> DataFrame:
    """The target after the load of ``source``.

    ignore keeps the target row, replace takes the source row, error raises.
    If a key may occur twice in the source, ``order`` picks the last row for
    replace and the first for ignore.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown conflict strategy {strategy}")
    if order is not None and strategy != "error":
        source = one_per_key(source, keys, order, last=strategy == "replace")
    elif not duplicate_keys(source, keys).isEmpty():
        raise ConflictError(f"the source has rows with the same {keys}")
    source = source.select(*[quote(c) for c in target.columns])
    if strategy == "error":
        if not existing_keys(target, source, keys).isEmpty():
            raise ConflictError(f"the target has rows with the same {keys}")
        return target.unionByName(source)
    if strategy == "ignore":
        return target.unionByName(new_rows(target, source, keys))
    return target.join(source.select(*keys), keys, "left_anti").select(
        *[quote(c) for c in target.columns]).unionByName(source)
