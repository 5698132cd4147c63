"""Merkle manifest of a table: a digest for each row, a tree per group, a root.

Every row is a leaf. Within a group, leaves are in ascending order; every
``fanout`` consecutive nodes of a level become the digest of their digests
(the level's last run may be shorter, one node included), until one node is
left: the group's subroot. The subroots in group order build the root the same
way. A row's proof is the list of its siblings, level by level, up to the root.

The tree is built with Spark alone. Each level is one equijoin of the level's
nodes with the nodes at computed sibling places: a node at place ``i`` sits in
slot ``i % fanout`` of its run, and the nodes at slots 1 .. fanout - 1 join the
slot-zero node at place ``i - slot``. The slot-zero row then holds the whole
run and gives the parent's digest and each member's siblings. Proofs are
joined from the top down, so each level is shuffled once more; no group, also
not one that holds a third of all rows, is ever in one task, since the join
keys are places, not groups.

Defined cases: null fields hash as ``-``; empty and very long texts are hashed
whole; rows that tie in group and order (repeated rows among them) are ordered
by their leaf digest, so equal rows are interchangeable and every row gets its
own proof; an empty table gives no rows; a group of one row has that leaf as
its subroot and an empty proof below it; further columns pass through under
their own names, whatever they are (inside, all are renamed ``_mk_c<n>``);
input columns named ``leaf``, ``subroot``, ``root`` or ``path`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablejobs.operators.ordering import number_rows
from tablejobs.session import materialize

#: Fixed values of the dealt manifest: fields of a leaf and the fan-out.
LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 3

PATH = "array<struct<slot:int,siblings:array<string>>>"


def H(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts' UTF-8 text, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value as text."""
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: list[Column]) -> Column:
    return H(*[field(c) for c in columns])


def _runs(nodes: DataFrame, fanout: int) -> DataFrame:
    """One row per run of ``fanout`` places of a level: group, the run's
    first place and the digests of its members (null where none).

    A level of one node gives a row with one member: that node is the top.
    """
    slot = F.col("_mk_i") % fanout
    run = nodes.where(slot == 0).select("_mk_g", "_mk_i", F.col("_mk_h").alias("_mk_h0"))
    for s in range(1, fanout):
        shifted = nodes.where(slot == s).select(
            "_mk_g", (F.col("_mk_i") - s).alias("_mk_i"), F.col("_mk_h").alias(f"_mk_h{s}"))
        run = run.join(shifted, ["_mk_g", "_mk_i"], "left")
    return run


def _levels(nodes: DataFrame, fanout: int, depth: int, label: str) -> tuple[list[DataFrame], DataFrame]:
    """The runs of each level (written once each) and the top node of each
    group (``_mk_g``, ``_mk_h``)."""
    members = [F.col(f"_mk_h{s}") for s in range(fanout)]
    alone = (F.col("_mk_i") == 0) & F.col("_mk_h1").isNull()
    levels, tops = [], []
    for level in range(depth + 1):
        runs = materialize(_runs(nodes, fanout), f"{label}-{level}")
        tops.append(runs.where(alone).select("_mk_g", F.col("_mk_h0").alias("_mk_h")))
        runs = runs.where(~alone)
        levels.append(runs)
        nodes = runs.select("_mk_g", (F.col("_mk_i") / fanout).cast("long").alias("_mk_i"),
                            F.sha2(F.concat_ws("", *members), 256).alias("_mk_h"))
    top = tops[0]
    for more in tops[1:]:
        top = top.unionByName(more)
    return levels, top


def _depth(largest: int, fanout: int) -> int:
    """Levels until a group of ``largest`` nodes is one node."""
    depth = 0
    while largest > 1:
        largest = -(-largest // fanout)
        depth += 1
    return depth


def _paths(levels: list[DataFrame], fanout: int) -> DataFrame:
    """Each node below a top: (``_mk_g``, ``_mk_i``, ``_mk_path``), the path
    an array of (slot, siblings) from its own level up to its group's top."""
    members = [F.col(f"_mk_h{s}") for s in range(fanout)]
    above = None
    for runs in reversed(levels):
        rows = runs.select("_mk_g", "_mk_i", F.array(*members).alias("_mk_run")).select(
            "_mk_g", (F.col("_mk_i") / fanout).cast("long").alias("_mk_p"),
            F.posexplode(F.array(*[F.lit(s) for s in range(fanout)])).alias("_mk_s", "_mk_x"), "_mk_i", "_mk_run")
        rows = rows.where(F.col("_mk_run")[F.col("_mk_s")].isNotNull()).select(
            "_mk_g", "_mk_p", (F.col("_mk_i") + F.col("_mk_s")).alias("_mk_i"),
            F.struct(F.col("_mk_s").cast("int").alias("slot"),
                     F.filter(F.col("_mk_run"), lambda h, j: (j != F.col("_mk_s")) & h.isNotNull()).alias("siblings"),
                     ).alias("_mk_step"))
        if above is not None:
            rows = rows.join(above.withColumnRenamed("_mk_i", "_mk_p"), ["_mk_g", "_mk_p"], "left")
            path = F.concat(F.array("_mk_step"), F.coalesce("_mk_path", F.array().cast(PATH)))
        else:
            path = F.array("_mk_step")
        above = materialize(rows.select("_mk_g", "_mk_i", path.alias("_mk_path")), "merkle-path")
    return above


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` gives with the siblings of ``path``."""
    def step(acc, s):
        parts = F.concat(F.slice(s["siblings"], 1, s["slot"]), F.array(acc),
                         F.slice(s["siblings"], s["slot"] + 1, FANOUT))
        return F.sha2(F.array_join(parts, ""), 256)
    return F.aggregate(path, leaf, step)


def proof_digest(path: Column) -> Column:
    """H of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(path, lambda s: s["siblings"])), ""), 256)


def build_manifest(rows: DataFrame, leaf: Column, group: str, order: list[Column],
                   fanout: int = FANOUT) -> DataFrame:
    """The rows with ``leaf``, ``subroot``, ``root`` and ``path`` (array of
    (slot, siblings) from the leaf's level to the root); input columns of
    these names are replaced.

    ``order`` orders leaves within a group; ties are ordered by the leaf.
    Groups are ordered by ``group`` ascending, null first (strings bytewise).
    Only the given columns are copied; project before, as texts are not needed
    once ``leaf`` is computed.
    """
    outputs = ("leaf", "subroot", "root", "path")
    keep = [c for c in rows.columns if c not in outputs]
    names = {c: f"_mk_c{i}" for i, c in enumerate(keep)}
    rows = rows.select(*[F.col(f"`{c}`").alias(names[c]) for c in keep],
                       leaf.alias("_mk_leaf"), F.col(f"`{group}`").alias("_mk_key"))
    order = [rows[names[c]] if isinstance(c, str) else c for c in order]
    numbered = number_rows(rows, [F.col("_mk_key").asc_nulls_first(), *order, F.col("_mk_leaf")], "_mk_pos")
    # The first place of each group names it and orders the groups.
    groups = materialize(numbered.groupBy("_mk_key").agg(F.min("_mk_pos").alias("_mk_g"),
                                                         F.count(F.lit(1)).alias("_mk_n")), "merkle-groups")
    stats = groups.agg(F.max("_mk_n").alias("largest"), F.count(F.lit(1)).alias("groups")).first()
    leaves = materialize(numbered.join(groups, numbered["_mk_key"].eqNullSafe(groups["_mk_key"]))
                         .drop(groups["_mk_key"]).drop("_mk_n")
                         .withColumn("_mk_i", F.col("_mk_pos") - F.col("_mk_g")), "merkle-leaves")
    empty = F.array().cast(PATH)
    restore = [F.col(n).alias(c) for c, n in names.items()]
    if not stats["groups"]:
        return leaves.select(*restore, F.col("_mk_leaf").alias("leaf"), F.lit(None).cast("string").alias("subroot"),
                             F.lit(None).cast("string").alias("root"), F.lit(None).cast(PATH).alias("path"))
    levels, subroots = _levels(leaves.select("_mk_g", "_mk_i", F.col("_mk_leaf").alias("_mk_h")),
                               fanout, _depth(stats["largest"], fanout), "merkle-level")

    # Subroots in group order are the leaves of the upper tree, one group.
    upper_nodes = materialize(number_rows(subroots, ["_mk_g"], "_mk_i").select(
        F.col("_mk_g").alias("_mk_source"), F.lit(0).cast("long").alias("_mk_g"), "_mk_i", "_mk_h"), "merkle-subroots")
    up_levels, root = _levels(upper_nodes.select("_mk_g", "_mk_i", "_mk_h"), fanout,
                              _depth(stats["groups"], fanout), "merkle-upper")
    root_value = root.first()["_mk_h"]  # one digest
    upper = upper_nodes.select(F.col("_mk_source").alias("_mk_g"), "_mk_i", F.col("_mk_h").alias("subroot"))
    if up_levels:
        upper = upper.join(_paths(up_levels, fanout).drop("_mk_g"), "_mk_i", "left")
    else:
        upper = upper.withColumn("_mk_path", F.lit(None).cast(PATH))
    upper = upper.select("_mk_g", "subroot", F.coalesce("_mk_path", empty).alias("_mk_upper"))
    out = leaves
    if levels:
        out = out.join(_paths(levels, fanout), ["_mk_g", "_mk_i"], "left")
    else:
        out = out.withColumn("_mk_path", F.lit(None).cast(PATH))
    return out.join(upper, "_mk_g").select(
        *restore, F.col("_mk_leaf").alias("leaf"), "subroot", F.lit(root_value).alias("root"),
        F.concat(F.coalesce("_mk_path", empty), "_mk_upper").alias("path"))


def manifest(docs: DataFrame, fields: tuple[str, ...] = LEAF_FIELDS, group: str = "source",
             order: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """The dealt manifest of a documents table: leaves of ``fields`` (see
    :func:`field`), one tree per ``group`` in ascending ``order``, then a root.
    ``carry`` names the columns kept beside (default: all but the texts)."""
    leaf = leaf_digest([F.col(f"`{f}`") for f in fields])
    if carry is None:
        carry = [c for c in docs.columns if c != "text"]
    rows = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*carry, group, order])], leaf.alias("_mk_in"))
    return build_manifest(rows.drop("leaf").withColumnRenamed("_mk_in", "leaf") if "leaf" in rows.columns
                          else rows.withColumnRenamed("_mk_in", "leaf"), F.col("leaf"), group, [order])
