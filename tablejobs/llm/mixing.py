"""Mix sources to target weights by a low-discrepancy schedule.

Sources, by code point (null last), weigh 5, 2, 1, repeating, and share the
corpus' words by weight; a target stops at ``most`` times its source's size and
the excess is shared again by weight.

Method: each source's documents, in the order of a hash, make a stream of words
that is cut into blocks of ``block_words``. Slot i of the mix stands at the
point frac(i / golden ratio); the sources' targets, laid end to end on the unit
interval, say whose slot that is. The slot's rank within its source names the
block: rank by rank, and from the first again after the last. The last slot of
a source takes only the words its target still lacks.

At scale: DataFrame operations only. Words and slots are summed in two steps,
within buckets of a hash (or of slots) and over the buckets, so no task orders
a whole source; a source with a third of all words is 65,536 groups. Blocks and
slots meet by (source, block). No text is shuffled for the schedule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablejobs.session import materialize

WORD = r"[^\x20\x09-\x0D]+"

#: The weights, repeating in the order of the sources.
WEIGHTS = (5, 2, 1)

BLOCK_WORDS = 256
SLOT_CHUNK = 1 << 16
CELLS = 4096

# 31 bits of the golden ratio's reciprocal: products of 31-bit numbers fit a long.
_BITS = 1 << 31
_GOLDEN = 1327217885


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """``source``, ``source_size``, ``target`` and ``quota`` (the target in whole
    words) from rows of ``source`` and ``size``.

    With sources in the order of cap by weight, let level k be what a unit of
    weight gets if all sources before k are capped. Levels rise as long as the
    source is capped, then fall, so the highest is the one that holds.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("place"))
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    return (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
            .withColumn("place", F.row_number().over(by_name) - 1)
            .withColumn("weight", weight.cast("double"))
            .withColumn("cap", F.col("source_size") * most)
            .withColumn("total", F.sum("source_size").over(everything))
            .withColumn("capped", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("level", (F.col("total") - F.col("capped"))
                        / F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
            .withColumn("level", F.max("level").over(everything))
            .withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")))
            .withColumn("quota", F.least(F.col("cap"), F.round("target").cast("long")))
            .select("place", "source", "source_size", "target", "quota"))


def _streams(docs: DataFrame, targets: DataFrame, id_column: str, tie_column: str | None) -> DataFrame:
    """``docs`` (with ``source``, ``size``) and each one's source facts and first
    word's place, ``start``, in its source's stream."""
    order = ["_h", "size"] + ([tie_column] if tie_column else [])
    bucket = Window.partitionBy("source", "_bucket")
    keyed = (docs.withColumn("_h", F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit(""))))
             .withColumn("_bucket", F.substring("_h", 1, 4)))
    sums = keyed.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = (sums.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
             .join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
             .select("_source", F.col("_bucket").alias("_b"), "_base", "place",
                     "source_size", "target", "quota"))
    within = F.coalesce(F.sum("size").over(bucket.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (keyed.withColumn("_within", within)
            .join(bases, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b")))
            .withColumn("start", F.col("_base") + F.col("_within"))
            .drop("_h", "_bucket", "_within", "_source", "_b", "_base"))


def slots(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix in order: ``slot``, ``place`` of the source, ``rank`` in it, and
    the ``block``'s number, ``pass_no`` and ``words`` taken, from its first on."""
    spark = targets.sparkSession
    need = targets.where("quota > 0").withColumn("n", F.ceil(F.col("quota") / block_words).cast("long"))
    up_to = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    share = need.withColumn("total", F.sum("n").over(Window.partitionBy()))
    share = (share.withColumn("hi", F.sum("n").over(up_to) / F.col("total"))
             .withColumn("lo", (F.sum("n").over(up_to) - F.col("n")) / F.col("total"))
             .select("place", "source_size", "quota", "n", "lo", "hi"))
    n_slots = need.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    cells = share.withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1).cast("long")))))
    point = F.pmod(F.pmod("slot", F.lit(_BITS)) * F.lit(_GOLDEN), F.lit(_BITS)) / F.lit(_BITS)
    drawn = (spark.range(n_slots).withColumnRenamed("id", "slot").withColumn("u", point)
             .withColumn("cell", F.floor(F.col("u") * CELLS))
             .join(cells, "cell").where("u >= lo AND u < hi")
             .withColumn("chunk", F.floor(F.col("slot") / SLOT_CHUNK)))
    before = Window.partitionBy("place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = drawn.groupBy("place", "chunk").count()
    bases = counts.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    ranked = (drawn.withColumn("at", F.row_number().over(Window.partitionBy("place", "chunk").orderBy("slot")) - 1)
              .join(bases, ["place", "chunk"])
              .withColumn("rank", F.col("base") + F.col("at")).where("rank < n")
              .select("slot", "place", "source_size", "quota", "rank"))
    # The points give each source its share up to a few slots: those come last.
    have = counts.groupBy("place").agg(F.sum("count").alias("have"))
    rest = (share.join(have, "place", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < n")
            .withColumn("rank", F.explode(F.sequence("have", F.col("n") - 1)))
            .select((F.col("rank") + n_slots).alias("slot"), "place", "source_size", "quota", "rank"))
    blocks = F.ceil(F.col("source_size") / block_words)
    block = F.pmod("rank", blocks)
    passes = F.floor(F.col("rank") / blocks)
    begin = passes * F.col("source_size") + block * block_words
    end = F.least(passes * F.col("source_size") + F.least((block + 1) * block_words, F.col("source_size")), F.col("quota"))
    # A source's last block may be short, so a whole number of passes needs a
    # slot for each block of each pass.
    more = (share.withColumn("_b", F.ceil(F.col("source_size") / block_words))
            .withColumn("_full", F.floor(F.col("quota") / F.col("source_size")))
            .withColumn("_n", F.col("_full") * F.col("_b")
                        + F.ceil((F.col("quota") - F.col("_full") * F.col("source_size")) / block_words))
            .where("_n > n").withColumn("rank", F.explode(F.sequence("n", F.col("_n") - 1)))
            .select((F.col("rank") + n_slots).alias("slot"), "place", "source_size", "quota", "rank"))
    return (ranked.unionByName(rest).unionByName(more)
            .select("slot", "place", "rank", block.alias("block"), passes.alias("pass_no"),
                    (end - begin).alias("words")).where("words > 0"))


def _taken(streams: DataFrame, targets: DataFrame, block_words: int) -> DataFrame:
    """Words the mix takes of each document, by (place, start)."""
    used = slots(targets, block_words).groupBy("place", "block").agg(
        F.sum("words").alias("words"), F.max("words").alias("widest"), F.min("words").alias("narrowest"),
        F.count("*").alias("times"))
    pieces = (streams.where("size > 0").select("place", "start", "size")
              .withColumn("block", F.explode(F.sequence(
                  F.floor(F.col("start") / block_words),
                  F.floor((F.col("start") + F.col("size") - 1) / block_words))))
              .withColumn("a", F.greatest(F.col("start") - F.col("block") * block_words, F.lit(0)))
              .withColumn("b", F.least(F.col("start") + F.col("size") - F.col("block") * block_words, F.lit(block_words))))
    # All takes of a block are whole but at most one, which is a head of it.
    whole = F.when(F.col("widest") > F.col("narrowest"), F.col("times") - 1).otherwise(F.col("times"))
    in_head = F.greatest(F.least("b", "narrowest") - F.col("a"), F.lit(0))
    in_whole = F.greatest(F.least("b", "widest") - F.col("a"), F.lit(0))
    return (pieces.join(used, ["place", "block"])
            .withColumn("part", whole * in_whole + F.when(F.col("widest") > F.col("narrowest"), in_head).otherwise(0))
            .groupBy("place", "start").agg(F.sum("part").alias("taken")))


def _sized(docs: DataFrame, text_column: str, source_column: str) -> DataFrame:
    return docs.withColumn("size", n_words(F.col(text_column))).withColumn("source", F.col(source_column))


def mix_report(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, block_words: int = BLOCK_WORDS,
               id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """For each row of ``docs``: its id, ``size``, ``source_size``, its source's
    ``target`` and the words ``taken`` (repeats counted).

    A source's taken words are its target rounded; no row gives over ``most``
    times its size. Null and wordless texts have size 0 and give none; so do
    sources without words. A null source is one more source, the last. Rows that
    repeat an id follow each other, by size and text. An empty table gives an
    empty result; further columns play no part.
    """
    # The order of rows that agree in id and size does not show in this report.
    slim = _sized(docs.select(F.col(id_column), F.col(text_column), F.col(source_column)), text_column,
                  source_column).select(id_column, "source", "size")
    slim = materialize(slim, "sizes")  # words are counted once
    targets = materialize(source_targets(slim, weights, most), "targets")
    streams = _streams(slim, targets, id_column, None)
    taken = _taken(streams, targets, block_words)
    size_0 = (F.col("size") == 0)
    return (streams.withColumn("_key", F.when(size_0, None).otherwise(F.col("start")))
            .join(taken.withColumnRenamed("start", "_key"), ["place", "_key"], "left")
            .select(id_column, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3,
                  block_words: int = BLOCK_WORDS, id_column: str = "doc_id", text_column: str = "text",
                  source_column: str = "source", length_column: str | None = "n_chars") -> DataFrame:
    """The mixed corpus, with the columns of ``docs``: a row for each time a
    document is taken. A document that is taken in part the last time is cut
    after those words (joined by one space; ``length_column`` follows); all
    other texts are unchanged. Documents that the mix does not reach go, and so
    do wordless ones."""
    names = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"),
                       F.col(f"`{id_column}`").alias("_id"), F.col(f"`{text_column}`").alias("_text"),
                       F.col(f"`{source_column}`").alias("source"))
    held = held.withColumn("size", n_words(F.col("_text"))).withColumn("_t", F.xxhash64("_text"))
    slim = materialize(held.select("_id", "source", "size", "_t"), "sizes")
    targets = materialize(source_targets(slim, weights, most), "targets")
    taken = _taken(_streams(slim, targets, "_id", "_t"), targets, block_words)
    streams = _streams(held, targets, "_id", "_t").where("size > 0")
    got = (streams.join(taken, ["place", "start"]).where("taken > 0")
           .withColumn("_times", F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int")))
           .withColumn("_pass", F.explode("_times"))
           .withColumn("_words", F.least(F.col("size"), F.col("taken") - (F.col("_pass") - 1) * F.col("size"))))
    head = F.concat_ws(" ", F.slice(F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("_words").cast("int")))
    text = F.when(F.col("_words") == F.col("size"), F.col("_text")).otherwise(head)
    out = got.withColumn("_out", text)
    columns = []
    for c in names:
        if c == text_column:
            columns.append(F.col("_out").alias(c))
        elif c == length_column:
            columns.append(F.when(F.col("_words") == F.col("size"), F.col("_row")[c])
                           .otherwise(F.length("_out")).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col("_row")[c].alias(c))
    return out.select(*columns)
