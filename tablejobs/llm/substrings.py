"""Repeated passages of a fixed number of words, removed wherever they stand.

A window is ``window`` consecutive words of one document. Every word covered
by a window whose word sequence also starts anywhere else goes.

Method: anchors at the places of a difference cover. For a period v and a
cover D every two places i, j have a shift below v that takes both into D, so
two equal windows share an anchor of ``window - v + 1`` words that starts at a
cover place in both. Only a fraction of all places is hashed (5 of 21 for 35
words). Anchors that occur twice are extended to the whole windows around
them, and those are compared in full (by 96 bits of hash).

At scale: anchors are counted with partial sums before the shuffle, and joined
back by a join whose large partitions Spark may split, so a passage in a third
of all documents is no hot group. No pairs are formed. The text is shuffled
once, by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablejobs.session import materialize

from .words import mix, runs, signed, slices

# Perfect difference sets by period.
COVERS = {1: (0,), 3: (0, 1), 7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14)}

LEAST_ANCHOR = 12  # words


def cover(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of a useful length."""
    period = max((p for p in COVERS if window - p + 1 >= min(window, LEAST_ANCHOR)), default=1)
    return period, COVERS[period]


def _key(id_column: str, text_column: str) -> list[Column]:
    """A document's key: its id (null: 0) and 31 bits of its text's hash, with
    the id's being null as lowest bit, so rows that repeat an id with another
    text stay apart. Rows equal in both are the same text anyway."""
    missing = F.col(id_column).isNull()
    return [F.coalesce(F.col(id_column).cast("long"), F.lit(0)).alias("id"),
            F.hash(text_column).bitwiseAND(-2).bitwiseOR(missing.cast("int")).alias("k"),
            F.col(text_column).alias("text")]


def _rows(columns: list, words, counts: np.ndarray) -> list:
    return [np.repeat(c[words.lo:words.hi], counts) for c in columns]


def _columns(batch: pa.RecordBatch) -> list:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in ("id", "k")]


def remove_repeats(docs: DataFrame, window: int = 35, id_column: str = "doc_id",
                   text_column: str = "text") -> DataFrame:
    """For each row of ``docs``: its id, ``n_words``, ``n_removed``, the
    ``kept_text`` (kept words joined by one space) and its ``kept_sha256``.

    Null texts are empty: no words, the hash of no bytes. A text shorter than
    the window keeps all its words. Rows that repeat a text of a window or more
    lose all its words, each of them. An empty table gives an empty result;
    further columns are left out, whatever their names.
    """
    texts = docs.select(*_key(id_column, text_column))
    period, chosen = cover(window)
    anchor = window - period + 1
    at_cover = np.isin(np.arange(period), chosen)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _columns(batch)
            for words in slices(batch.column("text")):
                found = runs(words.hashes(), anchor)
                place = words.place()
                # A text that has no whole window has no anchor to look for.
                use = (at_cover[place % period] & (words.left() >= anchor)
                       & np.repeat(words.counts >= window, words.counts))[:len(found)]
                where = np.flatnonzero(use)
                text = np.searchsorted(words.first, where, "right") - 1 + words.lo
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(found[where])), pa.array(keys[0][text]), pa.array(keys[1][text]),
                     pa.array(place[where].astype(np.int32))], ["anchor", "id", "k", "place"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hits = _columns(batch), batch.column("places")
            copied = batch.column("copied").to_numpy(zero_copy_only=False)
            for words in slices(batch.column("text")):
                hashes = words.hashes()
                found = runs(hashes, window)
                second = runs(mix(hashes + np.uint64(1)), window)
                marks = np.zeros(len(hashes) + 1, dtype=np.int64)
                for i in range(words.lo, words.hi):
                    marks[words.first[i - words.lo] + hits[i].values.to_numpy() + 1] = 1
                marks = np.cumsum(marks)
                n = len(found)
                use = (marks[period:period + n] > marks[:n]) & (words.left()[:n] >= window)
                where = np.flatnonzero(use)
                place = words.place()[where].astype(np.int32)
                text = np.searchsorted(words.first, where, "right") - 1 + words.lo
                place = np.where(copied[text], np.int32(-1), place)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(found[where])), pa.array((second[where] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                     pa.array(keys[0][text]), pa.array(keys[1][text]), pa.array(place)],
                    ["w", "w2", "id", "k", "place"])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ks = (batch.column(n).to_pylist() for n in ("id", "k"))
            texts, starts = batch.column("text"), batch.column("starts")
            out = []
            for i in range(batch.num_rows):
                words = (texts[i].as_py() or "").encode().split()
                n = len(words)
                if starts[i].is_valid:
                    at = starts[i].values.to_numpy()
                    if at.min() < 0:  # a copy
                        words = words if n < window else []
                    else:
                        edge = np.zeros(n + 1, dtype=np.int32)
                        edge[at] += 1
                        edge[at + window] -= 1
                        keep = np.cumsum(edge[:-1]) == 0
                        words = [w for w, k in zip(words, keep.tolist()) if k]
                text = b" ".join(words)
                out.append((None if ks[i] & 1 else ids[i], n, n - len(words), text.decode(),
                            hashlib.sha256(text).hexdigest()))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))],
                ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    # Documents whose whole text stands elsewhere too, and one of each such text.
    text_key = ["k2", "t", "n"]
    keyed = texts.select("id", "k", F.col("k").bitwiseAND(-2).alias("k2"), F.xxhash64("text").alias("t"),
                         F.length("text").alias("n")).where("n > 0")
    groups = keyed.groupBy(*text_key).agg(F.count("*").alias("c"), F.min(F.struct("id", "k")).alias("one")).where("c > 1")
    copies = materialize(
        keyed.join(groups, text_key).select("id", "k", (F.struct("id", "k") == F.col("one")).alias("chosen")).distinct(),
        "copies")

    places = texts.mapInArrow(anchors, "anchor long, id long, k int, place int")
    repeated = places.groupBy("anchor").count().where("count > 1").select("anchor")
    found = (places.join(repeated, "anchor", "left_semi")
             .groupBy("id", "k").agg(F.collect_set("place").alias("places")))
    hits = materialize(found.join(copies, ["id", "k"], "left").where("chosen IS NULL OR chosen")
                       .select("id", "k", "places", F.col("chosen").isNotNull().alias("copied")), "anchors")

    # Rows that repeat both id and text are one key here; they are copies.
    candidates = texts.join(hits, ["id", "k"]).select("id", "k", "text", "places", "copied").mapInArrow(
        windows, "w long, w2 int, id long, k int, place int")
    twice = candidates.groupBy("w", "w2").count().where("count > 1").select("w", "w2")
    starts = (candidates.where("place >= 0").join(twice, ["w", "w2"], "left_semi").select("id", "k", "place")
              .unionByName(copies.select("id", "k", F.lit(-1).alias("place")))
              .groupBy("id", "k").agg(F.collect_set("place").alias("starts")))
    return (texts.join(starts, ["id", "k"], "left").select("id", "k", "text", "starts")
            .mapInArrow(kept, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
            .withColumnRenamed("doc_id", id_column))
