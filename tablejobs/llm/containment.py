"""Short items found inside long documents, by word shingles.

An item is found in a document that holds at least ``threshold`` of the item's
distinct five-word shingles, wherever in the document they stand.

Method: MinHash containment search by size. Items fall into classes of size by
powers of two. For a class of items of more than P shingles, documents are cut
into pieces of P shingles, so that a piece and an item are of like size however
long the document is; a piece whose least hash under one of K functions is also
the item's least makes the pair a candidate. K follows from the sizes and the
recall wanted. Candidates are checked by exact containment in the whole
document.

At scale: one pass over the documents with no shuffle. The items' index goes to
the tasks; it is built from at most ``chunk`` items and ``chunk_bytes`` of text.
More items make more chunks, each with its own pass, with the same results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .words import Words, mix, runs, slices

SHINGLE = 5

#: Least piece, in shingles; smaller items are found in pieces of this size too.
LEAST_PIECE = 8


def shingles(words: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of a slice and, for each text, where its own begin."""
    found = runs(words.hashes(), n)
    found = found[words.left()[:len(found)] >= n]
    counts = np.maximum(words.counts - n + 1, 0)
    return found, np.concatenate([[0], np.cumsum(counts)])


def functions_needed(size: int, piece: int, threshold: float, miss: float) -> int:
    """How many hash functions let at most ``miss`` of the true pairs go. One
    function finds a pair if the least hash of item and piece together is one
    of the shared shingles."""
    hit = threshold * size / (size + piece)
    return max(1, math.ceil(math.log(miss) / math.log1p(-hit)))


def _seeds(k: int) -> tuple[np.uint64, np.uint64]:
    a, b = mix(np.array([2 * k + 1, 2 * k + 2], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return a, b | np.uint64(1)


@dataclass
class SizeClass:
    piece: int
    #: By function: the items' least hashes, in order, and the items they are of.
    least: list[np.ndarray] = field(default_factory=list)
    items: list[np.ndarray] = field(default_factory=list)


class Index:
    """Items by size class; the searched side of the containment search."""

    def __init__(self, ids: list, texts: list, threshold: float = 0.8, miss: float = 1e-5):
        self.ids, self.threshold = ids, threshold
        self.sets: list[np.ndarray] = []
        for words in slices(pa.array(texts, pa.string())):
            found, first = shingles(words)
            self.sets += [np.unique(found[a:b]) for a, b in zip(first[:-1], first[1:])]
        by_piece: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            if len(s):
                piece = max(LEAST_PIECE, 1 << ((len(s) - 1).bit_length() - 1) if len(s) > 1 else 1)
                by_piece.setdefault(piece, []).append(i)
        self.classes = []
        for piece, members in sorted(by_piece.items()):
            c = SizeClass(piece)
            smallest = min(len(self.sets[i]) for i in members)
            for k in range(functions_needed(smallest, piece, threshold, miss)):
                a, b = _seeds(k)
                least = np.array([((self.sets[i] ^ a) * b).min() for i in members], dtype=np.uint64)
                order = np.argsort(least)
                c.least.append(least[order])
                c.items.append(np.array(members)[order])
            self.classes.append(c)

    def candidates(self, found: np.ndarray, first: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) pairs of one slice that share a least hash."""
        if not self.classes or not len(found):
            return set()
        counts = np.diff(first)
        grids, below = [], None
        for c in self.classes:
            pieces = -(-counts // c.piece)
            text = np.repeat(np.arange(len(counts)), pieces)
            nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            if below is None:
                starts = first[text] + nth * c.piece
            else:  # a piece of this size is whole pieces of the size before
                size, piece_first = below
                starts = piece_first[text] + nth * (c.piece // size)
            grids.append((c, text, starts))
            below = (c.piece, np.concatenate([[0], np.cumsum(pieces)]))
        pairs: set[tuple[int, int]] = set()
        for k in range(max(len(c.least) for c in self.classes)):
            a, b = _seeds(k)
            least = (found ^ a) * b
            for c, text, starts in grids:
                least = np.minimum.reduceat(least, starts)
                if k >= len(c.least):
                    continue
                at = np.searchsorted(c.least[k], least)
                at[at == len(c.least[k])] = 0
                for p in np.flatnonzero(c.least[k][at] == least):
                    j = at[p]
                    while j < len(c.least[k]) and c.least[k][j] == least[p]:
                        pairs.add((int(text[p]), int(c.items[k][j])))
                        j += 1
        return pairs

    def found_in(self, words: Words) -> list[tuple[int, int, int, int]]:
        """(text of the slice, item, item's shingles, shared) by exact containment."""
        found, first = shingles(words)
        by_text: dict[int, list[int]] = {}
        for text, item in self.candidates(found, first):
            by_text.setdefault(text, []).append(item)
        out = []
        for text, items in by_text.items():
            own = np.unique(found[first[text]:first[text + 1]])
            for i in sorted(items):
                s = self.sets[i]
                shared = int(np.count_nonzero(own[np.minimum(np.searchsorted(own, s), len(own) - 1)] == s))
                if shared >= self.threshold * len(s) - 1e-9:
                    out.append((text, i, len(s), shared))
        return out


def _indexes(items: DataFrame, id_column: str, text_column: str, threshold: float, miss: float,
             chunk: int, chunk_bytes: int) -> Iterator[Index]:
    """Indexes of bounded size that together hold all items."""
    rows = items.select(F.col(id_column).alias("item_id"), F.col(text_column).alias("text")).where("text is not null")
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-n // chunk), -(-size // chunk_bytes))
    for p in range(parts):
        part = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p)
        got = part.collect()
        yield Index([r[0] for r in got], [r[1] for r in got], threshold, miss)


def find_contained(docs: DataFrame, items: DataFrame, threshold: float = 0.8, miss: float = 1e-5,
                   id_column: str = "doc_id", item_column: str = "item_id", text_column: str = "text",
                   chunk: int = 20_000, chunk_bytes: int = 32 << 20) -> DataFrame:
    """One row for each document row and item found in it: both ids, the item's
    ``n_shingles``, the ``n_shared`` and the ``containment``.

    Null texts and texts of fewer than five words have no shingle: such items
    are in no document, such documents hold no item. Repeated document rows give
    repeated results; items of one text are all found. A null id stays null. An
    empty side gives an empty result. Further columns play no part.
    """
    id_type, item_type = docs.schema[id_column].dataType, items.schema[item_column].dataType
    schema = T.StructType([T.StructField(id_column, id_type), T.StructField("n_shingles", T.LongType()),
                           T.StructField("n_shared", T.LongType()), T.StructField("item", T.IntegerType())])
    texts = docs.select(F.col(id_column), F.col(text_column).alias("_text"))
    out = None
    for index in _indexes(items, item_column, text_column, threshold, miss, chunk, chunk_bytes):
        def search(batches, index=index):
            for batch in batches:
                ids = batch.column(0)
                for words in slices(batch.column(1)):
                    hits = index.found_in(words)
                    if hits:
                        text, item, size, shared = (list(c) for c in zip(*hits))
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array([words.lo + t for t in text])), pa.array(size, pa.int64()),
                             pa.array(shared, pa.int64()), pa.array(item, pa.int32())], schema.names)

        names = docs.sparkSession.createDataFrame(
            list(enumerate(index.ids)), T.StructType([T.StructField("item", T.IntegerType()),
                                                      T.StructField(item_column, item_type)]))
        part = texts.mapInArrow(search, schema).join(names, "item").select(
            id_column, item_column, "n_shingles", "n_shared",
            (F.col("n_shared") / F.col("n_shingles")).alias("containment"))
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, miss: float = 1e-5,
                      item_column: str = "item_id", text_column: str = "text",
                      chunk: int = 20_000, chunk_bytes: int = 32 << 20) -> DataFrame:
    """``docs`` without the documents in which an item is found; all columns and
    all other rows stay, null and short texts too."""
    for index in _indexes(items, item_column, text_column, threshold, miss, chunk, chunk_bytes):
        def search(batches, index=index, at=docs.columns.index(text_column)):
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for words in slices(batch.column(at)):
                    for text, *_ in index.found_in(words):
                        clean[words.lo + text] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(search, docs.schema)
    return docs
