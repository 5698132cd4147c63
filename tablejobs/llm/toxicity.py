"""Toxicity by the nearest labelled examples, with the votes as evidence.

A text is a TF-IDF vector over a bounded vocabulary: hashed words and word
beginnings that tell the classes of the labelled sample apart, and the most
frequent words. Its ``k`` nearest examples by exact cosine vote, nearer ones
more; votes on the examples themselves, each left out in turn, calibrate the
score.

Method: the examples are an inverted index cut into blocks of examples, with
the largest weight of each term in each block. The products of a text's weights
with those give a bound for every block; blocks are evaluated in the order of
their bounds until no block left can change the k nearest, so the result is
exact.

Bounds: at most ``examples`` labelled rows of each class (the lowest by a hash of
the id) and ``terms`` terms of each kind; so index and vocabulary do not grow
with the corpus. Document frequencies are counted over all documents. Scoring is
one map-only pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablejobs.session import materialize

from .words import mix, signed, slices

BEGINNING = 4  # bytes
_OTHER = np.uint64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class Settings:
    examples: int = 4096
    terms: int = 1024
    common: int = 64
    #: Standard errors by which a term must tell the classes apart.
    tells: float = 5.0
    k: int = 9
    block: int = 64


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, text of the slice, feature hash) for each word and beginning."""
    for words in slices(texts, folded=True):
        whole, begin = words.hashes(), mix(words.hashes(BEGINNING) ^ _OTHER)
        text = np.repeat(np.arange(words.hi - words.lo), words.counts)
        yield words.lo, words.hi, np.concatenate([text, text]), np.concatenate([whole, begin])


class Vocabulary:
    """Feature hashes in order, each with its weight by rarity."""

    def __init__(self, hashes: np.ndarray, idf: np.ndarray | None = None):
        self.hashes = np.sort(hashes)
        self.idf = idf
        self.sieve = np.zeros(1 << 20, dtype=bool)
        self.sieve[self.hashes >> np.uint64(44)] = True

    def find(self, text: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, times) of the features that are terms, in that order."""
        maybe = self.sieve[feature >> np.uint64(44)]
        text, feature = text[maybe], feature[maybe]
        at = np.searchsorted(self.hashes, feature)
        at[at == len(self.hashes)] = 0
        ok = self.hashes[at] == feature if len(self.hashes) else np.zeros(0, dtype=bool)
        pairs, times = np.unique(text[ok].astype(np.int64) * max(len(self.hashes), 1) + at[ok], return_counts=True)
        return pairs // max(len(self.hashes), 1), pairs % max(len(self.hashes), 1), times

    def vectors(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(lo, hi, text, term, weight) with unit length for each text."""
        for lo, hi, text, feature in features(texts):
            text, term, times = self.find(text, feature)
            weight = (1 + np.log(times)) * self.idf[term]
            length = np.sqrt(np.bincount(text, weight * weight, hi - lo))
            keep = weight > 0
            yield lo, hi, text[keep], term[keep], weight[keep] / length[text[keep]]


class BlockIndex:
    """Postings of examples by term and block, with each block's largest weight.
    Terms of an eighth of all examples or more are kept as full rows by block."""

    def __init__(self, n_terms: int, example: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, block: int):
        self.n, self.block = n, block
        self.blocks = max(1, -(-n // block))
        often = np.bincount(term, minlength=n_terms) >= max(1, n / 8)
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        self.full = np.zeros((self.blocks, int(often.sum()), block))
        at = often[term]
        self.full[example[at] // block, self.row[term[at]], example[at] % block] = weight[at]
        order = np.lexsort((example, term))
        self.example, self.weight = example[order].astype(np.int32), weight[order]
        key = term[order] * self.blocks + self.example // block
        self.cut = np.searchsorted(key, np.arange(n_terms * self.blocks + 1)).astype(np.int32)
        self.largest = np.zeros((n_terms, self.blocks), dtype=np.float32)
        # Rounded up, so that a bound is never below what it bounds.
        np.maximum.at(self.largest.reshape(-1), key, np.nextafter(self.weight.astype(np.float32), np.float32(2)))

    def nearest(self, text: np.ndarray, term: np.ndarray, weight: np.ndarray, n_texts: int, k: int,
                skip: np.ndarray | None = None, step: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest cosine for each text, nearest first,
        ties to the lower example; (-1, 0) where there are fewer with a term in
        common. ``skip[i]`` is an example that text i leaves out."""
        first = np.searchsorted(text, np.arange(n_texts + 1))
        bound = np.zeros((n_texts, self.blocks))
        some = np.flatnonzero(np.diff(first))
        if len(some):
            bound[some] = np.add.reduceat(weight[:, None].astype(np.float32) * self.largest[term], first[some], axis=0)
        bound *= 1 + 1e-5
        often = self.row[term] >= 0
        full = np.zeros((n_texts, self.full.shape[1]))
        full[text[often], self.row[term[often]]] = weight[often]
        text, term, weight = text[~often], term[~often], weight[~often]
        first = np.searchsorted(text, np.arange(n_texts + 1))
        order = np.argsort(-bound, axis=1, kind="stable")
        best = np.zeros((n_texts, k))
        who = np.full((n_texts, k), -1, dtype=np.int64)
        active = some
        for at in range(0, self.blocks, step):
            take = order[active, at:at + step]
            open_ = np.take_along_axis(bound[active], take, axis=1) >= np.maximum(best[active, -1:], 1e-12)
            active, take, open_ = active[open_[:, 0]], take[open_[:, 0]], open_[open_[:, 0]]
            if not len(active):
                break
            width = take.shape[1]
            scores = np.where(open_[:, :, None], self._scores(active, take, full, first, term, weight), 0.0)
            new = (take[:, :, None] * self.block + np.arange(self.block)).reshape(len(active), -1)
            scores = scores.reshape(len(active), width * self.block)
            if skip is not None:
                scores[new == skip[active][:, None]] = 0
            scores = np.concatenate([best[active], scores], axis=1)
            new = np.concatenate([who[active], np.where(scores[:, k:] > 0, new, -1)], axis=1)
            # Sums in another order differ in the last digits; those are ties.
            chosen = np.lexsort((new, -np.round(scores, 9)), axis=1)[:, :k]
            best[active] = np.take_along_axis(scores, chosen, axis=1)
            who[active] = np.take_along_axis(new, chosen, axis=1)
        return who, np.where(who >= 0, best, 0.0)

    def _scores(self, texts, take, full, first, term, weight) -> np.ndarray:
        """Exact cosines of texts with all examples of their chosen blocks."""
        out = np.matmul(full[texts][:, None, None, :], self.full[take])[:, :, 0, :]
        counts = np.diff(first)[texts]
        own = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first[texts], counts)
        width = take.shape[1]
        which = np.repeat(np.arange(len(texts)), counts)
        key = (term[own][:, None] * self.blocks + take[which]).reshape(-1)
        pair = (which[:, None] * width + np.arange(width)).reshape(-1)
        begin, size = self.cut[key], self.cut[key + 1] - self.cut[key]
        has = size > 0
        begin, size, pair = begin[has].astype(np.int64), size[has], pair[has]
        times = np.repeat(weight[own], width)[has]
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - begin, size)
        to = np.repeat(pair * self.block, size) + self.example[at] % self.block
        return out + np.bincount(to, np.repeat(times, size) * self.weight[at],
                                 len(texts) * width * self.block).reshape(len(texts), width, self.block)


def votes(similarity: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The share of label 1, each neighbour weighing more the nearer it is;
    without neighbours 0."""
    weight = np.where(similarity > 0, 1 / (1.05 - np.minimum(similarity, 1.0)), 0.0)
    total = weight.sum(axis=1)
    return np.where(total > 0, (weight * label).sum(axis=1) / np.maximum(total, 1e-12), 0.0)


def calibration(raw: np.ndarray, label: np.ndarray, weight: np.ndarray, bins: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """A rising map from votes to shares of label 1: bins of like votes, pooled
    until their shares rise."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []
    for part in np.array_split(order, min(bins, max(1, len(order)))):
        w = float(weight[part].sum())
        pools.append([float((raw[part] * weight[part]).sum()), float((label[part] * weight[part]).sum()), w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    x, y = (np.array([p[i] / p[2] for p in pools]) for i in (0, 1))
    return np.concatenate([[0.0], x, [1.0]]), np.concatenate([[y[0]], y, [y[-1]]])


class Model:
    """Vocabulary, index, the examples' ids and labels, and the calibration."""

    def __init__(self, vocabulary: Vocabulary, ids: list, label: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]],
                 class_weight: tuple[float, float], settings: Settings):
        self.vocabulary, self.settings = vocabulary, settings
        vectors = []
        for term, times in rows:
            w = (1 + np.log(times)) * vocabulary.idf[term]
            vectors.append((term[w > 0], w[w > 0] / max(np.sqrt((w * w).sum()), 1e-12)))
        # Like examples side by side give tight blocks: by label, then main term.
        main = [int(t[np.argmax(w)]) if len(t) else -1 for t, w in vectors]
        order = np.lexsort((np.arange(len(label)), main, label))
        self.ids, self.label = [ids[i] for i in order], label[order]
        vectors = [vectors[i] for i in order]
        sizes = [len(t) for t, _ in vectors]
        example = np.repeat(np.arange(len(vectors)), sizes)
        term = np.concatenate([t for t, _ in vectors] or [np.zeros(0, np.int64)]).astype(np.int64)
        weight = np.concatenate([w for _, w in vectors] or [np.zeros(0)])
        self.index = BlockIndex(len(vocabulary.hashes), example, term, weight, len(vectors), settings.block)
        raw = []
        first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        for lo in range(0, len(vectors), 128):
            hi = min(lo + 128, len(vectors))
            s = slice(first[lo], first[hi])
            who, near = self.index.nearest(example[s] - lo, term[s], weight[s], hi - lo, settings.k, np.arange(lo, hi))
            raw.append(votes(near, np.where(who >= 0, self.label[who], 0)))
        if vectors:
            self.map = calibration(np.concatenate(raw), self.label, np.array(class_weight)[self.label])
        else:
            self.map = (np.array([0.0, 1.0]), np.array([0.0, 0.0]))

    def score(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Scores, neighbours and similarities, for some texts at a time."""
        for lo, hi, text, term, weight in self.vocabulary.vectors(texts):
            who, near = self.index.nearest(text, term, weight, hi - lo, self.settings.k)
            yield np.interp(votes(near, np.where(who >= 0, self.label[who] if len(self.label) else 0, 0)), *self.map), who, near


def _sample(docs: DataFrame, labels: DataFrame, settings: Settings, id_column: str, text_column: str):
    """(id, label, text) of at most ``examples`` rows of each class, and the
    classes' sizes. Ids labelled both ways, or neither, are left out; rows that
    repeat id and text are one."""
    told = (labels.select(F.col(id_column).alias("id"), F.col("label").cast("int").alias("label"))
            .where("label IN (0, 1) AND id IS NOT NULL").groupBy("id")
            .agg(F.min("label").alias("label"), F.max("label").alias("_most")).where("label = _most").drop("_most"))
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where("text IS NOT NULL")
    keys = (texts.select("id", F.xxhash64("text").alias("h")).join(told, "id").groupBy("id", "h", "label").count())
    keys = materialize(keys.select("id", "h", "label"), "labelled")
    sizes = {r["label"]: r["count"] for r in keys.groupBy("label").count().collect()}
    chosen = None
    for label in (0, 1):
        part = keys.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id", "h").limit(settings.examples)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 x examples rows of two numbers: its size is bounded.
    picked = (texts.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["id", "h"])
              .dropDuplicates(["id", "h"]).select("id", "label", "text"))
    return materialize(picked, "examples"), sizes


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id",
          text_column: str = "text") -> Model:
    """Learn from the rows of ``labels`` (id column and ``label``)."""
    sample, sizes = _sample(docs, labels, settings, id_column, text_column)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, text, feature in features(batch.column(1)):
                each = np.unique(np.stack([text.astype(np.uint64), feature]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(signed(each[1].copy())),
                                                  pa.array(label[lo:hi][each[0].astype(np.int64)].astype(np.int64))],
                                                 ["feature", "label"])

    # Signed root of the likelihood ratio of term against class, over the sample.
    n = sample.groupBy().agg(F.coalesce(F.sum("label"), F.lit(0)).alias("one"), F.count("*").alias("all")).first()
    ones, zeros = n["one"], n["all"] - n["one"]
    counts = (sample.select("label", "text").mapInArrow(told, "feature long, label long").groupBy("feature")
              .agg(F.sum("label").alias("a"), (F.count("*") - F.sum("label")).alias("b")).where("a + b >= 3"))
    a, b = F.col("a"), F.col("b")
    share = (a + b) / F.lit(max(1, ones + zeros))
    cells = [(a, share * ones), (b, share * zeros), (ones - a, (1 - share) * ones), (zeros - b, (1 - share) * zeros)]
    ratio = sum((F.when((o > 0) & (e > 0), o * F.log(o / e)).otherwise(0.0) for o, e in cells), F.lit(0.0))
    counts = materialize(counts.withColumn("z", F.signum(a - share * ones) * F.sqrt(F.greatest(2 * ratio, F.lit(0.0)))), "terms")
    told_apart = [counts.where(F.col("z") * s > settings.tells).orderBy(F.col("z") * -s, "feature").limit(settings.terms)
                  for s in (1, -1)]
    common = counts.orderBy((F.col("a") + F.col("b")).desc(), "feature").limit(settings.common)
    hashes = {r[0] for part in (*told_apart, common) for r in part.select("feature").collect()}
    vocabulary = Vocabulary(np.array(sorted(hashes), dtype=np.int64).view(np.uint64))

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted, texts = np.zeros(len(vocabulary.hashes), dtype=np.int64), 0
        for batch in batches:
            texts += batch.num_rows
            for _, _, text, feature in features(batch.column(0)):
                counted += np.bincount(vocabulary.find(text, feature)[1], minlength=len(counted))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(counted))), pa.array(np.concatenate([[texts], counted]))],
                                         ["term", "n"])

    df = np.zeros(len(vocabulary.hashes) + 1)
    for r in (docs.select(F.col(text_column).alias("text")).mapInArrow(frequency, "term long, n long")
              .groupBy("term").agg(F.sum("n").alias("n")).collect()):
        df[r["term"] + 1] = r["n"]
    vocabulary.idf = np.log((1 + df[0]) / (1 + df[1:]))

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, text, feature in features(batch.column(2)):
                text, term, n = vocabulary.find(text, feature)
                cut = np.searchsorted(text, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo),
                     pa.array([term[i:j].tolist() for i, j in zip(cut[:-1], cut[1:])], pa.list_(pa.int64())),
                     pa.array([n[i:j].tolist() for i, j in zip(cut[:-1], cut[1:])], pa.list_(pa.int64()))],
                    ["id", "label", "terms", "times"])

    id_type = docs.schema[id_column].dataType.simpleString()
    rows = sorted(sample.select("id", "label", "text").mapInArrow(
        times, f"id {id_type}, label int, terms array<long>, times array<long>").collect(), key=lambda r: (r["id"], r["terms"]))
    label = np.array([r["label"] for r in rows], dtype=np.int64)
    weight = tuple(sizes.get(c, 0) / max(1, int((label == c).sum())) for c in (0, 1))
    return Model(vocabulary, [r["id"] for r in rows], label,
                 [(np.array(r["terms"], dtype=np.int64), np.array(r["times"], dtype=np.int64)) for r in rows], weight, settings)


def _scored(docs: DataFrame, model: Model, text_column: str, select, schema):
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_column)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = list(held.value.score(batch.column(at)))
            score, who, near = (np.concatenate(p) for p in zip(*parts)) if parts else (
                np.zeros(0), np.zeros((0, 1), np.int64), np.zeros((0, 1)))
            yield select(batch, held.value, score, who, near)

    return docs.mapInArrow(work, schema)


def score_toxicity(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each row of ``docs``: its id, the ``score`` (0 to 1) and the
    ``evidence``: the nearest examples' ids, similarities and labels.

    Null, empty and very short texts that hold no term have no neighbours; they
    score what texts without votes do. Equal texts score alike, whatever their
    other columns. An empty table gives an empty result; without examples every
    score is 0. Further columns play no part."""
    slim = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    id_type = docs.schema[id_column].dataType.simpleString()
    evidence = f"array<struct<id:{id_type},similarity:double,label:int>>"

    def select(batch, model, score, who, near):
        voices = [[{"id": model.ids[w], "similarity": s, "label": int(model.label[w])} for w, s in zip(ws, ss) if w >= 0]
                  for ws, ss in zip(who.tolist(), near.tolist())]
        ids = batch.column(0)
        kind = pa.list_(pa.struct([("id", ids.type), ("similarity", pa.float64()), ("label", pa.int32())]))
        return pa.RecordBatch.from_arrays([ids, pa.array(score), pa.array(voices, kind)], ["id", "score", "evidence"])

    return (_scored(slim, model, "text", select, f"id {id_type}, score double, evidence {evidence}")
            .withColumnRenamed("id", id_column))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7, text_column: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns
    and all other rows stay, null and empty texts too."""
    return _scored(docs, model, text_column,
                   lambda batch, model, score, who, near: batch.filter(pa.array(score < threshold)), docs.schema)
