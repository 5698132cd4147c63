"""Nearest neighbours by cosine through balanced posting lists.

Method: centroids of like-sized clusters are fitted on a bounded sample; every
vector is then put on the posting list of its nearest centroid and, if it lies
near a boundary, on those of others about as near (replicas); an in-memory graph
of centroids finds them. A query reads the lists whose distance is within a ratio
of the nearest's, however many these are. The ratio is found at each run: for
``trials`` queries the true neighbours are looked up in all vectors, and the
ratio is the least that reads ``recall`` of them (two standard errors more).
Candidates are scored exactly.

Bounds: ``sample`` vectors, ``most_lists`` centroids and the trials with their
neighbours reach the driver and the tasks; all else stays distributed. Lists of
like centroids share a shelf, so a query goes once to a shelf and not once to
each list. Shelves are cut into parts of ``part_rows`` a list, and the queries of
a shelf into parts too, so no group grows with the data. Copies of one vector are
searched once: each distinct vector carries its lowest ids only, as many as a
result can hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablejobs.session import materialize


@dataclass(frozen=True)
class Settings:
    sample: int = 32_768
    list_rows: int = 200
    most_lists: int = 4096
    #: A vector is on lists up to this ratio of its least distance, and so many.
    replica_ratio: float = 1.1
    replicas: int = 6
    #: A query reads at least this: lists up to this ratio of its least distance,
    #: so many. All others that the run's own ratio asks for come on top.
    read_ratio: float = 1.35
    reads: int = 64
    trials: int = 256
    recall: float = 0.95
    links: int = 16
    beam: int = 80
    part_rows: int = 2048
    shelf: int = 16


def _matrix(column) -> np.ndarray:
    """A list column without nulls as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    # Divided by the largest part first, so that squares neither vanish nor overflow.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; the same for the same two rows anywhere."""
    return (_unit(a) * _unit(b)).sum(axis=1)


def balanced_centroids(x: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """Centroids of unit vectors: k-means whose large clusters are split and
    whose small ones are given up, round by round."""
    rng = np.random.default_rng(7)
    lists = max(1, min(lists, len(x)))
    centres = x[rng.choice(len(x), lists, replace=False)].copy()
    for r in range(rounds):
        near = np.concatenate([np.argmax(part @ centres.T, axis=1) for part in np.array_split(x, max(1, len(x) // 4096))])
        size = np.bincount(near, minlength=lists)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        full = np.flatnonzero(size)
        norm = np.sqrt((sums[full] ** 2).sum(axis=1, keepdims=True))
        centres[full] = np.where(norm > 1e-9, sums[full] / np.maximum(norm, 1e-9), centres[full])
        mean = len(x) / lists
        large = np.argsort(-size)[:np.count_nonzero(size > 2 * mean)]
        small = np.argsort(size)[:len(large)]
        if r < rounds - 2:
            for a, b in zip(large, small):
                if size[b] < mean / 2:
                    centres[b] = x[rng.choice(np.flatnonzero(near == a))]
    return centres


def side_by_side(centres: np.ndarray) -> np.ndarray:
    """The centroids in an order in which like ones are near each other: halved
    along the axis of most spread, again and again."""
    def halves(at: np.ndarray) -> list[np.ndarray]:
        if len(at) <= 2:
            return [at]
        own = centres[at] - centres[at].mean(axis=0)
        at = at[np.argsort(own @ np.linalg.eigh(own.T @ own)[1][:, -1], kind="stable")]
        return halves(at[:len(at) // 2]) + halves(at[len(at) // 2:])
    return centres[np.concatenate(halves(np.arange(len(centres))))]


class CentroidGraph:
    """Centroids linked to their nearest, searched best first from fixed entries."""

    def __init__(self, centres: np.ndarray, links: int, beam: int):
        self.centres, self.beam = centres, min(beam, len(centres))
        like = centres @ centres.T
        np.fill_diagonal(like, -np.inf)
        k = min(links, len(centres) - 1)
        near = np.argsort(-like, axis=1, kind="stable")[:, :k]
        # A ring over all centroids besides, so that every one can be reached.
        ring = (np.arange(len(centres))[:, None] + 1) % len(centres)
        self.links = np.concatenate([near, ring], axis=1)
        self.entries = np.linspace(0, len(centres) - 1, min(len(centres), max(8, beam // 4))).astype(np.int64)

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For unit vectors: the beam's centroids and distances, nearest first."""
        n, beam = len(x), self.beam
        seen = np.zeros((n, len(self.centres)), dtype=bool)
        seen[:, self.entries] = True
        who = np.tile(self.entries, (n, 1))
        like = x @ self.centres[self.entries].T
        pad = beam - who.shape[1]
        if pad > 0:
            who = np.concatenate([who, np.full((n, pad), -1)], axis=1)
            like = np.concatenate([like, np.full((n, pad), -np.inf)], axis=1)
        done = who < 0
        while True:
            order = np.argsort(-like, axis=1, kind="stable")[:, :beam]
            who, like, done = (np.take_along_axis(a, order, axis=1) for a in (who, like, done))
            open_ = ~done
            active = np.flatnonzero(open_.any(axis=1))
            if not len(active):
                return who, np.sqrt(np.maximum(2 - 2 * like, 0))
            at = np.argmax(open_[active], axis=1)
            done[active, at] = True
            new = self.links[who[active, at]]
            fresh = ~seen[active[:, None], new]
            # The ring's link may be one of the others too: the first counts.
            fresh[:, -1] &= (new[:, :-1] != new[:, -1:]).all(axis=1)
            seen[active[:, None], new] = True
            got = np.where(fresh, np.einsum("ij,ikj->ik", x[active], self.centres[new]), -np.inf)
            grow = new.shape[1]
            who = np.concatenate([who, np.full((n, grow), -1)], axis=1)
            like = np.concatenate([like, np.full((n, grow), -np.inf)], axis=1)
            done = np.concatenate([done, np.ones((n, grow), dtype=bool)], axis=1)
            who[active, -grow:], like[active, -grow:] = np.where(fresh, new, -1), got
            done[active, -grow:] = ~fresh


def _near(graph: CentroidGraph, x: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) for each list that unit vectors are filed on."""
    who, far = graph.search(x)
    near = (far <= settings.replica_ratio * far[:, :1] + 1e-12) & (who >= 0)
    near[:, settings.replicas:] = False
    row, at = np.nonzero(near)
    return row, who[row, at]


def _filed(vectors: DataFrame, graph: CentroidGraph, settings: Settings) -> DataFrame:
    """(shelf, list, rep, vector) for each list that a vector is on."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                row, on = _near(graph, _unit(_matrix(part.column(1))), settings)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((on // settings.shelf).astype(np.int32)), pa.array(on.astype(np.int32)),
                     part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row))], ["shelf", "list", "rep", "vector"])

    return vectors.select("rep", "vector").mapInArrow(work, "shelf int, list int, rep long, vector array<double>")


def _distances(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of unit vectors to all centroids, as ratios of the least, and their ranks."""
    far = np.sqrt(np.maximum(2 - 2 * x @ centres.T, 0))
    rank = np.empty(far.shape, dtype=np.int32)
    np.put_along_axis(rank, np.argsort(far, axis=1, kind="stable"), np.arange(far.shape[1], dtype=np.int32)[None, :], axis=1)
    return far / np.maximum(far.min(axis=1, keepdims=True), 1e-12), rank


def _always(ratio: np.ndarray, rank: np.ndarray, settings: Settings) -> np.ndarray:
    return (rank == 0) | ((rank < settings.reads) & (ratio <= settings.read_ratio))


def _read(vectors: DataFrame, graph: CentroidGraph, ratio: float, settings: Settings) -> DataFrame:
    """(shelf, rep, vector, lists) for each shelf of which a query reads lists."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                own, rank = _distances(_unit(_matrix(part.column(1))), graph.centres)
                row, on = np.nonzero((own <= ratio) | _always(own, rank, settings))
                key = row * len(graph.centres) + on // settings.shelf
                cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(on)).astype(np.int32)), pa.array(on.astype(np.int32)))
                take = pa.array(row[cut])
                yield pa.RecordBatch.from_arrays(
                    [pa.array((on[cut] // settings.shelf).astype(np.int32)), part.column(0).take(take), part.column(1).take(take),
                     lists], ["shelf", "rep", "vector", "lists"])

    return vectors.select("rep", "vector").mapInArrow(work, "shelf int, rep long, vector array<double>, lists array<int>")


def ratio_for(needed: np.ndarray, recall: float) -> float:
    """The least ratio that reads ``recall`` of the trial neighbours, and two
    standard errors more; without any, that of the nearest list."""
    if not len(needed):
        return 1.0
    share = recall + 2 * np.sqrt(recall * (1 - recall) / len(needed))
    return float(np.sort(needed)[min(len(needed), int(np.ceil(share * len(needed)))) - 1]) * (1 + 1e-9)


def _read_ratio(distinct: DataFrame, asking: DataFrame, graph: CentroidGraph, k: int, settings: Settings) -> float:
    """The ratio to read by, from true neighbours of some queries."""
    trials = (asking.select("rep", "vector").dropDuplicates(["rep"]).orderBy(F.xxhash64("rep"), "rep")
              .limit(settings.trials).toArrow())
    if not trials.num_rows:
        return 1.0
    q_ids, q = trials.column(0).to_numpy(), _unit(_matrix(trials.column(1)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, who = np.full((len(q), k), -np.inf), np.full((len(q), k), -1, dtype=np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                ids = part.column(0).to_numpy()
                like = q @ _unit(_matrix(part.column(1))).T
                like[q_ids[:, None] == ids[None, :]] = -np.inf
                like = np.concatenate([best, like], axis=1)
                at = np.argpartition(-like, k - 1, axis=1)[:, :k]
                who = np.take_along_axis(np.concatenate([who, np.tile(ids, (len(q), 1))], axis=1), at, axis=1)
                best = np.take_along_axis(like, at, axis=1)
        row, at = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(who[row, at]), pa.array(best[row, at])], ["q", "rep", "like"])

    top = Window.partitionBy("q").orderBy(F.desc("like"), "rep")
    true = (distinct.select("rep", "vector").mapInArrow(compare, "q long, rep long, like double")
            .withColumn("n", F.row_number().over(top)).where(F.col("n") <= k))
    pairs = true.join(distinct.select("rep", "vector"), "rep").select("q", "vector").toArrow()
    if not pairs.num_rows:
        return 1.0
    own, rank = _distances(q, graph.centres)
    own = np.where(_always(own, rank, settings), 1.0, own)
    row, on = _near(graph, _unit(_matrix(pairs.column(1))), settings)
    needed = np.full(pairs.num_rows, np.inf)
    np.minimum.at(needed, row, own[pairs.column(0).to_numpy()[row], on])
    return ratio_for(needed, settings.recall)


def _valid(vector: Column) -> Column:
    """All parts finite, one not zero."""
    plain = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & plain & F.exists(vector, lambda v: v != 0)


def _parts(rows: DataFrame, part_rows: int) -> DataFrame:
    """How many parts each shelf needs."""
    return rows.groupBy("shelf").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, settings: Settings = Settings(),
            id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """For each row for which ``is_query`` holds: its ``k`` nearest other rows
    found (all, if there are fewer), as ``query_id``, ``rank`` from 1, the id and
    the ``score``, the cosine of the original vectors in double precision.

    Ties go to the smaller id. Vectors that are null, zero, hold null or
    non-finite parts, or have a null id take no part; nor do those of another
    length than the commonest (of equally common ones the shortest). Rows that
    repeat an id and vector are one. Equal vectors under other ids are found like
    any others. Without valid rows the result is empty; further columns play no
    part.
    """
    rows = (vectors.where(F.col(id_column).isNotNull())
            .select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"),
                    F.coalesce(is_query, F.lit(False)).alias("asks")).where(_valid(F.col("vector"))))
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("vector") == (sizes["d"] if sizes else 0)).distinct()
    # Distinct vectors, with the lowest ids: a result holds k others and itself.
    by_vector = Window.partitionBy("vector").orderBy("id")
    low = rows.groupBy("vector", "id").agg(F.max("asks").alias("asks"))
    kept = low.withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1)
    distinct = materialize(kept.groupBy("vector").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids")),
                           "vectors")
    asking = low.where("asks").select("vector", F.col("id").alias("query_id"))
    asking = materialize(asking.join(distinct.select("vector", "rep"), "vector").select("query_id", "rep", "vector"), "queries")

    n = distinct.count()
    drawn = distinct.orderBy(F.xxhash64("rep"), "rep").limit(settings.sample).select("vector").toArrow()
    x = _unit(_matrix(drawn.column(0))) if drawn.num_rows else np.ones((1, 1))
    centres = balanced_centroids(x, min(settings.most_lists, max(1, n // settings.list_rows)))
    graph = CentroidGraph(side_by_side(centres), settings.links, settings.beam)
    ratio = _read_ratio(distinct, asking, graph, k, settings)

    filed = materialize(_filed(distinct, graph, settings), "postings")
    read = materialize(_read(asking.select("rep", "vector").dropDuplicates(["rep"]), graph, ratio, settings), "reads")
    parts = (_parts(filed, settings.part_rows * settings.shelf)
             .join(_parts(read, settings.part_rows).withColumnRenamed("parts", "q_parts"), "shelf"))
    spread = lambda n, own: F.pmod(F.xxhash64(own), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = filed.join(parts, "shelf").withColumn("p", spread("parts", "rep")).withColumn("q", every("q_parts"))
    right = read.join(parts, "shelf").withColumn("q", spread("q_parts", "rep")).withColumn("p", every("parts"))
    key = ["shelf", "p", "q"]

    def search(held: pa.Table, asked: pa.Table) -> pa.Table:
        query, rep, score = [], [], []
        if held.num_rows and asked.num_rows:
            held = held.take(pa.array(np.lexsort((held.column("rep").to_numpy(), held.column("list").to_numpy()))))
            on, all_ids, all_v = held.column("list").to_numpy(), held.column("rep").to_numpy(), _matrix(held.column("vector"))
            asks = asked.column("lists").combine_chunks()
            wants = asks.flatten().to_numpy()
            asker = np.repeat(np.arange(asked.num_rows), asks.value_lengths().to_numpy())
            every_q = asked.column("rep").to_numpy(), _matrix(asked.column("vector"))
            for one in np.unique(on):
                cut = slice(*np.searchsorted(on, [one, one + 1]))
                ids, v = all_ids[cut], all_v[cut]
                q_ids, q = (x[asker[wants == one]] for x in every_q)
                unit = _unit(v)
                # A few more than asked for, since the last digits of products differ.
                m = min(k + 4, len(ids))
                for lo in range(0, len(q_ids), 256):
                    like = _unit(q[lo:lo + 256]) @ unit.T
                    like[q_ids[lo:lo + 256, None] == ids[None, :]] = -np.inf
                    at = np.argpartition(-like, m - 1, axis=1)[:, :m]
                    row = np.repeat(np.arange(len(at)), m)
                    at = at.reshape(-1)
                    fine = np.isfinite(like[row, at])
                    row, at = row[fine], at[fine]
                    query.append(q_ids[lo + row])
                    rep.append(ids[at])
                    score.append(cosine(q[lo + row], v[at]))
        cat = lambda parts, t: np.concatenate(parts) if parts else np.zeros(0, t)
        query, rep, score = cat(query, np.int64), cat(rep, np.int64), cat(score, np.float64)
        # Lists of a shelf share vectors; a query takes its best of them only.
        order = np.lexsort((rep, -score, query))
        query, rep, score = query[order], rep[order], score[order]
        new = np.ones(len(query), dtype=bool)
        new[1:] = (query[1:] != query[:-1]) | (rep[1:] != rep[:-1])
        query, rep, score = query[new], rep[new], score[new]
        few = np.arange(len(query)) - np.searchsorted(query, query) <= k
        return pa.table({"q_rep": query[few], "rep": rep[few], "score": score[few]})

    found = (left.select(*key, "list", "rep", "vector").groupBy(*key).cogroup(right.select(*key, "rep", "vector", "lists").groupBy(*key))
             .applyInArrow(search, "q_rep long, rep long, score double").distinct())
    best = Window.partitionBy("q_rep").orderBy(F.desc("score"), "rep")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")

    # Copies of the query's own vector are as near as can be.
    own = asking.groupBy("rep", "vector").count().select(F.col("rep").alias("q_rep"), "rep", "vector")

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cosine(v, v) if len(v) else np.zeros(0))],
                                             ["q_rep", "rep", "score"])

    found = found.unionByName(own.mapInArrow(same, "q_rep long, rep long, score double"))
    ids = found.join(distinct.select("rep", "ids"), "rep").select("q_rep", F.explode("ids").alias(id_column), "score")
    by_rank = Window.partitionBy("query_id").orderBy(F.desc("score"), id_column)
    # Each query vector has few rows by now; its copies each take their own pick.
    top = Window.partitionBy("q_rep").orderBy(F.desc("score"), id_column)
    ids = ids.withColumn("n", F.row_number().over(top)).where(F.col("n") <= k + 1).drop("n")
    return (asking.select("query_id", F.col("rep").alias("q_rep")).join(ids, "q_rep")
            .where(F.col("query_id") != F.col(id_column))
            .withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k)
            .select("query_id", "rank", id_column, "score"))
